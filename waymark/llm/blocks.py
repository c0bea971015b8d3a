"""Columns of text as byte arrays: words, lines and hashes without a loop over rows.

UTF-8 never uses bytes under 0x80 inside longer characters, so ASCII classes can be tested
on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once, unless one text alone is longer.
BLOCK_BYTES = 2 << 20
#: Values moved at once.
_GATHERED = 1 << 17
_BASE = 0x9E3779B97F4A7C15 | 1


def u64(value: int) -> np.uint64:
    return np.uint64(value & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * u64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES) + 1
        _POWERS.clear()
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            steps = np.full(size, u64(base))
            steps[0] = 1
            _POWERS.append(np.cumprod(steps, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


class Block:
    """Some rows of a text column.

    ``data`` holds their bytes, row ``i`` from ``offsets[i]`` to ``offsets[i + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int = 0) -> None:
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def lowered(self) -> Block:
        """With A-Z in lower case."""
        data = self.data.copy()
        data[(data >= 65) & (data <= 90)] += 32
        return Block(data, self.offsets, self.first)

    def rows_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, positions, "right") - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest runs of bytes that are ``inside``, never across rows: starts, ends, rows."""
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        filled = self.offsets[:-1] < self.offsets[1:]
        for edge, at in ((starts, self.offsets[:-1][filled]), (ends, self.offsets[1:][filled] - 1)):
            edge[at] = inside[at]
        first = np.flatnonzero(starts)
        return first, np.flatnonzero(ends) + 1, self.rows_of(first)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs free of space, tab, line feed, vertical tab, form feed, carriage return."""
        return self.runs(~is_space(self.data))

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces between line feeds; an empty row is one empty line."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]), kind="stable")
        before = np.searchsorted(breaks, self.offsets)
        return starts, ends, np.repeat(np.arange(len(self)), np.diff(before) + 1)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
        """A 64-bit hash of the bytes from each start to its end."""
        up, down = _powers(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_letters(seed)[self.data] * up[: len(self.data)], out=total[1:])
        sums = (total[ends] - total[starts]) * down[starts]
        return mix(sums ^ ((ends - starts).astype(np.uint64) * u64(_BASE)))


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def one_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def whole(column: pa.Array | pa.ChunkedArray) -> Block:
    """All rows of a column in one block; null counts as empty."""
    array = one_array(column).cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    values = array.buffers()[2]
    data = np.frombuffer(values or b"", np.uint8)[offsets[0] : offsets[-1]]
    return Block(data, offsets - offsets[0])


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's rows in order, in blocks of about ``size`` bytes, at least one row each."""
    every = whole(column)
    at = 0
    while at < len(every):
        to = int(np.searchsorted(every.offsets, every.offsets[at] + size, "right")) - 1
        to = max(to, at + 1)
        low, high = every.offsets[at], every.offsets[to]
        yield Block(every.data[low:high], every.offsets[at : to + 1] - low, at)
        at = to


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces of ``values`` from each start, put one after the other."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, values.dtype)
    at = 0
    while at < len(ends):
        # some pieces at once: place numbers need eight bytes each
        base = int(ends[at] - lengths[at])
        to = max(at + 1, int(np.searchsorted(ends, base + _GATHERED, "right")))
        shift = np.repeat(starts[at:to] - (ends[at:to] - lengths[at:to]), lengths[at:to])
        out[base : int(ends[to - 1])] = values[shift + np.arange(base, int(ends[to - 1]))]
        at = to
    return out


def places(distinct: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands among ``distinct``, sorted 64-bit hashes that hold all keys.

    Hashes spread evenly, so a table over their upper bits leads next to the place.
    """
    if not len(keys):
        return np.zeros(0, np.int64)
    bits = len(distinct).bit_length() + 1
    shift = u64(64 - bits)
    table = np.searchsorted(distinct >> shift, np.arange(1 << bits, dtype=np.uint64))
    at = table[(keys >> shift).astype(np.int64)]
    rest = np.flatnonzero(distinct[at] != keys)
    while len(rest):
        at[rest] += 1
        rest = rest[distinct[at[rest]] != keys[rest]]
    return at


def totals(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sum of weights (or count) per row number."""
    out = np.bincount(rows, weights, n)
    return out if weights is not None and weights.dtype.kind == "f" else out.astype(np.int64)


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first)
