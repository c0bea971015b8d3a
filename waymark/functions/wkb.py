"""Well-known binary to vertex arrays.

Decoding bytes is the one step Spark's own functions cannot express.  It runs in
``mapInArrow`` on the Arrow buffers of a whole batch: headers and counts of all geometries
are read together, one step deeper at a time, and vertices are gathered in one go.  No
Python object is made per geometry.  Bytes that are no geometry never fail the job: the row
keeps null geometry and a reason.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.functions.geometry import PARTS_TYPE

# The few functions below travel to the workers with the job, so that executors need not
# have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Geometry type codes of the WKB format.
TYPE_NAMES = {
    1: "POINT",
    2: "LINESTRING",
    3: "POLYGON",
    4: "MULTIPOINT",
    5: "MULTILINESTRING",
    6: "MULTIPOLYGON",
}

#: Why bytes were not decoded, by number.
ERRORS = (None, "truncated", "unknown byte order", "unsupported type", "mixed members", "trailing bytes")
_TRUNCATED, _ORDER, _TYPE, _MIXED, _TRAILING = range(1, 6)

#: Bytes of geometry decoded at once, unless one alone is longer.
SLICE_BYTES = 8 << 20


class _Walk:
    """Cursors over the bytes of many geometries, moved together.

    ``rings`` collects, per step, the geometry, the part, the position of the first vertex
    and the number of vertices of every ring (or line, or point) met.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        n = len(starts)
        # reads past the last geometry stay inside the padding
        self.data = np.concatenate([data, np.zeros(8, np.uint8)])
        self.at, self.ends = starts.astype(np.int64), ends.astype(np.int64)
        self.error = np.zeros(n, np.int8)
        self.kind = np.zeros(n, np.int8)
        self.little = np.ones(n, bool)
        self.dims = np.zeros(n, np.int64)
        self.members, self.rings_left = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.part = np.full(n, -1, np.int64)
        self.rings: list[tuple[np.ndarray, ...]] = []

    def _fail(self, who: np.ndarray, bad: np.ndarray, error: int) -> np.ndarray:
        """Mark geometries as undecodable; the others are returned."""
        lost = who[bad]
        self.error[lost] = error
        self.members[lost] = self.rings_left[lost] = 0
        return who[~bad]

    def _has(self, who: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self._fail(who, self.ends[who] - self.at[who] < size, _TRUNCATED)

    def _number(self, who: np.ndarray) -> np.ndarray:
        """The unsigned 32-bit number at each cursor."""
        quads = self.data[self.at[who, None] + np.arange(4)]
        both = quads.view("<u4")[:, 0], quads.view(">u4")[:, 0]
        self.at[who] += 4
        return np.where(self.little[who], *both).astype(np.int64)

    def _header(self, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read byte order and type: the geometries still good, and their base types."""
        who = self._has(who, 5)
        order = self.data[self.at[who]]
        who = self._fail(who, order > 1, _ORDER)
        self.little[who] = self.data[self.at[who]] == 1
        self.at[who] += 1
        code = self._number(who)
        # flag bits for z, m and srid, or thousands for z, m and zm
        dims = 2 + (code >> 31 & 1) + (code >> 30 & 1)
        self.at[who] += 4 * (code >> 29 & 1)
        code &= 0x1FFFFFFF
        thousands = code // 1000
        dims += np.where(thousands == 3, 2, thousands)
        self.dims[who] = dims
        base = np.where(thousands <= 3, code % 1000, 0)
        good = (base >= 1) & (base <= 6)
        return self._fail(who, ~good, _TYPE), base[good]

    def _record(self, who: np.ndarray, count: np.ndarray) -> None:
        self.rings.append((who, self.part[who], self.at[who], count, self.little[who], self.dims[who]))
        self.at[who] += 8 * count * self.dims[who]

    def _part(self, who: np.ndarray, base: np.ndarray) -> None:
        """Begin a point, a line or a polygon whose header has been read."""
        self.part[who] += 1
        points = who[base == 1]
        points = self._has(points, 8 * self.dims[points])
        self._record(points, np.ones(len(points), np.int64))
        self.rings_left[who[base == 2]] = 1
        polygons = self._has(who[base == 3], 4)
        self.rings_left[polygons] = self._number(polygons)

    def run(self, who: np.ndarray) -> None:
        """Walk through the given geometries to their ends."""
        who, base = self._header(who)
        self.kind[who] = base
        self._part(who[base <= 3], base[base <= 3])
        many = self._has(who[base > 3], 4)
        self.members[many] = self._number(many)
        while True:
            ringed = np.flatnonzero(self.rings_left)
            open_ = np.flatnonzero((self.members > 0) & (self.rings_left == 0))
            if not len(ringed) and not len(open_):
                break
            ringed = self._has(ringed, 4)
            count = self._number(ringed)
            fits = count <= (self.ends[ringed] - self.at[ringed]) // (8 * self.dims[ringed])
            ringed, count = self._fail(ringed, ~fits, _TRUNCATED), count[fits]
            self._record(ringed, count)
            self.rings_left[ringed] -= 1
            self.members[open_] -= 1
            open_, base = self._header(open_)
            same = base == self.kind[open_] - 3
            self._part(self._fail(open_, ~same, _MIXED), base[same])
        good = who[self.error[who] == 0]
        self._fail(good, self.at[good] != self.ends[good], _TRAILING)

    def vertices(self, start: np.ndarray, little: np.ndarray) -> np.ndarray:
        """Doubles at any byte position."""
        views = (np.ndarray((len(self.data) - 7,), kind, self.data, 0, (1,)) for kind in ("<f8", ">f8"))
        low, high = views
        if little.all():
            return low[start]
        return np.where(little, low[start], high[start].astype("<f8"))


def _offsets(groups: np.ndarray, n: int) -> np.ndarray:
    """Where each of ``n`` groups starts among sorted group numbers."""
    return np.searchsorted(groups, np.arange(n + 1)).astype(np.int32)


def _decode_column(column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Type name, parts and error of every geometry."""
    column = column.cast(pa.large_binary())
    n = len(column)
    edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    given = column.is_valid().to_numpy(zero_copy_only=False)
    walk = _Walk(data, edges[:-1], edges[1:])
    walk.run(np.flatnonzero(given))
    none = np.zeros(0, np.int64)
    found = [np.concatenate([none, *columns]) for columns in zip(*walk.rings)] or [none] * 6
    owner, part, start, count, little, dims = found
    keep = walk.error[owner] == 0
    # empty points are written as not-a-number; an empty line has no vertices
    x = walk.vertices(start, little.astype(bool))
    y = walk.vertices(start + 8, little.astype(bool))
    points = np.isin(walk.kind[owner], (1, 4))
    keep &= ~(points & (np.isnan(x) | np.isnan(y)))
    keep &= ~(np.isin(walk.kind[owner], (2, 5)) & (count == 0))
    order = np.flatnonzero(keep)
    order = order[np.argsort(owner[order], kind="stable")]
    owner, part, start, count, little, dims = (c[order] for c in found)
    ends = np.cumsum(count)
    # the byte position of every vertex
    at = np.repeat(start - 8 * dims * (ends - count), count)
    at += np.repeat(8 * dims, count) * np.arange(len(at))
    order = np.repeat(little.astype(bool), count)
    points = pa.StructArray.from_arrays(
        [pa.array(walk.vertices(at + shift, order)) for shift in (0, 8)], ["x", "y"]
    )
    rings = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), points)
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
    polygons = pa.ListArray.from_arrays(
        pa.array(np.append(np.flatnonzero(new), len(owner)), pa.int32()), rings
    )
    good = given & (walk.error == 0)
    starts = pa.array(_offsets(owner[new], n), pa.int32(), mask=np.append(~good, False))
    names = pa.array([TYPE_NAMES.get(i) for i in range(7)], pa.string())
    reasons = pa.array(ERRORS, pa.string())
    return (
        names.take(pa.array(np.where(good, walk.kind, 0))),
        pa.ListArray.from_arrays(starts, polygons),
        reasons.take(pa.array(walk.error)),
    )


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with a bounded number of geometry bytes."""
    sizes = batch.column(column).cast(pa.large_binary())
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def decode(df: DataFrame, column: str = "geometry", error: str | None = None) -> DataFrame:
    """Replace a WKB column by ``geom_type`` and ``parts``.

    Where the bytes are no geometry, both are null; a column named ``error``, if asked for,
    gives the reason, one of ``ERRORS``."""
    kept = [f for f in df.schema.fields if f.name != column]
    made = [
        T.StructField("geom_type", T.StringType()),
        T.StructField("parts", T.DataType.fromDDL(PARTS_TYPE)),
    ]
    if error is not None:
        made.append(T.StructField(error, T.StringType()))
    names = [f.name for f in kept]
    out = [*names, *(f.name for f in made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _slices(batch, column):
                decoded = _decode_column(some.column(column))[: len(made)]
                arrays = [some.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*arrays, *decoded], out)

    return df.mapInArrow(run, T.StructType(kept + made))
