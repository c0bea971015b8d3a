"""Removal of lines that many documents share.

Lines are known by a 128-bit hash of their key. Counts per line are summed before and after
the shuffle; lines found often enough go into a sharded index: a minimal perfect hash over
one half of the hash leads to compact arrays of fingerprints (the other half), document
counts and the document that keeps the line. Documents probe the arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import Block, blocks, gather, is_space, mix, one_array, totals, u64
from waymark.llm.tables import (
    BROADCAST_BYTES, picked, probed, schema, shard_column, shards_for, stored,
)

MIN_CHARS = 20
MIN_DOCS = 3
_LEVELS = 40
#: Bytes of text scanned at once: arrays that fit into the processor's cache.
_SCAN_BYTES = 1 << 18
_MISSING = np.int64(-(2**63))


def keyed_lines(block: Block, min_chars: int) -> tuple[np.ndarray, ...]:
    """Starts, ends and rows of all lines; which have a long key; the keys' two hashes."""
    starts, ends, rows = block.lines()
    solid = np.flatnonzero(~is_space(block.data))
    first = np.searchsorted(solid, starts)
    last = np.searchsorted(solid, ends)
    some = np.flatnonzero(last > first)
    low, high = solid[first[some]], solid[last[some] - 1] + 1
    letters = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    fits = letters[high] - letters[low] >= min_chars
    some, low, high = some[fits], low[fits], high[fits]
    plain = block.lowered()
    hashes = np.stack([plain.hashes(low, high, seed) for seed in (1, 2)], axis=1)
    return starts, ends, rows, some, hashes


def _count(min_chars: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            ids = one_array(batch["_id"])
            for block in blocks(batch["_text"], _SCAN_BYTES):
                _, _, rows, some, hashes = keyed_lines(block, min_chars)
                salted = mix(hashes[:, 1] ^ mix(rows[some].astype(np.uint64) + u64(1)))
                _, once = np.unique(salted, return_index=True)
                parts.append((hashes[once], block.first + rows[some][once]))
            if not parts:
                continue
            hashes, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            known = ids.fill_null(int(_MISSING) + 1).to_numpy(zero_copy_only=False)[at]
            order = np.lexsort((known, hashes[:, 1], hashes[:, 0]))
            hashes, known = hashes[order], known[order]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[1:] != hashes[:-1]).any(axis=1)
            edges = np.flatnonzero(new)
            last = np.append(edges[1:], len(order)) - 1 if len(edges) else edges
            yield pa.record_batch(
                {
                    "key": pa.array(hashes[edges, 0].view(np.int64)),
                    "mark": pa.array(hashes[edges, 1].view(np.int64)),
                    "n": pa.array(np.diff(np.append(edges, len(order))), pa.int64()),
                    "owner": pa.array(known[last], pa.int64()),
                }
            )

    return count


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + u64(0x9E3779B97F4A7C15 * (level + 1))) % u64(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct keys: sizes of its levels, and their bits.

    A key takes a bit at the first level where no other key left over wants the same bit; its
    number is the count of bits before. Keys never placed would be an error of the hash.
    """
    sizes, levels, left = [], [], keys
    for level in range(_LEVELS):
        if not len(left):
            break
        size = max(64, 2 * len(left))
        at = _slot(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        left = left[~alone[at]]
    if len(left):
        raise ValueError("line hashes are not distinct")
    return np.array(sizes, np.int64), np.concatenate(levels or [np.zeros(0, bool)])


def number(keys: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Numbers from the minimal perfect hash; -1 where no level has a bit."""
    ranks = np.cumsum(bits) - 1
    out, base = np.full(len(keys), -1, np.int64), 0
    left = np.arange(len(keys))
    for level, size in enumerate(sizes):
        at = base + _slot(keys[left], level, int(size))
        hit = bits[at]
        out[left[hit]] = ranks[at[hit]]
        left, base = left[~hit], base + int(size)
    return out


def _pack(group: pa.Table) -> pa.Table:
    keys, marks, n, owner = (one_array(group[c]).to_numpy() for c in ("key", "mark", "n", "owner"))
    sizes, bits = build_hash(keys.view(np.uint64))
    order = np.argsort(number(keys.view(np.uint64), sizes, bits))
    blobs = {"sizes": sizes, "bits": np.packbits(bits), "marks": marks[order], "counts": n[order], "owners": owner[order]}
    columns = {name: pa.array([blob.tobytes()], pa.binary()) for name, blob in blobs.items()}
    return pa.table({"shard": group["shard"][:1]} | columns)


def probe(shard: dict, keys: np.ndarray) -> np.ndarray:
    """The document that keeps each line, or a number under all ids if the line stays."""
    sizes = np.frombuffer(shard["sizes"], np.int64)
    bits = np.unpackbits(np.frombuffer(shard["bits"], np.uint8))[: sizes.sum()].astype(bool)
    marks, owners = (np.frombuffer(shard[c], np.int64) for c in ("marks", "owners"))
    at = number(keys[:, 0], sizes, bits)
    found = (at >= 0) & (marks[at] == keys[:, 1].view(np.int64))
    return np.where(found, owners[at], _MISSING)


def line_index(docs: DataFrame, min_chars: int, min_docs: int) -> tuple[DataFrame, int]:
    """Index of the lines that reach ``min_docs`` documents, and its number of shards."""
    made = "key long, mark long, n long, owner long"
    partial = docs.select("_id", "_text").mapInArrow(_count(min_chars), made)
    lines = partial.groupBy("key", "mark").agg(F.sum("n").alias("n"), F.max("owner").alias("owner"))
    lines = stored(lines.filter(F.col("n") >= min_docs))
    shards = shards_for(lines)
    dealt = lines.withColumn("shard", shard_column("key", shards))
    blobs = "sizes binary, bits binary, marks binary, counts binary, owners binary"
    return dealt.groupBy("shard").applyInArrow(_pack, f"shard int, {blobs}"), shards


def _cleaned(min_chars: int):
    def clean(table: pa.Table, find) -> pa.Table:
        ids = one_array(table["_id"]).fill_null(int(_MISSING) + 1).to_numpy()
        n_lines, n_dropped, texts = [], [], []
        for block in blocks(table["_text"], _SCAN_BYTES):
            starts, ends, rows, some, hashes = keyed_lines(block, min_chars)
            owner = find(hashes)
            drop = np.zeros(len(starts), bool)
            drop[some] = (owner != _MISSING) & (owner != ids[block.first + rows[some]])
            stay = np.flatnonzero(~drop)
            count, dropped = totals(rows, len(block)), totals(rows[drop], len(block))
            # a line takes the line feed after it along, but for the last that stays
            lengths = ends[stay] - starts[stay]
            final = np.ones(len(stay), bool)
            final[:-1] = rows[stay][1:] != rows[stay][:-1]
            pieces = gather(np.append(block.data, np.uint8(10)), starts[stay], lengths + ~final)
            breaks = np.cumsum(lengths + ~final)[~final] - 1
            pieces[breaks] = 10
            sizes = np.bincount(rows[stay], lengths + ~final, len(block)).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            texts.append(
                pa.LargeStringArray.from_buffers(len(block), pa.py_buffer(offsets), pa.py_buffer(pieces.tobytes()))
            )
            n_lines.append(count)
            n_dropped.append(dropped)
        text = pa.concat_arrays(texts).cast(pa.string()) if texts else pa.array([], pa.string())
        hashed = [hashlib.sha256(t.as_buffer()).hexdigest() for t in text]
        columns = {
            "doc_id": one_array(table["_id"]),
            "n_lines": pa.array(np.concatenate(n_lines) if n_lines else [], pa.int64()),
            "n_dropped": pa.array(np.concatenate(n_dropped) if n_dropped else [], pa.int64()),
            "kept_sha256": pa.array(hashed, pa.string()),
            "kept_text": text,
        }
        return pa.table(columns | {c: table[c] for c in table.column_names if c == "row"})

    return clean


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    keep_rows: bool = False,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Every document without the lines that ``min_docs`` documents or more share.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys
    shorter than ``min_chars`` characters always stay. The document with the largest id keeps
    all its copies. Result: doc_id, n_lines, n_dropped, kept_sha256, kept_text; with
    ``keep_rows`` also ``row``. Null and empty texts are one empty line. Every row counts as a
    document: of rows with one id, all keep the line; a null id comes below all others.
    """
    docs = picked(docs, id_col, text_col, keep_rows=keep_rows)
    index, shards = line_index(docs, min_chars, min_docs)

    def keys_of(table: pa.Table) -> np.ndarray:
        found = [keyed_lines(block, min_chars)[4] for block in blocks(table["_text"], _SCAN_BYTES)]
        return np.concatenate(found or [np.zeros((0, 2), np.uint64)])

    made = schema(
        "doc_id bigint", "n_lines bigint", "n_dropped bigint", "kept_sha256 string", "kept_text string", rows=docs
    )
    return probed(docs, index, shards, keys_of, probe, _MISSING, _cleaned(min_chars), made, width=2, limit=limit)
