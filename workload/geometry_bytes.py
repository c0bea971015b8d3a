"""Vertex arrays to well-known binary, to have raw layers to prepare."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from waymark.functions.wkb import TYPE_NAMES

_CODES = {name: code for code, name in TYPE_NAMES.items()}


def _put(out: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Write one number per position, as bytes."""
    octets = np.ascontiguousarray(values).view(np.uint8).reshape(len(at), values.itemsize)
    out[at[:, None] + np.arange(octets.shape[1])] = octets


def _headers(out: np.ndarray, at: np.ndarray, codes: np.ndarray) -> None:
    out[at] = 1
    _put(out, at + 1, codes.astype("<u4"))


def _within(groups: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Bytes of a group's earlier members before each member."""
    whole = np.bincount(groups, sizes, n).astype(np.int64)
    return np.cumsum(sizes) - sizes - (np.cumsum(whole) - whole)[groups]


def encode_column(kinds: pa.Array, parts: pa.Array) -> pa.Array:
    """WKB of each geometry, little-endian; null for null."""
    n = len(kinds)
    given = kinds.is_valid().to_numpy(zero_copy_only=False) & parts.is_valid().to_numpy(zero_copy_only=False)
    code = np.array([_CODES.get(k, 0) for k in kinds.to_pylist()], np.int64)
    sizes = lambda column: column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    polygons = parts.flatten()
    rings = polygons.flatten()
    points = rings.flatten()
    owner = np.repeat(np.arange(n), sizes(parts))
    holder = np.repeat(np.arange(len(polygons)), sizes(polygons))
    simple = np.where(code > 3, code - 3, code)
    # bytes before: a geometry, a part of a multi geometry, the vertices of a ring
    head = np.where(given, np.where(code > 3, 9, np.where(code == 3, 9, 5)), 0)
    part_head = np.where(code[owner] > 3, np.where(simple[owner] == 3, 9, 5), 0)
    ring_head = np.where(simple[owner][holder] == 1, 0, 4)
    counts = sizes(rings)
    ring_size = ring_head + 16 * counts
    part_size = part_head + np.bincount(holder, ring_size, len(polygons)).astype(np.int64)
    # a line without vertices still has its count
    bare = (code == 2) & given & (np.bincount(owner, minlength=n) == 0)
    total = head + 4 * bare + np.bincount(owner, part_size, n).astype(np.int64)
    ends = np.cumsum(total)
    starts = ends - total
    part_at = starts[owner] + head[owner] + _within(owner, part_size, n)
    ring_at = part_at[holder] + part_head[holder] + _within(holder, ring_size, len(polygons))
    out = np.zeros(int(ends[-1]) if n else 0, np.uint8)
    _headers(out, starts[given], code[given])
    several = np.bincount(owner, minlength=n)
    many = given & (code > 3)
    _put(out, starts[many] + 5, several[many].astype("<u4"))
    ring_counts = np.bincount(holder, minlength=len(polygons))
    single = given & (code == 3)
    _put(out, starts[single] + 5, np.bincount(owner, ring_counts, n)[single].astype("<u4"))
    of_many = code[owner] > 3
    _headers(out, part_at[of_many], simple[owner][of_many])
    filled = of_many & (simple[owner] == 3)
    _put(out, part_at[filled] + 5, ring_counts[filled].astype("<u4"))
    counted = ring_head > 0
    _put(out, ring_at[counted], counts[counted].astype("<u4"))
    first = ring_at + ring_head - 16 * (np.cumsum(counts) - counts)
    at = np.repeat(first, counts) + 16 * np.arange(counts.sum())
    for shift, name in ((0, "x"), (8, "y")):
        _put(out, at + shift, points.field(name).to_numpy(zero_copy_only=False).astype("<f8"))
    made = [pa.array(given).buffers()[1], pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out)]
    return pa.Array.from_buffers(pa.binary(), n, made)


def encode(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Replace ``geom_type`` and ``parts`` by a WKB column."""
    kept = [f for f in df.schema.fields if f.name not in ("geom_type", "parts")]
    schema = T.StructType(kept + [T.StructField(column, T.BinaryType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = encode_column(batch.column("geom_type"), batch.column("parts"))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), made], [*names, column])

    return df.mapInArrow(run, schema)
