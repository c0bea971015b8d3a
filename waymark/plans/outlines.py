"""Polygons whose outlines are too long for a row: sites against pieces of outlines.

Whether a polygon encloses a site is decided by the edges to the right of it, and every edge
counts by itself: pieces of an outline can be met one by one, in any order, and what was
found is added up.  Spark brings *slices* of neighbouring pieces and the sites at their
height to one task, which tests them as arrays.  It deals the edges into blocks by ``x``: of
blocks right of a site the heights alone decide, looked up in sorted order; blocks left of it
are skipped, and only in those at its own ``x`` each edge is tested.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.plans.skew import balanced_sides

#: Consecutive pieces of an outline that one task holds.
PIECES_PER_SLICE = 128

#: Edges of a block.
BLOCK = 4096

#: Pairs of a site and an edge tested at once.
PAIRS_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class OutlinedLayer:
    """Polygons with their outlines in a table of their own.

    ``rows`` has one row per polygon with ``bbox`` and ``outline``, the key of its outline;
    rows may share one, and a null key has none.  ``pieces`` has the outlines, cut: ``outline``, ``at``
    (position in the outline, from 0), ``bbox``, which holds the piece, and ``line``, an array
    of at most some thousand vertices.  The last vertex of a piece is the first of the next."""

    rows: DataFrame
    pieces: DataFrame


def _numbers(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _edges(lines: pa.ChunkedArray) -> list[np.ndarray]:
    """``x1, y1, x2, y2`` of all edges of some lines; those with a missing end are left out."""
    found = []
    for chunk in lines.chunks:
        size = chunk.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        vertices = chunk.flatten()
        if len(vertices) < 2:
            continue
        x, y = (_numbers(c) for c in vertices.flatten())
        line = np.repeat(np.arange(len(size)), size)
        joined = line[:-1] == line[1:]
        ends = np.stack([x[:-1], y[:-1], x[1:], y[1:]])[:, joined]
        found.append(ends[:, ~np.isnan(ends).any(axis=0)])
    return list(np.concatenate(found, axis=1)) if found else [np.empty(0)] * 4


def met(edges: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each site the number of edges to its right and whether it lies on one, as
    ``geometry.crossings`` finds them."""
    order = np.argsort(np.minimum(edges[0], edges[2]), kind="stable")
    edges = [c[order] for c in edges]
    west, east = np.minimum(edges[0], edges[2]), np.maximum(edges[0], edges[2])
    low, high = np.minimum(edges[1], edges[3]), np.maximum(edges[1], edges[3])
    by_x = np.argsort(x, kind="stable")
    sx, sy = x[by_x], y[by_x]
    crossed, touched = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    for start in range(0, len(order), BLOCK):
        part = slice(start, start + BLOCK)
        left = np.searchsorted(sx, west[start])
        # edges right of a site are crossed where they begin at or below it and end above it
        lows, highs = np.sort(low[part]), np.sort(high[part])
        crossed[:left] += np.searchsorted(lows, sy[:left], "right") - np.searchsorted(highs, sy[:left], "right")
        beside = np.arange(left, np.searchsorted(sx, east[part].max(), "right"))
        beside = beside[(sy[beside] >= lows[0]) & (sy[beside] <= highs[-1])]
        step = max(1, PAIRS_AT_ONCE // len(lows))
        for at in range(0, len(beside), step):
            rows = beside[at : at + step]
            px, py = sx[rows, None], sy[rows, None]
            x1, y1, x2, y2 = (c[part] for c in edges)
            side = (x1 - px) * (y2 - py) - (x2 - px) * (y1 - py)
            across = ((y1 > py) != (y2 > py)) & ((side > 0) == (y2 > y1))
            crossed[rows] += across.sum(axis=1)
            on = (side == 0) & (py >= low[part]) & (py <= high[part])
            touched[rows] |= (on & (px >= west[part]) & (px <= east[part])).any(axis=1)
    counts, marks = np.empty_like(crossed), np.empty_like(touched)
    counts[by_x], marks[by_x] = crossed, touched
    return counts, marks


def _meet(pieces: pa.Table, sites: pa.Table) -> pa.Table:
    edges = _edges(pieces.column("line"))
    x, y = (_numbers(sites.column(c).combine_chunks()) for c in ("lng", "lat"))
    crossed, touched = met(edges, x, y)
    kept = (crossed > 0) | touched
    some = sites.select(["outline", "lat", "lng"]).filter(pa.array(kept))
    return some.append_column("crossed", pa.array(crossed[kept])).append_column("touched", pa.array(touched[kept]))


def within_outlines(wanted: DataFrame, pieces: DataFrame, rows_per_task: int) -> DataFrame:
    """Those rows of ``wanted`` (distinct ``outline``, ``lat`` and ``lng``) whose outline
    encloses the site, boundary excluded."""
    sliced = pieces.select(
        "outline", "at", "bbox", "line", F.floor(F.col("at") / PIECES_PER_SLICE).alias("_slice")
    )
    # from the boxes of the pieces alone; one row per slice
    boxes = sliced.groupBy("outline", "_slice").agg(
        F.max("bbox.xmax").alias("_east"), F.min("bbox.ymin").alias("_south"), F.max("bbox.ymax").alias("_north")
    )
    asked = (
        wanted.join(F.broadcast(boxes), "outline")
        .where((F.col("lng") <= F.col("_east")) & F.col("lat").between(F.col("_south"), F.col("_north")))
        .select("outline", "_slice", "lat", "lng")
    )
    sides = balanced_sides(
        sliced.select("outline", "_slice", "at", "line"), asked, ["outline", "_slice"], ["at"], ["lat", "lng"], rows_per_task
    )
    keys = sides[2]
    # both come from the same tables: columns get an identity of their own
    lines, sites = (df.select(*[F.col(c).alias(c) for c in df.columns]).dropna(subset=keys) for df in sides[:2])
    kinds = {f.name: f.dataType.simpleString() for f in sites.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("outline", "lat", "lng")) + ", crossed long, touched boolean"
    found = lines.groupBy(*keys).cogroup(sites.groupBy(*keys)).applyInArrow(_meet, schema)
    return (
        found.groupBy("outline", "lat", "lng")
        .agg(F.sum("crossed").alias("_crossed"), F.bool_or("touched").alias("_touched"))
        .where("_crossed % 2 = 1 AND NOT _touched")
        .select("outline", "lat", "lng")
    )
