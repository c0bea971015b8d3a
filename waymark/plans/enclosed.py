"""Crowded cells: their small polygons against the sites in them.

Where many sites meet many polygons, pairs as rows cost more than their tests.  Spark brings
the polygons of a cell and its sites to one task, large cells in slices; a task tests them as
arrays and gives back one row per polygon, with the numbers of the sites it encloses.  The
tests are those of ``geometry.encloses``, operation by operation, missing and not-a-number
coordinates included, so that a pair is judged alike wherever it is tested.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.plans.skew import balanced_sides

#: Polygons, and sites, of a slice.  A task holds the enclosed pairs of two slices as numbers: at
#: most 16 million, should every polygon enclose every site.
ROWS_AT_ONCE = 4_000

#: Pairs of a site and a polygon tested at once.
PAIRS_AT_ONCE = 1 << 16

BOX = ("xmin", "xmax", "ymin", "ymax")


def _numbers(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)


def _span(a: np.ndarray, b: np.ndarray, missing: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``least`` and ``greatest`` of two columns as SQL has them: missing values do not count,
    NaN is above all numbers."""
    a, b = np.where(missing[0], b, a), np.where(missing[1], a, b)
    low, high = np.fmin(a, b), np.maximum(a, b)
    return np.where(np.isnan(low), np.inf, low), np.where(np.isnan(high), np.inf, high)


@dataclass(frozen=True)
class _Polygons:
    """Polygons by falling number of edges; ``edges`` has, for each place in an outline, the
    edges there as columns, one row for each of the first polygons."""

    order: np.ndarray
    box: list[np.ndarray]
    edges: list[list[np.ndarray]]

    @classmethod
    def of(cls, table: pa.Table):
        lines = table.column("_edges").combine_chunks()
        number = lines.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(-number, kind="stable")
        first, number = (np.cumsum(number) - number)[order], number[order]
        ends = lines.flatten().flatten()
        gaps = [c.is_null().to_numpy(zero_copy_only=False) for c in ends]
        x1, y1, x2, y2 = (_numbers(c) for c in ends)
        low, high = _span(y1, y2, (gaps[1], gaps[3]))
        west, east = _span(x1, x2, (gaps[0], gaps[2]))
        # an edge without its ends' x is beside every site, one without their y beside none
        west[gaps[0] & gaps[2]] = -np.inf
        low[gaps[1] & gaps[3]] = np.inf
        up = (y2 > y1) | (np.isnan(y2) & ~np.isnan(y1))
        whole = ~np.logical_or.reduce(gaps)
        columns = [low, high, x1, y1, x2, y2, west, east, up, whole]
        most = int(number[0]) if len(number) else 0
        held = [first[: np.searchsorted(-number, -k)] + k for k in range(most)]
        # NaN ends a box above all numbers and begins it there
        box = [_numbers(table.column(c))[order] for c in BOX]
        return cls(order, [np.where(np.isnan(c), np.inf, c) for c in box], [[c[at] for c in columns] for at in held])

    def around(self, polygon: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs of a polygon (ascending) and a site, whether it encloses the site."""
        odd, touched = np.zeros((2, len(polygon)), bool)
        for low, high, *columns in self.edges:
            some = polygon[: np.searchsorted(polygon, len(low))]
            py = y[: len(some)]
            near = np.flatnonzero((py >= low[some]) & (py <= high[some]))
            shape, px, py = some[near], x[near], py[near]
            x1, y1, x2, y2, west, east, up, whole = (c[shape] for c in columns)
            side = (x1 - px) * (y2 - py) - (x2 - px) * (y1 - py)
            # what is not at most a number is above it, NaN too
            across = ((y1 <= py) != (y2 <= py)) & ((side <= 0) != up) & whole
            odd[near] ^= across
            on = np.flatnonzero((side == 0) | ~whole)
            on = on[(px[on] >= west[on]) & (px[on] <= east[on])]
            touched[near[on]] = True
        return odd & ~touched


def pairs(polygons: _Polygons, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Enclosed pairs: places of a polygon in the order of ``polygons``, ascending, and of a site."""
    by_x = np.argsort(x, kind="stable")
    sx, sy = x[by_x], y[by_x]
    xmin, xmax, ymin, ymax = polygons.box
    start, end = np.searchsorted(sx, xmin, "left"), np.searchsorted(sx, xmax, "right")
    number = np.maximum(end - start, 0)
    before = np.concatenate([[0], np.cumsum(number)])
    found, at = [(np.empty(0, np.int64), np.empty(0, np.int64))], 0
    while at < len(number):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS_AT_ONCE, "right")) - 1)
        part = slice(at, to)
        polygon = np.repeat(np.arange(at, to), number[part])
        site = np.arange(before[at], before[to]) + np.repeat(start[part] - before[:-1][part], number[part])
        py = sy[site]
        inside = np.flatnonzero((py >= ymin[polygon]) & (py <= ymax[polygon]))
        polygon, site = polygon[inside], site[inside]
        kept = polygons.around(polygon, sx[site], sy[site])
        found.append((polygon[kept], by_x[site[kept]]))
        at = to
    polygon, site = (np.concatenate(c) for c in zip(*found))
    return polygon, site


def _meet(shapes: pa.Table, sites: pa.Table) -> pa.Table:
    polygons = _Polygons.of(shapes)
    with np.errstate(invalid="ignore", over="ignore"):
        polygon, site = pairs(polygons, _numbers(sites.column("lng")), _numbers(sites.column("lat")))
    starts = np.flatnonzero(np.diff(polygon, prepend=-1))
    kept = shapes.column("_kept").take(pa.array(polygons.order[polygon[starts]])).combine_chunks()
    numbers = sites.column("_site").take(pa.array(site)).combine_chunks()
    lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(polygon)), pa.int32()), numbers)
    return pa.table([kept, lists], ["_kept", "_at"])


def enclosed(
    shapes: DataFrame, sites: DataFrame, sizes: tuple[DataFrame, DataFrame], rows_at_once: int = ROWS_AT_ONCE
) -> DataFrame:
    """Polygons that enclose sites of their cell: ``_kept`` and ``_at``, an array of ``_site``.

    ``shapes`` has ``cell``, the box, ``_edges`` and ``_kept``, a polygon once for each of its
    cells; ``sites`` has ``cell``, ``_site``, ``lat`` and ``lng``; ``sizes`` their numbers per cell."""
    schema = T.StructType([shapes.schema["_kept"], T.StructField("_at", T.ArrayType(T.LongType()))])
    dealt = shapes.withColumn("_slice", F.xxhash64("_kept", *BOX))
    left, right, keys = balanced_sides(
        dealt, sites, ["cell"], ["_slice"], ["_site"], rows_at_once, *sizes
    )

    def run(some: pa.Table, here: pa.Table) -> pa.Table:
        if some.num_rows and here.num_rows:
            return _meet(some, here)
        return pa.schema([some.schema.field("_kept"), pa.field("_at", pa.list_(pa.int64()))]).empty_table()

    # both may come from the same tables: columns get an identity of their own
    renewed = [df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left.drop("_slice"), right)]
    sides = [df.dropna(subset=keys).groupBy(*keys) for df in renewed]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)
