"""Opened tiles: their features against the sites whose rim cuts them.

Spark brings the features of a tile and its sites to one task, large tiles in slices; a
task tests them as arrays.  Features are dealt into *blocks* of neighbours, which are counted
whole, skipped or opened as tiles are; the tests of single pairs are those of
``radius.within_reach``, operation by operation, so that a pair is judged alike wherever it
is tested.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import geodesy

#: Features of a block.
BLOCK = 128

#: Pairs of a site and a block, or a feature, judged at once.
PAIRS_AT_ONCE = 1 << 18

#: Numbers held per tile for counts by block and group, or by site and group.
COUNTS_AT_ONCE = 1 << 22

#: Margin in metres between bounds and the decisions drawn from them.
MARGIN_M = 1e-3

MIN_CURVATURE_RADIUS_M = (
    geodesy.SEMI_MAJOR_M * (1 - geodesy.FLATTENING) * (1 - geodesy.FLATTENING)
)

Open = Callable[[pa.Table, pa.Table], pa.Table]


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    """A numeric column as doubles, null as NaN."""
    return table.column(column).to_numpy().astype(np.float64, copy=False)


def _positions(table: pa.Table, prefix: str) -> list[np.ndarray]:
    return [_numbers(table, c) for c in geodesy.position_columns(prefix)]


def _in_space(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Block of each feature: strips by ``x``, walked up and down by ``y``."""
    n = len(x)
    strips = math.ceil(math.sqrt(n / size))
    strip = np.empty(n, np.int64)
    strip[np.argsort(x, kind="stable")] = np.arange(n) * strips // n
    block = np.empty(n, np.int64)
    block[np.lexsort((np.where(strip % 2, -y, y), strip))] = np.arange(n) // size
    return block


@dataclass(frozen=True)
class _Sites:
    """Searches as arrays: one column each, so that they meet rows of features or blocks."""

    box: list[np.ndarray]
    place: list[np.ndarray]
    radius: np.ndarray

    @classmethod
    def of(cls, table: pa.Table):
        columns = lambda found: [c[:, None] for c in found]
        box = [_numbers(table, c) for c in ("lng_min", "lng_max", "lat_min", "lat_max")]
        return cls(columns(box), columns(_positions(table, "site")), _numbers(table, "radius_m")[:, None])

    def at(self, rows: np.ndarray | slice) -> _Sites:
        return _Sites([c[rows] for c in self.box], [c[rows] for c in self.place], self.radius[rows])


@dataclass(frozen=True)
class _Features:
    """Features as arrays, by block; ``starts`` and ``ends`` of the blocks, and their bounds."""

    x: np.ndarray
    y: np.ndarray
    place: list[np.ndarray]
    starts: np.ndarray
    ends: np.ndarray
    bounds: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, table: pa.Table, blocks: np.ndarray):
        """``blocks``, the block of each feature, ascends."""
        x, y, place = _numbers(table, "_px"), _numbers(table, "_py"), _positions(table, "rep")
        starts = np.flatnonzero(np.diff(blocks, prepend=-1))
        bounds = [(np.minimum.reduceat(c, starts), np.maximum.reduceat(c, starts)) for c in (x, y, *place[:3])]
        return cls(x, y, place, starts, np.append(starts[1:], len(x)), bounds)

    def met(self, sites: _Sites) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Site by block: whether it may hold matches, whether all of it matches, and squared
        chords to its nearest and farthest corner."""
        west, east, south, north = sites.box
        (x0, x1), (y0, y1) = self.bounds[:2]
        meets = (x0 <= east) & (x1 >= west) & (y0 <= north) & (y1 >= south)
        whole = (x0 >= west) & (x1 <= east) & (y0 >= south) & (y1 <= north)
        nearest, farthest = np.zeros(meets.shape), np.zeros(meets.shape)
        for (low, high), at in zip(self.bounds[2:], sites.place):
            below, above = low - at, at - high
            gap = np.maximum(below, above)
            np.maximum(gap, 0.0, out=gap)
            nearest += gap * gap
            span = np.maximum(np.abs(below, out=below), np.abs(above, out=above))
            farthest += span * span
        meets &= nearest < (sites.radius + MARGIN_M) ** 2
        diameter = 2 * MIN_CURVATURE_RADIUS_M
        # the chord whose longest path is as long as the radius
        angle = np.clip((sites.radius - MARGIN_M) / diameter, 0, math.pi / 2)
        whole &= farthest < (diameter * np.sin(angle)) ** 2 * (1 - 1e-12)
        return meets, whole & meets, nearest, farthest

    def near(self, block: int, sites: _Sites) -> np.ndarray:
        """Site by feature of one block: whether it is in reach."""
        part = slice(self.starts[block], self.ends[block])
        x, y, (west, east, south, north) = self.x[part], self.y[part], sites.box
        scratch = np.empty((2, len(sites.radius), len(x)))
        near = geodesy.arrays_within([c[part] for c in self.place], sites.place, sites.radius, scratch)
        near &= (x >= west) & (x <= east)
        near &= (y >= south) & (y <= north)
        return near

    def opened(self, wanted: np.ndarray):
        """Blocks and the rows of ``wanted``, site by block, that ask for them, in runs."""
        for block in np.flatnonzero(wanted.any(axis=0)):
            rows = np.flatnonzero(wanted[:, block])
            step = max(1, PAIRS_AT_ONCE // (4 * int(self.ends[block] - self.starts[block])))
            for at in range(0, len(rows), step):
                yield block, rows[at : at + step]


def _counter(features: pa.Table, sites: pa.Table) -> pa.Table:
    """Features in reach per site and group."""
    text = features.column("_g").combine_chunks().dictionary_encode().indices
    mark = text.to_numpy(zero_copy_only=False).astype(np.int64) * 2 + features.column("_g0").to_numpy()
    _, shown, group = np.unique(mark, return_index=True, return_inverse=True)
    groups, n = len(shown), features.num_rows
    size = max(BLOCK, n * groups // COUNTS_AT_ONCE)
    block = _in_space(_numbers(features, "_px"), _numbers(features, "_py"), size)
    order = np.lexsort((group, block))
    layer = _Features.of(features.take(pa.array(order)), block[order])
    # runs of one group in a block
    runs = np.flatnonzero(np.diff(block[order] * groups + group[order], prepend=-1))
    run_group, run_block = group[order][runs], block[order][runs]
    in_block = np.zeros((len(layer.starts), groups))
    in_block[run_block, run_group] = np.diff(runs, append=n)
    first = np.searchsorted(run_block, np.arange(len(layer.starts) + 1))
    asked = _Sites.of(sites)
    step = max(1, min(PAIRS_AT_ONCE // len(layer.starts), COUNTS_AT_ONCE // groups))
    found = []
    for at in range(0, sites.num_rows, step):
        some = asked.at(slice(at, at + step))
        meets, whole, _, _ = layer.met(some)
        counts = (whole.astype(np.float64) @ in_block).astype(np.int64)
        for b, rows in layer.opened(meets & ~whole):
            own = slice(first[b], first[b + 1])
            near = layer.near(b, some.at(rows))
            counts[rows[:, None], run_group[own]] += np.add.reduceat(
                near, runs[own] - layer.starts[b], axis=1, dtype=np.int64
            )
        rows, which = np.nonzero(counts)
        found.append((rows + at, shown[which], counts[rows, which]))
    rows, which, numbers = (np.concatenate(c) for c in zip(*found))
    named = features.select(["_g", "_g0"]).take(pa.array(which))
    site = sites.column("_site").take(pa.array(rows))
    return pa.table([site, *named.columns, pa.array(numbers)], ["_site", "_g", "_g0", "n"])


def _first(rows: np.ndarray, columns: np.ndarray, paths: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of each site the ``most`` nearest and what ties with the last."""
    order = np.lexsort((paths, rows))
    rows, columns, paths = rows[order], columns[order], paths[order]
    _, start, number = np.unique(rows, return_index=True, return_counts=True)
    last = paths[start + np.minimum(number, most) - 1] if len(rows) else paths
    kept = paths <= np.repeat(last, number)
    return rows[kept], columns[kept], paths[kept]


def _searcher(kept: list[str], most: int) -> Open:
    """Features in reach per site with distance: the nearest and what ties with the last."""

    def search(features: pa.Table, sites: pa.Table) -> pa.Table:
        block = _in_space(_numbers(features, "_px"), _numbers(features, "_py"), BLOCK)
        order = np.argsort(block, kind="stable")
        features = features.take(pa.array(order))
        layer = _Features.of(features, block[order])
        numbers = layer.ends - layer.starts
        asked, k = _Sites.of(sites), np.minimum(_numbers(sites, "_k"), most)
        limit = _numbers(sites, "_limit")
        limit = np.where(np.isnan(limit), np.inf, limit) + MARGIN_M
        step = max(1, PAIRS_AT_ONCE // len(layer.starts))
        found = []
        for at in range(0, sites.num_rows, step):
            some, some_k, reach = asked.at(slice(at, at + step)), k[at : at + step], limit[at : at + step]
            meets, whole, nearest, farthest = layer.met(some)
            # blocks inside the circle, by reach, until they are sure to hold k features
            diameter = 2 * MIN_CURVATURE_RADIUS_M
            far = np.full(whole.shape, np.inf)
            far[whole] = diameter * np.arcsin(np.sqrt(farthest[whole]) / diameter)
            by_reach = np.argsort(far, axis=1)
            far = np.take_along_axis(far, by_reach, 1)
            held = np.cumsum(np.where(np.isinf(far), 0, numbers[by_reach]), axis=1)
            sure = np.where(held >= some_k[:, None], far, np.inf).min(axis=1) + MARGIN_M
            reach = np.minimum(reach, sure)
            for b, rows in layer.opened(meets & (np.sqrt(nearest) <= reach[:, None])):
                own = some.at(rows)
                line, column = np.nonzero(layer.near(b, own))
                column += layer.starts[b]
                paths = geodesy.array_distance(
                    [c[column] for c in layer.place], [c[line, 0] for c in own.place]
                )
                close = paths <= reach[rows[line]]
                found.append(_first(rows[line[close]] + at, column[close], paths[close], most))
        found.append((np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
        rows, columns, paths = _first(*(np.concatenate(c) for c in zip(*found)), most)
        taken = [sites.column(c).take(pa.array(rows)) for c in ("_site", "_k")]
        taken += [features.column(c).take(pa.array(columns)) for c in kept]
        return pa.table([*taken, pa.array(paths)], ["_site", "_k", *kept, "distance"])

    return search


def _opened(
    features: DataFrame, sites: DataFrame, keys: list[str], work: Open, schema: T.StructType
) -> DataFrame:
    """``work`` on the features and sites of each key; a null key meets nothing."""
    names = schema.names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows and right.num_rows:
            return work(left, right)
        # an empty table of the same types
        columns = {**dict(zip(right.column_names, right.schema.types)), **dict(zip(left.column_names, left.schema.types))}
        fixed = {"n": pa.int64(), "distance": pa.float64()}
        return pa.schema([(c, fixed.get(c, columns.get(c))) for c in names]).empty_table()

    # columns of tiles come from those of features: they get an identity of their own
    renewed = [df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (features, sites)]
    sides = [df.dropna(subset=keys).groupBy(*keys) for df in renewed]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType) for n in names]


def counted(features: DataFrame, sites: DataFrame, keys: list[str]) -> DataFrame:
    """Features in reach per site and group (``_g``, ``_g0``): ``n``, none left out."""
    fields = _fields(sites, ["_site"]) + _fields(features, ["_g", "_g0"])
    schema = T.StructType([*fields, T.StructField("n", T.LongType())])
    return _opened(features, sites, keys, _counter, schema)


def searched(features: DataFrame, sites: DataFrame, keys: list[str], kept: list[str], most: int) -> DataFrame:
    """Pairs in reach with ``distance`` and what is kept of a feature: of each tile at least
    the ``_k`` nearest of a site (``_k <= most``), within its ``_limit``."""
    fields = _fields(sites, ["_site", "_k"]) + _fields(features, kept)
    schema = T.StructType([*fields, T.StructField("distance", T.DoubleType())])
    return _opened(features, sites, keys, _searcher(kept, most), schema)
