"""Radius searches over dense layers for many sites.

In a dense city the pairs of many sites and a layer would dwarf both.  The layer is
therefore pre-aggregated first: *tiles* hold the number of features per kind and the
bounds of their positions.  They form levels, each tile parted into sixteen on the next
one, down to tiles of some thousand features.  A tile lying wholly inside a search circle
contributes its count, one wholly outside is skipped, and tiles cut by the rim are parted;
only on the last level they are opened to test single features, as arrays (``opening``).  A circle with ``n``
features so meets about ``sqrt(n)`` tiles.  For top-k searches the tile counts shrink each
circle, level by level, to one sure to hold ``k`` features.

How many pairs there are is counted first.  Where they are few, a direct join tests them.

The bounds are boxes in earth-centred space, so the tests on tiles are strict: the path
is never shorter than the chord and never longer than the arc over that chord of a
circle with the ellipsoid's smallest radius of curvature.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import geodesy
from waymark.plans import grid, opening
from waymark.plans.opening import MARGIN_M, MIN_CURVATURE_RADIUS_M
from waymark.plans.radius import (
    ANY,
    BOX,
    DEFAULT_OPTIONS,
    Criteria,
    RadiusOptions,
    SiteFacts,
    feature_rows,
    never_null,
    radius_join,
    ranged_sites,
    site_facts,
    spread_sites,
    with_cells,
    with_search_box,
    within_reach,
)
from waymark.plans.results import nearest
from waymark.plans.saved import saved
from waymark.plans.skew import balanced_join, balanced_sides, key_sizes

#: Tile size below the cell size, in rungs (factor 4 each).
TILE_STEP = 2

#: Most tiles of the first level, met by every site.
ROOT_TILES = 256

#: Tiles of a level (rows of about 200 bytes) that are sent to every executor.
BROADCAST_TILES = 500_000

#: Sites, or features, of one tile that are tested by one task.
OPENED_ROWS = 50_000

#: Keys of features found (about 50 bytes each) that are sent to every executor.
BROADCAST_WINNERS = 1_000_000

_AXES = ("ex", "ey", "ez")


def _finer(pair: int) -> int:
    fine = (max(k - TILE_STEP, grid.MIN_RUNG) for k in grid.split_pair(pair))
    return grid.join_pair(*fine)


def _with_tiles(features: DataFrame, pairs: list[int]) -> DataFrame:
    """Key features by cell and tile, one row per rung pair in use."""
    keys = F.array(
        *[
            F.struct(
                grid.cell_at(p, "_px", "_py").alias("cell"),
                grid.cell_at(_finer(p), "_px", "_py").alias("tile"),
                F.lit(p).alias("rungs"),
            )
            for p in pairs
        ]
    )
    return features.select("*", F.inline(keys))


def _tile_table(features: DataFrame, kind: list[str]) -> DataFrame:
    bounds = [
        f(c).alias(f"{name}_{end}")
        for name, c in [("px", "_px"), ("py", "_py")] + [(a, f"rep_{a}") for a in _AXES]
        for f, end in ((F.min, "lo"), (F.max, "hi"))
    ]
    return features.groupBy("rungs", "cell", "tile", *kind).agg(
        F.count(F.lit(1)).alias("n"), *bounds
    )


def _nearest_chord() -> Column:
    gaps = [
        F.greatest(
            F.col(f"{a}_lo") - F.col(f"site_{a}"),
            F.col(f"site_{a}") - F.col(f"{a}_hi"),
            F.lit(0.0),
        )
        for a in _AXES
    ]
    return F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])


def _longest_path() -> Column:
    spans = [
        F.greatest(
            F.abs(F.col(f"{a}_lo") - F.col(f"site_{a}")),
            F.abs(F.col(f"{a}_hi") - F.col(f"site_{a}")),
        )
        for a in _AXES
    ]
    chord = F.sqrt(spans[0] * spans[0] + spans[1] * spans[1] + spans[2] * spans[2])
    diameter = 2 * MIN_CURVATURE_RADIUS_M
    return F.when(
        chord < diameter, F.lit(diameter) * F.asin(chord / diameter)
    ).otherwise(F.lit(math.inf))


def _levels(features: DataFrame, kind: list[str], options: RadiusOptions) -> list[int]:
    """Rungs of the levels, coarsest first: from few tiles in all to few features in each.

    Numbers of tiles are approximate; they shape the work, not the result."""
    rungs = range(grid.MIN_RUNG, grid.MAX_RUNG - TILE_STEP + 1)
    tiles = [
        F.approx_count_distinct(F.xxhash64(grid.cell_at(grid.join_pair(k, k), "_px", "_py"), *kind))
        for k in rungs
    ]
    n, *counts = features.agg(F.count(F.lit(1)), *tiles).first()
    number = dict(zip(rungs, counts))
    finest = [k for k in rungs if n <= options.features_per_tile * number[k]]
    leaf = max(finest, default=grid.MIN_RUNG)
    few = [k for k in rungs if k >= leaf and number[k] <= ROOT_TILES]
    return list(range(min(few, default=rungs[-1]), leaf - 1, -1))


def _level(leaves: DataFrame, rung: int, kind: list[str], groups: list[str]) -> DataFrame:
    """The tiles of one level: number (``tile``), the tile they are part of (``parent``),
    bounds, ``n``, and with ``groups`` the features of each group (``by_group``)."""
    at = lambda k: grid.cell_at(grid.join_pair(k, k), "px_lo", "py_lo")
    keys = ["tile", "parent", *kind]
    ends = {"lo": F.min, "hi": F.max}
    bounds = [f(f"{c}_{e}").alias(f"{c}_{e}") for c in ("px", "py", *_AXES) for e, f in ends.items()]
    total = F.sum("n").alias("n")
    above = min(rung + 1, grid.MAX_RUNG)
    made = leaves.withColumns({"parent": at(above), "tile": at(rung)})
    made = made.groupBy(*keys, *groups).agg(total, *bounds)
    if groups:
        listed = F.collect_list(F.struct(*groups, "n")).alias("by_group")
        made = made.groupBy(*keys).agg(total, listed, *bounds)
    return made


@dataclass(frozen=True)
class _Levels:
    """A layer summarised: its features by the tile of the last level, and the tiles of all."""

    features: DataFrame
    leaves: DataFrame
    tiles: list[DataFrame]
    kind: list[str]

    @classmethod
    def of(cls, features: DataFrame, kind: list[str], groups: list[str], options: RadiusOptions):
        rungs = _levels(features, kind, options)
        leaf = rungs[-1] + TILE_STEP
        keyed = _with_tiles(features, [grid.join_pair(leaf, leaf)]).drop("cell", "rungs")
        table = _tile_table(_with_tiles(features, [grid.join_pair(leaf, leaf)]), [*kind, *groups])
        leaves = saved(table.drop("rungs", "cell"))
        return cls(keyed, leaves, [_level(leaves, k, kind, groups) for k in rungs], kind)

    def sized(self) -> list[tuple[DataFrame, bool]]:
        """The tables of tiles and whether each fits every executor."""
        # a level has no more tiles than the leaves have rows
        small = self.leaves.count() <= BROADCAST_TILES
        return [(t, small or i == 0) for i, t in enumerate(self.tiles)]


#: What a site carries down the levels besides its number.
_SEARCH = ["radius_m", *BOX, *geodesy.position_columns("site")]


def _numbered(sites: DataFrame, k: Column | None, options: RadiusOptions) -> tuple[DataFrame, DataFrame]:
    """Sites with a number (``_site``), and the same dealt over tasks with their searches.

    Rows of one site stay in one task as long as they only meet broadcast tables."""
    if k is not None:
        sites = sites.withColumn("_k", k)
    numbered = saved(sites.withColumn("_site", F.monotonically_increasing_id()))
    searches = geodesy.with_position(
        never_null(with_search_box(numbered, options.prefilter)), "lng", "lat", "site"
    )
    context = sites.sparkSession.sparkContext
    tasks = max(
        context.defaultParallelism, int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    return numbered, searches.repartition(tasks, "_site")


def _judged(joined: DataFrame) -> DataFrame:
    """Site-tile pairs that may hold matches: ``n``, ``near``, ``far``, ``whole``."""
    hits = (
        joined.where(
            (F.col("px_lo") <= F.col("lng_max"))
            & (F.col("px_hi") >= F.col("lng_min"))
            & (F.col("py_lo") <= F.col("lat_max"))
            & (F.col("py_hi") >= F.col("lat_min"))
        )
        .withColumns({"near": _nearest_chord(), "far": _longest_path()})
        .where(F.col("near") < F.col("radius_m") + MARGIN_M)
    )
    in_box = (
        (F.col("px_lo") >= F.col("lng_min"))
        & (F.col("px_hi") <= F.col("lng_max"))
        & (F.col("py_lo") >= F.col("lat_min"))
        & (F.col("py_hi") <= F.col("lat_max"))
    )
    return hits.withColumn(
        "whole", in_box & (F.col("far") < F.col("radius_m") - MARGIN_M)
    )


def _first_hits(searches: DataFrame, levels: _Levels, criteria: Criteria) -> DataFrame:
    """All sites against the few tiles of the first level."""
    tiles = F.broadcast(levels.tiles[0].drop("parent"))
    joined = searches.join(tiles, [*criteria.match]) if criteria.match else searches.crossJoin(tiles)
    return _judged(criteria.apply(joined))


def _next_hits(
    rim: DataFrame, tiles: DataFrame, small: bool, kind: list[str], carried: list[str], options: RadiusOptions
) -> DataFrame:
    """Site-tile pairs of one level from those of the level above."""
    above = rim.withColumnRenamed("tile", "parent").select("_site", "parent", *kind, *carried)
    keys = ["parent", *kind]
    if small:
        joined = above.join(F.broadcast(tiles), keys)
    else:
        joined = balanced_join(above, tiles, keys, ["_site"], ["tile"], options.rows_per_task)
    return _judged(joined.drop("parent"))


def _opened(
    rim: DataFrame,
    levels: _Levels,
    columns: list[str],
    carried: list[str],
    options: RadiusOptions,
    work: Callable[[DataFrame, DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """``work`` on the features and sites of the tiles to open."""
    keys = ["tile", *levels.kind]
    place = ["_px", "_py", *geodesy.position_columns("rep")]
    features, sites, keys = balanced_sides(
        levels.features.select(*keys, *place, *columns, "_slice"),
        rim.select("_site", *keys, *carried),
        keys,
        ["_slice"],
        ["_site"],
        min(options.rows_per_task, OPENED_ROWS),
        left_sizes=_sizes(levels.leaves, keys),
    )
    return work(features.drop("_slice"), sites, keys)


def _counted_by_level(
    sites: DataFrame, features: DataFrame, criteria: Criteria, options: RadiusOptions
) -> DataFrame:
    """Number of matches per site and group: ``n``."""
    kind, groups = [*criteria.match, *criteria.traits], ["_g", "_g0"]
    levels = _Levels.of(features, kind, groups, options)
    numbered, searches = _numbered(sites, None, options)
    carried = [c for c in _SEARCH if c not in kind]
    rim, counts = None, []
    for tiles, small in levels.sized():
        if rim is None:
            hits = _first_hits(searches, levels, criteria)
        else:
            hits = _next_hits(rim, tiles, small, kind, carried, options)
        counts.append(hits.where("whole").select("_site", F.inline("by_group")))
        # stored, because the code of several levels in one stage is too long to be compiled
        rim = saved(hits.where("NOT whole").select("_site", "tile", *kind, *carried))
    counts.append(_opened(rim, levels, groups, carried, options, opening.counted))
    counted = reduce(DataFrame.unionByName, counts).groupBy("_site", *groups).agg(F.sum("n").alias("n"))
    return numbered.join(counted, "_site").select(*sites.columns, *groups, "n")


def _nearest_by_level(
    sites: DataFrame,
    features: DataFrame,
    k: Column,
    most: int,
    criteria: Criteria,
    options: RadiusOptions,
) -> DataFrame:
    """The ``k`` nearest features of each site, of equal ones by ``id`` and ``_rest``."""
    kind = [*criteria.match, *criteria.traits]
    levels = _Levels.of(features, kind, [], options)
    numbered, searches = _numbered(sites, k, options)
    carried = ["_k", *[c for c in _SEARCH if c not in kind]]
    per_site = W.partitionBy("_site")
    # tiles inside the circle, by reach, until they are sure to hold k features
    by_reach = per_site.orderBy("far", "tile", *kind).rowsBetween(W.unboundedPreceding, W.currentRow)
    sure = F.sum(F.when(F.col("whole"), F.col("n")).otherwise(0)).over(by_reach)
    limit = F.min(F.when(F.col("_sure") >= F.col("_k"), F.col("far"))).over(per_site)
    hits = None
    for tiles, small in levels.sized():
        if hits is None:
            hits = _first_hits(searches, levels, criteria)
        else:
            hits = _next_hits(hits, tiles, small, kind, carried, options)
        hits = (
            hits.withColumn("_sure", sure)
            .withColumn("_limit", limit)
            .where(F.col("_limit").isNull() | (F.col("near") <= F.col("_limit") + MARGIN_M))
        )
    carried = [*carried, "_limit"]
    rim = saved(hits.select("_site", "tile", *kind, *carried))
    rows = [c for c in features.columns if c in ("id", "_rest", *ROW_KEY)]
    search = partial(opening.searched, kept=rows, most=most)
    found = _opened(rim, levels, rows, carried, options, search)
    top = nearest(found, ["_site"], F.col("_k"), most, [F.col("_rest")]).drop("_k")
    return numbered.drop("_k").join(top, "_site").drop("_site")


def _null_safe(column: Column) -> tuple[Column, Column]:
    return F.coalesce(column, F.lit("")), column.isNull()


def _sizes(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """Features per join key, from the tiles: ``n``."""
    return tiles.groupBy(*keys).agg(F.sum("n").alias("n"))


def _dense(spread: DataFrame, tiles: DataFrame, keys: list[str], options: RadiusOptions) -> bool:
    """Whether candidate pairs would far outnumber the rows that make them.

    Tiles, or sizes of keys, are a histogram of the layer: joined with the sites per key it
    gives the number of pairs a direct join would test."""
    sites = spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    both = _sizes(tiles, keys).join(sites, keys, "full")
    n, m = (F.coalesce(c, F.lit(0)).cast("double") for c in ("n", "m"))
    pairs, rows = both.agg(F.sum(n * m), F.sum(n + m)).first()
    return (pairs or 0) > options.pairs_per_row * (rows or 0)


def _joined_directly(
    sites: DataFrame,
    spread: DataFrame,
    features: DataFrame,
    sizes: DataFrame,
    criteria: Criteria,
    options: RadiusOptions,
) -> DataFrame:
    """Exact pairs by one shuffle join, large cells cut by the counted ``sizes``."""
    keys = ["cell", *criteria.match]
    joined = balanced_join(
        features,
        spread.drop("rungs"),
        keys,
        ["_slice"],
        sites.columns,
        options.rows_per_task,
        left_sizes=sizes,
    )
    return within_reach(criteria.apply(joined))


def _crowded(features: DataFrame, spread: DataFrame, keys: list[str], options: RadiusOptions) -> bool:
    """Whether sites that are broadcast would test too many pairs; counted in one scan."""
    sites = F.broadcast(spread.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")))
    met = features.join(sites, keys, "left")
    pairs, rows = met.agg(F.sum(F.coalesce("m", F.lit(0)).cast("double")), F.count(F.lit(1))).first()
    return (pairs or 0) > max(options.pairs_per_row * rows, options.few_pairs)


def _again(features: DataFrame, layer: DataFrame) -> DataFrame:
    """Features that are read several times: stored, unless they come from files as they are."""
    features = features if set(ROW_KEY) <= set(layer.columns) else saved(features)
    return features.where(~F.isnan("rep_ex"))  # without a position nothing is near


def _direct(
    sites: DataFrame,
    layer: DataFrame,
    keep: dict[str, Column],
    criteria: Criteria,
    options: RadiusOptions,
    ranged: DataFrame,
    facts: SiteFacts,
) -> DataFrame | None:
    """Pairs of sites and features with what is kept, by one join; None if it would test too
    many."""
    spread, keys = spread_sites(ranged), ["cell", *criteria.match]
    bare = [c.alias(n) for n, c in criteria.match.items()]
    features = with_cells(feature_rows(layer, bare, facts, options), facts.pairs)
    if facts.cells <= options.broadcast_site_cells:
        if _crowded(features, spread, keys, options):
            return None
        return radius_join(sites, layer, keep, criteria, options, facts)
    sizes = saved(key_sizes(features, keys))
    if _dense(spread, sizes, keys, options):
        return None
    columns = [*criteria.columns, *[c.alias(n) for n, c in keep.items()]]
    features = with_cells(feature_rows(layer, columns, facts, options), facts.pairs)
    pairs = _joined_directly(sites, spread, features, sizes, criteria, options)
    return pairs.select(*sites.columns, *keep, "distance")


def radius_counts(
    sites: DataFrame,
    layer: DataFrame,
    group: Column | None = None,
    criteria: Criteria = ANY,
    options: RadiusOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """Number of features within reach of each site, per value of ``group``.

    The result has the site columns, ``key`` (the group, null kept) and ``count``;
    sites without any feature are absent.

    The pairs to expect are counted first.  They say whether the features themselves meet
    the sites, which are broadcast if they fit, or whole tiles are counted.
    """
    ranged = ranged_sites(sites, options)
    facts = site_facts(ranged)
    group = F.lit(None).cast("string") if group is None else group.cast("string")
    pairs = _direct(sites, layer, {"key": group}, criteria, options, ranged, facts)
    if pairs is not None:
        return pairs.groupBy(*sites.columns, "key").agg(
            F.count(F.lit(1)).alias("count")
        )
    text, absent = _null_safe(group)
    columns = [*criteria.columns, text.alias("_g"), absent.alias("_g0")]
    features = _again(feature_rows(layer, columns, facts, options), layer)
    return _counted_by_level(sites, features, criteria, options).select(
        *sites.columns,
        F.when(~F.col("_g0"), F.col("_g")).alias("key"),
        F.col("n").alias("count"),
    )


#: Where a row of a layer read from files comes from: file and position in it.
ROW_KEY = ("_file", "_row")

#: Files listed one by one in a scan.
_LISTED_FILES = 10_000


def ranked(
    sites: DataFrame,
    layer: DataFrame,
    keep: dict[str, Column],
    k: Column,
    most: int,
    criteria: Criteria = ANY,
    options: RadiusOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """The ``k`` nearest features of each site.

    What is kept travels with every pair where they are few.  Otherwise features are ranked
    by position alone, and it is fetched for the winners."""
    ranged = ranged_sites(sites, options)
    facts = site_facts(ranged)
    kept = {"id": F.col("id"), **keep}
    pairs = _direct(sites, layer, kept, criteria, options, ranged, facts)
    if pairs is not None:
        return nearest(pairs, sites.columns, k, most)
    rest = F.xxhash64(*keep.values()) if keep else F.lit(0).cast("bigint")
    placed = [F.col(c) for c in ROW_KEY] if tuple(keep) == ROW_KEY else []
    columns = [*criteria.columns, F.col("id"), rest.alias("_rest"), *placed]
    features = _again(feature_rows(layer, columns, facts, options), layer)
    top = _nearest_by_level(sites, features, k, most, criteria, options)
    if not placed:
        top = _with_kept(top, layer, keep, rest)
    return top.select(*sites.columns, *kept, "distance", "rank", "count")


def _with_kept(top: DataFrame, layer: DataFrame, keep: dict[str, Column], rest: Column) -> DataFrame:
    """Add what is kept of the winners; rows with one ``id`` and hash are equal."""
    key = ["_id", "_id0", "_rest"]
    safe = dict(zip(key, _null_safe(F.col("id").cast("string"))))
    top = saved(top.withColumns(safe))
    winners = top.select(*key).distinct()
    if winners.count() <= BROADCAST_WINNERS:
        winners = F.broadcast(winners)
    rows = layer.withColumns({**safe, "_rest": rest}).select(*key, *[c.alias(n) for n, c in keep.items()])
    rows = rows.join(winners, key, "left_semi").dropDuplicates(key)
    return top.join(rows, key)


def radius_nearest(
    sites: DataFrame,
    layer: DataFrame,
    keep: dict[str, Column],
    k: Column,
    most: int,
    criteria: Criteria = ANY,
    options: RadiusOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """The ``k`` nearest features within reach of each site, ``k <= most``.

    The result has the site columns, ``id``, the kept columns, ``distance``,
    ``rank`` and ``count``.

    With few pairs, all features in reach are ranked in one scan; rows beyond ``most`` are
    dropped before they are shuffled.  With many, tile counts bound the distance of the
    ``k``-th feature first, and tiles beyond it are never opened.

    A layer that says where its rows come from (``ROW_KEY``) is ranked by that alone; the
    kept columns, geometry among them, are read for the winners, from the files they are in.
    """
    if not set(ROW_KEY) <= set(layer.columns):
        return ranked(sites, layer, keep, k, most, criteria, options)
    place = {c: F.col(c) for c in ROW_KEY}
    top = saved(ranked(sites, layer, place, k, most, criteria, options))
    files = [r[0] for r in top.select("_file").distinct().limit(_LISTED_FILES + 1).collect()]
    if len(files) <= _LISTED_FILES:
        layer = layer.where(F.col("_file").isin(files))
    kept = layer.select(*ROW_KEY, *[c.alias(n) for n, c in keep.items()])
    kept = kept.join(top.select(*ROW_KEY).distinct(), list(ROW_KEY), "left_semi")
    found = balanced_join(
        top, kept, list(ROW_KEY), sites.columns, list(ROW_KEY), options.rows_per_task
    )
    return found.select(*sites.columns, "id", *keep, "distance", "rank", "count")
