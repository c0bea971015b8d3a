"""Containment joins: every polygon that encloses every site.

Polygons are spread over the one to four cells their box touches on the rung of their
size, sites emit one cell per rung in use, and an equi-join on the cell brings
candidates together.  Small polygons carry their edges with them.

Of a large polygon only the box takes part in that join.  Its height is cut into *bands*,
and the bands form a binary tree of *slabs*: one band, two, four, and so on up to the whole
height.  Each edge is stored once, in the smallest slab that holds both its ends; a site
looks only into the slabs that hold its band, one per level, and the crossings found in
them are added up.  Short edges lie deep in the tree and are seen by few sites; an edge as
tall as the polygon is seen by all, but no edge is ever copied.

Where the pairs of sites and small polygons would far outnumber both, the polygons of a cell
meet its sites in one task, which tests them as arrays (``enclosed``); the matches are kept as
``Lists``, one row per polygon.

Polygons with more edges than a row can hold come as an ``OutlinedLayer``; their boxes take
part in the same join, and ``outlines`` tests the pieces of their outlines.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geometry import all_segments, crossings, encloses
from waymark.plans import grid
from waymark.plans.enclosed import BOX, ROWS_AT_ONCE, enclosed
from waymark.plans.outlines import OutlinedLayer, within_outlines
from waymark.plans.saved import saved
from waymark.plans.skew import ROWS_PER_TASK, balanced_join, key_sizes

#: Polygons with more edges are cut into slabs; also the edges per band aimed at.
EDGES_PER_BAND = 64

#: Most bands of one polygon.  More edges than this allows make the bands longer.
MAX_BANDS = 1 << 16

#: Edges in one row of a slab.  Slabs with more edges have several rows.
EDGES_PER_ROW = 4096

#: Site cells sent to every executor; above this polygons and sites are shuffled.
BROADCAST_SITE_CELLS = 500_000

#: Candidate pairs per row of polygons and sites up to which they are joined directly.
PAIRS_PER_ROW = 8

#: Candidate pairs that are joined directly in any case.
FEW_PAIRS = 20_000_000

_BOX = ("bbox.xmin", "bbox.xmax", "bbox.ymin", "bbox.ymax")
_FRAME = ["_bands", "_ymin", "_height"]
_SLAB = ["_row", "_level", "_slab"]


@dataclass(frozen=True)
class ContainsOptions:
    broadcast_site_cells: int = BROADCAST_SITE_CELLS
    rows_per_task: int = ROWS_PER_TASK
    edges_per_band: int = EDGES_PER_BAND
    pairs_per_row: int = PAIRS_PER_ROW
    few_pairs: int = FEW_PAIRS
    rows_at_once: int = ROWS_AT_ONCE
    data_version: str | None = None


DEFAULT_OPTIONS = ContainsOptions()


@dataclass(frozen=True)
class Lists:
    """Matches by polygon, both tables stored.

    ``sites`` has the sites with their numbers, ``_site``; ``rows`` what is kept of a polygon
    and ``_at``, numbers of sites it encloses.  A polygon may have several rows; a pair of a
    site and a polygon is in one of them."""

    sites: DataFrame
    rows: DataFrame

    def exploded(self) -> DataFrame:
        """Pairs: what is kept and ``_site``."""
        return self.rows.withColumn("_site", F.explode("_at")).drop("_at")


def _with_bands(layer: DataFrame, edges_per_band: int) -> DataFrame:
    bands = F.least(F.ceil(F.col("n_edges") / edges_per_band), F.lit(MAX_BANDS))
    height = (F.col("bbox.ymax") - F.col("bbox.ymin")).cast("double")
    return layer.withColumns(
        {
            "_bands": F.when(height > 0, bands).otherwise(F.lit(1)).cast("int"),
            "_ymin": F.col("bbox.ymin").cast("double"),
            "_height": F.when(height > 0, height).otherwise(F.lit(1.0)),
        }
    )


def _band_of(y: Column) -> Column:
    """Band of a height; monotone in ``y``, so an edge lies in the bands between those of
    its ends."""
    position = F.floor((y - F.col("_ymin")) / F.col("_height") * F.col("_bands"))
    return F.least(F.greatest(position, F.lit(0)), F.col("_bands") - 1).cast("int")


def _bits(value: str) -> str:
    """Number of binary digits of a whole number, as SQL text."""
    return f"if({value} = 0, 0, length(bin({value})))"


def slabs(large: DataFrame) -> DataFrame:
    """Edges of large polygons by the smallest slab that holds them.

    One row per polygon (``_row``), level, slab and at most ``EDGES_PER_ROW`` edges, in
    ``_edges``; each edge occurs once."""
    edges = large.select("_row", *_FRAME, F.posexplode(all_segments("parts")).alias("_at", "_edge"))
    placed = edges.withColumns(
        {
            "_low": _band_of(F.least("_edge.y1", "_edge.y2")),
            "_high": _band_of(F.greatest("_edge.y1", "_edge.y2")),
        }
    ).withColumn("_level", F.expr(_bits("_low ^ _high")))
    return (
        placed.withColumns(
            {
                "_slab": F.expr("shiftright(_low, _level)"),
                "_part": F.floor(F.col("_at") / EDGES_PER_ROW),
            }
        )
        .groupBy(*_SLAB, "_part")
        .agg(F.collect_list("_edge").alias("_edges"))
    )


def _celled(shapes: DataFrame) -> DataFrame:
    return (
        grid.with_rungs(shapes, _BOX, finer=0)
        .withColumn("cell", F.explode(grid.covered_cells()))
        .drop(*grid.SCRATCH)
    )


def _spread(sites: DataFrame, pairs: list[int]) -> DataFrame:
    return sites.withColumn("cell", F.explode(grid.cells_at(pairs, "lng", "lat")))


def _box_join(
    sites: DataFrame, shapes: DataFrame, pairs: list[int], many: bool, options: ContainsOptions
) -> DataFrame:
    """Pairs of a site and a shape whose box holds it."""
    celled = _celled(shapes).withColumn("_slice", F.xxhash64(*_BOX))
    spread = _spread(sites, pairs)
    if many:
        joined = balanced_join(
            spread, celled, ["cell"], sites.columns, ["_slice"], options.rows_per_task
        )
    else:
        joined = celled.join(F.broadcast(spread), ["cell"])
    return joined.where(
        F.col("lng").between(F.col("bbox.xmin"), F.col("bbox.xmax"))
        & F.col("lat").between(F.col("bbox.ymin"), F.col("bbox.ymax"))
    ).drop("cell", "_slice")


def _met(shape_cells: DataFrame, site_cells: DataFrame, many: bool) -> float:
    """Pairs of a site and a shape that share a cell."""
    here = key_sizes(site_cells, ["cell"])
    if many:
        there = key_sizes(shape_cells, ["cell"]).withColumnRenamed("n", "m")
        number = there.join(here, "cell").agg(F.sum(F.col("n").cast("double") * F.col("m")))
    else:
        number = shape_cells.join(F.broadcast(here), "cell").agg(F.sum(F.col("n").cast("double")))
    return number.first()[0] or 0


def _within_large(
    sites: DataFrame,
    near: DataFrame,
    keep: dict[str, Column],
    pairs: list[int],
    many: bool,
    options: ContainsOptions,
) -> DataFrame:
    """Matches among the polygons that are cut into slabs."""
    kept = F.struct(*[c.alias(n) for n, c in keep.items()])
    # rows are numbered once: ids may be missing or repeat
    large = saved(
        near.where(F.col("n_edges") > options.edges_per_band).select(
            F.monotonically_increasing_id().alias("_row"), "bbox", "n_edges", "parts", kept.alias("_kept")
        )
    )
    large = _with_bands(large, options.edges_per_band)
    shapes = large.select("_row", "bbox", *_FRAME, "_kept")
    candidates = _box_join(sites, shapes, pairs, many, options).drop("bbox")
    touched = candidates.select("_row").distinct()
    pieces = slabs(large.join(touched, "_row", "left_semi"))
    path = candidates.select(
        *sites.columns,
        "_row",
        "_kept",
        _band_of(F.col("lat")).alias("_band"),
        F.explode(F.expr(f"sequence(0, {_bits('_bands - 1')})")).alias("_level"),
    ).withColumn("_slab", F.expr("shiftright(_band, _level)"))
    if many:
        joined = balanced_join(
            path, pieces, _SLAB, sites.columns, ["_part"], options.rows_per_task
        )
    else:
        joined = path.join(pieces, _SLAB)
    found = joined.select(
        *sites.columns, "_row", "_kept", crossings("_edges", "lng", "lat").alias("_met")
    )
    return (
        found.groupBy(*sites.columns, "_row")
        .agg(
            F.first("_kept").alias("_kept"),
            F.sum("_met.crossed").alias("_crossed"),
            F.bool_or("_met.touched").alias("_touched"),
        )
        .where("_crossed % 2 = 1 AND NOT _touched")
        .select(*sites.columns, *[F.col(f"_kept.{n}") for n in keep])
    )


def _within_outlined(
    sites: DataFrame,
    near: DataFrame,
    pieces: DataFrame,
    keep: dict[str, Column],
    pairs: list[int],
    many: bool,
    options: ContainsOptions,
) -> DataFrame:
    """Matches among polygons whose outlines are rows of ``pieces``."""
    kept = F.struct(*[c.alias(n) for n, c in keep.items()]).alias("_kept")
    candidates = _box_join(sites, near.select("bbox", "outline", kept), pairs, many, options)
    asked = candidates.select("outline", "lat", "lng").distinct()
    inside = within_outlines(asked, pieces, options.rows_per_task)
    return candidates.join(inside, ["outline", "lat", "lng"], "left_semi").select(
        *sites.columns, *[F.col(f"_kept.{n}") for n in keep]
    )


def contained(
    sites: DataFrame,
    layer: DataFrame | OutlinedLayer,
    keep: dict[str, Column],
    options: ContainsOptions = DEFAULT_OPTIONS,
) -> DataFrame | Lists:
    """The rows of :func:`contains_join`, or lists of them where they may be very many."""
    outlined = isinstance(layer, OutlinedLayer)
    polygons = layer.rows if outlined else layer
    reach = sites.agg(
        F.count(F.lit(1)), F.min("lng"), F.max("lng"), F.min("lat"), F.max("lat")
    ).first()
    count, west, east, south, north = reach
    near = polygons.where(F.lit(False)) if not count else polygons.where(
        (F.col("bbox.xmin") <= east)
        & (F.col("bbox.xmax") >= west)
        & (F.col("bbox.ymin") <= north)
        & (F.col("bbox.ymax") >= south)
    )
    # boxes and edge counts are enough to plan the join; at most RUNGS^2 rows
    edges = F.lit(None).cast("int").alias("n_edges") if outlined else F.col("n_edges")
    in_use = grid.with_rungs(near.select("bbox", edges), _BOX, finer=0)
    in_use = in_use.groupBy("rungs").agg(F.max("n_edges").alias("edges"), F.count(F.lit(1)).alias("rows")).collect()
    pairs = sorted(r["rungs"] for r in in_use) or [0]
    many = (count or 0) * len(pairs) > options.broadcast_site_cells
    if outlined:
        return _within_outlined(sites, near, layer.pieces, keep, pairs, many, options)
    few = near.where(F.col("n_edges") <= options.edges_per_band)
    large = any((r["edges"] or 0) > options.edges_per_band for r in in_use)
    # a site and a polygon share one cell at most: their numbers may settle it
    rows = sum(r["rows"] for r in in_use)
    most = max(options.few_pairs, options.pairs_per_row * (rows + (count or 0) * len(pairs)))
    if (count or 0) * rows > most:
        cells = (
            _celled(few.select("bbox")).select("cell"),
            _spread(sites.select("lat", "lng"), pairs).select("cell"),
        )
        if _met(*cells, many) > most:
            sizes = tuple(saved(key_sizes(c, ["cell"])) for c in cells)
            numbered = saved(sites.select(F.monotonically_increasing_id().alias("_site"), "*"))
            lists = _small_lists(numbered, few, keep, pairs, sizes, options)
            if large:
                found = _within_large(numbered, near, keep, pairs, many, options)
                lists = lists.unionByName(found.select(*keep, F.array("_site").alias("_at")))
            # rows of one cell are dealt over all tasks, as is what becomes of them
            return Lists(numbered, saved(lists.repartition(F.xxhash64(*keep, F.col("_at")[0]))))
    small = few.select(
        "bbox", *[c.alias(n) for n, c in keep.items()], all_segments("parts").alias("_edges")
    )
    matches = _box_join(sites, small, pairs, many, options)
    matches = matches.where(encloses("_edges", "lng", "lat")).select(*sites.columns, *keep)
    if large:
        matches = matches.unionByName(
            _within_large(sites, near, keep, pairs, many, options)
        )
    return matches


def _small_lists(
    numbered: DataFrame,
    few: DataFrame,
    keep: dict[str, Column],
    pairs: list[int],
    sizes: tuple[DataFrame, DataFrame],
    options: ContainsOptions,
) -> DataFrame:
    """Matches among polygons that carry their edges, in crowded cells."""
    kept = F.struct(*[c.alias(n) for n, c in keep.items()])
    small = few.select("bbox", kept.alias("_kept"), all_segments("parts").alias("_edges"))
    celled = _celled(small.where(F.col("_edges").isNotNull())).select(
        "cell", "_kept", "_edges", *[F.col(f"bbox.{c}").cast("double").alias(c) for c in BOX]
    )
    spread = _spread(numbered.select("_site", "lat", "lng"), pairs)
    found = enclosed(celled, spread, sizes, options.rows_at_once)
    return found.select(*[F.col(f"_kept.{n}").alias(n) for n in keep], "_at")


def contains_join(
    sites: DataFrame,
    layer: DataFrame | OutlinedLayer,
    keep: dict[str, Column],
    options: ContainsOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """Pairs of a site and a polygon that encloses it, boundary excluded.

    ``sites`` holds distinct rows with ``lat`` and ``lng``; ``keep`` names the polygon
    columns of the result.  ``layer`` must be prepared (``parts``, ``n_edges``); each of its
    rows is a polygon of its own, whatever its ``id``.
    """
    found = contained(sites, layer, keep, options)
    if not isinstance(found, Lists):
        return found
    if found.sites.count() <= options.broadcast_site_cells:
        joined = found.exploded().join(F.broadcast(found.sites), "_site")
    else:
        joined = balanced_join(
            found.sites, found.exploded(), ["_site"], ["_site"], list(keep), options.rows_per_task
        )
    return joined.select(*sites.columns, *keep)
