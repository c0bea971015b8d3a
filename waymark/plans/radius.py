"""Radius joins: every feature within ``radius_m`` of every site.

A *site* is a distinct combination of search parameters; copies of a query point share
one site, so a popular point is searched once.  The layer gets one grid cell per rung
in use, sites are spread over the cells their search box touches, and an equi-join on
the cell brings candidates together.  The box test and the exact distance decide.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import geodesy
from waymark.plans.limits import DEFAULT_LIMITS, Limits
from waymark.plans import grid
from waymark.plans.skew import ROWS_PER_TASK, balanced_join

# The search box of the queries being answered.
METRES_PER_DEGREE = 111_320
POLAR_COSINE = 0.01
POLAR_SPAN_DEGREES = 180.0

#: Site cells (narrow rows of about 100 bytes) that are sent to every executor.
#: Above this the layer is shuffled to the sites instead.
BROADCAST_SITE_CELLS = 500_000

BOX = ("lng_min", "lng_max", "lat_min", "lat_max")


#: Candidate pairs per row of layer and sites up to which they are joined directly;
#: with more of them the layer is summarised into tiles first.
PAIRS_PER_ROW = 8

#: Candidate pairs that sites which are broadcast may test in any case.
FEW_PAIRS = 10_000_000

#: Features per tile of the finest level, at most and on average.
FEATURES_PER_TILE = 40_000


@dataclass(frozen=True)
class RadiusOptions:
    """``prefilter``: ``"none"`` lets the distance alone decide, across the antimeridian
    too; ``"corner"`` tests the lower-left corner of a feature's box against the search box
    before the distance, which loses some features near the rim.

    ``limits`` bounds parameters and answers; ``data_version``, if given, is noted in every
    answer."""

    prefilter: str = "none"
    broadcast_site_cells: int = BROADCAST_SITE_CELLS
    rows_per_task: int = ROWS_PER_TASK
    pairs_per_row: int = PAIRS_PER_ROW
    few_pairs: int = FEW_PAIRS
    features_per_tile: int = FEATURES_PER_TILE
    limits: Limits = DEFAULT_LIMITS
    data_version: str | None = None

    def __post_init__(self):
        if self.prefilter not in ("corner", "none"):
            raise ValueError(f"prefilter must be 'corner' or 'none': {self.prefilter!r}")


DEFAULT_OPTIONS = RadiusOptions()

#: The search as the answered queries make it.
CORNER_OPTIONS = RadiusOptions(prefilter="corner")


def with_search_box(sites: DataFrame, prefilter: str) -> DataFrame:
    """Add the search box; without a prefilter a box crossing the antimeridian is cut
    in two."""
    if prefilter == "corner":
        d_lat = f"radius_m / {METRES_PER_DEGREE}"
        cosine = "cos(radians(lat))"
        d_lng = (
            f"CASE WHEN {cosine} < {POLAR_COSINE}D THEN {POLAR_SPAN_DEGREES}D "
            f"ELSE radius_m / ({METRES_PER_DEGREE} * {cosine}) END"
        )
        box = {
            "lat_min": f"lat - {d_lat}",
            "lat_max": f"lat + {d_lat}",
            "lng_min": f"lng - {d_lng}",
            "lng_max": f"lng + {d_lng}",
        }
        return sites.withColumns({c: F.expr(text) for c, text in box.items()})
    r, lat, lng = F.col("radius_m"), F.col("lat"), F.col("lng")
    d_lat = r * 1.01 / F.lit(METRES_PER_DEGREE)
    reach = F.abs(lat) + d_lat
    d_lng = F.when(reach >= 89.9, F.lit(360.0)).otherwise(
        r * 1.01 / (F.lit(METRES_PER_DEGREE) * F.cos(F.radians(reach)))
    )

    def piece(shift: float) -> Column:
        low = F.greatest(lng - F.col("_d") + shift, F.lit(-180.0))
        high = F.least(lng + F.col("_d") + shift, F.lit(180.0))
        return F.struct(low.alias("lo"), high.alias("hi"))

    pieces = F.when(F.col("_d") >= 180, F.array(piece(0.0))).otherwise(
        F.filter(
            F.array(piece(-360.0), piece(0.0), piece(360.0)), lambda p: p.lo <= p.hi
        )
    )
    return (
        sites.withColumns({"lat_min": lat - d_lat, "lat_max": lat + d_lat, "_d": d_lng})
        .withColumn("_piece", F.explode(pieces))
        .withColumns({"lng_min": F.col("_piece.lo"), "lng_max": F.col("_piece.hi")})
        .drop("_d", "_piece")
    )


@dataclass(frozen=True)
class Criteria:
    """Which features count for which site, besides their position.

    ``match``: feature columns that must equal the site column of the same name.
    ``traits``: further feature columns that ``residual``, a condition over site columns
    and traits, refers to.
    """

    match: dict[str, Column] = field(default_factory=dict)
    traits: dict[str, Column] = field(default_factory=dict)
    residual: Column | None = None

    @property
    def columns(self) -> list[Column]:
        return [c.alias(n) for n, c in {**self.match, **self.traits}.items()]

    def apply(self, df: DataFrame) -> DataFrame:
        return df if self.residual is None else df.where(self.residual)


ANY = Criteria()


@dataclass(frozen=True)
class SiteFacts:
    """What the layout of the join depends on; one small row read up front."""

    sites: int
    cells: int
    pairs: list[int]
    box: tuple[float, float, float, float] | None


def site_facts(ranged: DataFrame) -> SiteFacts:
    row = ranged.agg(
        F.count(F.lit(1)).alias("sites"),
        F.sum(grid.covered_count()).alias("cells"),
        F.collect_set("rungs").alias("pairs"),  # at most RUNGS^2 values
        F.min("lng_min"),
        F.max("lng_max"),
        F.min("lat_min"),
        F.max("lat_max"),
    ).first()
    if row["cells"] is None:
        return SiteFacts(0, 0, [0], None)
    return SiteFacts(row["sites"], row["cells"], sorted(row["pairs"]), tuple(row[3:7]))


def ranged_sites(sites: DataFrame, options: RadiusOptions) -> DataFrame:
    """Sites with search box and cell ranges."""
    return grid.with_rungs(with_search_box(sites, options.prefilter), BOX, finer=1)


def never_null(ranged: DataFrame) -> DataFrame:
    """Tell the planner that site numbers are present (screening has seen to it)."""
    numbers = ("lat", "lng", "radius_m", *BOX)
    return ranged.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})


def spread_sites(ranged: DataFrame) -> DataFrame:
    """One row per site and grid cell, with the site's position."""
    return (
        geodesy.with_position(never_null(ranged), "lng", "lat", "site")
        .withColumn("cell", F.explode(grid.covered_cells()))
        .drop(*(c for c in grid.SCRATCH if c != "rungs"))
    )


def feature_rows(
    layer: DataFrame, columns: list[Column], facts: SiteFacts, options: RadiusOptions
) -> DataFrame:
    """The columns of a layer a radius search needs, cut to the sites' overall box.

    ``_px``/``_py`` is the position the search box is tested against.
    """
    x, y = ("bbox.xmin", "bbox.ymin") if options.prefilter == "corner" else ("rep_x", "rep_y")
    if facts.box is None:
        layer = layer.where(F.lit(False))
    else:
        west, east, south, north = facts.box
        layer = layer.where(F.col(x).between(west, east) & F.col(y).between(south, north))
    # NaN for missing positions: such rows match nothing, and the pair arithmetic is
    # spared the null checks
    position = {"_px": x, "_py": y} | {c: c for c in geodesy.position_columns("rep")}
    return layer.select(
        *columns,
        *[F.expr(f"coalesce({c}, double('NaN'))").alias(n) for n, c in position.items()],
        F.xxhash64("id").alias("_slice"),
    )


def with_cells(df: DataFrame, pairs: list[int]) -> DataFrame:
    """Key features by grid cell: one row per rung pair in use."""
    if len(pairs) == 1:
        return df.withColumn("cell", grid.cell_at(pairs[0], "_px", "_py"))
    return df.withColumn("cell", F.explode(grid.cells_at(pairs, "_px", "_py")))


def within_reach(joined: DataFrame) -> DataFrame:
    """Keep candidate pairs that pass the search box and the exact distance."""
    boxed = joined.where(
        "_px BETWEEN lng_min AND lng_max AND _py BETWEEN lat_min AND lat_max"
    )
    return geodesy.within_distance(boxed, "rep", "site", "radius_m")


def radius_join(
    sites: DataFrame,
    layer: DataFrame,
    keep: dict[str, Column],
    criteria: Criteria = ANY,
    options: RadiusOptions = DEFAULT_OPTIONS,
    facts: SiteFacts | None = None,
) -> DataFrame:
    """Pairs of a site and a feature less than ``radius_m`` apart.

    ``sites`` holds distinct rows with ``lat``, ``lng``, ``radius_m`` and whatever else
    should be carried; ``keep`` names the feature columns of the result.  The result has
    all site columns, the kept columns and ``distance``.
    """
    ranged = ranged_sites(sites, options)
    facts = facts or site_facts(ranged)
    columns = [*criteria.columns, *[c.alias(n) for n, c in keep.items()]]
    features = with_cells(feature_rows(layer, columns, facts, options), facts.pairs)
    spread = spread_sites(ranged)
    keys = ["cell", *criteria.match]
    if facts.cells > options.broadcast_site_cells:
        joined = balanced_join(
            features, spread, keys, ["_slice"], sites.columns, options.rows_per_task
        )
    else:
        joined = features.join(F.broadcast(spread), keys)
    pairs = within_reach(criteria.apply(joined))
    return pairs.select(*sites.columns, *keep, "distance")
