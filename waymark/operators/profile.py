"""One row per point over all layers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.geodesy import position_columns
from waymark.operators.divisions import enclosing
from waymark.operators.roads import only_roads
from waymark.operators.screening import cleaned_points
from waymark.plans.radius import DEFAULT_OPTIONS, RadiusOptions
from waymark.plans.results import composition, with_data_version
from waymark.plans.skew import balanced_attach
from waymark.plans.tiles import radius_counts
from waymark.sources.manifest import Layer, around, under

_SITE = ["lat", "lng", "radius_m"]

#: What a feature of a layer is counted as: a letter, and its group after a colon.
_PLACE, _BUILDING, _ROAD, _PARCEL = "pbrl"


def _counted(layer: DataFrame, kind: str, group: Column) -> DataFrame:
    """The columns of a layer that a radius search needs, with ``_as`` to count by."""
    return layer.select(
        "id",
        F.struct(
            F.col("bbox.xmin").cast("double").alias("xmin"),
            F.col("bbox.ymin").cast("double").alias("ymin"),
        ).alias("bbox"),
        "rep_x",
        "rep_y",
        *position_columns("rep"),
        F.concat_ws(":", F.lit(kind), group).alias("_as"),
    )


def _place_key(category: Column, closed: Column) -> Column:
    return F.concat_ws(":", closed.cast("int").cast("string"), category)


def _everything(
    sites: DataFrame,
    places: Layer,
    buildings: Layer,
    segments: Layer,
    land_use: Layer,
    options: RadiusOptions,
) -> DataFrame:
    """All layers that are searched by radius, under one set of columns."""
    near = [around(x, sites, options.prefilter) for x in (places, buildings, segments, land_use)]
    closed = F.coalesce(F.col("operating_status"), F.lit("open")) == "permanently_closed"
    category = F.col("categories.primary")
    parts = [
        _counted(near[0].where(category.isNotNull()), _PLACE, _place_key(category, closed)),
        _counted(near[1], _BUILDING, F.coalesce("class", F.lit("unknown"))),
        _counted(only_roads(near[2]), _ROAD, F.coalesce("class", F.lit("unknown"))),
        _counted(near[3], _PARCEL, F.col("subtype")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _shares(kind: str, key: str) -> Column:
    """Groups of one kind with count and percentage, the largest first."""
    row = F.when(F.col("_kind") == kind, F.struct(-F.col("count"), "_group", "percentage"))
    return F.transform(
        F.array_sort(F.collect_list(row)),
        lambda r: F.struct(r["_group"].alias(key), (-r["col1"]).alias("count"), r["percentage"]),
    )


def _per_site(counts: DataFrame) -> DataFrame:
    """All figures of a site in one row."""
    grouped = counts.withColumns(
        {
            "_kind": F.substring("key", 1, 1),
            # a parcel without subtype has no group
            "_group": F.when(F.length("key") > 1, F.expr("substring(key, 3)")),
        }
    )
    shares = composition(grouped, [*_SITE, "_kind"])

    def total(kind: str) -> Column:
        return F.max(F.when(F.col("_kind") == kind, F.col("total")))

    places = F.collect_list(F.when(F.col("_kind") == _PLACE, F.struct("_group", "count")))
    return shares.groupBy(*_SITE).agg(
        F.map_from_entries(places).alias("_places"),
        total(_BUILDING).alias("building_count"),
        total(_ROAD).alias("total_segments"),
        total(_PARCEL).alias("total_parcels"),
        _shares(_BUILDING, "class").alias("building_classes"),
        _shares(_ROAD, "road_class").alias("road_classes"),
        _shares(_PARCEL, "subtype").alias("land_use_subtypes"),
    )


def area_profile(
    points: DataFrame,
    *,
    places: Layer,
    buildings: Layer,
    divisions: Layer,
    segments: Layer,
    land_use: Layer,
    taxonomy: DataFrame,
    options: RadiusOptions = DEFAULT_OPTIONS,
) -> DataFrame:
    """Counts of places, buildings, road segments and parcels around each point, the last
    three by class or subtype with shares, and the divisions the point lies in.

    One row per input row, whether or not ``query_id`` repeats.  A figure is null where its
    parameters were rejected.  Parameters are screened once, and all four layers meet the
    sites in one radius search.
    """
    screened = cleaned_points(
        points, "count_places_by_type_in_radius", taxonomy, options.limits
    )
    placed = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    around_it = placed & F.col("radius_m").isNotNull()
    sites = screened.where(around_it).select(*_SITE).distinct()
    everything = _everything(sites, places, buildings, segments, land_use, options)
    found = _per_site(radius_counts(sites, everything, F.col("_as"), options=options))
    spots = screened.where(placed).select("lat", "lng").distinct()
    areas = enclosing(spots, under(divisions, spots)).select(
        "lat", "lng", "locality", "region", "country"
    )
    with_counts = balanced_attach(screened, found, _SITE, ["query_id"])
    answers = balanced_attach(with_counts, areas, ["lat", "lng"], ["query_id"])

    def places_of(closed: bool) -> Column:
        key = _place_key(F.col("category"), F.lit(closed))
        return F.coalesce(F.try_element_at("_places", key), F.lit(0))

    place_count = places_of(False) + F.when(F.col("include_closed"), places_of(True)).otherwise(0)

    def figure(name: str) -> Column:
        return F.when(around_it, F.coalesce(name, F.lit(0))).alias(name)

    def listed(name: str) -> Column:
        empty = F.from_json(F.lit("[]"), found.schema[name].dataType)
        return F.when(around_it, F.coalesce(name, empty)).alias(name)

    made = answers.select(
        "query_id",
        F.when(around_it & F.col("category").isNotNull(), place_count).alias("place_count"),
        *[figure(c) for c in ("building_count", "total_segments", "total_parcels")],
        *[listed(c) for c in ("building_classes", "road_classes", "land_use_subtypes")],
        "locality",
        "region",
        "country",
    )
    return with_data_version(made, options.data_version)
