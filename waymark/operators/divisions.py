"""Administrative areas that contain a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.screening import accepted_points
from waymark.plans.contains import DEFAULT_OPTIONS, ContainsOptions, contains_join
from waymark.plans.results import answer_points, with_data_version
from waymark.sources.manifest import Layer, under

# Level of each kind of division, and of all others.
LEVELS = {
    "country": 2,
    "dependency": 3,
    "region": 4,
    "county": 6,
    "localadmin": 7,
    "locality": 8,
    "neighborhood": 9,
    "macrohood": 10,
    "microhood": 11,
}
OTHER_LEVEL = 99

# Wording of the suggestion.
_SUGGESTION = (
    "No administrative boundaries found for this point. It may be in international "
    "waters or an area with limited coverage."
)


def admin_level(subtype: Column) -> Column:
    pairs = [F.lit(v) for pair in LEVELS.items() for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), subtype), F.lit(OTHER_LEVEL))


def _matches(
    sites: DataFrame, divisions: DataFrame, options: ContainsOptions
) -> DataFrame:
    keep = {
        "id": F.col("id"),
        "name": F.col("names.primary"),
        "subtype": F.col("subtype"),
        "level": admin_level(F.col("subtype")),
    }
    return contains_join(sites, divisions.where(F.col("class") == "land"), keep, options)


def enclosing(
    sites: DataFrame, divisions: DataFrame, options: ContainsOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """The land divisions around each site (``lat``, ``lng``), one row per site that has any."""
    matches = _matches(sites, divisions, options)

    def last_of(subtype: str) -> Column:
        named = F.when(F.col("subtype") == subtype, F.struct("id", "name"))
        return F.max(named)["name"].alias(subtype)

    nested = F.struct("level", "id", "name", F.col("subtype").alias("type"))
    return matches.groupBy("lat", "lng").agg(
        last_of("locality"),
        last_of("region"),
        last_of("country"),
        F.transform(
            F.array_sort(F.collect_list(nested)),
            lambda d: F.struct(d["level"], d["name"], d["type"]),
        ).alias("admin_levels"),
        F.lit(True).alias("found"),
    )


def point_in_admin_boundary(
    points: DataFrame, divisions: Layer, options: ContainsOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """The land divisions around each point, broadest first, with the names of its
    country, region and locality."""
    accepted = accepted_points(points, "point_in_admin_boundary").select(
        "query_id", "lat", "lng"
    )
    sites = accepted.select("lat", "lng").distinct()
    levels = enclosing(sites, under(divisions, sites), options)
    made = answer_points(accepted, levels, ["lat", "lng"], F.lit(_SUGGESTION)).select(
        "query_id",
        F.col("lat").alias("query_lat"),
        F.col("lng").alias("query_lng"),
        "locality",
        "region",
        "country",
        "admin_levels",
        "suggestion",
    )
    return with_data_version(made, options.data_version)
