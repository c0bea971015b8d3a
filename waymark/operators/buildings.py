"""Buildings: count and composition by class around a point, measured to centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.screening import accepted_points
from waymark.operators.shares import share_answers
from waymark.plans.radius import DEFAULT_OPTIONS, RadiusOptions
from waymark.plans.results import answer_points, with_data_version
from waymark.plans.tiles import radius_counts
from waymark.sources.manifest import Layer, around

_SITE = ["lat", "lng", "radius_m"]


def building_count_in_radius(
    points: DataFrame, buildings: Layer, options: RadiusOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """How many buildings have their centroid within ``radius_m``; zeros included."""
    accepted = accepted_points(points, "building_count_in_radius", limits=options.limits)
    counts = radius_counts(
        accepted.select(*_SITE).distinct(),
        around(buildings, accepted, options.prefilter),
        options=options,
    ).select(*_SITE, "count", F.lit(True).alias("found"))
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("Zero buildings found within "), F.col("radius_m").cast("string"),
        F.lit("m. This may be an undeveloped area or indicate sparse coverage in this region."),
    )
    made = answer_points(accepted, counts, _SITE, suggestion).select(
        "query_id",
        F.col("lat").alias("query_lat"),
        F.col("lng").alias("query_lng"),
        "radius_m",
        F.coalesce("count", F.lit(0)).alias("count"),
        "suggestion",
    )
    return with_data_version(made, options.data_version)


def building_class_composition(
    points: DataFrame, buildings: Layer, options: RadiusOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """Count and share per building class within ``radius_m``, one row per class."""
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("Zero buildings found within "), F.col("radius_m").cast("string"),
        F.lit("m. Cannot compute composition for an area with no buildings."),
    )
    accepted = accepted_points(points, "building_class_composition", limits=options.limits)
    return share_answers(
        accepted,
        around(buildings, accepted, options.prefilter),
        F.coalesce("class", F.lit("unknown")),
        {"key": "class", "total": "total_buildings"},
        suggestion,
        options,
    )
