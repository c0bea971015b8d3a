"""Road segments: composition by class and surface, nearest segment of a class.

Only segments of subtype ``road`` count.  Distances are measured to one vertex of the
segment (the interior vertex nearest to its centroid), not to its closest position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import shaping
from waymark.functions.geodesy import whole_metres
from waymark.operators.screening import accepted_points
from waymark.operators.shares import share_answers
from waymark.plans.radius import DEFAULT_OPTIONS, Criteria, RadiusOptions
from waymark.plans.results import answer_points, with_data_version
from waymark.plans.tiles import radius_nearest
from waymark.sources.manifest import Layer, around


def only_roads(segments: DataFrame) -> DataFrame:
    """Segments that are roads, not rails or waterways."""
    return segments.where(F.col("subtype") == "road")


def road_count_by_class(
    points: DataFrame, segments: Layer, options: RadiusOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """Count and share per road class within ``radius_m``, one row per class."""
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("Zero road segments found within "), F.col("radius_m").cast("string"),
        F.lit("m. This may be an undeveloped area or an area with limited road mapping."),
    )
    accepted = accepted_points(points, "road_count_by_class", limits=options.limits)
    return share_answers(
        accepted,
        only_roads(around(segments, accepted, options.prefilter)),
        F.coalesce("class", F.lit("unknown")),
        {"key": "road_class", "total": "total_segments"},
        suggestion,
        options,
    )


def road_surface_composition(
    points: DataFrame, segments: Layer, options: RadiusOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """Count and share per first surface value within ``radius_m``."""
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("Zero road segments found within "), F.col("radius_m").cast("string"),
        F.lit("m. Cannot compute surface composition for an area with no roads."),
    )
    surface = shaping.first(F.col("road_surface"))["value"]
    accepted = accepted_points(points, "road_surface_composition", limits=options.limits)
    return share_answers(
        accepted,
        only_roads(around(segments, accepted, options.prefilter)),
        F.coalesce(surface, F.lit("unknown")),
        {"key": "surface", "total": "total_segments"},
        suggestion,
        options,
    )


def nearest_road_of_class(
    points: DataFrame, segments: Layer, options: RadiusOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """The closest segment of a road class within ``max_radius_m`` (5000 when absent)."""
    accepted = accepted_points(points, "nearest_road_of_class", limits=options.limits).drop("include_closed")
    with_geometry = "include_geometry" in points.columns
    site = [c for c in accepted.columns if c != "query_id"]
    flags = F.col("road_flags")
    keep = {
        "name": F.col("names.primary"),
        "road_surface": shaping.first(F.col("road_surface"))["value"],
        "road_lat": F.col("rep_y"),
        "road_lng": F.col("rep_x"),
        "is_bridge": shaping.has_flag(flags, "is_bridge"),
        "is_tunnel": shaping.has_flag(flags, "is_tunnel"),
        "is_link": shaping.has_flag(flags, "is_link"),
    }
    if with_geometry:
        keep |= {"geom_type": F.col("geom_type"), "parts": F.col("parts")}
    best = radius_nearest(
        accepted.select(*site).distinct(),
        only_roads(around(segments, accepted, options.prefilter)),
        keep,
        F.lit(1),
        1,
        Criteria(match={"road_class": F.col("class")}),
        options,
    ).withColumn("found", F.lit(True))
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("No "), F.col("road_class"), F.lit(" road found within "),
        F.col("radius_m").cast("string"),
        F.lit("m. Try increasing max_radius_m or use a more common road class."),
    )
    shape = {
        "query_id": F.col("query_id"),
        "query_lat": F.col("lat"),
        "query_lng": F.col("lng"),
        "max_radius_m": F.col("radius_m"),
        "road_class": F.col("road_class"),
        "count": F.coalesce("count", F.lit(0)),
        "id": F.col("id"),
        "name": F.col("name"),
        "road_surface": F.col("road_surface"),
        "distance_m": whole_metres(F.col("distance")),
        "lat": F.bround("road_lat", 7),
        "lng": F.bround("road_lng", 7),
        "is_bridge": F.col("is_bridge"),
        "is_tunnel": F.col("is_tunnel"),
        "is_link": F.col("is_link"),
    }
    if with_geometry:
        shape |= shaping.geometry_columns(
            F.col("include_geometry"),
            shaping.GEOMETRY_NOTE,
            options.limits.geometry_text_cap,
        )
    made = answer_points(accepted, best, site, suggestion).select(
        *[c.alias(n) for n, c in shape.items()], "suggestion"
    )
    return with_data_version(made, options.data_version)
