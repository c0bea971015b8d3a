"""Land use: parcels at a point, composition and search around a point."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.functions import shaping
from waymark.functions.geodesy import whole_metres
from waymark.operators.screening import accepted_points
from waymark.operators.shares import share_answers
from waymark.plans import contains
from waymark.plans.outlines import OutlinedLayer
from waymark.plans.radius import DEFAULT_OPTIONS, Criteria, RadiusOptions
from waymark.plans.results import answer_lists, answer_points, with_data_version
from waymark.plans.tiles import radius_nearest
from waymark.sources.manifest import Layer, around, under


def land_use_at_point(
    points: DataFrame,
    parcels: Layer | OutlinedLayer,
    options: contains.ContainsOptions = contains.DEFAULT_OPTIONS,
) -> DataFrame:
    """Every parcel that encloses the point, overlapping ones included."""
    accepted = accepted_points(points, "land_use_at_point").select(
        "query_id", "lat", "lng"
    )
    site = ["lat", "lng"]
    keep = {
        "id": F.col("id"),
        "subtype": F.col("subtype"),
        "class": F.col("class"),
        "names_primary": F.col("names.primary"),
        "source": shaping.first(F.col("sources"))["dataset"],
        "found": F.lit(True),
    }
    sites = accepted.select(*site).distinct()
    found = contains.contained(sites, under(parcels, sites), keep, options)
    # Wording of the suggestion.
    suggestion = F.lit(
        "No land use designation found for this point. The area may lack land use "
        "mapping coverage, or the point may be in water/unmapped territory."
    )
    if isinstance(found, contains.Lists):
        answers = answer_lists(
            accepted, found.sites, found.rows, site, suggestion, options.broadcast_site_cells, options.rows_per_task
        )
    else:
        counted = found.withColumn("count", F.count(F.lit(1)).over(W.partitionBy(*site)))
        answers = answer_points(accepted, counted, site, suggestion)
    made = answers.select(
        "query_id",
        F.col("lat").alias("query_lat"),
        F.col("lng").alias("query_lng"),
        F.coalesce("count", F.lit(0)).alias("count"),
        "id",
        "subtype",
        "class",
        "names_primary",
        "source",
        "suggestion",
    )
    return with_data_version(made, options.data_version)


def land_use_composition(
    points: DataFrame, parcels: Layer, options: RadiusOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """Count and share per subtype within ``radius_m``; a null subtype stays null."""
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("Zero land use parcels found within "), F.col("radius_m").cast("string"),
        F.lit("m. This area may lack land use mapping coverage. Try increasing radius."),
    )
    accepted = accepted_points(points, "land_use_composition", limits=options.limits)
    return share_answers(
        accepted,
        around(parcels, accepted, options.prefilter),
        F.col("subtype"),
        {"key": "subtype", "total": "total_parcels"},
        suggestion,
        options,
    )


def land_use_search(
    points: DataFrame, parcels: Layer, options: RadiusOptions = DEFAULT_OPTIONS
) -> DataFrame:
    """Parcels of a subtype within ``radius_m``, nearest first, up to ``limit``."""
    accepted = accepted_points(points, "land_use_search", limits=options.limits).drop("include_closed")
    with_geometry = "include_geometry" in points.columns
    site = [c for c in accepted.columns if c != "query_id"]
    keep = {
        "class": F.col("class"),
        "names_primary": F.col("names.primary"),
        "parcel_lat": F.col("rep_y"),
        "parcel_lng": F.col("rep_x"),
    }
    if with_geometry:
        keep |= {"geom_type": F.col("geom_type"), "parts": F.col("parts")}
    top = radius_nearest(
        accepted.select(*site).distinct(),
        around(parcels, accepted, options.prefilter),
        keep,
        F.col("limit"),
        options.limits.max_results,
        Criteria(match={"subtype": F.col("subtype")}),
        options,
    ).withColumn("found", F.lit(True))
    # Wording of the suggestion.
    suggestion = F.concat(
        F.lit("No "), F.col("subtype"), F.lit(" land use found within "),
        F.col("radius_m").cast("string"),
        F.lit(
            "m. Try increasing radius or use land_use_composition to see what land use "
            "types exist in this area."
        ),
    )
    shape = {
        "query_id": F.col("query_id"),
        "query_lat": F.col("lat"),
        "query_lng": F.col("lng"),
        "radius_m": F.col("radius_m"),
        "subtype": F.col("subtype"),
        "count": F.coalesce("count", F.lit(0)),
        "rank": F.col("rank"),
        "id": F.col("id"),
        "class": F.col("class"),
        "names_primary": F.col("names_primary"),
        "lat": F.bround("parcel_lat", 7),
        "lng": F.bround("parcel_lng", 7),
        "distance_m": whole_metres(F.col("distance")),
    }
    if with_geometry:
        shape |= shaping.geometry_columns(
            F.col("include_geometry"),
            shaping.GEOMETRY_NOTE,
            options.limits.geometry_text_cap,
        )
    made = answer_points(accepted, top, site, suggestion).select(
        *[c.alias(n) for n, c in shape.items()], "suggestion"
    )
    return with_data_version(made, options.data_version)
