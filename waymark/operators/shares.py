"""Composition answers: counts and shares per group around a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.radius import RadiusOptions
from waymark.plans.results import answer_points, composition, with_data_version
from waymark.plans.tiles import radius_counts


def share_answers(
    accepted: DataFrame,
    layer: DataFrame,
    group: Column,
    names: dict[str, str],
    suggestion: Column,
    options: RadiusOptions,
) -> DataFrame:
    """One row per point and group with ``count`` and ``percentage``.

    ``names`` gives the output names of the group (``key``) and of the ``total``.
    Points without matches keep one row with total 0.
    """
    site = ["lat", "lng", "radius_m"]
    counts = radius_counts(
        accepted.select(*site).distinct(), layer, group, options=options
    )
    shares = composition(counts, site).withColumn("found", F.lit(True))
    made = answer_points(accepted, shares, site, suggestion).select(
        "query_id",
        F.col("lat").alias("query_lat"),
        F.col("lng").alias("query_lng"),
        "radius_m",
        F.coalesce("total", F.lit(0)).alias(names["total"]),
        F.col("key").alias(names["key"]),
        F.coalesce("count", F.lit(0)).alias("count"),
        "percentage",
        "suggestion",
    )
    return with_data_version(made, options.data_version)
