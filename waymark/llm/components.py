"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.tables import stored

_MAX_ROUNDS = 60


def _with_least(links: DataFrame) -> DataFrame:
    """Links both ways (u, v) with the least node among u and its neighbours."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("of")).drop("of")


def components(links: DataFrame) -> DataFrame:
    """Nodes of ``links`` (u bigint, v bigint) with the least node they reach: node, root.

    Each round hangs larger neighbours, then smaller ones, under the least neighbour; it ends
    when all links point to roots. Every round starts from stored rows.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = stored(links.distinct())
    for _ in range(_MAX_ROUNDS):
        large = _with_least(links).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "of")
        small = large.join(least, F.col("u") == F.col("of")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        links = stored(small.select("e.*").filter("u <> v").distinct())
        inner = links.select(F.col("v").alias("u")).distinct()
        if links.join(inner, "u", "left_semi").isEmpty() and _single(links):
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
    raise RuntimeError("components did not settle")


def _single(links: DataFrame) -> bool:
    return links.groupBy("u").count().filter("count > 1").isEmpty()
