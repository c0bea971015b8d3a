"""From matches to answers: top-k, shares, and rows for points without any match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waymark.plans.saved import saved
from waymark.plans.skew import ROWS_PER_TASK, balanced_attach, balanced_join


def nearest(
    pairs: DataFrame, site: list[str], k: Column, most: int, ties: list[Column] | None = None
) -> DataFrame:
    """The ``k`` nearest rows of each site, ``k <= most``, numbered in ``rank``, with
    their number in ``count``.

    Ordered by distance, hence also by whole metres, then by ``id``, then by ``ties``: unless
    given, a hash of all that was kept of a row.  The constant bound lets Spark drop rows
    beyond it before the shuffle.
    """
    if ties is None:
        rest = [c for c in pairs.columns if c not in (*site, "distance", "id")]
        ties = [F.xxhash64(*rest)] if rest else []
    order = W.partitionBy(*site).orderBy("distance", "id", *ties)
    ranked = pairs.withColumn("rank", F.row_number().over(order))
    top = ranked.where(F.col("rank") <= most).where(F.col("rank") <= k)
    return top.withColumn("count", F.count(F.lit(1)).over(W.partitionBy(*site)))


def composition(counts: DataFrame, site: list[str]) -> DataFrame:
    """Add ``total`` and ``percentage`` to the counts of each site's groups."""
    total = F.sum("count").over(W.partitionBy(*site))
    return _with_tenths(
        counts.withColumn("total", total),
        F.col("count") / F.col("total") * 100,
        "percentage",
    )


def _with_tenths(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Round a non-negative double to one decimal by its exact binary value, ties to
    even.  (``bround`` rounds the shortest decimal text instead: 2.45, which is stored
    slightly above, would become 2.4.)

    The value lies above the midpoint ``k + 0.5`` tenths when ``20 v > 2k + 1``.  That
    product is formed as ``16 v + 4 v``, two exact terms, with the rounding error of
    their sum carried along.
    """
    v, k = F.col("_v"), F.col("_k")
    df = df.withColumn("_v", value).withColumns(
        {"_k": F.floor(v * 10), "_s": v * 16 + v * 4}
    )
    lost = v * 4 - (F.col("_s") - v * 16)
    df = df.withColumn("_above", F.col("_s") - (2 * k + 1) + lost)
    up = (F.col("_above") > 0) | ((F.col("_above") == 0) & (k % 2 == 1))
    return df.withColumn(out, (k + F.when(up, 1).otherwise(0)) / 10.0).drop(
        "_v", "_k", "_s", "_above"
    )


def with_data_version(answers: DataFrame, version: str | None) -> DataFrame:
    """Note the release the layers came from, if given, in every row."""
    return answers if version is None else answers.withColumn("data_version", F.lit(version))


def answer_points(
    points: DataFrame,
    matches: DataFrame,
    site: list[str],
    suggestion: Column,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Attach matches to every point that asked for them; popular sites are cut.

    Points without a match keep one row with null result columns and ``suggestion``;
    for all others ``suggestion`` is null.  ``matches`` must have a ``found`` column
    that is never null.
    """
    ident = [c for c in points.columns if c not in site] or site
    joined = balanced_attach(points, matches, site, ident, rows_per_task)
    return joined.withColumn(
        "suggestion", F.when(F.col("found").isNull(), suggestion)
    ).drop("found")


def answer_lists(
    points: DataFrame,
    sites: DataFrame,
    lists: DataFrame,
    site: list[str],
    suggestion: Column,
    broadcast_points: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """What :func:`answer_points` gives, from matches as lists of site numbers, with their number
    per site in ``count``, null where there are none.

    ``sites`` has ``site`` and ``_site``, ``lists`` the matches and ``_at``, an array of
    ``_site``; both are stored.  The numbers are counted first, and the points with matches sent
    to the lists: a match becomes a row only where it is an answer."""
    pairs = lists.withColumn("_site", F.explode("_at")).drop("_at", "found")
    numbers = lists.select(F.explode("_at").alias("_site")).groupBy("_site").agg(F.count(F.lit(1)).alias("count"))
    ident = [c for c in points.columns if c not in site] or site
    met = sites.join(numbers, "_site")
    asked = saved(balanced_attach(points, met, site, ident, rows_per_task))
    some = asked.where(F.col("count").isNotNull())
    if some.count() <= broadcast_points:
        answers = pairs.join(F.broadcast(some), "_site")
    else:
        matches = [c for c in pairs.columns if c != "_site"]
        answers = balanced_join(some, pairs, ["_site"], ident, matches, rows_per_task)
    none = asked.where(F.col("count").isNull()).withColumn("suggestion", suggestion)
    return answers.unionByName(none, allowMissingColumns=True).drop("_site")
