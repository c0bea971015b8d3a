"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.plans.saved import saved

#: Rows of one key that one task may hold before the key is split.
ROWS_PER_TASK = 1_000_000

#: Large keys (narrow rows, counted) that are sent to every executor.
BROADCAST_KEYS = 10_000


def key_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, in the column ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _large_keys(sizes: DataFrame, keys: list[str], rows: int, name: str) -> DataFrame:
    """Keys with more than ``rows`` rows and the number of slices they need."""
    return sizes.where(F.col("n") > rows).select(
        *keys, F.ceil(F.col("n") / rows).cast("int").alias(name)
    )


def _slice_of(ident: list[str], slices: Column) -> Column:
    """A row's slice: a hash of its identifying columns, so that a recomputed task puts
    it in the same place."""
    return F.pmod(F.xxhash64(*ident), slices.cast("bigint")).cast("int")


def _every(slices: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), slices - 1))


class _Slices:
    """How often large keys are cut: a stored table of keys and slice counts.

    Few keys are broadcast.  Many meet the rows in a join that is itself cut: rows by their
    hash, and every key repeated for each piece."""

    def __init__(self, table: DataFrame, keys: list[str], counts: list[str]):
        self.keys, self.counts = keys, counts
        largest = F.max(F.greatest(*counts) if len(counts) > 1 else F.col(counts[0]))
        self.number, self.most = table.agg(F.count(F.lit(1)), largest).first()
        # most tables have no large key; those that have are read by both sides
        self.table = saved(table) if self.number else table

    def onto(self, df: DataFrame, ident: list[str]) -> DataFrame:
        """Add the slice counts of each row's key, 1 where it is not cut."""
        if self.number <= BROADCAST_KEYS:
            sized = df.join(F.broadcast(self.table), self.keys, "left")
        else:
            table = self.table.withColumn("_piece", _every(F.lit(self.most)))
            dealt = df.withColumn("_piece", _slice_of(ident, F.lit(self.most)))
            sized = dealt.join(table, [*self.keys, "_piece"], "left").drop("_piece")
        return sized.withColumns({c: F.coalesce(c, F.lit(1)) for c in self.counts})


def balanced_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: list[str],
    right_id: list[str],
    rows_per_task: int = ROWS_PER_TASK,
    left_sizes: DataFrame | None = None,
    right_sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner join on ``keys`` in which large keys are cut on both sides; see
    :func:`balanced_sides`."""
    sides = balanced_sides(
        left, right, keys, left_id, right_id, rows_per_task, left_sizes, right_sizes
    )
    return sides[0].join(sides[1], sides[2]).drop("_sl", "_sr")


def balanced_sides(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: list[str],
    right_id: list[str],
    rows_per_task: int = ROWS_PER_TASK,
    left_sizes: DataFrame | None = None,
    right_sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join on ``keys``, large keys cut, and the keys they meet by.

    The sizes of keys are counted first, unless they are passed in as tables of
    :func:`key_sizes` form.

    A key with ``m`` slices on the left and ``n`` on the right becomes ``m * n`` keys:
    every left row goes to one of the ``m`` slices and is repeated for the ``n`` slices
    of the other side, and the reverse.  Each pair of rows meets exactly once.
    """
    sizes = [
        key_sizes(df, keys) if given is None else given
        for df, given in ((left, left_sizes), (right, right_sizes))
    ]
    large = _large_keys(sizes[0], keys, rows_per_task, "_m").join(
        _large_keys(sizes[1], keys, rows_per_task, "_n"), keys, "full"
    )
    slices = _Slices(large.na.fill(1, ["_m", "_n"]), keys, ["_m", "_n"])
    if not slices.number:
        return left, right, keys

    def cut(df: DataFrame, ident: list[str], own: str, other: str, mine: str, theirs: str):
        sized = slices.onto(df, ident).withColumn(mine, _slice_of(ident, F.col(own)))
        return sized.withColumn(theirs, _every(F.col(other))).drop("_m", "_n")

    cut_left = cut(left, left_id, "_m", "_n", "_sl", "_sr")
    cut_right = cut(right, right_id, "_n", "_m", "_sr", "_sl")
    return cut_left, cut_right, [*keys, "_sl", "_sr"]


def balanced_attach(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_id: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Left join in which keys with many rows on the left are cut: their rows are dealt
    into slices, and what belongs to the key on the right is repeated for each."""
    large = _large_keys(key_sizes(left, keys), keys, rows_per_task, "_m")
    slices = _Slices(large, keys, ["_m"])
    if not slices.number:
        return left.join(right, keys, "left")
    dealt = slices.onto(left, left_id).withColumn("_s", _slice_of(left_id, F.col("_m")))
    repeated = slices.onto(right, keys).withColumn("_s", _every(F.col("_m")))
    return dealt.drop("_m").join(repeated.drop("_m"), [*keys, "_s"], "left").drop("_s")
