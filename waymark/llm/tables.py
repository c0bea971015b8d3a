"""Helpers around Spark tables: cutting lineage, keeping rows, probing sharded arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.blocks import one_array

#: Largest size of arrays, measured on the stored table, that every task may hold at once.
BROADCAST_BYTES = 64 << 20
#: Bytes of text that one group of documents should hold.
CHUNK_BYTES = 12 << 20
#: Entries of one shard of an index.
SHARD_ROWS = 250_000
#: Groups of documents that ask one copy of a shard: more groups get more copies.
COPY_CHUNKS = 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = "file://" + tempfile.mkdtemp(prefix="waymark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(frame: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: later work starts from files."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: Session settings for batches that cross into Python: rows, and bytes.
_BATCH_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20,
}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables stored meanwhile pass through Python in batches of a few megabytes of text.

    A single longer text is still one batch. The session's own settings return afterwards.
    """
    before = {name: spark.conf.get(name) for name in _BATCH_SETTINGS}
    for name, value in _BATCH_SETTINGS.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def picked(docs: DataFrame, id_col: str, text_col: str, *more: str, keep_rows: bool = False) -> DataFrame:
    """Columns ``_id`` (bigint), ``_text``, ``_<more>`` as text and, on wish, ``row`` (the other columns).

    Other columns can have any names: they are left out or sit inside ``row``.
    """
    quoted = lambda name: F.col(f"`{name}`")
    columns = [quoted(id_col).cast("bigint").alias("_id"), quoted(text_col).cast("string").alias("_text")]
    columns += [quoted(name).cast("string").alias(f"_{name}") for name in more]
    if keep_rows:
        columns.append(F.struct(*[quoted(name) for name in docs.columns if name != text_col]).alias("row"))
    return docs.select(*columns)


def row_fields(frame: DataFrame) -> list[T.StructField]:
    """The field ``row`` if the frame has it, for the schema of a result that keeps rows."""
    return [field for field in frame.schema.fields if field.name == "row"]


def schema(*pairs: str, rows: DataFrame | None = None) -> T.StructType:
    """Schema from ``"name type"`` texts, plus the kept rows of a frame."""
    made = T.StructType.fromDDL(", ".join(pairs))
    return T.StructType(made.fields + (row_fields(rows) if rows is not None else []))


def groups_for(docs: DataFrame, group_bytes: int) -> int:
    """How many groups of about ``group_bytes`` the texts make.

    Small tables still keep all cores busy, but not with ever smaller groups.
    """
    size = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(-(-size // group_bytes), min(2 * parts, -(-4 * size // group_bytes)), 1)


def chunked(docs: DataFrame, chunks: int) -> DataFrame:
    """The frame dealt by a hash of id and text into ``chunks`` groups ``_chunk``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunk = F.pmod(F.xxhash64("_id", "_text"), F.lit(chunks)).cast("int")
    return docs.withColumn("_chunk", chunk).repartition(max(parts, chunks // 3), "_chunk")


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(shards)).astype(np.int32)


def shard_column(key: str, shards: int):
    return F.expr(f"cast(shiftrightunsigned({key}, 33) % {shards} as int)")


def shards_for(table: DataFrame) -> int:
    return -(-table.count() // SHARD_ROWS) or 1


def sorted_arrays(table: DataFrame) -> tuple[DataFrame, int]:
    """``table`` (key bigint, value double) as sharded arrays sorted by key; number of shards."""
    shards = shards_for(table)
    dealt = table.withColumn("shard", shard_column("key", shards))
    packed = dealt.groupBy("shard").applyInArrow(_pack_sorted, "shard int, keys binary, vals binary")
    return packed, shards


def _pack_sorted(group: pa.Table) -> pa.Table:
    keys = one_array(group["key"]).to_numpy(zero_copy_only=False).view(np.uint64)
    order = np.argsort(keys)
    values = one_array(group["value"]).to_numpy(zero_copy_only=False)
    return pa.table(
        {
            "shard": group["shard"][:1],
            "keys": pa.array([keys[order].tobytes()], pa.binary()),
            "vals": pa.array([values[order].tobytes()], pa.binary()),
        }
    )


def probe_sorted(shard: dict, keys: np.ndarray) -> np.ndarray:
    """Values of keys by binary search in a shard of sorted arrays; nan where missing."""
    have, values = np.frombuffer(shard["keys"], np.uint64), np.frombuffer(shard["vals"])
    at = np.minimum(np.searchsorted(have, keys[:, 0]), len(have) - 1)
    return np.where(have[at] == keys[:, 0], values[at], np.nan)


Probe = Callable[[dict, np.ndarray], np.ndarray]
Find = Callable[[np.ndarray], np.ndarray]


def _answers(held: dict, shards: int, probe: Probe, missing: float | int, keys: np.ndarray) -> np.ndarray:
    if shards == 1:
        return probe(held[0], keys) if 0 in held else np.full(len(keys), missing)
    out = np.full(len(keys), missing)
    to = shard_of(keys[:, 0], shards)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(shards + 1))
    for shard, row in held.items():
        mine = order[edges[shard] : edges[shard + 1]]
        if len(mine):
            out[mine] = probe(row, keys[mine])
    return out


def distinct_rows(keys: np.ndarray) -> np.ndarray:
    if keys.shape[1] == 1:
        return np.unique(keys[:, 0])[:, None]
    return np.unique(keys, axis=0)


def probed(
    docs: DataFrame,
    index: DataFrame,
    shards: int,
    keys_of: Callable[[pa.Table], np.ndarray],
    probe: Probe,
    missing: float | int,
    finish: Callable[[pa.Table, Find], pa.Table],
    result: T.StructType,
    width: int = 1,
    limit: int = BROADCAST_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Work through ``docs`` with answers from sharded arrays.

    ``index`` has one row per shard: ``shard`` and binary columns. ``probe`` gives one number
    for each row of a two-dimensional array of 64-bit keys (``width`` columns), whose first
    column deals the shards. ``finish`` gets rows of ``docs`` and a function from keys to numbers.

    If the stored arrays measure at most ``limit`` bytes, each task holds them all and nothing
    is shuffled. Else documents are dealt into chunks; each chunk sends its distinct keys to
    their shards, and the answers meet the chunk again. ``COPY_CHUNKS`` chunks share one copy of
    the shards, so no group grows with the number of documents.
    """
    index = stored(index)
    binaries = [c for c in index.columns if c != "shard"]
    size = index.agg(F.sum(sum(F.octet_length(c) for c in binaries))).first()[0] or 0
    if size <= limit:
        rows = {row["shard"]: {c: row[c] for c in binaries} for row in index.toArrow().to_pylist()}
        held = docs.sparkSession.sparkContext.broadcast(rows)

        def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def find(keys: np.ndarray) -> np.ndarray:
                return _answers(held.value, shards, probe, missing, keys)

            for batch in batches:
                yield from finish(pa.Table.from_batches([batch]), find).to_batches()

        return docs.mapInArrow(direct, result)

    n_chunks = groups_for(docs, chunk_bytes)
    chunks = chunked(docs, n_chunks)

    def ask(group: pa.Table) -> pa.Table:
        keys = distinct_rows(keys_of(group))
        to = shard_of(keys[:, 0], shards)
        order = np.argsort(to, kind="stable")
        found, starts = np.unique(to[order], return_index=True)
        parts = np.split(keys[order], starts[1:]) if len(found) else []
        chunk = group["_chunk"][0].as_py()
        return pa.table(
            {
                "_chunk": pa.array([chunk] * len(parts), pa.int32()),
                "shard": pa.array(found, pa.int32()),
                "asked": pa.array([part.tobytes() for part in parts], pa.binary()),
            }
        )

    def answer(asked: pa.Table, shard: pa.Table) -> pa.Table:
        held = {c: shard[c][0].as_py() for c in binaries} if shard.num_rows else None
        told = []
        for blob in asked["asked"].to_pylist():
            keys = np.frombuffer(blob, np.uint64).reshape(-1, width)
            known = probe(held, keys) if held else np.full(len(keys), missing)
            told.append(known.tobytes())
        return asked.drop_columns(["copy"]).append_column("told", pa.array(told, pa.binary()))

    def close(group: pa.Table, told: pa.Table) -> pa.Table:
        kind = np.asarray(missing).dtype
        keys = b"".join(told["asked"].to_pylist())
        values = np.frombuffer(b"".join(told["told"].to_pylist()), kind)
        rows = np.frombuffer(keys, np.uint64).reshape(-1, width)
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, np.int64)
        rows, values = rows[order], values[order]

        def find(wanted: np.ndarray) -> np.ndarray:
            if not len(rows):
                return np.full(len(wanted), missing)
            low = np.searchsorted(rows[:, 0], wanted[:, 0])
            low = np.minimum(low, len(rows) - 1)
            same = (rows[low] == wanted).all(axis=1)
            return np.where(same, values[low], missing)

        return finish(group.drop_columns(["_chunk"]), find)

    asked = chunks.groupBy("_chunk").applyInArrow(ask, "_chunk int, shard int, asked binary")
    copies = F.explode(F.sequence(F.lit(0), F.lit((n_chunks - 1) // COPY_CHUNKS)))
    asked = asked.withColumn("copy", F.expr(f"cast(_chunk div {COPY_CHUNKS} as int)"))
    copied = index.withColumn("copy", copies)
    both = asked.groupBy("shard", "copy").cogroup(copied.groupBy("shard", "copy"))
    told = both.applyInArrow(answer, "_chunk int, shard int, asked binary, told binary")
    return chunks.groupBy("_chunk").cogroup(told.groupBy("_chunk")).applyInArrow(close, result)
