"""From raw documents to token ids: quality, shared lines, near copies, leaks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` stores it as Parquet
in the shared folder and hands it to the next stage. All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm.bpe import encoded
from waymark.llm.decontaminate import without_leaks
from waymark.llm.jaccard import similar_documents
from waymark.llm.kneser_ney import quality
from waymark.llm.line_dedup import drop_shared_lines
from waymark.llm.tables import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity bands."""
    kept = quality(docs, keep_rows=True).filter("kept")
    return kept.select(*[F.col("text" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others share; a document may end up empty."""
    kept = drop_shared_lines(docs, keep_rows=True)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("bigint")}
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id.

    Rows that share an id are one document and stay together; of a group without ids all stay.
    """
    found = similar_documents(docs)
    gone = found.filter("component_id is not null and not doc_id <=> component_id")
    gone = gone.select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and hashes that prove the round trip."""
    return encoded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Random walks and language models have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
