"""The registered queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.bpe import encoded
from waymark.llm.bwt import drop_repeated_bytes
from waymark.llm.centroids import clusters
from waymark.llm.collocations import collocations
from waymark.llm.context_tree import scores
from waymark.llm.decontaminate import leaks
from waymark.llm.jaccard import similar_documents
from waymark.llm.kneser_ney import quality
from waymark.llm.licenses import licenses
from waymark.llm.line_dedup import drop_shared_lines
from waymark.llm.secrets import secrets
from waymark.llm.simhash import near_duplicates
from waymark.llm.surrogates import pseudonymised


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(_table(spark, sf_dir, "documents")).drop("kept_text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(_table(spark, sf_dir, "documents"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(_table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(_table(spark, sf_dir, "documents"), b"surrogates of the query")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(_table(spark, sf_dir, "documents"), keep_ids=False)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(_table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_decontamination, op3_line_dedup, op4_secret_scan, op5_license_scan, op6_context_tree,
        op7_ngram_jaccard, op8_suffix_dedup, op9_pii_surrogates, op10_byte_bpe, op11_simhash, op12_centroids,
        op13_collocations,
    )
}
