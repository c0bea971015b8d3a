"""The pipeline's stages, each judged on its own input."""

import pytest

from tests.llm import brute
from waymark.llm.tables import stored

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        docs = stored(stage(spark, docs, SMALL))
        after = {r[0] for r in docs.select("doc_id").collect()}
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "quality_rules":
            good = {doc for doc, text in before if brute.base_quality(text)[0] >= 20}
            assert after <= good and len(after) >= 0.8 * len(good)
        elif name == "line_dedup":
            texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
            assert {d: brute.sha(t.encode()) for d, t in texts.items()} == {r[0]: r[3] for r in brute.shared_lines(before)}
        elif name == "near_copies":
            assert after == {root for _, root in brute.similar(before).values()}
        elif name == "decontamination":
            dirty = {doc for doc, _ in brute.leaks(before, items)}
            assert {doc for doc, _ in before} - after <= dirty
        else:
            assert after == {doc for doc, _ in before}
