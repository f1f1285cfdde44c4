"""Each stage of the corpus pipeline on its own input."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = corpus_pipeline.quality(spark, docs, SF)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum((i in kept) == bool(q) for i, q in labels.items()) / len(labels) > 0.95
    once = corpus_pipeline.exact_dedup(spark, docs, SF).collect()
    assert len({"".join(r.text.split()) for r in docs.collect()}) == pytest.approx(len(once), abs=1)
    clean = corpus_pipeline.decontamination(spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() < docs.count()
