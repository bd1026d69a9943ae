"""The corpus pipeline stage by stage."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from timeweave.llm import decontam, secrets
from timeweave.llm.common import materialize

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        sizes.append(out.count())
        docs = out
    assert sizes[0] >= sizes[1] > sizes[2] > sizes[3] == sizes[4] > 0.8 * sizes[0]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.leaks(docs, bench).count() == 0
    assert not [r for r in docs.select("text").collect() if secrets.base_spans(r["text"] or "")]
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() > 0 and {"shard", "slot", "doc_ids", "text"} <= set(mixed.columns)


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    if os.path.isdir(SF):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stages_keep_columns_of_any_name(spark):
    clash = ["score", "lang_pred", "bits_per_byte", "_text", "_id", "_cuts", "kept", "component_id", "_leak", "gain", "text_hash", "row", "cuts"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).selectExpr("*", *(f"'x' as `{c}`" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), name)
        assert set(clash) < set(docs.columns) and docs.where("score != 'x' or kept != 'x'").count() == 0
    assert docs.count() > 0 and corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
