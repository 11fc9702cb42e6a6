"""Columns of any name come back as they were: dotted ones, and those named like what an operator adds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import htmltext, language, neardup, quality, toxicity

ADDED = ["a.b", "c d", "`q`", "score", "lang_pred", "main_text", "predicted", "distance", "n_words", "class_id", "_row", "row", "word"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"some words of document number {k // 2} that go on for a little while and then end here", "en", "s", 10) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.select("*", *(F.lit(f"own {c}").alias(c) for c in ADDED))


def own(df, *replaced):
    rows = df.collect()
    assert rows
    for r in rows:
        got = r.asDict()
        assert all(got[c] == f"own {c}" for c in ADDED if c not in replaced)
    return len(rows)


def test_operators(docs):
    assert own(neardup.keep_one_of_each_class(docs)) == 20
    assert own(quality.quality_rules(docs), "distance", "n_words") == 40
    assert own(language.predict_languages(docs, language.fit_languages(docs)), "score", "lang_pred") == 40
    assert own(toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, docs.select("doc_id", F.lit(0).alias("toxic")))), "score", "predicted") == 40
    assert own(htmltext.extract_text(docs.withColumn("html", F.col("text"))), "main_text") == 40


def test_stages(spark, docs, tmp_path):
    docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        if stage is not corpus_pipeline.toxicity:
            assert own(out) > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
