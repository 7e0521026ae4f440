"""The pipeline's first stage gets few texts at a time, so that Python workers stay small."""

import numpy as np

import corpus_pipeline
from weftgraph.llm import langid

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_language_takes_small_batches(spark, monkeypatch):
    seen, stored, before = [], corpus_pipeline.stored, spark.conf.get(KEY)
    monkeypatch.setattr(corpus_pipeline, "stored", lambda df: seen.append(int(spark.conf.get(KEY))) or stored(df))
    monkeypatch.setattr(langid, "learn", lambda docs: langid.ByteGru.fresh(["a", "b"], langid.HIDDEN, np.random.default_rng(1)))
    docs = spark.range(1200).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'a' AS lang")
    got = corpus_pipeline.language(spark, docs, "").select("doc_id").distinct().count()
    assert seen and max(seen) <= 1000 and spark.conf.get(KEY) == before
    assert got >= 1198  # all but a thousandth
