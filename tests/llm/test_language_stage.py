"""The language stage: what the network can't tell goes, and labels are not needed."""

import corpus_pipeline
import numpy as np


def test_prediction_takes_effect(spark, sf_dir):
    rng = np.random.default_rng(5)
    alphabets = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}
    text = lambda letters, k: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(k))
    rows = [(i, text(alphabets[lang], 40), lang) for i, lang in enumerate(list(alphabets) * 300)]
    mixed = [(5000 + i, " ".join(text(a, 12) for a in alphabets.values()), None) for i in range(20)]
    docs = spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string")
    out = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert out == {i for i, _, _ in rows}


def test_no_labels(spark, sf_dir):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 34", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    out = corpus_pipeline.language(spark, docs, sf_dir)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 4}
