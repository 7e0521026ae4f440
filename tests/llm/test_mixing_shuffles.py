"""How often the mix shuffles whole rows."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import mixing
from weftgraph.llm.common import n_words


def whole_rows(df, capsys):
    """Exchanges of the plan through which texts go, be it inside of a struct."""
    df.explain("formatted")
    found = re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*?)\]\n", capsys.readouterr().out)
    assert found
    return sum(bool(re.search(r"(text|_row|_doc)#", f)) for f in found)


def test_whole_rows_are_shuffled_once(spark, sf_dir, capsys):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert whole_rows(corpus_pipeline.mix(spark, docs, sf_dir), capsys) == 1


def test_mixed_by_ranges_equals_one_order(spark, monkeypatch):
    """Ranges of three rows, sources that are null or empty, against the running sum of each source."""
    monkeypatch.setattr(mixing, "BLOCK", 3)
    rows = [(i, [None, "", "b", "a", "none"][i % 5], "w " * (i % 7 if i % 5 < 4 else 0)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = mixing.mix_sources(docs, n_words(F.col("text"))).toPandas()
    assert len(out) == 200 and (out["taken"] <= 2 * out["size"]).all()
    by = out.groupby(out["source"].fillna("null"))
    assert (abs(by["taken"].sum() - by["target"].first()) <= 1).all() and (by["size"].sum() == by["source_size"].first()).all()
    cut = out[(out["taken"] % out["size"].where(out["size"] > 0, 1)) > 0]
    assert cut.groupby(cut["source"].fillna("null")).size().max() <= 1
