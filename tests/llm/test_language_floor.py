"""The floor of the language stage counts all labelled texts."""

from weftgraph.llm import langid


def test_floor_counts_every_score(spark):
    """30 of 10,000 are weak; a sample of 1,500 of each language need not meet them."""
    scored = spark.range(10000).selectExpr("CASE WHEN id < 30 THEN 0.1 + id / 1000 ELSE 0.9 END AS score")
    assert abs(langid.floor_of(scored) - 0.109) < 1e-12
    assert langid.floor_of(scored, miss=0.003) == 0.1 + 29 / 1000
    assert langid.floor_of(scored, miss=0.0031) == 0.5
    assert langid.floor_of(scored.limit(0)) == 0.5
