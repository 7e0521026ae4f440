"""Each stage of the pipeline against a plain version of its decision."""

import re

import corpus_pipeline
from tests.llm.test_similar import groups
from weftgraph.llm import bpe


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs.toPandas()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out = docs.toPandas()
        if name != "tokens":
            assert docs.columns == columns
        if name == "language":
            assert set(out["doc_id"]) == set(kept["doc_id"][kept["text"].map(lambda t: any(map(str.isalpha, t or "")))])
        elif name == "near_dedup":
            assert set(out["doc_id"]) == groups(kept[["doc_id", "text"]].itertuples(index=False))
        elif name == "secret_scan":
            assert len(out) == len(kept)
            secret = re.compile(r'(?i)(token = ")[0-9a-f]{40}"')
            want = {i: secret.sub(r'\1[secret]"', t) for i, t in zip(kept["doc_id"], kept["text"])}
            assert dict(zip(out["doc_id"], out["text"])) == want
        elif name == "mix":
            assert set(out["doc_id"]) <= set(kept["doc_id"]) and out.groupby("doc_id").size().max() <= 2
        else:
            coder = bpe.WordBpe(open(bpe.default_vocabulary()).read())
            assert len(out) == len(kept) and all(coder.encode(t).tolist() == list(i) for t, i in zip(out["text"].head(50), out["ids"].head(50)))
        kept = out


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty texts, repeats, ties, further columns with clashing names, and an empty table."""
    from tests.llm.test_edge_cases import ROWS

    docs = spark.createDataFrame([(*r, "old", "old") for r in ROWS], "doc_id long, text string, lang string, source string, ids string, _row string")
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.limit(0)):
            out = stage(spark, d, sf_dir)
            rows = out.collect()
            assert (name == "tokens") or out.columns == docs.columns
            if d is not docs:
                assert not rows
            elif name == "language":
                assert {r["doc_id"] for r in rows} <= {1, 2, 6, 7, 9, None} and all(r["text"] for r in rows)
            elif name == "near_dedup":
                assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 3, 6, 7, 8] and sum(r["doc_id"] is None for r in rows) == 2
            elif name in ("secret_scan", "tokens"):
                assert len(rows) == len(ROWS)
