"""The near_dedup stage against every pair's exact similarity."""

import corpus_pipeline
import numpy as np
from weftgraph.llm import simhash


def groups(rows, least=0.8):
    """The ids that stay, from (doc_id, text) rows, every pair compared as plain sets."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    label = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return set(label.values())


def test_stage_finds_every_pair_of_the_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    rows = docs.select("doc_id", "text").toPandas()
    assert out.columns == docs.columns
    want = groups(rows.itertuples(index=False))
    assert len(want) < rows["text"].nunique()  # near copies, not only equal texts
    assert {r.doc_id for r in out.select("doc_id").collect()} == want


def test_chains_boilerplate_and_empty_texts(spark):
    rng = np.random.default_rng(3)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 10**6, k)]
    base = word(120)
    texts = [None, "", " \n", "Short text", "short  TEXT", "short"]
    for k in range(0, 60, 4):  # each is like the next one, the ends are not alike
        texts.append(" ".join(base[k : k + 60]))
    passage = word(60)
    texts += [" ".join(passage + word(w)) for w in (10, 12, 14, 20, 40, 90) for _ in range(4)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs, n=5, least=0.8).collect()} == groups([(int(i), t) for i, t in rows])
