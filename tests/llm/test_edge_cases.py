"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import bpe, bytebpe, langid, media, merkle, mixing, mixlm, periodic, quality, rules, secrets, sharding, simhash
from weftgraph.llm.common import WORD, n_words

KEY = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"
ROWS = [
    (1, "the cat sat on the mat and the dog ran off to the sea", "en", "a"),
    (2, "der hund und die katze sind auf der strasse und schlafen", "de", "a"),
    (3, None, "en", "b"),
    (4, "", None, None),
    (5, " \t\n", "de", "b"),
    (6, f'so token = "{KEY}" is here', "en", None),
    (6, f'so token = "{KEY}" is here', "en", None),
    (None, "no number but some words in it", "en", "c"),
    (None, None, None, None),
    (7, "long " * 30000 + "end.\n", "en", "a"),
    (8, "12345 !!! ...", None, "c"),
    (9, "THE CAT sat on the mat and the dog ran off to the sea", "en", "a"),
]
EXTRA = ["score", "shard", "size", "taken", "lang_pred", "kept", "ids", "decoded", "_row", "n_words", "predicted", "component_id", "error", "_key", "_p", "_m", "_in", "_text", "_tile", "_named", "_made", "_ids", "train", "_salt"]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(f"old {c}") for c in EXTRA}).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


OPERATORS = {
    "langid": lambda d: langid.predict(d, langid.learn(d, epochs=1)),
    "rules": rules.judge,
    "simhash": simhash.near_duplicates,
    "lm": lambda d: mixlm.lm_scores(d, F.lit(True)),
    "secrets": secrets.scan_secrets,
    "redact": secrets.redact_secrets,
    "mixing": lambda d: mixing.mix_sources(d, n_words(F.col("text"))),
    "sharding": sharding.shuffle_into_shards,
    "media": media.texts_as_media,
    "tiles": lambda d: media.media_tiles(d.withColumn("media", F.col("text").cast("binary"))),
    "similar": lambda d: simhash.drop_near_duplicates(d, n=5, least=0.8),
    "quality": lambda d: quality.score_quality(d, quality.fit_quality(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "bpe": lambda d: bpe.bpe_decode(bpe.bpe_encode(d, bpe.default_vocabulary()), bpe.default_vocabulary()),
    "dedup": simhash.drop_near_duplicates,
    "merkle": lambda d: merkle.merkle_manifest(d, ["doc_id", "text", "source"], "lang", "doc_id"),
    "runs": lambda d: periodic.periodic_runs(d.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))),
    "bytes": lambda d: bytebpe.byte_bpe_decode(bytebpe.byte_bpe_encode(d, bytebpe.default_vocabulary()), bytebpe.default_vocabulary()),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(docs, name):
    rows = OPERATORS[name](docs).collect()
    if name in ("dedup", "similar"):
        assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [1, 2, 3, 6, 7, 8]
    elif name == "secrets":
        assert {(r["doc_id"], r["start"], r["value"]) for r in rows if r["score"] >= 0.5} <= {(6, 12, KEY)}
    else:
        assert len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, name):
    assert OPERATORS[name](empty).count() == 0


def test_defined_results(docs):
    lang = {r["doc_id"]: r for r in OPERATORS["langid"](docs).collect()}
    assert {i for i in lang if lang[i]["lang_pred"] == "und"} >= {3, 4, 5, 8} and lang[3]["score"] == 0 and lang[1]["n_chars"] is not None
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()}
    assert prints[3] == prints[4] == prints[5] == "0" * 16 and prints[1] == prints[9]
    judged = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    assert judged[3]["n_words"] == 0 and judged[3]["base_failed"] and not judged[3]["kept"] and judged[7]["n_repeat_words"] >= 30000
    tokens = {r["doc_id"]: r for r in OPERATORS["bpe"](docs).collect()}
    assert tokens[3]["ids"] == [] and tokens[3]["decoded"] == "" and tokens[7]["n_tokens"] == 30002
    mixed = {r["doc_id"]: r for r in OPERATORS["mixing"](docs).collect()}
    assert mixed[3]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in mixed.values())
    sharded = sharding.shuffle_into_shards(docs, 5).collect()
    by = {}
    for r in sharded:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sorted(map(len, by.values())) == [2, 2, 2, 3, 3] and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_redaction_takes_the_secret_alone(spark):
    text = f'on token = "{KEY}" we go antidisestablishmentarianism 1234567890123456'
    many = [(i, f'on token = "{KEY[i:]}{KEY[:i]}" we go', "") for i in range(20)] + [(100 + i, f"plain antidisestablishmentarianism{'abcde'[i % 5]} 123456789012345{i % 10}", "") for i in range(20)]
    docs = spark.createDataFrame([(500, text, ""), *many], "doc_id long, text string, source string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert out[500] == text.replace(KEY, "[secret]")
    assert out[103] == many[23][1]
