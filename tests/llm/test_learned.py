"""What learned operators say, against plain versions that use the same weights, accuracies or trees."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import langid, quality, rules, secrets
from weftgraph.llm.common import least_hashes
from weftgraph.llm.registry import QUERIES

HEX = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b"


def test_copies_take_one_place_of_a_sample(spark):
    rows = [("a", h, h) for h in range(-5, 40)] + [("a", -9, -9)] * 500 + [(None, -99, 0), ("b", 7, 7)]
    got = least_hashes(spark.createDataFrame(rows, "g string, h long, x long").repartition(4), "g", "h", 10).collect()
    assert sorted((r["g"], r["h"], r["x"]) for r in got) == [("a", h, h) for h in [-9, *range(-5, 4)]] + [("b", 7, 7)]


def plain_languages(net, text):
    """The mean of the bytes' probabilities, byte by byte."""
    w = {k: v.astype(float) for k, v in net.w.items()}
    k, total = w["u_f"].shape[1], np.zeros(len(net.langs))
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for at in range(0, len(text), langid.WINDOW):
        part, states = text[at : at + langid.WINDOW], {}
        for way, steps in (("f", range(len(part))), ("b", reversed(range(langid.WINDOW)))):
            h = np.zeros(k)
            for t in steps:
                byte = part[t] if t < len(part) else 0  # windows are filled up with zero bytes
                x, rec = w[f"in_{way}"][:, byte], w[f"u_{way}"] @ h
                z, r = sigmoid(x[:k] + rec[:k]), sigmoid(x[k : 2 * k] + rec[k : 2 * k])
                h = z * h + (1 - z) * np.tanh(x[2 * k :] + r * rec[2 * k :])
                states[way, t] = h
        for t in range(len(part)):
            e = np.exp(w["out"] @ np.concatenate([states["f", t], states["b", t]]) + w["bias"][:, 0])
            total += e / e.sum()
    return total / len(text)


def test_languages_byte_by_byte(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = langid.learn(docs.select("text", "lang"), steps=20, epochs=1)
    short = docs.where("length(text) between 1 and 700").select("doc_id", "text").limit(12)
    for r in langid.predict(short, net).collect():
        p = plain_languages(net, r["text"].encode())
        assert r["lang_pred"] == net.langs[int(p.argmax())] and math.isclose(r["score"], p.max(), abs_tol=1e-4)


def plain_posteriors(votes, prior=(0.4, 0.95), strength=5.0):
    """Expectation-maximisation text by text, without patterns."""
    n, names = len(votes), list(votes[0])
    good = [(sum(v > 0 for v in t.values()) + 0.5) / (sum(v != 0 for v in t.values()) + 1) for t in votes]
    for _ in range(200):
        share = (sum(good) + 0.5 * strength) / (n + strength)
        keep = {}
        for name in names:
            for y in (0, 1):
                at = [(g if y else 1 - g, t[name]) for g, t in zip(good, votes) if t[name]]
                begin = strength * (prior[1] if y else 1 - prior[0])
                keep[y, name] = (begin + sum(w for w, v in at if v > 0)) / (strength + sum(w for w, _ in at))
        old, good = good, []
        for t in votes:
            p = [math.log(1 - share), math.log(share)]
            for y in (0, 1):
                p[y] += sum(math.log(max(1e-12, keep[y, k] if v > 0 else 1 - keep[y, k])) for k, v in t.items() if v)
            good.append(1 / (1 + math.exp(min(700, p[0] - p[1]))))
        if max(abs(a - b) for a, b in zip(old, good)) < 1e-9:
            break
    return good


def plain_votes(text):
    """The rules by their plain meaning."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, chars, letters = max(1, len(words)), sum(map(len, words)), sum(c.isalpha() for c in text)
    windows = list(zip(words, words[1:], words[2:]))
    marked = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    top, distinct = max(map(words.count, words), default=0), len(set(words))
    symbols, upper = len(re.findall(r"[#*$%&|<>]", text)) / n, sum(c.isupper() for c in text) / max(1, letters)
    doubled = len(lines) - len(set(lines))
    vote = lambda bad, good: -1 if bad else int(good)
    return {
        "word_length": vote(chars / n < 2 or chars / n > 15, 3 <= chars / n <= 10),
        "few_symbols": vote(symbols > 0.1, symbols < 0.01),
        "letters_in_words": vote(letters < 0.75 * chars, letters > 0.9 * chars),
        "lower_case": vote(upper > 0.4, upper < 0.2),
        "new_lines": vote(doubled > 0.3 * max(1, len(lines)), doubled < 0.1 * max(1, len(lines))),
        "new_phrases": vote(len(marked) > 0.3 * n, len(marked) < 0.15 * n),
        "varied_words": vote(distinct < 3 * math.sqrt(n) and len(words) >= 20, distinct > 4.5 * math.sqrt(n)),
        "no_single_word": vote(top > 0.2 * n and len(words) >= 20, top < 0.15 * n),
    }, len(words) < 50 or 100 * len(marked) > 50 * len(words)


def test_kept_is_what_plain_rules_and_rounds_say(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    texts = {i: t for i, t in texts.items() if len(t) < 20000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in rules.judge(docs).collect()}
    told = {i: plain_votes(t) for i, t in texts.items()}
    for (i, (_, base)), p in zip(told.items(), plain_posteriors([v for v, _ in told.values()])):
        r = got[i]
        assert math.isclose(r["posterior"], p, abs_tol=1e-6)
        assert r["base_failed"] == base and (abs(p - 0.5) < 1e-6 or r["kept"] == (not base and p >= 0.5))


def test_a_rule_that_guesses_drops_nothing(spark):
    """Four rules agree, a fifth votes at random: all must pass would drop a third of the good texts."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        good = bool(rng.random() < 0.7)
        right = lambda p: int((rng.random() < p) == good) * 2 - 1
        rows.append((i, good, *[right(0.93) for _ in range(4)], 1 if rng.random() < 2 / 3 else -1))
    names = [f"r{k}" for k in range(5)]
    docs = spark.createDataFrame([(*r, 100, 0) for r in rows], ", ".join(["doc_id long", "good boolean", *[f"{n} int" for n in names], "n_words long", "n_repeat_words long"]))
    out = rules.judge_measured(docs, rules={n: F.col(n) for n in names}).toPandas()
    all_pass = (out[names] > 0).all(axis=1)
    assert out[out["good"]]["kept"].mean() > 0.97 and all_pass[out["good"]].mean() < 0.55
    assert out[~out["good"]]["kept"].mean() < 0.06
    one_fails = (out[names[:4]] > 0).all(axis=1) & (out["r4"] < 0)
    assert out[one_fails]["kept"].all() and one_fails.sum() > 300


@pytest.fixture(scope="module")
def findings(spark):
    """Secrets behind names, alone and in prose; long words, one of them behind the name of a credential."""
    word = lambda i: "".join("bcdfg"[(i // 5**k) % 5] + "aeiou"[(i // 3 + k) % 5] for k in range(8 + i % 6))
    key = lambda i: f"{(i + 1) * 0x9E3779B97F4A7C15F39CC0605CEDC834 % (1 << 160):040x}"
    prose = lambda i: " ".join("the word that stands here and there we set".split()[: i * 7 % 9])
    rows = [(i, f'{prose(i)} token = "{key(i)}" {prose(i + 1)}', "a") for i in range(40)]
    rows += [(100 + i, f"{prose(i)} {word(i)} {prose(i + 2)}, 12345678901234{i:02d} {prose(i + 5)}", "b") for i in range(60)]
    rows += [(500, f"we set {HEX} there", "a"), (501, "password: antidisestablishment and more", "b"), (502, f"the word that key: {HEX[::-1]} stands here", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_forest_by_its_trees(spark, findings):
    found = secrets.candidates(findings, F.col("source"))
    marks = secrets.dictionary(found)
    model = secrets.learn(secrets.label_findings(found), marks)

    def vote(node, row):
        while node.subtreeDepth():
            split = node.split()
            node = node.leftChild() if row[secrets.FEATURES[split.featureIndex()]] <= split.threshold() else node.rightChild()
        stats = list(node.impurityStats().stats())
        return stats[1] / sum(stats)

    rows = secrets.score(secrets.features(found, marks), model).collect()
    roots = [t._call_java("rootNode") for t in model.forest.trees]
    assert len(rows) == 40 + 120 + 3 and len(roots) == 20
    for r in rows:
        assert math.isclose(r["score"], sum(vote(t, r) for t in roots) / len(roots), abs_tol=1e-9)


def test_labels_look_at_names_and_scores_at_values(spark, findings):
    found = secrets.candidates(findings, F.col("source"))
    label = {(r["doc_id"], r["pos"]): r["label"] for r in secrets.label_findings(found).collect()}
    assert all(label[i, 0] == 1 for i in range(40)) and label[500, 0] == 0 and label[501, 0] == 1 and label[502, 0] is None
    score = {(r["doc_id"], r["pos"]): r["score"] for r in secrets.scan_secrets(findings, F.col("source")).collect()}
    assert all(score[i, 0] > 0.8 for i in range(40)) and score[502, 0] > 0.5  # no name of a credential there
    assert all(score[100 + i, k] < 0.2 for i in range(60) for k in (0, 1))  # words and numbers


def test_many_secrets_of_one_text_are_replaced(spark, findings):
    long = " é ".join(f'{"x" * (i % 5)} token = "{(i + 7) ** 31 % (1 << 160):040x}" antidisestablishment' for i in range(3000))
    docs = findings.union(spark.createDataFrame([(900, long, "a"), (901, HEX, "a"), (902, f"{HEX} {HEX}", "a")], findings.schema))
    out = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs, F.col("source")).collect()}
    assert out[900] == re.sub(r"\b[0-9a-f]{40}\b", "[secret]", long)
    for i, whole in ((901, HEX), (902, f"{HEX} {HEX}"), (100, None)):
        assert whole is None or out[i] in (whole, whole.replace(HEX, "[secret]"))
    assert out[100] == next(r["text"] for r in findings.collect() if r["doc_id"] == 100)


def plain_quality(weights, text, orders=2):
    """Tokens, n-grams and their places one by one."""
    mixed = lambda h: int(quality._mixed(np.array([h % (1 << 64)], np.uint64))[0])
    tokens, last = [], 0
    for b in text:
        kind = int(quality._KIND[b])
        if kind and kind == last:
            tokens[-1].append(b)
        elif kind:
            tokens.append([b])
        last = kind
    h = [mixed(sum((b + 1) * pow(int(quality._MUL), i, 1 << 64) for i, b in enumerate(t))) for t in tokens]
    total, count, seen, gram = 0.0, 0, set(), h
    for n in range(1, 4):
        if n > 1:
            gram = [mixed(g * 31 + x + n) for g, x in zip(gram, h[n - 1 :])]
        for g in gram:
            if n <= orders:
                total, count = total + float(weights[g >> (64 - quality.HASH_BITS)]), count + 1
            if n == 3 and g in seen:
                total, count = total + float(weights[quality.REPEAT]), count + 1
            seen |= {g} if n == 3 else set()
    return 1 / (1 + math.exp(-(float(weights[-1]) + quality.SCALE * total / max(1, count))))


def test_quality_scores_gram_by_gram(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    weights = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").where(~langid.held_out(3, 1)))
    got = {r["doc_id"]: r["score"] for r in QUERIES["op9_quality"](spark, sf_dir).collect()}
    for r in docs.where("length(text) < 4000").limit(60).collect():
        assert math.isclose(got[r["doc_id"]], plain_quality(weights, (r["text"] or "").encode()), abs_tol=1e-5)
