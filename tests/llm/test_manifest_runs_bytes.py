"""Merkle proofs, periodic runs and byte-level tokens against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.conftest import same_rows
from weftgraph.llm import bytebpe, merkle, periodic
from weftgraph.llm.registry import SQL


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_top(nodes):
    while len(nodes) > 1:
        nodes = [sha(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
    return nodes[0]


@pytest.mark.parametrize("bits", [1, 3, 12])
def test_manifest_matches_sql_with_small_and_large_blocks(spark, duck, sf_dir, bits):
    got = merkle.op11_merkle(spark, sf_dir, bits).toPandas()
    same_rows(got, duck.sql(SQL["op11_merkle"]).df())
    assert 0.5 < got["verified"].mean() < 1


def test_manifest_of_odd_groups(spark):
    rows = [(i, f"text {i}", g) for g, n in (("one", 1), ("five", 5), (None, 3), ("é", 9)) for i in range(n)] + [(2, "text 2", "five")] * 3 + [(None, None, "five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = merkle.merkle_manifest(docs, ["doc_id", "text"], "lang", "doc_id", bits=2).collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for i, t, g in rows:
        groups.setdefault(g, []).append(((i is not None, i or 0), sha(field(i), field(t))))
    tops = {g: plain_top([leaf for _, leaf in sorted(x)]) for g, x in groups.items()}
    order = sorted(tops, key=lambda g: (g is not None, (g or "").encode()))
    assert len(got) == len(rows) and {r["root"] for r in got} == {plain_top([tops[g] for g in order])}
    assert {r["subroot"] for r in got} == set(tops.values())
    assert all(r["verified"] and merkle.fold(r["leaf"], r["proof"]) == r["root"] for r in got)
    assert merkle.fold(sha("other"), got[0]["proof"]) != got[0]["root"]


def test_one_row_is_its_own_root(spark):
    r = merkle.merkle_manifest(spark.createDataFrame([(1, None)], "doc_id long, lang string"), ["doc_id"], "lang", "doc_id").first()
    assert r["leaf"] == r["subroot"] == r["root"] == sha("1:1") and r["proof"] == []


def plain_runs(words, least=6, times=4):
    n, out = len(words), []
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            whole = words[i : i + p]
            if j - i + p >= max(least, times * p) and not any(p % q == 0 and whole == whole[:q] * (p // q) for q in range(1, p)):
                out.append((i, j - i + p, p))
            i = j + 1
    return sorted(out)


def repetitive(rng, n):
    s = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(n))]
    if rng.random() < 0.7:
        base = s[: rng.randrange(1, 6)]
        s = s[: rng.randrange(8)] + base * rng.randrange(2, 9) + base[: rng.randrange(3)] + s[: rng.randrange(9)]
    return s


def test_lyndon_arrays_of_both_orders_and_runs():
    rng = random.Random(5)
    for _ in range(1500):
        s = repetitive(rng, 40) or [0]
        codes = np.array(s)
        for turned in (False, True):
            t = [max(s) - x for x in s] if turned else s
            want = [next((j for j in range(i + 1, len(t)) if t[j:] < t[i:]), len(t)) - i for i in range(len(t))]
            assert periodic.lyndon_array(codes, turned).tolist() == want
        assert periodic.find_runs(codes) == plain_runs(s)
        assert periodic.find_runs(codes, 2, 2) == plain_runs(s, 2, 2)


def test_stretches_lose_no_run():
    rng = random.Random(6)
    docs = [[str(x) for x in repetitive(rng, 60)] for _ in range(1500)]
    runs, stays = periodic.runs_of(pa.array(docs, pa.list_(pa.string())))
    assert runs == [plain_runs(d) for d in docs] and sum(map(len, runs)) > 300
    assert stays.tolist() == [not any(a + p <= i < a + n for a, n, p in plain_runs(d)) for d in docs for i in range(len(d))]


def test_runs_of_documents(spark, sf_dir):
    got = {r["doc_id"]: r for r in periodic.op12_runs(spark, sf_dir).collect()}
    found = 0
    for row in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        h = zlib.crc32(str(row["doc_id"]).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 1500:
            continue  # the plain version takes the square
        runs, best = plain_runs(words), None
        for r in runs:
            if best is None or r[1] * best[2] > best[1] * r[2]:
                best = r
        left = " ".join(w for i, w in enumerate(words) if not any(a + p <= i < a + k for a, k, p in runs))
        want = (len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{k},{p}\n" for a, k, p in runs)), sha(left))
        assert tuple(got[row["doc_id"]][c] for c in "n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()) == want
        found += len(runs)
    assert found > 5


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(), mergeable_ranks=bytebpe.read_ranks(bytebpe.default_vocabulary()), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return bytebpe.ByteBpe(*bytebpe.spec(bytebpe.default_vocabulary()))


def odd_texts(coder, unlike):
    rng = random.Random(1)
    some = ["a", "aa", "the", "=", "--", " ", "  ", "\n", "\t", "é", "日本", "😀", "'s", "'ll", "1", "23", "　", "\x1c", "\x85", "ß", "한국", "́", *unlike]
    return ["".join(rng.choice(some) * rng.choice([1, 1, 2, 5, 30]) for _ in range(rng.randrange(12))) for _ in range(3000)]


def test_byte_tokens_of_odd_texts(coder, library):
    unlike = [chr(int(x, 16)) for x in re.findall(r"U(\w{8})", bytebpe.unlike_characters())][:9]
    for text in odd_texts(coder, unlike):
        ids = coder.encode([text])[0]
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()
        parts = list(bytebpe.in_parts(text, 3))
        assert "".join(parts) == text and [i for p in parts for i in library.encode_ordinary(p)] == ids.tolist()
        if len(ids):
            spans = [(int(a), int(b)) for a, b in zip(*coder.offsets(text, ids), strict=True)]
            assert spans == coder.whole.encode(text, add_special_tokens=False).offsets


def test_byte_tokens_of_documents(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in bytebpe.op13_byte_bpe(spark, sf_dir).collect()}
    for row in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        text, r = row["text"] or "", got[row["doc_id"]]
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(text))


def test_split_characters_are_decoded_as_bytes(spark):
    docs = bytebpe.byte_bpe_encode(spark.createDataFrame([("x 🜛 y",)], "text string"), bytebpe.default_vocabulary())
    halves = docs.select(F.explode(F.transform("ids", lambda i: F.array(i))).alias("ids"))
    back = bytebpe.byte_bpe_decode(halves, bytebpe.default_vocabulary()).collect()
    assert b"".join(bytes(r["decoded_bytes"]) for r in back).decode() == "x 🜛 y" and any("�" in r["decoded"] for r in back)
    with pytest.raises(Exception, match="vocabulary"):
        bytebpe.byte_bpe_decode(spark.createDataFrame([([999_999],)], "ids array<int>"), bytebpe.default_vocabulary()).collect()
