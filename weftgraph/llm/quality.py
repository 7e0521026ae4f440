"""Quality classifier: logistic regression over hashed word n-grams, fitted by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, by_bytes, table
from weftgraph.llm.langid import held_out

#: Weights are addressed by this many bits of an n-gram's hash.
HASH_BITS = 18
#: The place of trigrams that occur again in a text.
REPEAT = 0
_MUL = 0x9E3779B97F4A7C15 | 1
_KIND = np.full(256, 2, np.uint8)  # symbols
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 128]] = 1
_KIND[48:58] = 3


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(_MUL)
    return h ^ (h >> np.uint64(29))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_MUL, pow(_MUL, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.multiply.accumulate(steps)
    return _POWERS


def hashed_ngrams(texts: list[bytes], orders: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all n-grams, n from 1 to `orders`, of all texts, and the text of each. A trigram
    that its text has had before adds the place REPEAT.

    A token is a run of letters, of digits or of symbols between white space, so that marks stuck
    to words count on their own. Hashes of all tokens come from one pass: with powers of an odd
    multiplier, a token's polynomial is a difference of prefix sums, shifted to its start.
    """
    buffer = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    kind = _KIND[buffer]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts, ends = change[:-1], change[1:]
    words = kind[starts] > 0
    starts, ends = starts[words], ends[words]
    power, inverse = _powers(len(buffer))
    sums = np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * power[: len(buffer)])
    h = _mixed((sums[ends - 1] - sums[starts - 1]) * inverse[starts])
    text_ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    owner = np.searchsorted(text_ends, starts, side="right")
    places, owners, gram = [], [], h
    for n in range(1, max(orders, 3) + 1):
        if n > 1:
            gram = _mixed(gram[:-1] * np.uint64(31) + h[n - 1 :] + np.uint64(n))
            whole = owner[: len(gram)] == owner[n - 1 :]
        else:
            whole = np.ones(len(gram), bool)
        own = owner[: len(gram)][whole]
        if n <= orders:
            places.append((gram[whole] >> np.uint64(64 - HASH_BITS)).astype(np.int64))
            owners.append(own)
        if n == 3:
            key = gram[whole] ^ _mixed(own.astype(np.uint64) + np.uint64(1))
            again = np.ones(len(key), bool)
            again[np.unique(key, return_index=True)[1]] = False
            owners.append(own[again])
            places.append(np.full(len(owners[-1]), REPEAT))
        if len(gram) < 2:
            break
    return np.concatenate(places), np.concatenate(owners)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss, with an unpenalised bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 1e-3) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, self.l1)
        return -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


#: A text's n-grams weigh SCALE altogether, each occurrence alike.
SCALE = 20.0


def _raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "replace")


def _sparse_rows(parts: Iterator[pd.DataFrame], orders: int) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        rows = []
        for text in pdf["text"]:
            places, _ = hashed_ngrams([_raw(text)], orders)
            at, counts = np.unique(places, return_counts=True)
            rows.append((at.astype(np.int32), (counts * (SCALE / max(1, len(places)))).astype(np.float32)))
        yield pd.DataFrame({"h": pdf["h"], "t": pdf["t"], "label": pdf["label"], "at": [r[0] for r in rows], "value": [r[1] for r in rows]})


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 6000, entries: int = 1 << 25, orders: int = 2, epochs: int = 4, seed: int = 3) -> np.ndarray:
    """Weights (2**HASH_BITS and the bias) from docs (doc_id, text) and labels (doc_id, 0 or 1).

    The sample is bounded: the `sample` labelled rows of least hash, whole texts, as long as they
    have no more than `entries` n-grams (a text counts for its bytes, or all places if it has more).
    A text and label that come twice for a doc_id count once. Features are made in the tasks; the
    driver gets 8 bytes an entry. Null ids and labels other than 0 and 1 don't count. Without
    labelled rows all weights are 0.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "label")).orderBy("h", "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.select("h", "label", F.xxhash64("text").alias("t"), "text")
    size = F.least(F.coalesce(F.octet_length("text"), F.lit(0)), F.lit(1 << HASH_BITS)) * orders
    sizes = rows.select("h", "label", "t", size.alias("size")).distinct().orderBy("h", "label", "t").limit(sample).toPandas()
    within = sizes[sizes["size"].cumsum() <= entries]
    taken = docs.sparkSession.createDataFrame([tuple(map(int, r)) for r in within[["h", "label", "t"]].itertuples(index=False)], "h long, label int, t long")
    rows = rows.join(F.broadcast(taken), ["h", "label", "t"]).dropDuplicates(["h", "label", "t"])  # `sample` rows at most
    made = rows.mapInPandas(lambda parts: _sparse_rows(parts, orders), "h long, t long, label int, at array<int>, value array<float>").toPandas().sort_values(["h", "label", "t"])
    model = Ftrl(1 << HASH_BITS)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            model.learn(np.asarray(made["at"].iloc[i], np.int64), np.asarray(made["value"].iloc[i], float), int(made["label"].iloc[i]))
    return model.weights(np.arange(len(model.z)))


def score_quality(docs: DataFrame, weights: np.ndarray, orders: int = 2) -> DataFrame:
    """docs with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on).

    The score is a sparse dot product over the n-grams of the whole text. Null and empty texts have
    the bias alone. Rows are independent; input columns score and predicted are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, bias = model.value[:-1], float(model.value[-1])
        for texts in parts:
            found = []
            all_ = [_raw(t) for t in texts]
            for some in by_bytes(map(len, all_), 1 << 18):
                raw = all_[some]
                places, owner = hashed_ngrams(raw, orders)
                sums, n = np.bincount(owner, w[places], len(raw)), np.bincount(owner, minlength=len(raw))
                found.append(1 / (1 + np.exp(-np.clip(bias + SCALE * sums / np.maximum(n, 1), -35, 35))))
            yield pd.Series(np.concatenate(found) if found else [], dtype="float64")

    udf = F.pandas_udf(score, "double")
    d = docs.select(as_row(docs, "score", "predicted"), udf(F.col("text").cast("string")).alias("score"))
    return d.select("_row.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score_quality() of all documents, fitted to labels of rows whose crc32(doc_id) mod 3 is not 1.
    Null and empty texts score the bias; repeats repeat, a score of 0.5 is predicted as 1, an empty
    table gives no rows, and further columns play no part."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    weights = fit_quality(docs, labels.where(~held_out(3, 1)))
    return score_quality(docs, weights).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")
