"""Language identification with a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import as_row, by_bytes, least_hashes, table, without

#: Bytes that the network reads at a time; its states start from zero in each window.
WINDOW = 64
HIDDEN = 8
#: Windows that are scored together.
BATCH = 2048
OUT = ("lang_pred", "score", "agreement")


def _gates(x: np.ndarray, h: np.ndarray, w: dict[str, np.ndarray], way: str) -> tuple[np.ndarray, ...]:
    """One step of the gated recurrent unit; arrays are (units, windows). Sigmoids are written with
    tanh, so that one call makes all gates: s(v) = (1 + tanh(v / 2)) / 2."""
    k = len(h)
    rec = w[f"u_{way}"] @ h
    zr = np.tanh(0.5 * (x[: 2 * k] + rec[: 2 * k])) * 0.5 + 0.5
    z, r = zr[:k], zr[k:]
    n = np.tanh(x[2 * k :] + r * rec[2 * k :])
    return n + z * (h - n), z, r, n, rec[2 * k :]


class ByteGru:
    """Weights: in_f, in_b (3H, 256) bytes to gates with their bias, u_f, u_b (3H, H) states to
    gates, out (C, 2H) and bias (C, 1) states of both directions to languages, at every byte."""

    def __init__(self, langs: list[str], weights: dict[str, np.ndarray]) -> None:
        self.langs, self.w = langs, weights

    @classmethod
    def fresh(cls, langs: list[str], hidden: int, rng: np.random.Generator) -> ByteGru:
        def drawn(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[-1] if shape[-1] < 256 else hidden)).astype(np.float32)

        w = {f"{k}_{way}": drawn(3 * hidden, 256 if k == "in" else hidden) for way in "fb" for k in ("in", "u")}
        return cls(langs, w | {"out": drawn(len(langs), 2 * hidden), "bias": np.zeros((len(langs), 1), np.float32)})

    def _run(self, x: np.ndarray, way: str, keep: list | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """States after each byte; x is (bytes, windows). Backwards from the last byte for way b."""
        w, steps = self.w, range(len(x)) if way == "f" else range(len(x) - 1, -1, -1)
        h = np.zeros((w["u_f"].shape[1], x.shape[1]), np.float32)
        for t in steps:
            before = h
            h, z, r, n, rec = _gates(np.take(w[f"in_{way}"], x[t], axis=1), h, w, way)
            if keep is not None:
                keep.append((t, before, z, r, n, rec))
            yield t, h

    def positions(self, x: np.ndarray, keep: dict | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each byte position, the last first: states of both directions and probabilities (C, windows)."""
        forward = [h for _, h in self._run(x, "f", keep and keep["f"])]
        for t, h in self._run(x, "b", keep and keep["b"]):
            both = np.concatenate([forward[t], h])
            p = self.w["out"] @ both + self.w["bias"]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield t, both, p

    def gradients(self, x: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the bytes of windows (bytes, windows) and its gradients, by
        backpropagation through time."""
        w, k = self.w, self.w["u_f"].shape[1]
        keep: dict = {"f": [None], "b": [None]}  # not empty, so that it counts as given
        grad = {name: np.zeros_like(v) for name, v in w.items()}
        at_state, loss, total = {}, 0.0, float(size.sum())
        column = np.arange(x.shape[1])
        for t, both, p in self.positions(x, keep):
            live = (size > t).astype(np.float32) / total
            loss -= float((np.log(p[label, column] + 1e-9) * live).sum())
            p[label, column] -= 1
            p *= live
            grad["out"] += p @ both.T
            grad["bias"] += p.sum(axis=1, keepdims=True)
            at_state[t] = w["out"].T @ p
        for way, half in (("f", slice(0, k)), ("b", slice(k, 2 * k))):
            d = np.zeros((k, x.shape[1]), np.float32)
            for t, before, z, r, n, rec in reversed(keep[way][1:]):
                d = d + at_state[t][half]
                dn = d * (1 - z) * (1 - n * n)
                dz = d * (before - n) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                pre = np.concatenate([dz, dr, dn])  # of the gates, without the recurrent part's r
                rec_d = np.concatenate([dz, dr, dn * r])
                for g in range(3 * k):
                    grad[f"in_{way}"][g] += np.bincount(x[t], pre[g], 256)
                grad[f"u_{way}"] += rec_d @ before.T
                d = d * z + w[f"u_{way}"].T @ rec_d
        return loss, grad

    def fit(self, x: np.ndarray, size: np.ndarray, label: np.ndarray, epochs: int, batch: int, rate: float, rng: np.random.Generator) -> None:
        """Adam with a rate that falls to zero; x is (windows, bytes)."""
        mean, square = ({n: np.zeros_like(v) for n, v in self.w.items()} for _ in range(2))
        steps, step = epochs * -(-len(x) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), batch):
                some = order[at : at + batch]
                _, grad = self.gradients(np.ascontiguousarray(x[some].T), size[some], label[some])
                step += 1
                now = rate * (1 - step / (steps + 1))
                clip = min(1.0, 1.0 / (1e-9 + float(np.sqrt(sum((g * g).sum() for g in grad.values())))))
                for n, g in grad.items():
                    g = g * clip
                    mean[n] = 0.9 * mean[n] + 0.1 * g
                    square[n] = 0.99 * square[n] + 0.01 * g * g
                    self.w[n] -= (now * (mean[n] / (1 - 0.9**step)) / (np.sqrt(square[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _states(self, x: np.ndarray, way: str) -> Iterator[tuple[int, np.ndarray]]:
        """As _run(), for labelling: in place and with the gates' halves in the weights."""
        k = self.w["u_f"].shape[1]
        half = np.repeat([0.5, 0.5, 1.0], k).astype(np.float32)
        table, u = np.ascontiguousarray((self.w[f"in_{way}"] * half[:, None]).T), self.w[f"u_{way}"] * half[:, None]
        h = np.zeros((k, x.shape[1]), np.float32)
        for t in range(len(x)) if way == "f" else range(len(x) - 1, -1, -1):
            given, rec = np.ascontiguousarray(np.take(table, x[t], axis=0).T), u @ h
            zr, n = given[: 2 * k], rec[2 * k :]
            zr += rec[: 2 * k]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            n *= zr[k:]
            n += given[2 * k :]
            np.tanh(n, out=n)
            h = h - n
            h *= zr[:k]
            h += n
            yield t, h

    def _labels(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The probabilities of positions()."""
        k = self.w["u_f"].shape[1]
        forward = [h for _, h in self._states(x, "f")]
        for t, h in self._states(x, "b"):
            p = self.w["out"][:, :k] @ forward[t]
            p += self.w["out"][:, k:] @ h
            p += self.w["bias"]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield t, p

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the mean of its bytes' probabilities (texts, C), and the share of its bytes
        that are labelled with the language that wins. An empty text has zeros."""
        sizes = np.array([len(t) for t in texts], np.int64)
        windows = -(-sizes // WINDOW)
        flat = np.zeros((int(windows.sum()), WINDOW), np.uint8)
        starts = np.cumsum(windows) - windows
        for at, text in zip(starts * WINDOW, texts, strict=True):
            flat.reshape(-1)[at : at + len(text)] = np.frombuffer(text, np.uint8)
        owner = np.repeat(np.arange(len(texts)), windows)
        left = np.minimum(WINDOW, sizes[owner] - (np.arange(len(owner)) - starts[owner]) * WINDOW)
        pooled, votes = np.zeros((2, len(self.langs), len(texts)))
        for at in range(0, len(owner), BATCH):
            own, size = owner[at : at + BATCH], left[at : at + BATCH]
            ragged = int(size.min())
            p_sum, v_sum = np.zeros((2, len(self.langs), len(own)), np.float32)
            for t, p in self._labels(np.ascontiguousarray(flat[at : at + BATCH].T)):
                if t >= ragged:
                    p *= size > t
                p_sum += p
                v_sum += (p == p.max(axis=0)) & (p > 0)
            for c in range(len(self.langs)):
                pooled[c] += np.bincount(own, p_sum[c], len(texts))
                votes[c] += np.bincount(own, v_sum[c], len(texts))
        n = np.maximum(sizes, 1)
        pooled /= n
        return pooled.T, np.take_along_axis(votes / n, pooled.argmax(axis=0)[None], 0)[0] if len(texts) else np.zeros(0)


def learn(docs: DataFrame, **params) -> ByteGru | None:
    """A network from the columns text and lang of docs (rows without either don't count).

    The sample is bounded: of each language the per_lang different texts of least hash, each once
    however often it stands there, and of each of them `windows` pieces of WINDOW bytes at hashed places. None without rows.
    """
    return _learn(docs, **params)[0]


def floor_of(scored: DataFrame, most: float = 0.5, miss: float = 0.001) -> float:
    """The score below which no language is told: `most`, or what all but the share `miss` of scored
    (score) reach, if the network is too weak for `most`. All rows count, and only a place is looked up
    among those below `most`."""
    n, low = scored.agg(F.count("*"), F.count(F.when(F.col("score") < most, 1))).first()
    place = int(miss * (n - 1)) if n else 0
    if low <= place:
        return most
    return float(scored.where(F.col("score") < most).select("score").orderBy("score").limit(place + 1).agg(F.max("score")).first()[0])


def _learn(docs: DataFrame, per_lang: int = 1500, windows: int = 4, epochs: int = 6, steps: int = 300, batch: int = 256, rate: float = 0.03, hidden: int = HIDDEN, seed: int = 1) -> tuple:
    """The network, and its sample: pieces (pieces, WINDOW), their sizes, the document of each. A
    small sample is read more than `epochs` times, until the weights have moved `steps` times."""
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.encode(F.col("text"), "utf-8").alias("raw")).where("lang is not null and length(raw) > 0")
    hashed = known.withColumn("h", F.xxhash64(F.lit(seed), "raw"))
    place = lambda i: F.pmod(F.xxhash64(F.lit("window"), "h", i), F.greatest(F.lit(1), F.length("raw") - WINDOW // 2)).cast("int") + 1
    # pieces are cut before rows are ranked, so that no whole text is shuffled
    cut_ = F.array(*[F.struct(F.lit(i).alias("i"), F.substring("raw", place(F.lit(i)), F.lit(WINDOW)).alias("piece")) for i in range(1, windows + 1)])
    ranked = least_hashes(hashed.select("lang", "h", cut_.alias("pieces")), "lang", "h", per_lang)
    rows = ranked.select("lang", "h", F.explode("pieces").alias("p")).select("lang", "h", "p.*").toPandas().sort_values(["lang", "h", "i"])
    if rows.empty:
        return None, None, None, None
    langs = sorted(rows["lang"].unique())
    size = rows["piece"].map(len).to_numpy()
    x = np.stack([np.frombuffer(bytes(p).ljust(WINDOW, b"\0"), np.uint8) for p in rows["piece"]])
    rng = np.random.default_rng(seed)
    net = ByteGru.fresh(langs, hidden, rng)
    epochs = max(epochs, -(-steps * batch // len(x)))
    net.fit(x, size, rows["lang"].map(langs.index).to_numpy(), epochs, batch, rate, rng)
    return net, x, size, rows.groupby(["lang", "h"]).ngroup().to_numpy()


def predict(docs: DataFrame, net: ByteGru | None) -> DataFrame:
    """docs with lang_pred, score (probability of lang_pred, the mean over all bytes of the text)
    and agreement (share of the bytes labelled with it).

    A null text, an empty one and one without a letter are `und` with score and agreement 0, and so
    is every text if there was nothing to learn from. Only the text counts. Rows are independent;
    input columns with the output's names are replaced.
    """
    spark = docs.sparkSession
    if net is None:
        return without(docs, *OUT).select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("agreement"))
    model = spark.sparkContext.broadcast((net.langs, net.w))

    def label(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = ByteGru(*model.value)
        for texts in parts:
            pooled, votes = [], []
            raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
            for some in by_bytes(map(len, raw)):
                p, v = own.score(raw[some])
                pooled.append(p)
                votes.append(v)
            p = np.concatenate(pooled) if pooled else np.zeros((0, len(own.langs)))
            yield pd.DataFrame({"lang_pred": [own.langs[i] for i in p.argmax(axis=1)], "score": np.clip(p.max(axis=1), 0, 1), "agreement": np.concatenate(votes) if votes else []})

    udf = F.pandas_udf(label, "lang_pred string, score double, agreement double")
    text = F.col("text").cast("string")
    named = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    d = docs.select(as_row(docs, *OUT), udf(text).alias("_p"), named.alias("_named"))
    pick = [F.when(F.col("_named"), F.col(f"_p.{n}")).otherwise(F.lit(other)).alias(n) for n, other in (("lang_pred", "und"), ("score", 0.0), ("agreement", 0.0))]
    return d.select("_row.*", *pick)


def held_out(mod: int, rest: int):
    """Whether crc32 of doc_id as text leaves `rest` divided by `mod` (a null doc_id: no)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == rest, F.lit(False))


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """predict() for all documents, learned from those whose crc32(doc_id) mod 5 is not 0. Null and
    letterless texts are `und` with score 0; repeats repeat, ties go to the first language by name,
    an empty table gives no rows, and further columns play no part."""
    docs = table(spark, sf_dir, "documents")
    net = learn(docs.where(~held_out(5, 0)).select("text", "lang"))
    return predict(docs.select("doc_id", "text"), net).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "agreement")
