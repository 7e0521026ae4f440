"""Near-duplicates by the exact similarity of word shingles; MinHash brings candidates together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_rows
from weftgraph.operators.components import connected_components
from weftgraph.plans.lineage import cut

#: A pair of similarity s meets in none of the bands with probability (1 - s ** ROWS) ** BANDS:
#: 3e-6 at 0.8, less above.
BANDS, ROWS = 32, 5
PIECE = 2048  # shingles whose hashes are made together
TILE = 512  # texts in a block of a large bucket
PAIRS = 256  # pairs of texts that a task gets at a time
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def hashes(text: str | None, n: int, seed: int) -> np.ndarray:
    """XXH64 of each of a text's n-word shingles (A-Z in lower case) in the text's order, as 8
    big-endian bytes each; a text of fewer words is one shingle, and one without a word has none."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.empty(0, ">u8")
    whole = b" ".join(words)
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=starts[1:])
    ends = (starts[n:] if len(words) >= n else starts[-1:]) - 1
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends.tolist(), strict=False)]), ">u8")


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of hashes(), as a signed number: a bit is 1 if it is in more than half of them.
    They are counted some at a time, so that a long text takes no more memory than a short one."""
    if not len(found):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(found), 1 << 16):
        ones += np.unpackbits(found[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(found)).view(">i8")[0])


def shingles(text: str | None, n: int, seed: int = 42) -> np.ndarray:
    """The set of a text's hashes(), sorted."""
    return np.unique(hashes(text, n, seed).astype(np.uint64))


def bands(hashes: np.ndarray, seed: int) -> np.ndarray:
    """A text's bucket in each band: a hash of the band's ROWS least values."""
    rng = np.random.default_rng(seed)
    times, plus, mix = (rng.integers(0, 1 << 64, k, np.uint64) for k in (BANDS * ROWS, BANDS * ROWS, BANDS * (ROWS + 1)))
    times, mix, least = times | np.uint64(1), mix | np.uint64(1), np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), PIECE):
        values = times[:, None] * hashes[None, at : at + PIECE]
        values += plus[:, None]
        np.minimum(least, values.min(axis=1), out=least)
    least ^= least >> np.uint64(32)
    mixed = (least * mix[: BANDS * ROWS]).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + mix[BANDS * ROWS :]
    mixed ^= mixed >> np.uint64(29)
    return (mixed * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _key() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _similar(pairs: DataFrame, texts: DataFrame, n: int, least: float) -> DataFrame:
    """The pairs (a, b) of keys whose texts have at least the similarity."""

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def of(key: int, text: str) -> np.ndarray:
            if key not in known:
                if len(known) >= PAIRS:
                    known.clear()
                known[key] = shingles(text, n)
            return known[key]

        for pdf in parts:
            keep = [similarity(of(a, ta), of(b, tb)) >= least for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"], strict=True)]
            yield pdf.loc[keep, ["a", "b"]]

    first = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
    with arrow_rows(pairs.sparkSession, PAIRS):
        return cut(pairs.join(first, "a").join(second, "b").mapInPandas(compare, "a long, b long"))


def _tile(rows: pd.DataFrame, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join the groups (c) of a tile's rows: a pair is compared unless its rows are in one
    group by then or in the same block of a tile of two."""
    key, block = rows["key"].to_numpy(), rows["s"].to_numpy()
    _, group = np.unique(rows["c"].to_numpy(), return_inverse=True)
    two = rows["lo"].iloc[0] != rows["hi"].iloc[0]
    sets = [x if len(x) else np.array([~np.uint64(0)]) for x in sets]  # empty sets are alike
    size = np.array([len(x) for x in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(size) - size
    here, found = np.zeros(len(flat) + 1, np.int32), []
    for i in range(len(key) - 1):
        open_ = (group != group[i]) & (np.minimum(size, size[i]) >= least * np.maximum(size, size[i]))
        open_[: i + 1] = False
        if two:
            open_ &= block != block[i]
        if not open_.any():
            continue
        own = flat[starts[i] : starts[i] + size[i]]
        here[own] = 1
        both = np.add.reduceat(here[flat[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
        here[own] = 0
        for j in np.flatnonzero(open_[i + 1 :] & (both / (size[i + 1 :] + size[i] - both) >= least)) + i + 1:
            if group[j] != group[i]:
                found.append((key[i], key[j]))
                group[group == group[j]] = group[i]
    return found


def _tiles(parts: Iterator[pd.DataFrame], n: int, least: float) -> Iterator[pd.DataFrame]:
    """The links of all tiles, from sorted rows."""
    left: list[pd.DataFrame] = []
    known: dict[int, np.ndarray] = {}

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        place = rows[["band", "lo", "hi"]].to_numpy()
        bounds = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, len(rows)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            some, sets = rows.iloc[lo:hi], []
            for k, t in zip(some["key"], some["text"], strict=True):
                if k not in known:
                    if len(known) >= 4 * PAIRS:
                        known.clear()
                    known[k] = shingles(t, n)
                sets.append(known[k])
            found += _tile(some, sets, least)
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    for pdf in parts:
        last = (pdf[["band", "lo", "hi"]] == pdf[["band", "lo", "hi"]].iloc[-1]).all(axis=1)
        if last.all() and left and (left[-1][["band", "lo", "hi"]].iloc[-1] == pdf[["band", "lo", "hi"]].iloc[-1]).all():
            left.append(pdf)  # one tile over several batches
            continue
        yield solve(pd.concat([*left, pdf[~last]], ignore_index=True))
        left = [pdf[last]]
    if left:
        yield solve(pd.concat(left, ignore_index=True))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): equal texts have equal keys, a null text the key of an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.col("text").cast("string").alias("text"))


def prints(texts: DataFrame, n: int, seed: int) -> DataFrame:
    """(doc_id, key, fp, bands): SimHash and MinHash buckets of every whole text, from one pass."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            found = [hashes(t, n, seed) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64"), "key": pdf["key"], "fp": np.array([fingerprint(h) for h in found], np.int64),
                "bands": [bands(np.unique(h.astype(np.uint64)), seed) for h in found],
            })

    return texts.mapInPandas(batches, "doc_id long, key long, fp long, bands array<long>")


def similar_groups(keyed_: DataFrame, prints_: DataFrame, candidates: DataFrame, n: int, least: float) -> DataFrame:
    """(id, component) of the keys of texts that are like another one.

    Texts link when the sets of their n-word shingles have a Jaccard similarity of at least `least`,
    computed on whole texts; groups are what links connect. Compared are the candidates (a, b) and
    all pairs that meet in one of BANDS MinHash buckets: first each with its bucket's least member,
    then every pair that isn't in one group by then and whose sizes allow it, in tiles of at most
    about 2 * TILE texts, so that no row is made for a pair.
    """
    spark = keyed_.sparkSession
    each = prints_.select("key", F.explode("bands").alias("band"))
    heads = each.groupBy("band").agg(F.min("key").alias("head"), F.max("key").alias("last")).where("head < last").select("band", "head")
    members = cut(each.join(heads, "band").distinct())
    pairs = cut(candidates.union(members.where("key > head").select("key", "head")).distinct())
    needed = members.select("key").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = cut(keyed_.select("key", "text").dropDuplicates(["key"]).join(needed, "key", "left_semi"))
    groups = cut(connected_components(_similar(pairs, texts, n, least), "a", "b"))

    # what the first members have not settled
    own = members.join(groups, F.col("key") == F.col("id"), "left").select("band", "key", "head", F.coalesce("component", "key").alias("c"))
    split = own.groupBy("band").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("band")
    own = cut(own.where("key > head").join(split, "band", "left_semi").select("band", "key", "c"))
    # a large bucket goes to tiles, each pair of its blocks to one
    blocks = own.groupBy("band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    dealt = own.join(blocks, "band").withColumn("s", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", F.least("s", "x").alias("lo"), F.greatest("s", "x").alias("hi"), "s", "key", "c").join(texts, "key")
    tiles = dealt.select("band", "lo", "hi", "s", "key", "c", "text").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    with arrow_rows(spark, 4 * PAIRS):
        more = cut(tiles.mapInPandas(lambda parts: _tiles(parts, n, least), "a long, b long").distinct())
    return groups if more.isEmpty() else cut(connected_components(groups.where("id > component").select(F.col("id").alias("a"), F.col("component").alias("b")).union(more), "a", "b"))
