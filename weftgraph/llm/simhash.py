"""SimHash near-duplicates, linked with a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm import similar
from weftgraph.llm.common import arrow_rows, join_spread, table
from weftgraph.operators.components import connected_components
from weftgraph.plans.lineage import cut

BITS = 64
#: Fingerprints of a bucket; larger ones are cut into pages of that size.
CAP = 2048
#: Masks at most, and tasks that cut hot buckets into pages.
MASKS, TASKS = 60, 4096
#: Children of an index node.
FAN = 8


def simhash(text: str | None, n: int, seed: int) -> int:
    """The fingerprint of a text's n-word shingles as a signed 64-bit number."""
    return similar.fingerprint(similar.hashes(text, n, seed))


def fingerprints(docs: DataFrame, n: int, seed: int) -> DataFrame:
    """(doc_id, fp) of every whole text."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": np.array([simhash(t, n, seed) for t in pdf["text"]], np.int64)})

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInPandas(batches, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def tables(radius: int, n: int, cap: int) -> list[int]:
    """Masks such that two fingerprints within radius agree in all bits of one mask at least.

    Of `blocks` blocks of bits, radius differences leave all but radius untouched, so the unions of
    blocks - radius blocks will do. More blocks give longer masks and so smaller buckets, but more of
    them; there are as few as keep a bucket of n random fingerprints at a quarter of the cap.
    """
    for blocks in range(radius + 1, BITS + 1):
        parts = [sum(1 << int(b) for b in part) for part in np.array_split(np.arange(BITS), blocks)]
        masks = [sum(some) for some in combinations(parts, blocks - radius)]
        if n * 4 <= cap << min(m.bit_count() for m in masks) or comb(blocks + 1, radius) > MASKS:
            break
    return masks


def within_two(fps: DataFrame) -> DataFrame:
    """(src, dst): links that connect all distinct fingerprints (fp) that differ in at most two bits.

    Each stands at its own place and at those that differ from it in one bit: two meet in a place if
    and only if they differ in two bits at most. A place holds BITS + 1 of them at most, and all
    link to the least one there.
    """
    places = F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(BITS)])).alias("place")
    met = fps.select("fp", places).groupBy("place").agg(F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    return met.select(F.explode("all").alias("src"), F.array_min("all").alias("dst")).where("src != dst").distinct()


def buckets(fps: DataFrame, radius: int, cap: int) -> tuple[DataFrame, DataFrame | None]:
    """(mask, val, fp), where distinct fingerprints that may link meet in a bucket of at most 2 * cap,
    and links (src, dst) that were found on the way or None.

    Each goes to one bucket for each of tables(). A bucket above the cap is sorted by Gray rank and
    cut into pages of at most `cap`; a page knows the bits that all of its fingerprints agree in, and
    two pages that differ in more than radius of their common ones are dropped as a whole. Each pair
    of pages that is left makes a bucket (mask and val are then the pages' numbers), and so does each
    page. Only pages are paired, never their rows, and nothing is lost at any size.

    A bucket of more than BITS pages, where pairs could copy a row more often than it has bits, first
    links what within_two() finds. A group of more than `cap` then gets pages of its own, and pages
    whose rows are in one group by then are not paired: so the near copies of one text cost in
    proportion to their number, and only what is three bits away from all others still meets in pairs.
    """
    masks = tables(radius, fps.count(), cap)
    split = F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")
    met = fps.select("fp", split).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("val"), "fp")
    hot = cut(met.groupBy("mask", "val").agg(F.count("*").alias("n")).where(F.col("n") > cap))
    sizes = hot.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    if not sizes["rows"]:
        return met, None
    rank = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    ranked, near = met.join(hot.select("mask", "val"), ["mask", "val"], "left_semi").withColumn("rank", rank), None
    if radius >= 2 and sizes["most"] > BITS * cap:
        large = hot.where(F.col("n") > BITS * cap)
        near = cut(within_two(met.join(large, ["mask", "val"], "left_semi").select("fp").distinct()))
        groups = connected_components(near).select(F.col("id").alias("fp"), "component")
        whole = groups.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("component", F.col("component").alias("apart"))
        ranked = ranked.join(groups.join(whole, "component", "left"), "fp", "left")
        ranked = ranked.select("mask", "val", "fp", "rank", F.coalesce("component", "fp").alias("known"), F.coalesce("apart", F.lit(0)).alias("apart"))
    else:
        ranked = ranked.select("mask", "val", "fp", "rank", F.col("fp").alias("known"), F.lit(0).cast("long").alias("apart"))
    order = ["mask", "val", "apart", "rank"]
    ranked = ranked.repartitionByRange(min(TASKS, -(-sizes["rows"] // cap)), *order).sortWithinPartitions(*order)
    paged = cut(ranked.mapInPandas(lambda batches: _pages(batches, cap), "mask long, val long, fp long, known long, page long"))
    same = F.bitwise_not(F.col("ones").bitwiseXOR(F.col("any"))).alias("same")
    bounds = [F.min("known").alias("low"), F.max("known").alias("high")]
    node = paged.groupBy("mask", "val", "page").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("any"), *bounds)
    node = cut(node.select("mask", "val", "page", "ones", same, "low", "high"))
    several = node.groupBy("mask", "val").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    node = node.join(several, ["mask", "val"], "left_semi")
    other = node.select("mask", "val", *[F.col(c).alias(f"{c}_b") for c in ("page", "ones", "same", "low", "high")])
    differ = F.bit_count(F.col("ones").bitwiseXOR(F.col("ones_b")).bitwiseAND(F.col("same")).bitwiseAND(F.col("same_b")))
    open_ = F.least("low", "low_b") < F.greatest("high", "high_b")
    pairs = node.join(other, ["mask", "val"]).where((F.col("page") <= F.col("page_b")) & (differ <= radius) & open_).select("page", "page_b")
    sides = pairs.select(F.col("page").alias("a"), F.col("page_b").alias("b"), F.explode(F.array_distinct(F.array("page", "page_b"))).alias("page"))
    dealt = sides.join(paged.select("page", "fp"), "page").select(F.col("a").alias("mask"), F.col("b").alias("val"), "fp")
    return met.join(hot.select("mask", "val"), ["mask", "val"], "left_anti").union(dealt), near


def _pages(batches: Iterator[pd.DataFrame], cap: int) -> Iterator[pd.DataFrame]:
    """Numbers of the pages of sorted rows: negative, so that none is taken for a mask."""
    page, n, last = -(TaskContext.get().partitionId() + 1) << 32, 0, None
    for pdf in batches:
        numbers = np.empty(len(pdf), np.int64)
        for i, key in enumerate(zip(pdf["mask"], pdf["val"], pdf["apart"], strict=True)):
            if key != last or n == cap:
                page, n, last = page + 1, 0, key
            n += 1
            numbers[i] = page
        yield pdf[["mask", "val", "fp", "known"]].assign(page=numbers)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of a bit pattern in the order of the reflected Gray code."""
    rank = fp.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


class GrayIndex:
    """Hierarchical index over fingerprints, several buckets side by side.

    Fingerprints stand in the order of bucket and Gray rank, where neighbours share most bits. FAN
    neighbours of a bucket make a node of the level above, which keeps the bits that all of them
    agree in (mask, pattern); what is left to a child are its own bits outside of its parent's mask.
    A search adds up the differing bits on the way down and drops a whole node when they exceed the
    radius.
    """

    def __init__(self, bucket: np.ndarray, fp: np.ndarray) -> None:
        self.fp = fp.astype(np.uint64)
        whole = np.full(len(fp), ~np.uint64(0))
        # of each level, from the leaves up: pattern, mask, first child, one past the last, last leaf
        self.levels = [(self.fp, whole, np.arange(len(fp)), np.arange(len(fp)), np.arange(len(fp)))]
        while len(np.unique(bucket)) < len(bucket) or len(self.levels) == 1:
            pattern, mask, _, _, leaf = self.levels[-1]
            new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            place = np.arange(len(bucket)) - np.repeat(new, np.diff(np.r_[new, len(bucket)]))
            first = np.flatnonzero(place % FAN == 0)
            end = np.r_[first[1:], len(bucket)]
            ones, zeros = np.bitwise_and.reduceat(pattern & mask, first), np.bitwise_and.reduceat(~pattern & mask, first)
            self.levels.append((ones, ones | zeros, first, end, leaf[end - 1]))
            bucket = bucket[first]
        self.root_leaf = self.levels[-1][4]

    def links(self, radius: int, step: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i < j, of the same bucket within radius, for `step` values of i at a time."""
        for at in range(0, len(self.fp), step):
            i = np.arange(at, min(at + step, len(self.fp)))
            node = np.searchsorted(self.root_leaf, i)
            known = np.zeros(len(i), np.uint64)
            differ = np.zeros(len(i), np.int64)
            for depth in range(len(self.levels) - 1, -1, -1):
                pattern, mask, first, end, leaf = self.levels[depth]
                own = mask[node] & ~known
                differ = differ + np.bitwise_count((self.fp[i] ^ pattern[node]) & own)
                keep = (differ <= radius) & (leaf[node] > i)
                i, node, differ = i[keep], node[keep], differ[keep]
                if depth:
                    n = end[node] - first[node]
                    known = np.repeat(mask[node], n)
                    i, differ = np.repeat(i, n), np.repeat(differ, n)
                    node = np.repeat(first[node], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield i, node


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least member of each row's group."""
    label = np.arange(n)
    for i, j in pairs:
        while len(i):
            a, b = label[i], label[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    return label


def _link_buckets(parts: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of each bucket's fingerprints to the least of their group in it, from sorted rows."""
    left: pd.DataFrame | None = None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"src": [], "dst": []}, dtype="int64")
        mask, val, fp = (rows[c].to_numpy() for c in ("mask", "val", "fp"))
        bucket = np.cumsum(np.r_[True, (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])])
        order = np.lexsort((gray_rank(fp.view(np.uint64)), bucket))
        bucket, fp = bucket[order], fp[order]
        counts = np.bincount(bucket)
        several = counts[bucket] > 1
        bucket, fp = bucket[several], fp[several]
        if not len(fp):
            return pd.DataFrame({"src": fp, "dst": fp})
        root = _roots(len(fp), GrayIndex(bucket, fp.view(np.uint64)).links(radius))
        tied = root != np.arange(len(fp))
        return pd.DataFrame({"src": fp[tied], "dst": fp[root[tied]]})

    for pdf in parts:
        rows = pdf if left is None else pd.concat([left, pdf], ignore_index=True)
        last = (rows["mask"] == rows["mask"].iloc[-1]) & (rows["val"] == rows["val"].iloc[-1])
        left = rows[last]
        yield solve(rows[~last])
    if left is not None:
        yield solve(left)


def links(fps: DataFrame, radius: int, cap: int = CAP) -> DataFrame:
    """(src, dst): of distinct fingerprints (fp), enough pairs within radius to connect all that
    are connected by such pairs."""
    met, near = buckets(fps, radius, cap)
    met = met.repartition("mask", "val").sortWithinPartitions("mask", "val")
    found = met.mapInPandas(lambda parts: _link_buckets(parts, radius), "src long, dst long")
    return found if near is None else found.union(near)


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, seed: int = 42, cap: int = CAP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    fingerprint: 16 hex digits of the SimHash of the text's n-word shingles (repeats count, A-Z in
    lower case). Rows link when their fingerprints differ in at most `radius` bits; component_id is
    the least doc_id that can be reached over links, a row's own included. A null, empty or blank
    text has fingerprint zero and links like any other; a text of fewer than n words is one shingle.
    A null doc_id is never a component_id unless nothing else is reached. Repeated rows repeat; an
    empty table gives no rows; columns other than doc_id and text play no part.

    Only distinct fingerprints are compared, so copies cost nothing; see buckets() for how they
    meet and GrayIndex for how they are compared. A bucket gives each of its fingerprints at most
    one link, to the least of its group there; components put the buckets together.
    """
    prints = cut(fingerprints(docs, n, seed))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    groups = connected_components(links(distinct.select("fp"), radius, cap))
    tied = cut(groups.join(distinct, groups["id"] == distinct["fp"]).select("fp", "component", "least", "copies"))
    least = tied.groupBy("component").agg(F.min("least").alias("component_id"))
    tied = tied.join(least, "component").select("fp", "component_id", "copies")
    alone = distinct.join(tied.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"), "copies")
    out = join_spread(prints, tied.union(alone), "fp", "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, n: int = 3, radius: int = 3, seed: int = 42, cap: int = CAP, least: float | None = None) -> DataFrame:
    """docs with one row of each group of near-duplicates left, the one of least doc_id.

    Without `least` the groups are the components of near_duplicates(). With it two texts link when
    the sets of their n-word shingles have at least that Jaccard similarity, computed on whole texts.
    Fingerprints within radius are the first candidates, but a pair at 0.8 differs in 10 of 64 bits
    on average, which no index of that radius reaches; similar.similar_groups() brings the others
    together. Equal texts are one; null and blank texts are alike.

    doc_id is taken for a key: of rows that repeat a kept doc_id one stays. Rows without a doc_id
    can't be named by a component and all stay. Columns and their order stay as they are. An empty
    table gives no rows.
    """
    if least is None:
        found = near_duplicates(docs, n, radius, seed, cap).where("doc_id = component_id")
        return keep_named(docs, found.select(F.col("doc_id").alias("_id")).distinct())
    texts = similar.keyed(docs)
    with arrow_rows(docs.sparkSession, 1000):
        prints = cut(similar.prints(texts, n, seed))
    ids = prints.groupBy("key").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("_id"))
    ids = cut(ids)
    first = ids.groupBy("fp").agg(F.min("key").alias("head"))
    near = links(first.select("fp"), radius, cap)
    head = lambda side: first.select(F.col("fp").alias(side), F.col("head").alias(f"{side}_key"))
    near = near.join(head("src"), "src").join(head("dst"), "dst").select(F.col("src_key").alias("a"), F.col("dst_key").alias("b"))
    equal = ids.join(first, "fp").where("key != head").select(F.col("key").alias("a"), F.col("head").alias("b"))
    groups = similar.similar_groups(texts, prints, near.union(equal), n, least)
    named = ids.join(groups, F.col("key") == F.col("id"), "left").select(F.coalesce("component", "key").alias("c"), "_id")
    keep = named.groupBy("c").agg(F.min("_id").alias("_id")).where("_id is not null").select("_id").distinct()
    return keep_named(docs, keep)


def keep_named(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """docs with one row of each doc_id in keep (_id), and all rows without a doc_id."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("_row"), F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_h"))
    kept = packed.join(keep, F.col("_d") == F.col("_id"), "left_semi")
    first = Window.partitionBy("_d").orderBy("_h")
    kept = kept.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return kept.select("_row.*").union(packed.where("_d is null").select("_row.*"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents; nulls, empty texts, ties, repeats, an empty table and
    further columns as stated there."""
    return near_duplicates(table(spark, sf_dir, "documents"))
