"""Runs of repeated words: Lyndon arrays from the grouping phase of a suffix sorter, under both orders of
the words, whose roots are extended to runs by longest common extensions."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, as_row, by_bytes, table

#: Words compared at first when an extension is looked for; doubled as long as they agree.
STEP = 16
OUT = ("n_words", "runs", "collapsed")
SCHEMA = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_array(codes: np.ndarray, descending: bool = False) -> np.ndarray:
    """The length of the longest Lyndon word at each place, under the order of the codes or its reverse.

    This is a suffix sorter's first phase. Places are grouped by a prefix, at first by their code, and
    groups are taken from the greatest down. For each place of a group, the nearest place before it
    that no group so far has had takes the group's prefix at the end of its own, as often as it is the
    nearest; it moves to a new group right above its old one, the more often the higher. A group's
    prefix is final when its turn comes, and is the longest Lyndon word there. A place moves once for
    each place at most that it is nearest to, so all moves together are linear.
    """
    values, at = np.unique(codes, return_inverse=True)
    kinds = len(values)
    group = (kinds - 1 - at if descending else at).tolist()
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=kinds))
    members = [x.tolist() for x in np.split(order, ends[:-1])]
    size, down, up = [1] * kinds, list(range(-1, kinds - 1)), [*range(1, kinds), -1]
    n = len(codes)
    before, after = list(range(-1, n)), list(range(1, n + 2))  # places that no group has had yet
    out = [1] * n
    top = kinds - 1
    while top >= 0:
        length = size[top]
        took: dict[int, int] = {}
        for i in members[top]:
            if group[i] != top:
                continue  # it has moved on
            out[i] = length
            left, right = before[i], after[i]
            before[right] = left
            if left >= 0:
                after[left] = right
                took[left] = took.get(left, 0) + 1
        if took:
            moves: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i, times in took.items():
                moves[-times, group[i]].append(i)
            for times, old in sorted(moves):
                new, above = len(size), up[old]
                size.append(size[old] - times * length)
                down.append(old)
                up.append(above)
                up[old] = new
                if above >= 0:
                    down[above] = new
                members.append(moved := moves[times, old])
                for i in moved:
                    group[i] = new
        members[top] = []
        top = down[top]
    return np.array(out, np.int64)


def common_extension(codes: np.ndarray, a: int, b: int) -> int:
    """How many codes from place a on equal those from place b on (a < b)."""
    n, step = 0, STEP
    while b + n < len(codes):
        x, y = codes[a + n : a + n + step], codes[b + n : b + n + step]
        unlike = np.flatnonzero(x[: len(y)] != y)
        if len(unlike):
            return n + int(unlike[0])
        n, step = n + len(y), 2 * step
    return n


def find_runs(codes: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(least, times * period) codes (times >= 2),
    by start, then period.

    A run repeats a longest Lyndon word of one of the two orders, which begins within the run's first
    period, and no run has another smallest period than that word's length. So each place where the
    Lyndon word is followed by times - 2 copies at least is extended both ways.
    """
    n, found = len(codes), set()
    places, back = np.arange(n), codes[::-1]
    for descending in (False, True):
        root = lyndon_array(codes, descending)
        # the root lies within the first period, so times - 1 periods follow its begin
        able = np.flatnonzero(places + (times - 1) * root <= n)
        for k in range(1, times - 1):
            able = able[codes[able] == codes[able + k * root[able]]]
        until: dict[int, int] = {}  # the end of the last run of a period
        for i in able.tolist():
            p = int(root[i])
            if i + p <= until.get(p, 0):
                continue  # the same run
            right = common_extension(codes, i, i + p)
            if right < (times - 2) * p:
                continue
            left = common_extension(back, n - i - p, n - i)
            until[p] = i + p + right
            if left + right + p >= max(least, times * p):
                found.add((i - left, left + right + p, p))
    return sorted(found)


def stretches(codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to): the stretches of one owner's codes that can hold a run of length max(6, 4 * period)
    and all its neighbours of the same period.

    Every three neighbouring words of such a run stand in it three times at least. So a stretch goes
    on only over triples that its owner has three times; stretches under six words drop, and triples
    are counted again within each stretch until all stay. The first count is one of hashes, which only
    lets more through.
    """
    n = len(codes)
    if n < 6:
        return
    kept = np.ones(n, bool)
    for turn in range(64):
        triple = np.zeros(n, bool)  # whether one begins here
        triple[:-2] = kept[:-2] & kept[1:-1] & kept[2:] & (owner[:-2] == owner[2:])
        at = np.flatnonzero(triple)
        if not len(at):
            return
        if turn == 0:
            odd = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)]
            h = codes[at].astype(np.uint64) * odd[0] + codes[at + 1].astype(np.uint64) * odd[1] + codes[at + 2].astype(np.uint64) * odd[2] + owner[at].astype(np.uint64) * odd[3]
            names = ((h ^ (h >> np.uint64(29))) * odd[0] >> np.uint64(64 - int(4 * n).bit_length())).astype(np.int64)
        else:
            names = owner[at]
            for k in range(3):
                names = np.unique(names * (int(codes.max()) + 1) + codes[at + k], return_inverse=True)[1]
        enough = np.bincount(names)[names] >= 3
        at = at[enough]
        now = np.zeros(n, bool)
        now[at] = now[at + 1] = now[at + 2] = True
        # a stretch ends where no triple that stays reaches over
        linked = np.zeros(n, bool)
        linked[at + 1] = linked[at + 2] = True
        first = now & ~linked
        pieces = np.cumsum(first)
        sizes = np.bincount(pieces[now], minlength=pieces[-1] + 1 if n else 1)
        now &= sizes[pieces] >= 6
        settled = turn > 0 and enough.all() and (now == kept).all()
        kept, owner = now, np.where(now, pieces, 0)
        if settled or not kept.any():
            break
    begins = np.flatnonzero(kept & np.r_[True, (owner[1:] != owner[:-1]) | ~kept[:-1]])
    ends = np.flatnonzero(kept & np.r_[(owner[1:] != owner[:-1]) | ~kept[1:], True]) + 1
    yield from zip(begins.tolist(), ends.tolist(), strict=True)


def runs_of(words: pa.Array) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """For a list of words each, its runs; and of all words whether they stay when each run is cut down
    to its first period."""
    flat = words.flatten()
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(words)), counts)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(words))]
    gone = np.zeros(len(codes) + 1, np.int64)
    for a, b in stretches(codes, owner):
        i = int(owner[a])
        for start, length, period in find_runs(codes[a:b]):
            runs[i].append((a + start - int(begin[i]), length, period))
            gone[a + start + period] += 1
            gone[a + start + length] -= 1
    return [sorted(r) for r in runs], np.cumsum(gone)[:-1] == 0


def periodic_runs(docs: DataFrame, words: str = "words") -> DataFrame:
    """docs with n_words (long), runs (structs of start, length and period in words, by start, then
    period) and collapsed (string): the words that no run contains behind its first period, with one
    space between.

    `words` is a column of array<string>. A run is a stretch of consecutive words with the smallest
    period q, of max(6, 4 * q) words or more, that no neighbouring word goes on. Arrays go to Python a
    megabyte at a time, a longer one by itself. Null and empty arrays have no runs and an empty
    string; null words equal each other and stand for nothing in collapsed. Rows are independent:
    repeated rows repeat, ties can't arise. Input columns named like an output are replaced, others
    stay. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes = pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False)
            each = batch.nbytes // max(1, int(sizes.sum())) + 1
            for some in [*by_bytes(int(n) * each + 64 for n in sizes)] or [slice(0, 0)]:
                yield _result(pc.fill_null(batch[some], []) if batch[some].null_count else batch[some])

    d = docs.select(as_row(docs, *OUT), F.col(words).alias("_words"))
    return d.select("_row", F.arrow_udf(run, SCHEMA)(F.col("_words")).alias("_made")).select("_row.*", "_made.*")


def _result(words: pa.Array) -> pa.Array:
    runs, stays = runs_of(words)
    counts = words.value_lengths().to_numpy(zero_copy_only=False)
    kept = np.add.reduceat(np.r_[stays, False].astype(np.int64), np.cumsum(counts) - counts) * (counts > 0) if len(counts) else counts
    flat = words.flatten().filter(pa.array(stays))
    lists = pa.LargeListArray.from_arrays(pa.array(np.cumsum(np.r_[0, kept]), pa.int64()), flat)
    joined = pc.binary_join(lists.cast(pa.large_list(pa.string())), " ")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in of] for of in runs], pa.list_(kind))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), rows, joined.cast(pa.string())], names=list(OUT))


def planted(docs: DataFrame, words: str = "words", doc_id: str = "doc_id") -> DataFrame:
    """docs whose words are changed by the query's contract: of one document in ten by the checksum h
    of its id, the words from place a on repeat p words from there. Null ids have no checksum and
    keep their words."""
    h, n = F.crc32(F.col(doc_id).cast("string")), F.size(words)
    d = docs.withColumn("_h", h).withColumn("_a", F.when((F.col("_h") % 10 == 0) & (n > 0), F.expr("_h div 10") % n).cast("int"))
    d = d.withColumn("_p", (1 + F.floor((n - F.col("_a")) / (3 + F.expr("_h div 10") % 8))).cast("int"))
    moved = F.transform(words, lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get(words, F.col("_a") + (i - F.col("_a")) % F.col("_p"))))
    return d.withColumn(words, F.when(F.col("_a").isNull(), F.col(words)).otherwise(moved)).drop("_h", "_a", "_p")


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """periodic_runs() of the words of all documents, changed by planted(), as counts and digests.
    Nulls, empty texts, repeats, an empty table and further columns as stated there."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array().cast("array<string>")).alias("words"))
    found = periodic_runs(planted(docs)).drop("words")
    # runs come by start and period, so a run takes the place of an earlier one only if it's more periods long
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))))
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    return told.select("doc_id", "n_runs", "_b.start", "_b.length", "_b.period", F.expr("1000 * _b.length div _b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
