"""Uniform shuffling into shards of exact sizes with a hypergeometric communication matrix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import table, uniform, without
from weftgraph.plans.lineage import cut

#: Rows of a source partition, on average; a task sorts one at a time.
BLOCK = 16384
OUT = ("shard", "slot")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among `draws` of `pop` items of which `good` are good, by inversion
    of the uniform number u.

    Weights relative to the mode come from the ratio of neighbouring probabilities, so nothing
    overflows. The walk covers nine standard deviations on both sides (or all of the support),
    beyond which less than 2**-53 of the probability lies, the resolution of u.
    """
    one = F.lit(1).cast("long")
    p = good / F.greatest(pop, one)
    sd = F.sqrt(draws * p * (1 - p) * (pop - draws) / F.greatest(pop - 1, one))
    reach = F.ceil(9 * sd).cast("long") + 30
    given = F.struct(
        pop.alias("pop"), good.alias("good"), draws.alias("draws"), u.alias("u"), reach.alias("reach"),
        F.floor((draws + 1) * ((good + 1) / (pop + 2).cast("double"))).cast("long").alias("mode"),
        F.greatest(F.lit(0).cast("long"), draws + good - pop).alias("lo"), F.least(draws, good).alias("hi"),
    )

    def pick(g: Column) -> Column:
        mode = F.greatest(g["lo"], F.least(g["hi"], g["mode"]))
        return _let(F.struct(mode.alias("mode"), F.greatest(g["lo"], mode - g["reach"]).alias("lo"), F.least(g["hi"], mode + g["reach"]).alias("hi")), lambda r: walk(g, r))

    def up(g: Column, k: Column) -> Column:  # P(k) / P(k - 1)
        return ((g["good"] - k + 1).cast("double") * (g["draws"] - k + 1)) / (k.cast("double") * (g["pop"] - g["good"] - g["draws"] + k))

    def span(a: Column, b: Column) -> Column:
        return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))

    def total(g: Column, ks: Column, ratio: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"))
        return F.aggregate(ks, start, lambda s, k: _let(s["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))))

    def walk(g: Column, r: Column) -> Column:
        down = total(g, F.reverse(span(r["lo"] + 1, r["mode"])), lambda k: 1 / up(g, k))  # its last weight is P(lo) / P(mode)
        above = total(g, span(r["mode"] + 1, r["hi"]), lambda k: up(g, k))
        return _let(F.struct(down["w"].alias("first"), (g["u"] * (1 + down["sum"] + above["sum"])).alias("aim")), lambda t: choose(g, r, t))

    def choose(g: Column, r: Column, t: Column) -> Column:
        start = F.struct(t["first"].alias("w"), t["first"].alias("sum"), r["lo"].alias("k"))
        step = lambda s, k: F.when(s["sum"] >= t["aim"], s).otherwise(_let(s["w"] * up(g, k), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), k.alias("k"))))
        return F.aggregate(span(r["lo"] + 1, r["hi"]), start, step)["k"]

    return _let(given, pick)


def _share(counts: Column, draws: Column, node: Column, seed: int) -> Column:
    """A multivariate hypergeometric draw: how many of `draws` items fall to each entry of counts."""
    def one(done: Column, j: Column) -> Column:
        rest = F.aggregate(F.slice(counts, j, F.size(counts)), F.lit(0).cast("long"), lambda a, x: a + x)
        left = draws - F.aggregate(done, F.lit(0).cast("long"), lambda a, x: a + x)
        return F.concat(done, F.array(hypergeometric(rest, F.element_at(counts, j), left, uniform(F.lit(seed), node, j))))

    return F.aggregate(F.sequence(F.lit(1), F.size(counts)), F.array().cast("array<bigint>"), one)


def communication_matrix(sizes: DataFrame, levels: int, shards: list[int], seed: int) -> DataFrame:
    """Rows (p, counts): how many rows of source partition p go to each shard.

    sizes has (p, n) for partitions 0 to 2**levels - 1 (absent: none); shards has the exact sizes.
    The whole range of partitions starts with the shard sizes. Each level draws, for every node,
    what its left half gets; the right half gets the rest. All nodes of a level are drawn at the
    same time, and the product of the draws has the law of a uniform shuffle.
    """
    spark = sizes.sparkSession
    caps = F.array(*[F.lit(x).cast("long") for x in shards])
    nodes = spark.range(1).select(F.lit(1).cast("long").alias("node"), caps.alias("counts"))
    if levels == 0:
        return nodes.select((F.col("node") - 1).alias("p"), "counts")
    # each partition adds its rows to the left-half count of the nodes above it whose left half it is in
    heap = F.col("p") + 2**levels
    above = sizes.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda i: F.floor(heap / F.pow(F.lit(2.0), i - 1)).cast("long"))).alias("child"))
    halves = above.where("child % 2 = 0").groupBy(F.expr("child div 2").alias("node")).agg(F.sum("n").alias("left_n"))
    for _ in range(levels):
        nodes = nodes.join(halves, "node", "left").withColumn("left_n", F.coalesce("left_n", F.lit(0).cast("long")))
        nodes = nodes.withColumn("left", _share(F.col("counts"), F.col("left_n"), F.col("node"), seed))
        halved = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts")), F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")))
        nodes = nodes.select(F.explode(halved).alias("half")).select("half.*")
    return nodes.select((F.col("node") - 2**levels).alias("p"), "counts")


def shuffle_into_shards(docs: DataFrame, n_shards: int = 24, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """docs with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard): a uniformly
    random permutation of the rows, cut into shards whose row counts differ by one at most.

    Rows are dealt to source partitions by hash; the communication matrix says how many rows each
    sends to each shard; a random order within the partition says which; and a second random order
    within the shard gives the slots. No task holds more than a block of rows: slots are counted in
    ranges of the second order and put together from the counts of the ranges.

    The key and the row's own number seed the order, so a hot or null key spreads like any other.
    An empty table gives no rows; repeated rows get slots of their own. Input columns named shard or
    slot are replaced. The rows are written once to the shared folder, as two passes need them
    alike: hand over only the columns that are to travel.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in without(docs, *OUT).columns])
    deal = F.xxhash64(F.lit(seed), F.col(key), F.monotonically_increasing_id())
    keyed = cut(docs.select(row.alias("_row"), deal.alias("_k")))
    n = keyed.count()
    levels = max(0, (max(1, n) - 1) // BLOCK).bit_length() + 2 * (n > 0)
    keyed = keyed.withColumn("_p", F.pmod(F.xxhash64(F.lit("part"), "_k"), F.lit(2**levels)))
    sizes = keyed.groupBy(F.col("_p").alias("p")).agg(F.count("*").alias("n"))
    matrix = communication_matrix(sizes, levels, [n // n_shards + (j < n % n_shards) for j in range(n_shards)], seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda j: F.aggregate(F.slice("counts", 1, j), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = matrix.select(F.col("p").alias("_p"), ends.alias("_ends"))
    local = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(F.xxhash64(F.lit("local"), "_k"), "_k")) - 1)
    sent = local.join(matrix, "_p").withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_r"))).cast("int"))
    # the second permutation, in ranges of its order
    ranges = 2 ** max(0, (max(1, n) // n_shards - 1) // BLOCK).bit_length()
    again = F.xxhash64(F.lit("shard"), "_k")
    sent = sent.select("_row", "_k", "shard", again.alias("_again"), F.floor(uniform(F.lit("range"), again) * ranges).cast("int").alias("_range"))
    counts = sent.groupBy("shard", "_range").agg(F.count("*").alias("_c"))
    base = F.coalesce(F.sum("_c").over(Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "_range", base.alias("_base"))
    placed = sent.withColumn("_i", F.row_number().over(Window.partitionBy("shard", "_range").orderBy("_again", "_k")) - 1)
    return placed.join(counts, ["shard", "_range"]).select("_row.*", "shard", (F.col("_base") + F.col("_i")).cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str, parts: int = 1) -> None:
    """The shards as folders shard=J of Parquet files, `parts` slot ranges each, sorted by slot. Null
    texts and repeated rows are written as they are; an empty table writes no shard."""
    piece = F.pmod(F.xxhash64("slot"), F.lit(parts))
    sharded.repartition(F.col("shard"), piece).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op7_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shuffle_into_shards() of all documents by the law `rows`. A null text has size 8; repeats get
    slots of their own, ties are broken by the rows' hashes, an empty table gives no rows, and
    further columns play no part."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    d = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(d)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
