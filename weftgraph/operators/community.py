"""Communities, modularity and vertex orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.structure import degrees, map_ids, numbered
from weftgraph.plans import ranges
from weftgraph.plans.lineage import cut, stored


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(q) of labels (id, community) over directed edges of a symmetric graph with weights w:
    sum over communities of inside / m2 - (all / m2) squared."""
    a, b = labels.select(F.col("id").alias("src"), F.col("community").alias("_a")), labels.select(F.col("id").alias("dst"), F.col("community").alias("_b"))
    by = edges.join(a, "src").join(b, "dst").groupBy("_a").agg(F.sum("w").alias("whole"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("w")).otherwise(0)).alias("inside"))
    m2 = by.agg(F.sum("whole").alias("m2"))
    return by.crossJoin(F.broadcast(m2)).agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("whole") / F.col("m2"), 2)).alias("q"))  # one row


#: Levels by which the merges into one community are thinned.
LEVELS = 16


def merge_communities(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, community) such that no two communities would raise the modularity by merging."""
    return merge_forest(edges, vertices)[0]


def merge_forest(edges: DataFrame, vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, community) such that no two communities would raise the modularity by merging, and the
    merges that made them, (id, parent, round, size): the community `id`, of `size` vertices, merged
    into `parent` in a round. Both are named by the vertex they began as.

    Directions of edges don't count; weights w do. Every vertex starts alone. In each round a
    community looks for the neighbour whose merge gains most, w(a, b) - s(a) s(b) / m2. Pairs that
    choose each other merge. Of the others half, by hash, move to their choice (or to its pair) if
    that one stays in this round. So that many moves into one community can't undo each other's
    gain, they are thinned by hash until they weigh no more than what they join, and each must gain
    even if it comes last. The modularity thus never falls, stars and chains shrink by a share in
    every round, and later rounds work on the contracted graph only. Self loops count for strength.
    Edges are computed once; pairs carry the strengths of their ends, so a round joins them twice (with
    what its ends became), and vertices are only joined again when all rounds are done.
    """
    e = stored(edges.select("src", "dst", "w"))
    ends = e.select(F.col("src").alias("id"), "w").union(e.select("dst", "w"))
    own = ends.groupBy("id").agg(F.sum("w").alias("s"))
    # the communities of a round, with strength and size
    now = vertices.select("id").join(own, "id", "left").groupBy(F.col("id").alias("community"))
    now = stored(now.agg(F.sum(F.coalesce("s", F.lit(0))).alias("s"), F.count("*").alias("size")))
    m2 = now.agg(F.sum("s")).first()[0]
    strength = lambda c: now.select(F.col("community").alias(c), F.col("s").alias(f"s{c}"))
    pairs = e.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("w").alias("w"))
    pairs = stored(pairs.join(strength("a"), "a").join(strength("b"), "b"))
    done, steps, forest = 0, [], vertices.select("id", F.col("id").alias("parent"), F.lit(0).alias("round"), F.lit(0).cast("long").alias("size")).limit(0)
    while True:
        moves = stored(_moves(pairs, m2, done))
        if moves.isEmpty():
            break
        joined = now.join(moves.select(F.col("a").alias("community"), "head"), "community", "left")
        joined = stored(joined.select("community", F.coalesce("head", "community").alias("head"), "s", "size", F.col("head").isNotNull().alias("moved")))
        forest = forest.unionByName(joined.where("moved").select(F.col("community").alias("id"), F.col("head").alias("parent"), F.lit(done).alias("round"), "size"))
        now = stored(joined.groupBy(F.col("head").alias("community")).agg(F.sum("s").alias("s"), F.sum("size").alias("size")))
        step = stored(joined.select("community", "head").join(now.select(F.col("community").alias("head"), "s"), "head"))
        steps.append(step)
        to = lambda c, x: step.select(F.col("community").alias(c), F.col("head").alias(x), F.col("s").alias(f"s{x}"))  # noqa: B023, E731
        ends = pairs.select("a", "b", "w").join(to("a", "x"), "a").join(to("b", "y"), "b").where("x <> y")
        low = lambda x, y: F.when(F.col("x") < F.col("y"), F.col(x)).otherwise(F.col(y))
        ends = ends.select(low("x", "y").alias("a"), low("y", "x").alias("b"), low("sx", "sy").alias("sa"), low("sy", "sx").alias("sb"), "w")
        pairs = stored(ends.groupBy("a", "b", "sa", "sb").agg(F.sum("w").alias("w")))
        done += 1
    # where each community ended, from the last round to the first: only those of that round are joined
    found = now.select(F.col("community").alias("head"), F.col("community").alias("last"))
    for step in reversed(steps):
        found = stored(step.select("community", "head").join(found, "head").select(F.col("community").alias("head"), "last"))
    return vertices.select("id").join(found.toDF("id", "community"), "id", "left"), forest


def _moves(pairs: DataFrame, m2: float, done: int) -> DataFrame:
    """(a, head): the communities that merge in a round, and what each merges into. pairs: (a, b, w, sa, sb)."""
    gain = F.col("w") - F.col("sa") * F.col("sb") / m2
    good = pairs.withColumn("gain", gain).where("gain > 0")
    side = lambda a, b: F.struct(F.col(a).alias("a"), F.col(f"s{a}").alias("sa"), F.struct("gain", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"), F.col(b).alias("b"), F.col(f"s{b}").alias("sb"), "w").alias("c"))
    best = stored(good.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("e")).select("e.*").groupBy("a").agg(F.max("c").alias("c"), F.first("sa").alias("sa")).select("a", "sa", "c.b", "c.sb", "c.w"))
    next_ = best.select(F.col("a").alias("b"), F.col("b").alias("t"), F.col("sb").alias("st"))
    third = best.select(F.col("a").alias("t"), F.col("b").alias("u"))
    paired, to_pair = F.col("t") == F.col("a"), F.col("u") == F.col("b")
    waits = lambda c: F.pmod(F.xxhash64(F.lit(done), c), F.lit(2)) == 0
    told = stored(best.join(next_, "b").join(third, "t"))
    pairing = told.where(paired & (F.col("a") > F.col("b"))).select("a", F.col("b").alias("head"))
    asks = told.where(~paired & ~waits("a") & (to_pair | waits("b"))).select(
        "a", "sa", "w", F.when(to_pair, F.least("b", "t")).otherwise(F.col("b")).alias("head"), F.when(to_pair, F.col("sb") + F.col("st")).otherwise(F.col("sb")).alias("base"),
        F.least(F.lit(LEVELS - 1), F.floor(-F.log2((F.pmod(F.xxhash64("a", F.lit(done)), F.lit(1 << 30)) + 1) / (1 << 30)))).alias("level"),
    )
    sums = F.array(*[F.sum(F.when(F.col("level") >= k, F.col("sa")).otherwise(0)) for k in range(LEVELS)])
    heads = asks.groupBy("head").agg(sums.alias("sums"), F.greatest(F.max("base"), F.max("sa")).alias("most"))
    keep = F.array_position(F.transform("sums", lambda x: x <= F.col("most")), F.lit(True))
    heads = heads.withColumn("k", keep).where("k > 0").select("head", F.col("k") - 1, F.element_at("sums", F.col("k").cast("int")).alias("all")).toDF("head", "k", "all")
    takes = (F.col("level") >= F.col("k")) & (F.col("w") - F.col("sa") * (F.col("base") + F.col("all") - F.col("sa")) / m2 > 0)
    return pairing.union(asks.join(heads, "head").where(takes).select("a", "head"))


def order_by_community(labels: DataFrame) -> DataFrame:
    """(id, new): ids such that communities are contiguous, numbered range by range."""
    return numbered(labels, "community", "id").select("id", "new")


def order_by_forest(vertices: DataFrame, forest: DataFrame) -> DataFrame:
    """(id, new): the places of all vertices in a walk of the merge forest in depth: a vertex, then
    what merged into it, the earliest round first and then the least id, each with all that merged
    into that before; trees by the ids of their roots.

    A vertex stands behind its parent by one and the sizes of its earlier siblings, which are running
    sums over ranges, so a root with very many children is no single task. Distances to the root are
    added up by jumping: each round doubles the steps, so they are as many as the logarithm of the
    forest's depth, which is at most the number of merge rounds.
    """
    kids = ranges.running(forest, ["parent"], ["round", "id"], _sum=F.col("size"))
    links = kids.select("id", F.col("parent").alias("up"), (1 + F.col("_sum") - F.col("size")).alias("off"))
    below = forest.groupBy(F.col("parent").alias("id")).agg(F.sum("size").alias("_below"))
    tops = vertices.select("id").join(forest.select("id"), "id", "left_anti").join(below, "id", "left")
    tops = tops.select("id", (1 + F.coalesce("_below", F.lit(0))).alias("_size"), F.lit(0).alias("_one"))
    base = ranges.running(tops, ["_one"], ["id"], _sum=F.col("_size")).select("id", (F.col("_sum") - F.col("_size")).alias("base"))
    left = cut(links.select("id", "up", "off", F.lit(False).alias("end")).unionByName(tops.select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("end"))))
    while True:
        ended = left.where("end")
        if left.where("not end").isEmpty():
            break
        step = left.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("off").alias("_off"), F.col("end").alias("_end"))
        moved = left.where("not end").join(step, "up").select("id", F.col("_up").alias("up"), (F.col("off") + F.col("_off")).alias("off"), F.col("_end").alias("end"))
        left = cut(ended.unionByName(moved))
    return left.join(base.select(F.col("id").alias("up"), "base"), "up").select("id", (F.col("base") + F.col("off")).alias("new"))


def order_by_degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, new): by in-degree, largest first, then by id."""
    d = degrees(edges, vertices).select("id", (-F.col("in_degree")).alias("community"))
    return order_by_community(d)


def reorder(edges: DataFrame, order: DataFrame) -> DataFrame:
    return map_ids(edges, order)
