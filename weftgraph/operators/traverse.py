"""Fixed-point algorithms as rounds of join, aggregate and merge."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import cut, stored

#: What an unreached vertex gets where a number is asked for (largest unsigned 32-bit number less one).
FAR = 4294967294


#: Ends of one row of a vertex's list of neighbours, more or less; a hub has several rows.
ENDS = 1024


def _dealt(edges: DataFrame, *cols: str) -> DataFrame:
    """Edges dealt by source and sorted once, so that a round moves the frontier and neither moves nor sorts
    the edges. Without a number of partitions there would be as many as suit their size, not those of a join."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(edges.select(*cols).repartition(parts, "src").sortWithinPartitions("src"))


def _lists(edges: DataFrame) -> DataFrame:
    """(src, degree, ends) of edges, dealt by source: rounds read a row for each vertex or ENDS neighbours."""
    e = stored(edges.select("src", "dst"))
    out = e.groupBy("src").agg(F.count("*").alias("degree"))
    piece = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / ENDS))
    return _dealt(e.join(out, "src").groupBy("src", "degree", piece.alias("piece")).agg(F.collect_list("dst").alias("ends")), "src", "degree", "ends")


def propagate(edges: DataFrame, start: DataFrame, message: Callable[[Column, Column], Column], best: Callable[[Column], Column], better: Callable[[Column, Column], Column], rounds: int | None = None) -> DataFrame:
    """(id, value) after values have run along the edges until none improves.

    start: (id, value). In each round the vertices that improved send message(value, w) along their
    out-edges; best() picks from what a vertex gets, better(new, old) says whether it improves.
    Only improved vertices are active in the next round.
    """
    e = _dealt(edges, "src", "dst", "w")
    state = cut(start.select("id", "value", F.lit(True).alias("moved")))
    done = 0
    while (rounds is None or done < rounds) and not (active := state.where("moved")).isEmpty():
        sent = active.join(e, active["id"] == e["src"]).select(F.col("dst").alias("id"), message(F.col("value"), F.col("w")).alias("new"))
        sent = sent.groupBy("id").agg(best(F.col("new")).alias("new"))
        wins = F.col("new").isNotNull() & (F.col("value").isNull() | better(F.col("new"), F.col("value")))
        state = cut(state.drop("moved").join(sent, "id", "full").select("id", F.when(wins, F.col("new")).otherwise(F.col("value")).alias("value"), F.coalesce(wins, F.lit(False)).alias("moved")))
        done += 1
    return state.select("id", "value")


def _source(edges: DataFrame, source: int, value: int) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("id"), F.lit(value).cast("long").alias("value"))


def bfs(edges: DataFrame, source: int) -> DataFrame:
    """(id, value): hops from source along out-edges, reached vertices only."""
    return propagate(edges.withColumn("w", F.lit(1)), _source(edges, source, 0), lambda v, w: v + 1, F.min, lambda new, old: new < old)


def sssp(edges: DataFrame, source: int) -> DataFrame:
    """(id, value): least sum of weights (0 or more) from source."""
    return propagate(edges, _source(edges, source, 0), lambda v, w: v + w, F.min, lambda new, old: new < old)


def sswp(edges: DataFrame, source: int) -> DataFrame:
    """(id, value): the largest least weight of a path from source; FAR at the source itself."""
    return propagate(edges, _source(edges, source, FAR), lambda v, w: F.least(v, w), F.max, lambda new, old: new > old)


def min_labels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, value): the least vertex that reaches each vertex along directed edges."""
    return propagate(edges.withColumn("w", F.lit(0)), vertices.select("id", F.col("id").alias("value")), lambda v, w: v, F.min, lambda new, old: new < old)


def with_unreached(found: DataFrame, vertices: DataFrame, value: int = FAR) -> DataFrame:
    return vertices.select("id").join(found, "id", "left").select("id", F.coalesce("value", F.lit(value)).alias("value"))


def pagerank(edges: DataFrame, vertices: DataFrame, rounds: int | None = None, base: float = 0.15, damping: float = 0.85, least: float = 0.01) -> DataFrame:
    """(id, value, delta) of PageRank by pushing deltas, not normalised.

    Deltas start at `base`. In a round every vertex whose delta is above `least` adds it to its
    value and sends damping * delta / out-degree along its edges; what a vertex keeps is its delta
    less what it has sent. The mass of vertices without out-edges is dropped. Rounds are
    synchronous; without a number of rounds they end when no delta is above `least`.
    """
    e = _lists(edges)
    state = cut(vertices.select("id", F.lit(0.0).alias("value"), F.lit(base).alias("delta")).repartition(e.rdd.getNumPartitions(), "id").sortWithinPartitions("id"))
    done = 0
    while rounds is None or done < rounds:
        active = state.where(F.col("delta") > least)
        if rounds is None and active.isEmpty():
            break
        sent = active.join(e, active["id"] == e["src"]).select(F.explode("ends").alias("id"), (damping * F.col("delta") / F.col("degree")).alias("sent"))
        sent = sent.groupBy("id").agg(F.sum("sent").alias("got"))
        spent = F.when(F.col("delta") > least, F.col("delta")).otherwise(0.0)
        state = cut(state.join(sent, "id", "left").select("id", (F.col("value") + spent).alias("value"), (F.col("delta") - spent + F.coalesce("got", F.lit(0.0))).alias("delta")))
        done += 1
    return state


def betweenness(edges: DataFrame, source: int) -> DataFrame:
    """(id, level, paths, value): Brandes' dependency of one source, its own value included.

    Shortest paths are counted level by level, then dependencies flow back:
    value(u) = sum over v one level deeper of paths(u) / paths(v) * (1 + value(v)).
    """
    edges = stored(edges.select("src", "dst"))
    levels = cut(bfs(edges, source).withColumnRenamed("value", "level"))
    deepest = levels.agg(F.max("level")).first()[0]
    e = edges.select("src", "dst").join(levels.select(F.col("id").alias("src"), F.col("level").alias("ls")), "src").join(levels.select(F.col("id").alias("dst"), F.col("level").alias("ld")), "dst")
    e = cut(e.where("ld = ls + 1").select("src", "dst", F.col("ls").alias("level")))  # edges of shortest paths only
    paths = levels.where("level = 0").select("id", F.lit(1).cast("long").alias("paths"))
    all_paths = [paths]
    for depth in range(deepest):
        step = e.where(F.col("level") == depth).join(paths.withColumnRenamed("id", "src"), "src")
        paths = cut(step.groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")))
        all_paths.append(paths)
    value = all_paths[-1].select("id", "paths", F.lit(0.0).alias("value"))
    found = [value]
    for depth in range(deepest - 1, -1, -1):
        below = value.select(F.col("id").alias("dst"), F.col("paths").alias("pd"), F.col("value").alias("vd"))
        step = e.where(F.col("level") == depth).join(below, "dst").groupBy(F.col("src").alias("id")).agg(F.sum((1 + F.col("vd")) / F.col("pd")).alias("sum"))
        value = cut(all_paths[depth].join(step, "id", "left").select("id", "paths", (F.col("paths") * F.coalesce("sum", F.lit(0.0))).alias("value")))
        found.append(value)
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out.join(levels, "id").select("id", "level", "paths", "value")


def farthest(found: DataFrame) -> DataFrame:
    """(farthest, reached) of a traversal."""
    return found.agg(F.max(F.when(F.col("value") != FAR, F.col("value"))).alias("farthest"), F.sum((F.col("value") != FAR).cast("long")).alias("reached"))
