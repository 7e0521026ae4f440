"""Neighbour and negative samples that a portable hash decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.structure import degrees, numbered
from weftgraph.operators.temporal import mix


def split_of(id_: Column, train: int, val: int) -> Column:
    """train, val or test by hash, in percent."""
    h = (id_ * 2654435761) % 2147483629 % 100
    return F.when(h < train, "train").when(h < train + val, "val").otherwise("test")


#: Into how many lanes a seed's edges are dealt before they meet; each sends on as many as are asked for.
LANES = 64


def neighbours(edges: DataFrame, seeds: DataFrame, k: int, salt: int = 0, into: bool = False) -> DataFrame:
    """(seed, nbr): at most k out-neighbours (or in-neighbours) of each seed, without replacement."""
    here, there = ("dst", "src") if into else ("src", "dst")
    e = edges.select(F.col(here).alias("seed"), F.col(there).alias("nbr")).join(seeds.select(F.col("id").alias("seed")), "seed", "left_semi")
    order = [mix(F.col("seed"), F.col("nbr"), salt), "nbr"]
    # the k first of each lane of a seed, then of its lanes: a hub's edges don't meet in one task
    lane = Window.partitionBy("seed", F.pmod(F.xxhash64("nbr"), F.lit(LANES))).orderBy(*order)
    few = e.withColumn("n", F.row_number().over(lane)).where(F.col("n") <= k)
    return few.withColumn("n", F.row_number().over(Window.partitionBy("seed").orderBy(*order))).where(F.col("n") <= k).select("seed", "nbr")


def multi_hop(edges: DataFrame, seeds: DataFrame, fanouts: list[int], salt: int = 0) -> DataFrame:
    """(hop, seed, nbr): each hop samples for all nodes met so far."""
    front, out = seeds.select("id").distinct(), None
    for hop, k in enumerate(fanouts, 1):
        step = neighbours(edges, front, k, salt + hop).select(F.lit(hop).alias("hop"), "seed", "nbr")
        out = step if out is None else out.union(step)
        front = front.union(step.select("nbr")).distinct()
    return out


def negatives(events: DataFrame, n_nodes: int, per_event: int, salt: int = 0) -> DataFrame:
    """(eid, j, neg): per_event random nodes for each event."""
    rows = events.select("eid", F.explode(F.sequence(F.lit(1), F.lit(per_event))).alias("j"))
    return rows.select("eid", "j", (mix(F.col("eid"), F.col("j"), salt) % n_nodes).alias("neg"))


def unseen_nodes(split: DataFrame) -> DataFrame:
    """(id): ends of test events that no train event has, of events with split."""
    ends = lambda s: (e := split.where(F.col("split") == s)).select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    return ends("test").join(ends("train"), "id", "left_anti")


def negatives_among(events: DataFrame, nodes: DataFrame, per_event: int, salt: int = 0) -> DataFrame:
    """(eid, j, neg): per_event random nodes of `nodes` (id) for each event. Nodes are numbered range by
    range, and a draw is joined with the node of its number, so neither side is collected. Without
    nodes there are no draws."""
    pool = numbered(nodes.select("id").distinct(), "id", name="_i")
    n = pool.agg(F.count("*").alias("_n"))
    rows = events.select("eid", F.explode(F.sequence(F.lit(1), F.lit(per_event))).alias("j")).crossJoin(F.broadcast(n)).where("_n > 0")  # one row
    return rows.withColumn("_i", mix(F.col("eid"), F.col("j"), salt) % F.col("_n")).join(pool, "_i").select("eid", "j", F.col("id").alias("neg"))


def top_by_degree(edges: DataFrame, vertices: DataFrame, most: int) -> DataFrame:
    """(id, out_degree) of the `most` vertices of the most out-edges, of equal ones those of least id:
    what a cache of that size keeps. Each task sends on `most` rows."""
    return degrees(edges, vertices).select("id", "out_degree").orderBy(F.col("out_degree").desc(), "id").limit(most)


def visit_share(visits: DataFrame, top: float) -> DataFrame:
    """(nodes, visits, top_nodes, hit_rate): the share of visits that go to the `top` most visited."""
    counts = visits.groupBy("id").agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("nodes"), F.sum("n").alias("visits"))
    # frequencies are few, so nodes are ranked by groups of equal frequency
    by = counts.groupBy("n").agg(F.count("*").alias("c"))
    before = F.coalesce(F.sum("c").over(Window.orderBy(F.col("n").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    both = by.withColumn("before", before).crossJoin(F.broadcast(total)).withColumn("top_nodes", F.ceil(F.col("nodes") * top))
    taken = F.greatest(F.lit(0), F.least("c", F.col("top_nodes") - F.col("before")))
    return both.groupBy("nodes", "visits", "top_nodes").agg(F.sum(taken * F.col("n")).alias("hits")).select("nodes", "visits", "top_nodes", (F.col("hits") / F.col("visits")).alias("hit_rate"))
