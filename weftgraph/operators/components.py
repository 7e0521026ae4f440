"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.lineage import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) for every end of an edge, the direction of edges ignored; component is the
    least id that can be reached.

    In each round every vertex hooks to its least neighbour, pointer jumping finds the roots of the
    trees, and the graph shrinks to its roots. A root is least in its tree and the least vertex of a
    component never hooks, so the last root left is the component's least id. The vertices of a
    component at least halve in a round, so rounds are logarithmic whatever the diameter. Hubs only
    meet in minima, which combine before the shuffle, and in joins that the session can split.
    Self loops give their end a row; rows with a null end are left out.
    """
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    e = e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    e = cut(e)
    labels = e.select(F.col("a").alias("id")).union(e.select("b")).distinct().withColumn("component", F.col("id"))
    e = e.where("a < b")
    while not e.isEmpty():
        both = e.select(F.col("a").alias("v"), F.col("b").alias("n")).union(e.select("b", "a"))
        parent = cut(both.groupBy("v").agg(F.min("n").alias("n")).select("v", F.least("v", "n").alias("p")))
        while True:
            up = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            jumped = cut(parent.join(up, "p").select("v", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            parent = jumped.select("v", "p")
            if jumped.where("moved").isEmpty():
                break
        to = parent.select(F.col("v").alias("component"), F.col("p"))
        labels = labels.join(to, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        ends = e.join(parent.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(parent.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        e = cut(ends.where("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    return labels
