"""Restructuring graphs: edges, ids, degrees, neighbourhoods, subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans import ranges


def reverse(edges: DataFrame) -> DataFrame:
    return edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})


def with_reverse(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, none dropped."""
    return edges.unionByName(reverse(edges))


def symmetrise(edges: DataFrame) -> DataFrame:
    """Each pair both ways once, without self loops."""
    return with_reverse(edges.select("src", "dst")).where("src != dst").distinct()


def with_self_loops(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(vertices.select("id", "id"))


def merge_parallel(edges: DataFrame, weight: str = "w") -> DataFrame:
    """One edge for each pair, weights summed."""
    return edges.groupBy("src", "dst").agg(F.sum(weight).alias(weight))


def all_vertices(edges: DataFrame) -> DataFrame:
    """Ids from 0 to the largest end, as formats without a vertex list mean it."""
    most = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
    return edges.sparkSession.range(0 if most is None else most + 1)


def degrees(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree), 0 where there are no edges; one shuffle for both."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1))).union(vertices.select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def row_pointers(edges: DataFrame, vertices: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(id, start, degree): where a vertex's edges start when edges are sorted by source.

    Degrees are summed by blocks of ids first, so that no task scans all vertices.
    """
    deg = degrees(edges, vertices).select("id", F.col("out_degree").alias("degree"), F.floor(F.col("id") / block).alias("b"))
    sums = deg.groupBy("b").agg(F.sum("degree").alias("s"))
    base = sums.select("b", F.coalesce(F.sum("s").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.coalesce(F.sum("degree").over(Window.partitionBy("b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return deg.withColumn("before", before).join(base, "b").select("id", (F.col("base") + F.col("before")).alias("start"), "degree")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): sorted out-neighbours of each source."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def adjacency_chunks(edges: DataFrame, size: int) -> DataFrame:
    """(id, chunk, neighbours): as adjacency(), in arrays of at most `size` neighbours, so that a hub is
    no row that grows with it."""
    parts = neighbour_groups(edges.select("src", "dst"), size)
    return parts.groupBy(F.col("src").alias("id"), F.col("part").alias("chunk")).agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))


def stats(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(n_nodes, n_edges, avg_degree, avg_span) in one row; span is |src - dst|."""
    e = edges.agg(F.count("*").alias("n_edges"), F.avg(F.abs(F.col("src") - F.col("dst"))).alias("avg_span"))
    v = vertices.agg(F.count("*").alias("n_nodes"))
    return e.crossJoin(F.broadcast(v)).select("n_nodes", "n_edges", (F.col("n_edges") / F.col("n_nodes")).alias("avg_degree"), "avg_span")  # one row each


def right_norm(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, norm): 1 / in-degree, 0 without in-edges."""
    d = degrees(edges, vertices)
    return d.select("id", F.when(F.col("in_degree") > 0, 1 / F.col("in_degree")).otherwise(0.0).alias("norm"))


def numbered(rows: DataFrame, *order: str, name: str = "new") -> DataFrame:
    """rows with their number from 0 in the order, counted range by range."""
    return ranges.placed(rows.withColumn("_one", F.lit(0)), ["_one"], order, name).drop("_one")


def compact_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ends numbered from 0 in the order of the old ids, and the map (id, new).

    Ids are dealt in ranges and numbered within each; ranges' counts make the offsets.
    """
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    new = numbered(ids, "id")
    return map_ids(edges, new), new


def map_ids(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends replaced by the map (id, new); edges with an end outside of it go."""
    a, b = ids.select(F.col("id").alias("src"), F.col("new").alias("_s")), ids.select(F.col("id").alias("dst"), F.col("new").alias("_d"))
    return edges.join(a, "src").join(b, "dst").withColumns({"src": F.col("_s"), "dst": F.col("_d")}).drop("_s", "_d")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select(*edges.columns)


def hop_edges(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(hop, src, dst): edges into the frontier of each hop; the next frontier are their sources and
    all nodes so far."""
    front, out = seeds.select("id"), None
    for hop in range(1, hops + 1):
        step = edges.select("src", "dst").join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.lit(hop).alias("hop"), "src", "dst")
        out = step if out is None else out.union(step)
        front = front.union(step.select("src")).distinct()
    return out


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id): seeds and all nodes from which a seed can be reached in at most `hops` edges."""
    front = seeds.select("id")
    for _ in range(hops):
        step = edges.select("src", "dst").join(front.select(F.col("id").alias("dst")), "dst", "left_semi")
        front = front.union(step.select("src")).distinct()
    return front


def neighbour_groups(edges: DataFrame, size: int) -> DataFrame:
    """(src, dst, part): each source's edges in groups of `size`, as salts for heavy vertices."""
    return ranges.placed(edges, ["src"], ["dst"], "_i").withColumn("part", F.floor(F.col("_i") / size)).drop("_i")


def active_edges(edges: DataFrame, state: DataFrame, active: Column) -> DataFrame:
    """Out-edges of the vertices for which `active` holds."""
    return edges.join(state.where(active).select(F.col("id").alias("src")), "src", "left_semi")


def last_per_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Of each key the row that comes last in the order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(key, "r.*")


def stitch(relations: dict[str, DataFrame]) -> DataFrame:
    """One table of all relations' edges (src, dst) with bid, the relation's number by name."""
    out = None
    for bid, name in enumerate(sorted(relations)):
        e = relations[name].select("src", "dst", F.lit(bid).alias("bid"))
        out = e if out is None else out.unionByName(e)
    return out
