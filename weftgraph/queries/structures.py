from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import structure as st
from weftgraph.queries import query
from weftgraph.sources.graphs import EVENT_GRAPH, PART_GRAPH, SEEDS, SUPPLY_GRAPH, event_graph, part_graph, part_vertices, seeds, supply_graph, table

G = f"WITH {PART_GRAPH} "


@query("p1_row_pointers", G + "SELECT id, CAST(coalesce(sum(degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, degree FROM (SELECT p_partkey AS id, count(e.src) AS degree FROM part LEFT JOIN e ON e.src = p_partkey GROUP BY 1)")
def p1(spark, d):
    return st.row_pointers(part_graph(spark, d), part_vertices(spark, d), block=500)


@query("p1_adjacency", G + "SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM e GROUP BY src")
def p1_adjacency(spark, d):
    return st.adjacency(part_graph(spark, d)).select("id", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("p1_adjacency_chunks", G + "SELECT src AS id, chunk, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM (SELECT src, dst, CAST((row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 3 AS BIGINT) AS chunk FROM e) GROUP BY src, chunk")
def p1_chunks(spark, d):
    return st.adjacency_chunks(part_graph(spark, d), 3).select("id", "chunk", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query("p2_temporal_adjacency", f"WITH {EVENT_GRAPH} SELECT src, eid, dst, ts, row_number() OVER (PARTITION BY src ORDER BY ts, eid) - 1 AS pos FROM ev")
def p2(spark, d):
    from weftgraph.operators.temporal import time_sorted

    return time_sorted(event_graph(spark, d)).select("src", "eid", "dst", "ts", F.col("pos").cast("long").alias("pos"))


@query("p3_symmetrise", G + "SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def p3(spark, d):
    return st.symmetrise(part_graph(spark, d))


@query("p3_add_reverse", G + "SELECT src, dst, w FROM e UNION ALL SELECT dst, src, w FROM e")
def p3_reverse(spark, d):
    return st.with_reverse(part_graph(spark, d))


@query("p4_self_loops", G + "SELECT src, dst FROM e UNION ALL SELECT p_partkey, p_partkey FROM part")
def p4(spark, d):
    return st.with_self_loops(part_graph(spark, d), part_vertices(spark, d))


@query("p5_no_self_loops", "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey <> l_partkey")
def p5(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).where("src != dst")


@query("p6_merge_parallel", "SELECT l_suppkey AS src, l_partkey AS dst, sum(CAST(l_quantity AS BIGINT))::BIGINT AS w FROM lineitem GROUP BY 1, 2")
def p6(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("w"))
    return st.merge_parallel(e)


DEG = """d AS (SELECT p_partkey AS id, CAST((SELECT count(*) FROM e WHERE src = p_partkey) AS BIGINT) AS out_degree, CAST((SELECT count(*) FROM e WHERE dst = p_partkey) AS BIGINT) AS in_degree FROM part)"""


@query("p7_degrees", f"{G}, {DEG} SELECT *, round(sqrt(greatest(out_degree, 1)), 6) AS root FROM d")
def p7(spark, d):
    return st.degrees(part_graph(spark, d), part_vertices(spark, d)).withColumn("root", F.round(F.sqrt(F.greatest("out_degree", F.lit(1))), 6))


@query("p8_stats", G + "SELECT (SELECT count(*) FROM part) AS n_nodes, count(*) AS n_edges, round(count(*) / (SELECT count(*) FROM part), 6) AS avg_degree, round(avg(abs(src - dst)), 6) AS avg_span FROM e")
def p8(spark, d):
    s = st.stats(part_graph(spark, d), part_vertices(spark, d))
    return s.withColumns({c: F.round(c, 6) for c in ("avg_degree", "avg_span")})


@query("p9_right_norm", f"{G}, {DEG} SELECT id, CASE WHEN in_degree > 0 THEN round(1 / in_degree, 6) ELSE 0.0::DOUBLE END AS norm FROM d")
def p9(spark, d):
    return st.right_norm(part_graph(spark, d), part_vertices(spark, d)).withColumn("norm", F.round("norm", 6))


@query("p10_transpose", G + "SELECT dst AS src, src AS dst, w FROM e")
def p10(spark, d):
    return st.reverse(part_graph(spark, d))


@query("p11_stitch", f"WITH {PART_GRAPH}, {SUPPLY_GRAPH} SELECT src, dst, 0 AS bid FROM e UNION ALL SELECT src, dst, 1 FROM s")
def p11(spark, d):
    return st.stitch({"follows": part_graph(spark, d), "supplies": supply_graph(spark, d)})


@query("p13_compact_ids", G + ", m AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)) SELECT a.n AS src, b.n AS dst, w FROM e JOIN m a ON a.id = src JOIN m b ON b.id = dst")
def p13(spark, d):
    return st.compact_ids(part_graph(spark, d))[0].select("src", "dst", "w")


@query("p14_range_parts", "SELECT p_partkey AS id, CAST(least(p_partkey // 300, 5) AS BIGINT) AS part, p_partkey - 300 * CAST(least(p_partkey // 300, 5) AS BIGINT) AS local FROM part")
def p14(spark, d):
    from weftgraph.operators.partition import range_part

    return part_vertices(spark, d).withColumn("part", range_part(F.col("id"), 300, 6)).withColumn("local", F.col("id") - 300 * F.col("part"))


@query("p22_split", "SELECT vec_id AS id, CASE WHEN (vec_id * 2654435761) % 2147483629 % 100 < 65 THEN 'train' WHEN (vec_id * 2654435761) % 2147483629 % 100 < 75 THEN 'val' ELSE 'test' END AS split FROM embeddings")
def p22(spark, d):
    from weftgraph.operators.sampling import split_of

    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), split_of(F.col("vec_id"), 65, 10).alias("split"))


@query("p23_induced", G + "SELECT * FROM e WHERE src % 3 <> 0 AND dst % 3 <> 0")
def p23(spark, d):
    return st.induced(part_graph(spark, d), part_vertices(spark, d).where("id % 3 != 0"))


@query("p24_active_edges", G + ", g AS (SELECT src FROM e GROUP BY src HAVING count(*) > 4) SELECT * FROM e WHERE src IN (SELECT src FROM g)")
def p24(spark, d):
    e = part_graph(spark, d)
    return st.active_edges(e, st.degrees(e, part_vertices(spark, d)), F.col("out_degree") > 4).select("src", "dst", "w")


@query("p26_last_per_key", f"WITH {EVENT_GRAPH} SELECT src, eid, dst, ts FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts DESC, eid DESC) AS n FROM ev) WHERE n = 1")
def p26(spark, d):
    return st.last_per_key(event_graph(spark, d).select("src", "eid", "dst", "ts"), "src", "ts", "eid")


@query("p27_neighbour_groups", G + "SELECT src, dst, w, CAST((row_number() OVER (PARTITION BY src ORDER BY dst) - 1) // 4 AS BIGINT) AS part FROM e")
def p27(spark, d):
    return st.neighbour_groups(part_graph(spark, d), 4)


@query("j6_anti", G + "SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT dst FROM e)")
def j6(spark, d):
    return part_vertices(spark, d).join(part_graph(spark, d).select(F.col("dst").alias("id")), "id", "left_anti")


HOPS = f", n0 AS ({SEEDS}), n1 AS (SELECT id FROM n0 UNION SELECT src FROM e WHERE dst IN (SELECT id FROM n0))"


@query("j9_neighbourhood", G + HOPS + " SELECT id FROM n1 UNION SELECT src FROM e WHERE dst IN (SELECT id FROM n1)")
def j9(spark, d):
    return st.neighbourhood(part_graph(spark, d), seeds(spark, d), 2)


@query("n5_hop_edges", G + HOPS + " SELECT 1 AS hop, src, dst FROM e WHERE dst IN (SELECT id FROM n0) UNION ALL SELECT 2, src, dst FROM e WHERE dst IN (SELECT id FROM n1)")
def n5(spark, d):
    return st.hop_edges(part_graph(spark, d), seeds(spark, d), 2)


@query("s27_profile", f"WITH {PART_GRAPH}, {SUPPLY_GRAPH}, r AS (SELECT 'follows' AS relation, src, dst FROM e UNION ALL SELECT 'supplies', src, dst FROM s) SELECT relation, count(*) AS n_edges, count(DISTINCT src) AS n_src, count(DISTINCT dst) AS n_dst, round(count(*) / count(DISTINCT dst), 6) AS avg_in_degree FROM r GROUP BY relation")
def s27(spark, d):
    r = part_graph(spark, d).select(F.lit("follows").alias("relation"), "src", "dst").union(supply_graph(spark, d).select(F.lit("supplies"), "src", "dst"))
    return r.groupBy("relation").agg(F.count("*").alias("n_edges"), F.countDistinct("src").alias("n_src"), F.countDistinct("dst").alias("n_dst"), F.round(F.count("*") / F.countDistinct("dst"), 6).alias("avg_in_degree"))
