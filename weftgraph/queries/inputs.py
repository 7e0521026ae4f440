from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import vectors as vec
from weftgraph.queries import query
from weftgraph.sources import datasets, formats, generated, ranged
from weftgraph.sources.graphs import EVENT_GRAPH, FEATURES, PART_FEATURES, PART_GRAPH, event_graph, features, part_features, part_graph, part_vertices, table


@query("s3_binary_round_trip", f"WITH {PART_GRAPH} SELECT src, dst, w FROM e")
def s3(spark, d):
    e = part_graph(spark, d)
    parts = e.agg(F.floor(F.max("src") / 512) + 1).first()[0] or 1
    return formats.from_binary(formats.to_binary(e, parts, 512), 512)


@query("s3_s4_file_ranges", f"WITH {PART_GRAPH} SELECT src, dst, w FROM e")
def s3_ranges(spark, d):
    """Files of compressed rows with weights, each read by several tasks."""
    ranged.write_csr(part_graph(spark, d), path := _path(spark, "csr"), 1024)
    return ranged.read_csr(spark, path, weighted=True, edges=700, rows_per_file=1024)


@query("s8_array_ranges", f"WITH {FEATURES} SELECT id, pos, round(v, 6) AS val FROM f")
def s8(spark, d):
    """Feature arrays, each file read by several tasks."""
    ranged.write_npy(features(spark, d), path := _path(spark, "npy"), 300)
    return vec.long_form(ranged.read_npy(spark, path, 70), ["id"], "x")


@query("s22_features_labels_split", f"""WITH x AS (SELECT p_partkey AS id, list_transform(range(0, 5), lambda j: ((p_partkey + 1) * 2654435761 + (j + 1) * 40503 + 3) % 2147483629 / 2147483629) AS x, ((p_partkey + 1) * 2654435761 + 3) % 2147483629 AS h FROM part),
r AS (SELECT *, row_number() OVER (ORDER BY h, id) - 1 AS i, count(*) OVER () AS n FROM x)
SELECT id, round(list_sum(x), 6) AS total, h % 7 AS label, CASE WHEN i < n * 65 // 100 THEN 'train' WHEN i < n * 75 // 100 THEN 'val' ELSE 'test' END AS split FROM r""")
def s22(spark, d):
    """Random features, labels and a split of 65, 10 and 25 in a hundred for the parts."""
    ids = part_vertices(spark, d)
    x = generated.random_features(ids, 5, 3).select("id", F.round(vec.total(F.col("x")), 6).alias("total"))
    return x.join(generated.random_labels(ids, 7, 3), "id").join(generated.random_split(ids, 65, 10, 3), "id")


@query("s5_converted_edges", f"WITH {PART_GRAPH} SELECT src, dst, w FROM e")
def s5(spark, d):
    """An edge list with comments, converted to binary rows with weights and read back."""
    lines = part_graph(spark, d).select(F.concat_ws(" ", "src", "dst", "w").alias("value"))
    lines.union(spark.range(1).select(F.lit("# src dst w"))).write.text(path := _path(spark, "text"))
    ranged.write_csr(formats.read_edge_list(spark, path, weighted=True), path := _path(spark, "converted"), 1024)
    return ranged.read_csr(spark, path, weighted=True, rows_per_file=1024)


@query("s7_s15_derived", f"WITH {PART_GRAPH}, o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY dst) SELECT p_partkey AS id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(1.0::DOUBLE / i.n, 0) AS norm FROM part LEFT JOIN o ON o.id = p_partkey LEFT JOIN i ON i.id = p_partkey")
def s7(spark, d):
    return datasets.derived(part_graph(spark, d), part_vertices(spark, d))


@query("s18_s19_dataset", f"WITH {PART_GRAPH}, {PART_FEATURES} SELECT p_partkey AS id, CAST(p_size % 9 AS INTEGER) AS label, CASE p_size % 4 WHEN 1 THEN 'train' WHEN 2 THEN 'val' WHEN 3 THEN 'test' END AS split, (SELECT round(sum(v), 4) FROM pf WHERE pf.id = p_partkey) AS total, (SELECT count(*) FROM e) AS n_edges, 64 AS dim, (SELECT count(DISTINCT p_size % 9) FROM part) AS n_classes FROM part")
def s18(spark, d):
    """The parts as a data set of edges, features, labels and splits by type, written and read."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 9).cast("int").alias("label"), datasets.split_of_type(F.col("p_size") % 4).alias("split"))
    datasets.write_dataset(path := _path(spark, "dataset"), part_graph(spark, d), part_features(spark, d), p, p)
    nodes, info = datasets.read_dataset(spark, path, "nodes", "info")
    found = nodes.select("id", "label", "split", F.round(vec.total(F.col("x")), 4).alias("total"))
    return found.crossJoin(F.broadcast(info.select("n_edges", "dim", "n_classes")))  # one row


@query("s23_results", f"WITH {PART_GRAPH} SELECT src AS id, count(*) AS value FROM e WHERE src IN (SELECT DISTINCT src FROM e ORDER BY src LIMIT 100) GROUP BY src")
def s23(spark, d):
    """The results of the hundred least ids as a text sink keeps them."""
    found = part_graph(spark, d).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("value"))
    formats.write_results(found, path := _path(spark, "results"), first=100)
    return spark.read.csv(path, sep=" ", schema="id long, value long")


@query("s25_embedding_versions", f"WITH {FEATURES} SELECT id, CAST(CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS version, round(sum(v) * CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END, 4) AS total FROM f GROUP BY id")
def s25(spark, d):
    """Embeddings in versions, of which the last of each id counts; a third was written again."""
    x = features(spark, d)
    x.withColumn("version", F.lit(1)).write.parquet(path := _path(spark, "embeddings"))
    x.where("id % 3 = 0").select("id", F.transform("x", lambda v: v * 2).alias("x"), F.lit(2).alias("version")).write.mode("append").parquet(path)
    return formats.latest_versions(spark, path).select("id", "version", F.round(vec.total(F.col("x")), 4).alias("total"))


@query("s1_edge_lines", f"WITH {PART_GRAPH} SELECT src, dst, w FROM e")
def s1(spark, d):
    import uuid

    from weftgraph.plans.lineage import shared_dir

    path = f"{shared_dir(spark)}/edges-{uuid.uuid4().hex}"
    formats.write_edge_list(part_graph(spark, d), path, "src", "dst", "w")
    return formats.read_edge_list(spark, path, weighted=True)


@query("s9_part_scan", f"WITH {PART_GRAPH} SELECT src, dst, w FROM e WHERE src * 2654435761 % 2147483629 % 4 = 2")
def s9(spark, d):
    import uuid

    from weftgraph.operators.partition import hash_part
    from weftgraph.plans.lineage import shared_dir

    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    formats.write_parts(part_graph(spark, d).withColumn("part", hash_part(F.col("src"), 4)), path)
    return formats.read_part(spark, path, 2).select("src", "dst", "w")


@query("s10_rolled_events", "SELECT event_id AS eid, user_id AS src FROM events WHERE event_id % 4 <> 3")
def s10(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), (F.col("event_id") % 4).alias("int_roll"))
    return formats.rolled(e, "int_full").select("eid", "src")


@query("s20_shifted_both_ways", f"WITH {PART_GRAPH}, m AS (SELECT min(least(src, dst)) AS m FROM e) SELECT src - m AS src, dst - m AS dst FROM e, m UNION ALL SELECT dst - m, src - m FROM e, m")
def s20(spark, d):
    import uuid

    from weftgraph.plans.lineage import shared_dir

    path = f"{shared_dir(spark)}/pairs-{uuid.uuid4().hex}"
    formats.write_edge_list(part_graph(spark, d), path)
    return formats.read_point_pairs(spark, path, directed=False)


def _path(spark, name):
    import uuid

    from weftgraph.plans.lineage import shared_dir

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("s10_temporal_csv", f"WITH {EVENT_GRAPH} SELECT eid, src, dst, ts / 1e6::DOUBLE AS ts, CAST(eid % 4 AS INTEGER) AS int_roll, CAST(eid % 3 AS INTEGER) AS ext_roll FROM ev")
def s10_csv(spark, d):
    e = event_graph(spark, d).select("eid", "src", "dst", (F.col("ts") / 1e6).alias("time"), (F.col("eid") % 4).alias("int_roll"), (F.col("eid") % 3).alias("ext_roll"))
    e.write.csv(path := _path(spark, "temporal"), header=True)
    return formats.read_temporal(spark, path)


@query("s12_label_csv", "SELECT event_id AS label_id, user_id AS node, epoch_us(ts) / 1e6::DOUBLE AS ts, CAST(event_id % 2 AS INTEGER) AS label, CAST(event_id % 3 AS INTEGER) AS ext_roll FROM events")
def s12(spark, d):
    e = event_graph(spark, d).select(F.col("eid").alias("label_id"), F.col("src").alias("node"), (F.col("ts") / 1e6).alias("time"), (F.col("eid") % 2).alias("label"), (F.col("eid") % 3).alias("ext_roll"))
    e.write.csv(path := _path(spark, "labels"), header=True)
    return formats.read_labels(spark, path)


@query("s17_citation_edges", f"WITH {PART_GRAPH} SELECT DISTINCT src, dst FROM (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e UNION ALL SELECT p_partkey, p_partkey FROM part)")
def s17(spark, d):
    """Edges as a citation data set keeps them: both ways, once, with a loop at every vertex."""
    e = part_graph(spark, d).select("src", "dst")
    return e.union(e.select("dst", "src")).union(part_vertices(spark, d).select("id", F.col("id").alias("dst"))).distinct()


@query("s21_edge_text_split", f"""WITH {PART_GRAPH}, v AS (SELECT DISTINCT dst AS id FROM e), r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM v)
SELECT id, CASE WHEN i < n * 6 // 10 THEN 'train' WHEN i < n * 8 // 10 THEN 'val' ELSE 'test' END AS split FROM r""")
def s21(spark, d):
    """Tab-separated edges with comment lines, and a split of 60, 20 and 20 of a hundred targets."""
    lines = part_graph(spark, d).select(F.concat_ws("\t", "src", "dst").alias("value"))
    lines.union(spark.range(1).select(F.lit("# src\tdst"))).write.text(path := _path(spark, "snap"))
    return formats.split_targets(formats.read_commented(spark, path), 6, 2)
