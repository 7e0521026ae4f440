"""Small graphs with known answers, and properties that hold for any graph."""

import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from weftgraph.operators import community, layers, message, partition, structure, temporal, traverse
from weftgraph.operators.components import connected_components
from weftgraph.sources import formats
from weftgraph.sources.graphs import PART_GRAPH, part_graph
from weftgraph.streaming import mailbox

TOY = [(0, 1, 26), (0, 3, 33), (2, 3, 40), (1, 2, 10)]


def graph(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long, w long")


def values(df, *cols):
    return {r[0]: r[1] for r in df.select(*(cols or ("id", "value"))).collect()}


def test_traversals_of_the_toy_graph(spark):
    e = graph(spark, TOY)
    assert values(traverse.bfs(e, 0)) == {0: 0, 1: 1, 3: 1, 2: 2}
    assert values(traverse.sssp(e, 0)) == {0: 0, 1: 26, 3: 33, 2: 36}
    assert values(traverse.sswp(e, 0)) == {0: traverse.FAR, 1: 26, 2: 10, 3: 33}


def test_unreached_vertices_get_the_sentinel(spark):
    e = graph(spark, TOY)
    found = values(traverse.with_unreached(traverse.bfs(e, 2), spark.range(4)))
    assert found == {0: traverse.FAR, 1: traverse.FAR, 2: 0, 3: 1}


def test_components_of_chains_and_rings(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for c in range(5):
        ids = [c * 100 + i for i in range(1 + 9 * c)]
        walk = ids[:]
        rng.shuffle(walk)
        rows += [(a, b, 1) for a, b in zip(walk, walk[1:] or walk, strict=False)]
        want |= dict.fromkeys(ids, c * 100)
    assert values(connected_components(graph(spark, rows)), "id", "component") == want
    assert connected_components(graph(spark, []).limit(0)).count() == 0


def test_pagerank_drains(spark):
    e = graph(spark, [(0, 1, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1)])
    out = traverse.pagerank(e, spark.range(4), least=1e-3).toPandas().set_index("id")
    assert out["delta"].max() <= 1e-3
    assert abs(out["value"].sum() + out["delta"].sum() - 3 - 0.15) < 0.05


def test_betweenness_sums_to_distances(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(30), rng.randrange(30), 1) for _ in range(90)]
    e = graph(spark, [r for r in rows if r[0] != r[1]]).dropDuplicates(["src", "dst"])
    found = traverse.betweenness(e, 0).toPandas()
    assert abs(found["value"].sum() - found["level"].sum()) < 1e-9
    assert abs(found.loc[found["id"] == 0, "value"].iloc[0] - (len(found) - 1)) < 1e-9


def test_recent_is_strict_and_ordered(spark):
    ev = spark.createDataFrame([(1, 7, 0, 10), (2, 7, 1, 10), (3, 7, 2, 20), (4, 7, 3, 30)], "eid long, src long, dst long, ts long")
    roots = spark.createDataFrame([(100, 7, 30), (101, 7, 10), (102, 8, 30), (103, 7, 21), (104, 7, 21)], "root_id long, node long, root_ts long")
    got = temporal.recent(ev, roots, 2).toPandas().sort_values(["root_id", "rank"])
    assert got.groupby("root_id")["eid"].apply(list).to_dict() == {100: [3, 2], 103: [3, 2], 104: [3, 2]}


def test_softmax_sums_to_one_and_survives_large_scores(spark):
    e = graph(spark, [(i, i % 3, 1) for i in range(20)]).withColumn("s", F.col("src") * 100.0)
    sums = message.edge_softmax(e, "s").groupBy("dst").agg(F.sum("alpha").alias("a")).toPandas()
    assert (abs(sums["a"] - 1) < 1e-9).all()


def test_gcn_order_of_product_and_sum_makes_no_difference(spark):
    rng = random.Random(5)
    e = graph(spark, [(rng.randrange(9), rng.randrange(9), 1) for _ in range(30)]).dropDuplicates(["src", "dst"]).drop("w")
    x = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(9)], "id long, x array<double>")
    w = layers.weights(3, 4)
    short = layers.gcn(e, x, w).toPandas().set_index("id")["x"]
    square = layers.gcn(e, x, w + [[0.0] * 4]).toPandas().set_index("id")["x"]
    assert all(abs(a - b) < 1e-9 for i in short.index for a, b in zip(short[i], square[i], strict=False))


def test_reorder_is_a_permutation(spark):
    e = graph(spark, TOY)
    order = community.order_by_degree(e, spark.range(4))
    assert sorted(values(order, "id", "new").values()) == [0, 1, 2, 3]
    assert structure.map_ids(e, order).count() == 4


def test_first_fit_keeps_the_bound():
    bins = partition.first_fit({"a": 5, "b": 4, "c": 3, "d": 2}, 7)
    assert {sum({"a": 5, "b": 4, "c": 3, "d": 2}[n] for n in bins if bins[n] == b) for b in set(bins.values())} == {7}


def test_text_formats(spark, tmp_path):
    (tmp_path / "g.wel").write_text("# graph\n\n0 1 26\n0,3,33 x\n 2\t3 40\n1 2 10\n")
    assert sorted(map(tuple, formats.read_edge_list(spark, str(tmp_path / "g.wel"), True).collect())) == sorted(TOY)
    assert structure.all_vertices(graph(spark, TOY)).count() == 4


def test_binary_format(spark, tmp_path):
    e = graph(spark, TOY)
    block = formats.to_binary(e, 1, 4).collect()[0]
    (tmp_path / "g.bcsr").write_bytes(block["content"])
    (tmp_path / "g.bcsrw").write_bytes(block["weights"])
    assert sorted(map(tuple, formats.read_binary(spark, str(tmp_path / "g.bcsr"), True).collect())) == sorted(TOY)


def test_streamed_memory_equals_batch(spark, tmp_path):
    mail = [(i % 3, 10 * i, i, 0, float(i)) for i in range(12)]
    schema = "node long, ts long, eid long, side int, payload double"
    spark.createDataFrame(mail, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = mailbox.node_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("memories").outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("memories").toPandas().set_index("node")["memory"].to_dict()
    want = {}
    for node, *_, payload in mail:
        want[node] = 0.5 * want.get(node, 0.0) + 0.5 * payload
    assert got == want
    from weftgraph.operators.state import decayed_memory

    batch = values(decayed_memory(spark.createDataFrame(mail, schema)), "node", "memory")
    assert all(abs(batch[n] - want[n]) < 1e-12 for n in want)


def test_empty_graph(spark):
    e = graph(spark, []).limit(0)
    assert traverse.bfs(e, 0).count() == 1
    assert structure.degrees(e, spark.range(3)).agg(F.sum("out_degree")).first()[0] == 0
    assert isinstance(structure.stats(e, spark.range(3)).toPandas(), pd.DataFrame)


def test_lines_without_numbers_come_last_in_their_order(spark, tmp_path):
    """As in SQL, where they have the same line number as others or none."""
    lines = [(1, 1, 10, 5, 50.0), (1, 1, None, 5, 50.0), (1, 2, 11, 5, 45.0), (2, None, 20, 6, 44.0), (2, 3, 21, 6, 43.0), (2, 4, 22, 6, 42.0), (3, 1, 30, None, 50.0), (3, 1, 30, 7, 3.0), (3, 2, 31, 7, 50.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"WITH {PART_GRAPH} SELECT src, dst, w FROM e").fetchall()
    got = [tuple(r) for r in part_graph(spark, str(tmp_path)).select("src", "dst", "w").collect()]
    assert sorted(got) == sorted(want) and len(got) == 3
