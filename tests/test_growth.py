"""Steps whose work must not outgrow their input: the rows they make, and the vectors that they move."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.catalog import QUERIES
from weftgraph.functions import vectors as vec
from weftgraph.operators import community, layers, memory, message, partition, state, traverse
from weftgraph.queries import temporals
from weftgraph.sources.graphs import part_graph


@pytest.mark.parametrize("name", ["layer_norm", "l2_normalise", "row_normalise", "softmax", "log_softmax"])
def test_norms_are_linear_in_the_length(spark, name):
    """A vector of 2,000 numbers: one pass for each of them would be 4 million steps, two 8 billion."""
    values = [((i * 37) % 101 + 1) / 50 for i in range(2000)]
    a = np.array(values)
    e = np.exp(a - a.max())
    want = {"layer_norm": (a - a.mean()) / np.sqrt(a.var() + 1e-5), "l2_normalise": a / np.sqrt(a @ a), "row_normalise": a / a.sum(), "softmax": e / e.sum(), "log_softmax": np.log(e / e.sum())}[name]
    df = spark.createDataFrame([(values,)] * 400, "x array<double>").coalesce(1)
    made, start = df.select(getattr(vec, name)(F.col("x")).alias("x")), time.time()
    got = made.collect()
    assert time.time() - start < 12
    assert all(np.allclose(r["x"], want) for r in got)


def test_mails_of_a_hub_are_summed_before_they_are_sent(spark):
    """30,000 nodes next to a hub with 30,000 mails would meet in 900 million rows."""
    mail = spark.range(30000).select(F.lit(-1).cast("long").alias("node"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("payload"))
    mail = mail.union(spark.createDataFrame([(-2, None)], mail.schema))
    sampled = spark.range(30000).select(F.col("id").alias("node"), F.lit(-1).cast("long").alias("nbr")).union(spark.createDataFrame([(0, -2), (40000, -2)], "node long, nbr long"))
    start = time.time()
    got = {r["node"]: (r["payload"], r["n"]) for r in state.deliver_to_neighbours(mail, sampled).collect()}
    assert time.time() - start < 20
    want = sum(i for i in range(30000) if i % 3) / 20000
    assert len(got) == 30001 and got[0] == (want, 30001) and got[29999] == (want, 30000) and got[40000] == (None, 1)


def test_memory_rounds_do_not_grow_with_the_batches(spark):
    """900 batches, a hub in each and nodes that stay away for long, in one round, in many, and batch by batch."""
    rows = [(i, i % 37 if i % 5 else 40 + i // 60, 1000, 10**9 * (i + 1), [(i % 11) / 10]) for i in range(1800)]
    events = spark.createDataFrame(rows, "eid long, src long, dst long, ts long, feature array<double>")
    cell, seen, start = temporals.cell(), [], time.time()
    for part in (1 << 18, 700):
        got = memory.evolve(events, 2, cell, part).collect()
        assert len(got) == len({r["node"] for r in got})
        seen.append({r["node"]: (tuple(np.round(r["memory"], 9)), r["memory_ts"]) for r in got})
    assert time.time() - start < 90
    assert seen[0] == seen[1] and len(seen[0]) == len({r[1] for r in rows}) + 1
    state = memory.reset(events.select(F.col("src").alias("node")).limit(0), cell.dim)
    for at in (0, 2):
        state = memory.advance(events.where(F.col("eid").between(at, at + 1)), state, cell)
    want = {r["node"]: (tuple(np.round(r["memory"], 9)), r["memory_ts"]) for r in state.collect()}
    assert want == {r["node"]: (tuple(np.round(r["memory"], 9)), r["memory_ts"]) for r in memory.evolve(events.where("eid < 4"), 2, cell).collect()}
    assert memory.evolve(events.limit(0), 2, cell).count() == 0


def made(df):
    """The optimised plan with all of its fields."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")


@pytest.mark.parametrize("name", ["l4_sage_mean", "l4_sage_fold", "l6_sampled_gcn", "l6_full_gcn", "l7_history_gcn", "l10_rgcn", "l12_snapshot_state"])
def test_vectors_are_multiplied_before_they_are_moved(spark, sf_dir, name):
    """Aggregates of 64 places each would make these shuffles 16 times as large."""
    plan = made(QUERIES[name](spark, sf_dir))
    assert max(len(re.findall(r"(?:avg|sum)\(", line)) for line in plan.splitlines() if "Aggregate" in line) <= 16


def test_shared_vectors_are_looked_up_behind_the_shuffle(spark, sf_dir):
    plan = made(QUERIES["l10_hetero"](spark, sf_dir))
    assert not any("x#" in line and "src#" in line for line in plan.splitlines())


def test_edges_of_relations_are_shuffled_once_by_target(spark, sf_dir):
    """Distinct edges, edges by source, counts and counts by target were four shuffles of all edges, and a
    vector was shuffled for each count where Spark doesn't broadcast on its own."""
    plan = QUERIES["l10_hetero"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)]
    assert sorted(keys) == ["id", "l_orderkey", "src"]  # the last one moves nodes
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(40).select((F.col("id") % 7).alias("src"), (F.col("id") % 5).alias("dst"), F.lit(0).alias("bid"))
        nodes, table = spark.range(7).withColumn("v", F.col("id") % 2), spark.range(2).select(F.col("id").alias("v"), F.array(F.col("id") * 1.0).alias("x"))
        plan = layers.hetero_conv(edges, nodes, 1, table, once=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange hashpartitioning") == 3


def test_lines_are_shuffled_without_copies_of_their_columns(spark, sf_dir):
    """Source and weight were made from part and quantity before the window and shuffled beside them."""
    plan = part_graph(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert " AS " not in plan.split("Exchange hashpartitioning(l_orderkey")[1]


@pytest.mark.parametrize("once", [True, False])
def test_shared_vectors_of_repeated_edges_and_nodes(spark, once, monkeypatch):
    """A hub, edges given up to three times, a node given twice, sources that are no nodes, a target without a number."""
    rng = np.random.default_rng(5)
    edges = [(int(s), None if t == 9 else int(t), int(b)) for s, t, b in zip(rng.integers(0, 30, 400), rng.integers(0, 10, 400) % 11 * (rng.random(400) < 0.7), rng.integers(0, 2, 400))]
    edges += edges[:50] + edges[:20]
    nodes, table = [(i, i % 4) for i in range(25)] + [(3, 3)], {v: [float(x) for x in rng.normal(size=3)] for v in range(4)}
    want = {}
    for s, t, b in sorted(set(edges), key=str) if once else edges:
        want.setdefault(t, {}).setdefault(b, []).extend(table[v] for i, v in nodes if i == s)
    want = {t: np.mean([np.mean(m, axis=0) for m in of.values() if m], axis=0) for t, of in want.items()}
    relations = spark.createDataFrame(edges, "src long, dst long, bid int")
    index, shared = spark.createDataFrame(nodes, "id long, v long"), spark.createDataFrame(list(table.items()), "v long, x array<double>")
    whole = index.join(shared, "v").select("id", "x")
    made = [layers.hetero_conv(relations, index, 3, shared, once=once), layers.hetero_conv(relations, whole, 3, once=once)]
    monkeypatch.setattr(layers, "BROADCAST", 3)
    for made in (*made, layers.hetero_conv(relations, index, 3, shared, once=once)):
        got = {r["id"]: r["x"] for r in made.collect()}
        assert set(got) == set(want) and all(np.allclose(got[t], want[t]) for t in want)


@pytest.mark.parametrize("name", ["l9_gat", "l10_rgat", "l11_temporal_attention"])
def test_heads_are_one_aggregate(spark, sf_dir, name):
    """Edges multiplied by the heads and joined with their sums were shuffled twice more."""
    plan = made(QUERIES[name](spark, sf_dir))
    assert "alpha#" not in plan


def test_softmax_sums_of_wide_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 4, [float(s) for s in rng.normal(0, 400, 2)], [float(v) for v in rng.normal(size=6)]) for i in range(200)]
    rows[0] = (0, [None, -900.0], rows[0][2])
    got = {r["k"]: r["x"] for r in message.softmax_sums(spark.createDataFrame(rows, "k long, s array<double>, v array<double>"), ("k",), "s", "v", 2, 3).collect()}
    for k in range(4):
        for h in range(2):
            some = [(s[h], v[3 * h : 3 * h + 3]) for at, s, v in rows if at == k and s[h] is not None]
            s, v = np.array([s for s, _ in some]), np.array([v for _, v in some])
            e = np.exp(s - s.max())
            assert np.allclose(got[k][3 * h : 3 * h + 3], e @ v / e.sum())


def test_balanced_parts_read_their_edges_once(spark):
    """Eight rounds made the graph anew from its source twice each."""
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        for r in rows:
            seen.add(1)
            yield r

    schema = "src long, dst long"
    edges = spark.createDataFrame(spark.range(400).rdd.map(lambda r: (r["id"] % 97, (r["id"] * 7 + 1) % 97)).mapPartitions(counted), schema)
    partition.balanced_parts(edges, spark.range(97), 4).collect()
    assert seen.value == 400


def counted(spark, edges):
    """The edges, and how many of them were computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def each(parts):
        for pdf in parts:
            seen.add(len(pdf))
            yield pdf

    return edges.mapInPandas(each, edges.schema), seen


def test_rank_rounds_read_lists_and_not_edges(spark, monkeypatch):
    """A round reads a row for each vertex and some for a hub, not one for each of 14,000 edges."""
    pairs = sorted({(i, (i * 7 + j * j) % 600) for i in range(500) for j in range(20)} | {(7, 600 + j) for j in range(5000)})
    sizes, cut = [], traverse.cut
    monkeypatch.setattr(traverse, "cut", lambda df: sizes.append((made := cut(df)).count()) or made)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    got = traverse.pagerank(edges, spark.range(5600), rounds=4).collect()
    assert max(sizes[:-5]) < 700 and len(sizes) == 6
    src, dst = np.array(pairs).T
    value, delta, degree = np.zeros(5600), np.full(5600, 0.15), np.bincount(src, minlength=5600)
    for _ in range(4):
        spent = np.where(delta > 0.01, delta, 0)
        value, delta = value + spent, delta - spent + np.bincount(dst, 0.85 * spent[src] / degree[src], 5600)
    assert all(abs(r["value"] - value[r["id"]]) < 1e-9 and abs(r["delta"] - delta[r["id"]]) < 1e-9 for r in got) and len(got) == 5600


def test_betweenness_computes_its_edges_once(spark):
    edges, seen = counted(spark, spark.createDataFrame([(i, j) for i in range(40) for j in (i + 1, i + 2)], "src long, dst long").coalesce(1))
    got = {r["id"]: (r["level"], r["paths"]) for r in traverse.betweenness(edges, 0).collect()}
    assert seen.value == 80 and got[2] == (1, 1) and got[3] == (2, 2) and got[41] == (21, 20)


def test_communities_compute_their_edges_once(spark):
    """Two cliques and a bridge; a loop and both directions of an edge count."""
    rows = [(a + c, b + c, 2) for c in (0, 10) for a in range(6) for b in range(6) if a != b] + [(0, 10, 1), (3, 3, 1)]
    edges, seen = counted(spark, spark.createDataFrame(rows, "src long, dst long, w long").coalesce(1))
    labels, forest = community.merge_forest(edges, spark.range(17))
    got = {r["id"]: r["community"] for r in labels.collect()}
    assert seen.value == len(rows) and len(got) == 17 and forest.count() == 10
    assert len({got[i] for i in range(6)}) == len({got[i] for i in range(10, 16)}) == 1 and len(set(got.values())) == 7
