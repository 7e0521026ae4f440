"""One node that holds half of all events, dealt over several ranges, against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import sampling, state, structure, temporal
from weftgraph.plans import ranges

HUB = 7


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(3)
    rows = [(i, HUB if i % 2 else rng.randrange(8, 40), rng.randrange(100, 120), rng.randrange(300), float(rng.randrange(9))) for i in range(1200)]
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark.createDataFrame(rows, "eid long, src long, dst long, ts long, w double").repartition(3)
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture(scope="module")
def plain(events):
    by = defaultdict(list)
    for e in sorted(events.collect(), key=lambda e: (e["ts"], e["eid"])):
        by[e["src"]].append(e)
    return by


def test_the_hub_lies_in_several_ranges(events):
    per = ranges.dealt(events, ["src"], ["ts", "eid"]).where(F.col("src") == HUB).groupBy("_p").count().collect()
    assert len(per) >= 3 and max(r["count"] for r in per) < 400


@pytest.mark.parametrize("k", [1, 3, 200])
def test_recent_events(events, plain, k):
    roots = events.select(F.col("eid").alias("root_id"), F.col("src").alias("node"), F.col("ts").alias("root_ts"))
    got = defaultdict(list)
    for r in sorted(temporal.recent(events, roots, k).collect(), key=lambda r: r["rank"]):
        got[r["root_id"]].append((r["eid"], r["nbr"], r["dt"]))
    for node in plain.values():
        for root in node:
            want = [(e["eid"], e["dst"], root["ts"] - e["ts"]) for e in node if e["ts"] < root["ts"]][::-1][:k]
            assert got[root["eid"]] == want


def test_places_mailbox_state_and_draws(events, plain):
    places = {r["eid"]: r["pos"] for r in temporal.time_sorted(events).collect()}
    assert all(places[e["eid"]] == i for node in plain.values() for i, e in enumerate(node))
    mail = events.select(F.col("src").alias("node"), F.col("dst").alias("peer"), "ts", "eid", F.lit(0).alias("side"), F.col("w").alias("payload"))
    box = {(r["node"], r["slot"]): r["eid"] for r in state.mailbox(mail, 5).collect()}
    assert box == {(n, i % 5): e["eid"] for n, es in plain.items() for i, e in enumerate(es) if len(es) - i <= 5}
    times = events.select(F.col("eid").alias("label_id"), F.col("src").alias("node"), F.col("ts").alias("at"))
    seen = {r["label_id"]: (r["n"], r["total"]) for r in state.state_at(mail, times).collect()}
    for es in plain.values():
        for e in es:
            before = [x["w"] for x in es if x["ts"] < e["ts"]]
            assert seen[e["eid"]] == (len(before), sum(before))
    memory = {r["node"]: r["memory"] for r in state.decayed_memory(mail).collect()}
    for n, es in plain.items():
        h = 0.0
        for e in es:
            h = 0.5 * h + 0.5 * e["w"]
        assert abs(memory[n] - h) < 1e-9
    roots = events.select(F.col("eid").alias("root_id"), F.col("src").alias("node"), F.col("ts").alias("root_ts"))
    drawn = temporal.uniform(events, roots, 3, 5).collect()
    of = {e["eid"]: e for es in plain.values() for e in es}
    assert all(r["ts"] < of[r["root_id"]]["ts"] and of[r["eid"]]["src"] == of[r["root_id"]]["src"] for r in drawn)
    assert len(drawn) == 3 * sum(1 for n, _ in seen.values() if n)


def test_hub_neighbours_and_chunks(events, plain):
    edges = events.select("src", "dst").distinct()
    ends = defaultdict(set)
    for n, es in plain.items():
        ends[n] = {e["dst"] for e in es}
    rank = lambda n, d: ((n * 2654435761 + d * 40503 + 4) % 2147483629, d)
    got = defaultdict(set)
    for r in sampling.neighbours(edges, edges.select(F.col("src").alias("id")).distinct(), 5, 4).collect():
        got[r["seed"]].add(r["nbr"])
    assert got == {n: set(sorted(d, key=lambda x, n=n: rank(n, x))[:5]) for n, d in ends.items()}
    chunks = defaultdict(list)
    for r in sorted(structure.adjacency_chunks(edges, 4).collect(), key=lambda r: r["chunk"]):
        assert len(r["neighbours"]) <= 4
        chunks[r["id"]] += r["neighbours"]
    assert chunks == {n: sorted(d) for n, d in ends.items()}


def test_epochs_draw_their_borders(events, plain):
    rows = temporal.epoch_batches(events, 40, 8, 6, 3).collect()
    order = {e["eid"]: i for i, e in enumerate(sorted((e for es in plain.values() for e in es), key=lambda e: (e["ts"], e["eid"])))}
    shifts = [(k * 2654435761 + 3 * 40503) % 2147483629 % 8 * 5 for k in range(6)]
    assert len(set(shifts)) > 2 and all(r["batch"] == (order[r["eid"]] - shifts[r["epoch"]]) // 40 for r in rows)
