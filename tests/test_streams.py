"""Streams against their batch operators after each micro-batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import memory, state
from weftgraph.queries import temporals
from weftgraph.streaming import mailbox, ring

START = dt.datetime(2024, 1, 1)
SCHEMA = "node long, ts timestamp, eid long, side int, peer long, payload double"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ring.PROVIDER)
    yield spark
    spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def micro_batches(spark, parts, schema, path):
    """A stream that gives one of the parts in each micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{i}")
    import os
    import shutil

    os.makedirs(f"{path}/flat")
    for i in range(len(parts)):
        part = next(f for f in os.listdir(f"{path}/in/{i}") if f.endswith(".parquet"))
        shutil.copy(f"{path}/in/{i}/{part}", f"{path}/flat/{i}.parquet")
        os.utime(f"{path}/flat/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/flat")


def run(stream, path, see):
    query = stream.writeStream.outputMode("update").foreachBatch(see).option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()


def test_ring_equals_batch_after_each_micro_batch(rocks, tmp_path):
    rng, parts, eid = random.Random(4), [], 0
    for b in range(4):
        rows = []
        for _ in range(60):
            node = 1 if rng.random() < 0.5 else rng.randrange(2, 9)
            back = rng.choice([0, 0, 0, 50, 400])  # some mail comes late
            rows.append((node, START + dt.timedelta(minutes=100 * b + rng.randrange(100) - back), eid, 0, rng.randrange(5), float(eid)))
            eid += 1
        parts.append(rows)
    shown, checked = {}, []

    def see(batch, k):
        if k >= len(parts):  # the watermark alone moves on
            assert batch.isEmpty()
            return
        for r in batch.collect():
            shown.setdefault((k, r["node"]), {})[r["slot"]] = (r["eid"], r["n"])
        so_far = rocks.createDataFrame([r for p in parts[: k + 1] for r in p], SCHEMA)
        want, sizes = {}, {r["node"]: r["count"] for r in so_far.groupBy("node").count().collect()}
        for r in state.mailbox(so_far, 5).collect():
            want.setdefault(r["node"], {})[r["slot"]] = (r["eid"], sizes[r["node"]])
        for node in {r[0] for r in parts[k]}:
            assert shown[k, node] == want[node]
            checked.append(node)

    run(ring.mailbox_stream(micro_batches(rocks, parts, SCHEMA, tmp_path), 5), tmp_path, see)
    assert len(checked) > 20 and checked.count(1) == 4


def test_idle_nodes_are_forgotten(rocks, tmp_path):
    at = lambda m: START + dt.timedelta(minutes=m)
    parts = [[(1, at(0), 0, 0, 9, 1.0), (2, at(1), 1, 0, 9, 1.0)], [(2, at(500), 2, 0, 9, 1.0)], [(2, at(501), 3, 0, 9, 1.0)], [(1, at(502), 4, 0, 9, 1.0)]]
    seen = []
    run(ring.mailbox_stream(micro_batches(rocks, parts, SCHEMA, tmp_path), 3, "10 minutes", 60 * 60 * 1000), tmp_path, lambda b, k: seen.extend((r["node"], r["n"], r["expired"]) for r in b.collect()))
    assert (1, 1, True) in seen and (1, 1, False) in seen and seen[-1][:2] == (1, 1)
    assert (2, 3, False) in seen and (2, 3, True) not in seen


def test_memory_stream_equals_batch_after_each_micro_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randrange(6), 100 + rng.randrange(3), 1000 * i, [i / 50]) for i in range(50)]
    schema = "eid long, src long, dst long, ts long, feature array<double>"
    parts, c = [rows[i : i + 10] for i in range(0, 50, 10)], temporals.cell()
    query = ring.memory_stream(micro_batches(spark, parts, schema, tmp_path), f"{tmp_path}/state", c, f"{tmp_path}/cp")
    query.awaitTermination()
    like = memory.reset(spark.createDataFrame([], "node long"), c.dim)
    for k in (3, 4):  # the tables that are still there
        got = {r["node"]: (r["memory"], r["memory_ts"]) for r in ring.memory_at(spark, f"{tmp_path}/state", k, like).collect()}
        want = {r["node"]: (r["memory"], r["memory_ts"]) for r in memory.evolve(spark.createDataFrame(rows[: 10 * k + 10], schema), 10, c).collect()}
        assert set(got) == set(want) and all(got[n][1] == want[n][1] and all(abs(a - b) < 1e-12 for a, b in zip(got[n][0], want[n][0])) for n in got)


def test_windowed_activity_counts_what_is_in_time(spark, tmp_path):
    day = lambda d: START + dt.timedelta(days=d)
    parts = [[(day(0.1), 1, 2.0), (day(0.2), 1, 3.0)], [(day(6), 2, 1.0)], [(day(6.1), 3, 1.0)], [(day(0.3), 1, 50.0), (day(6.5), 2, 4.0)]]
    final = {}
    stream = mailbox.windowed_activity(micro_batches(spark, parts, "ts timestamp, src long, w double", tmp_path))
    run(stream, tmp_path, lambda b, k: final.update({(r["d"], r["src"]): (r["n"], r["total"]) for r in b.select(F.to_date("window.start").cast("string").alias("d"), "src", "n", "total").collect()}))
    assert final == {("2024-01-01", 1): (2, 5.0), ("2024-01-07", 2): (2, 5.0), ("2024-01-07", 3): (1, 1.0)}  # what came five days late is left out
