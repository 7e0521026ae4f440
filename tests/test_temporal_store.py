"""As-of queries over bucketed tables: their plans and results."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from weftgraph.sources import temporal_store as store


@pytest.fixture
def tables(spark):
    rng = random.Random(6)
    events = [(i, 1 if rng.random() < 0.5 else rng.randrange(2, 30), rng.randrange(100, 110), rng.randrange(1000)) for i in range(600)]
    roots = [(i, rng.randrange(0, 32), rng.randrange(1100)) for i in range(400)]
    name = f"t{uuid.uuid4().hex}"
    store.save_events(spark.createDataFrame(events, "eid long, src long, dst long, ts long"), f"{name}e", 50, 5)
    store.save_roots(spark.createDataFrame(roots, "root_id long, node long, root_ts long"), f"{name}r", 50, 5)
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield events, roots, f"{name}e", f"{name}r"
    for k, v in before.items():
        spark.conf.set(k, v)
    for t in "er":
        spark.sql(f"DROP TABLE {name}{t}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_event_moves(spark, tables):
    _, _, e, r = tables
    assert "Exchange" not in plan(store.latest_in_chunk(spark, e, r))
    assert "Exchange" not in plan(store.chunk_ends(spark, e))
    whole = plan(store.latest_before(spark, e, r))
    # only the table of chunks moves: for its window by node and back to the buckets
    assert whole.count("Exchange hashpartitioning") == 2 and "Exchange hashpartitioning(node" in whole
    assert max(x["n"] for x in spark.table(e).where("node = 1").groupBy("chunk").agg(F.count("*").alias("n")).collect()) < 60


def test_the_latest_event_before(spark, tables):
    events, roots, e, r = tables
    got = {x["root_id"]: (x["eid"], x["nbr"], x["ts"]) for x in store.latest_before(spark, e, r).collect()}
    for i, node, ts in roots:
        before = [(t, eid, dst) for eid, src, dst, t in events if src == node and t < ts]
        want = max(before) if before else (None,) * 3
        assert got[i] == (want[1], want[2], want[0])
