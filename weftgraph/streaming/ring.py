"""Mailboxes of an event stream as rings in keyed state, and vector memory batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from weftgraph.operators.memory import Cell, advance, reset
from weftgraph.plans.lineage import forget

#: What transformWithState keeps its state in.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MAIL = "ts timestamp, eid long, side int, peer long, payload double"
OUT = f"node long, slot int, n long, expired boolean, {MAIL}"


class Ring(StatefulProcessor):
    """The last `slots` mails of a node in the order of (ts, eid, side), in list state, and how many it
    has had. Mail that comes late takes its place among those kept, or only counts if it's older than
    all of a full ring. A node that has had no mail for `idle_ms` of event time is forgotten by a timer
    and shown once more, expired and without mail."""

    def __init__(self, slots: int, idle_ms: int | None = None) -> None:
        self.slots, self.idle_ms = slots, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", MAIL)
        self.had = handle.getValueState("had", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.had.get()[0] if self.had.exists() else 0
        names = ["ts", "eid", "side", "peer", "payload"]
        kept = pd.DataFrame(list(self.kept.get()) if self.kept.exists() else [], columns=names)
        for batch in rows:  # a busy node's mail passes through, and `slots` of it stay
            n += len(batch)
            both = [f for f in (kept, batch[names]) if len(f)]
            kept = pd.concat(both, ignore_index=True).sort_values(["ts", "eid", "side"]).tail(self.slots) if both else kept
        self.kept.put([(r.ts.to_pydatetime(), int(r.eid), int(r.side), int(r.peer), float(r.payload)) for r in kept.itertuples(index=False)])
        self.had.update((int(n),))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(kept["ts"].max().timestamp() * 1000) + self.idle_ms)
        first = n - len(kept)
        yield kept.assign(node=key[0], slot=[(first + i) % self.slots for i in range(len(kept))], n=n, expired=False)[["node", "slot", "n", "expired", *names]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.had.get()[0] if self.had.exists() else 0
        self.kept.clear()
        self.had.clear()
        yield pd.DataFrame({"node": [key[0]], "slot": [None], "n": [n], "expired": [True], "ts": [pd.NaT], "eid": [None], "side": [None], "peer": [None], "payload": [None]})

    def close(self) -> None:
        pass


def mailbox_stream(mail: DataFrame, slots: int, late: str = "1 hour", idle_ms: int | None = None) -> DataFrame:
    """A stream of (node, slot, n, expired, ts, eid, side, peer, payload): the ring of each node that has
    mail in a micro-batch, as state.mailbox() gives it over all mail so far; n is the node's mail so far.
    mail is a stream of (node, ts timestamp, eid, side, peer, payload). Mail later than the watermark
    still counts while its node is known; `late` sets how far the timers stay behind the newest mail.
    The session's state store must be RocksDB (PROVIDER)."""
    m = mail.select(F.col("node").cast("long"), F.col("ts").cast("timestamp"), F.col("eid").cast("long"), F.col("side").cast("int"), F.col("peer").cast("long"), F.col("payload").cast("double"))
    return m.withWatermark("ts", late).groupBy("node").transformWithStateInPandas(Ring(slots, idle_ms), OUT, "Update", "EventTime" if idle_ms is not None else "None")


def memory_stream(events: DataFrame, path: str, cell: Cell, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that keeps the vector memory of nodes: each micro-batch of events (eid, src, dst,
    ts, feature) is one batch of memory.advance(), as each node's update reads the memories of others,
    which keyed state can't. The state after batch k is the table <path>/k. A batch that runs twice
    reads the table before it and writes its own anew, and the table two behind goes."""

    def step(batch: DataFrame, k: int) -> None:
        spark = batch.sparkSession
        start = reset(batch.select(F.col("src").alias("node")).limit(0), cell.dim)
        state = memory_at(spark, path, k - 1, start) if k else start
        advance(batch, state, cell).write.mode("overwrite").parquet(f"{path}/{k}")
        if k > 1:
            forget(spark, f"{path}/{k - 2}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def memory_at(spark, path: str, k: int, like: DataFrame) -> DataFrame:
    """The state (node, memory, memory_ts) after batch k of memory_stream()."""
    return spark.read.schema(like.schema).parquet(f"{path}/{k}")
