"""Node memory of an event stream with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "node long, memory double, memory_ts long, n long"


def _remember(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState, keep: float) -> Iterator[pd.DataFrame]:
    memory, ts, n = state.get if state.exists else (0.0, 0, 0)
    mails = pd.concat(list(parts)).sort_values(["ts", "eid", "side"])  # a node's mails of one micro-batch
    for payload in mails["payload"]:
        memory = keep * memory + (1 - keep) * float(payload)
    ts, n = max(int(ts), int(mails["ts"].max())), int(n) + len(mails)
    state.update((memory, ts, n))
    yield pd.DataFrame({"node": [key[0]], "memory": [memory], "memory_ts": [ts], "n": [n]})


def node_memory(mail: DataFrame, keep: float = 0.5) -> DataFrame:
    """A stream of (node, memory, memory_ts, n): each node's memory after each micro-batch that has
    mail for it; mail is a stream of (node, ts, eid, side, payload). Within a batch mails run in time
    order; a mail that comes in a later batch counts when it comes."""
    return mail.groupBy("node").applyInPandasWithState(lambda k, p, s: _remember(k, p, s, keep), SCHEMA, "memory double, memory_ts long, n long", "update", GroupStateTimeout.NoTimeout)


def windowed_activity(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """A stream of (window, src, n, total): counts and sums by tumbling windows of event time; events
    that are later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "src").agg(F.count("*").alias("n"), F.sum("w").alias("total"))
