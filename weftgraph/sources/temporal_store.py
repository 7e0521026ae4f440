"""Events kept in buckets of node and time chunk, sorted, so that as-of queries move no events.

A bucket holds whole (node, chunk) groups in order of time. What a chunk needs of those before it is a
row for each (node, chunk), which alone is moved. A node with very many events has many chunks, which
lie in many buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import shared_dir


def chunk(ts: Column, width: int) -> Column:
    """The chunk of a time: chunks are `width` long."""
    return F.floor(ts / width).cast("long")


def _save(rows: DataFrame, name: str, buckets: int, *order: str) -> None:
    """A task writes one bucket as one file, dealt by the hash that buckets use, so that a bucket is
    read in its order without sorting it again."""
    dealt = rows.repartition(buckets, "node", "chunk").sortWithinPartitions("node", "chunk", *order)
    out = dealt.write.mode("overwrite").bucketBy(buckets, "node", "chunk").sortBy("node", "chunk", *order)
    out.option("path", f"{shared_dir(rows.sparkSession)}/{name}").saveAsTable(name)


def save_events(events: DataFrame, name: str, width: int, buckets: int) -> None:
    """events (eid, src, dst, ts) as the table `name` (node, chunk, at, eid, nbr); an earlier table of
    the name is replaced."""
    rows = events.select(F.col("src").alias("node"), chunk(F.col("ts"), width).alias("chunk"), F.col("ts").alias("at"), "eid", F.col("dst").alias("nbr"))
    _save(rows, name, buckets, "at", "eid")


def save_roots(roots: DataFrame, name: str, width: int, buckets: int) -> None:
    """roots (root_id, node, root_ts) as the table `name`, to be asked of events of the same width and
    number of buckets."""
    _save(roots.select("node", chunk(F.col("root_ts"), width).alias("chunk"), F.col("root_ts").alias("at"), "root_id"), name, buckets, "at", "root_id")


def _last_before(events: pa.Table, roots: pa.Table) -> pa.Table:
    """Of each root the last event before it in one chunk of a node, or else the one it brings along."""
    events = events.sort_by([("at", "ascending"), ("eid", "ascending")])
    i = np.searchsorted(events["at"].to_numpy(), roots["at"].to_numpy(), side="left") - 1
    at = pa.array(np.maximum(i, 0), mask=i < 0)
    found = [pc.coalesce(events[c].take(at), roots[f"_{c}"]) if len(events) else roots[f"_{c}"] for c in ("eid", "nbr", "at")]
    return pa.table([roots["root_id"], roots["node"], roots["at"], *found], names=["root_id", "node", "root_ts", "eid", "nbr", "ts"])


def _met(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Both sides' buckets meet where they lie, a chunk of a node at a time; roots are looked up by
    halving."""
    both = events.groupBy("node", "chunk").cogroup(roots.groupBy("node", "chunk"))
    return both.applyInArrow(_last_before, "root_id long, node long, root_ts long, eid long, nbr long, ts long")


def latest_in_chunk(spark: SparkSession, events: str, roots: str) -> DataFrame:
    """(root_id, node, root_ts, eid, nbr, ts): the latest event of each root's node that is strictly
    before it and in its chunk, else nulls. Nothing moves."""
    none = {c: F.lit(None).cast("long") for c in ("_eid", "_nbr", "_at")}
    return _met(spark.table(events), spark.table(roots).withColumns(none))


def chunk_ends(spark: SparkSession, events: str) -> DataFrame:
    """(node, chunk, event): the last event of each chunk of a node; nothing moves."""
    last = F.max_by(F.struct(F.col("at").alias("ts"), "eid", "nbr"), F.struct("at", "eid"))
    return spark.table(events).groupBy("node", "chunk").agg(last.alias("event"))


def latest_before(spark: SparkSession, events: str, roots: str) -> DataFrame:
    """(root_id, node, root_ts, eid, nbr, ts): the latest event of each root's node strictly before the
    root, with nulls where there's none. Where a root's chunk has none, the last one of the node's
    earlier chunks counts, from a table with a row for each (node, chunk)."""
    ends, asked = chunk_ends(spark, events), spark.table(roots).select("node", "chunk").distinct()
    both = asked.join(ends, ["node", "chunk"], "full_outer")
    earlier = F.last("event", ignorenulls=True).over(Window.partitionBy("node").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    carry = both.withColumn("_c", earlier).select("node", "chunk", F.col("_c.eid").alias("_eid"), F.col("_c.nbr").alias("_nbr"), F.col("_c.ts").alias("_at"))
    return _met(spark.table(events), spark.table(roots).join(carry, ["node", "chunk"], "left"))
