"""Node memory and mailboxes of event streams, in batch; weftgraph.streaming has them as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import ranges


def mails(events: DataFrame, payload: str = "w") -> DataFrame:
    """Two mails for each event: (node, peer, ts, eid, side, payload), each with the event's own time."""
    a = events.select(F.col("src").alias("node"), F.col("dst").alias("peer"), "ts", "eid", F.lit(0).alias("side"), F.col(payload).alias("payload"))
    return a.unionByName(events.select(F.col("dst").alias("node"), F.col("src").alias("peer"), "ts", "eid", F.lit(1).alias("side"), F.col(payload).alias("payload")))


def last_mail(mail: DataFrame) -> DataFrame:
    """Of each node the latest mail; combines before the shuffle."""
    return mail.groupBy("node").agg(F.max_by(F.struct("peer", "ts", "eid", "payload"), F.struct("ts", "eid", "side")).alias("m")).select("node", "m.*")


def mailbox(mail: DataFrame, slots: int) -> DataFrame:
    """(node, slot, ...): the last `slots` mails of each node in a ring: mail number i of a node
    stands in slot i modulo slots."""
    placed = ranges.placed(mail, ["node"], ["ts", "eid", "side"], "_i", "_n")
    return placed.where(F.col("_n") - F.col("_i") <= slots).withColumn("slot", F.pmod("_i", F.lit(slots))).drop("_i", "_n")


def deliver_to_neighbours(mail: DataFrame, sampled: DataFrame) -> DataFrame:
    """(node, payload, n): the mean of the mails that reach a node along sampled edges (node, nbr).

    A neighbour's mails are summed before they are sent, so an edge costs one row however many mails
    its hub has. Null payloads count in n and not in the mean."""
    m = mail.groupBy(F.col("node").alias("nbr")).agg(F.sum("payload").alias("_s"), F.count("payload").alias("_c"), F.count("*").alias("_n"))
    got = sampled.select("node", "nbr").join(m, "nbr").groupBy("node").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"), F.sum("_n").alias("n"))
    return got.select("node", F.when(F.col("_c") > 0, F.col("_s") / F.col("_c")).alias("payload"), "n")


def decayed_memory(mail: DataFrame, keep: float = 0.5) -> DataFrame:
    """(node, memory, memory_ts): h = keep * h + (1 - keep) * payload over a node's mails in time
    order, from zero. The recurrence is a weighted sum by places from the end, so it's an aggregate.
    """
    placed = ranges.placed(mail, ["node"], ["ts", "eid", "side"], "_i", "_n")
    w = placed.withColumn("_w", F.pow(F.lit(keep), F.col("_n") - F.col("_i") - 1) * (1 - keep))
    return w.groupBy("node").agg(F.sum(F.col("_w") * F.col("payload")).alias("memory"), F.max("ts").alias("memory_ts"))


def state_at(mail: DataFrame, times: DataFrame) -> DataFrame:
    """Each of times (label_id, node, at) with the count and sum of the node's payloads before it."""
    e = mail.select("node", F.col("ts").alias("at"), F.lit(1).alias("kind"), "payload", F.lit(None).cast("long").alias("label_id"), F.col("eid").alias("_order"))
    t = times.select("node", "at", F.lit(0).alias("kind"), F.lit(None).cast("double").alias("payload"), F.col("label_id").cast("long").alias("label_id"), F.col("label_id").cast("long").alias("_order"))
    both = ranges.running(e.unionByName(t), ["node"], ["at", "kind", "_order"], n=F.col("kind"), total=F.col("payload"))
    return both.where("kind = 0").select("label_id", "node", "n", "total")
