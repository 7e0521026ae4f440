"""Time-respecting neighbours, chronological splits and batches of events (eid, src, dst, ts)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import ranges


def time_sorted(events: DataFrame) -> DataFrame:
    """Events with pos, their place among the events of their source by time."""
    return ranges.placed(events, ["src"], ["ts", "eid"])


def recent(events: DataFrame, roots: DataFrame, k: int, offset: int = 0) -> DataFrame:
    """(root_id, rank, eid, nbr, ts, dt): the k latest events of each root's node strictly before its
    time (plus offset). roots: (root_id, node, root_ts).

    Roots are laid among the events of their node in time order, and both are dealt by ranges of node
    and time; a root takes the last k events before it, from its range and what that range got from
    those before it. So a node with n events costs n * k and not n * n, and a busy node takes as many
    tasks as its events need. Events at the same time as a root sort behind it, which makes "before"
    strict.
    """
    e = events.select(F.col("src").alias("node"), F.col("ts").alias("at"), F.lit(1).alias("kind"), F.col("eid").alias("_order"), F.struct("ts", "eid", "dst").alias("event"), F.lit(None).cast("long").alias("root_id"), F.lit(None).cast("long").alias("root_ts"))
    r = roots.select("node", (F.col("root_ts") + offset).alias("at"), F.lit(0).alias("kind"), F.col("root_id").cast("long").alias("_order"), F.lit(None).alias("event"), F.col("root_id").cast("long").alias("root_id"), "root_ts")
    last = ranges.last_before(e.unionByName(r), "node", ["at", "kind", "_order"], "event", k)
    rows = last.select("root_id", "root_ts", F.posexplode("last").alias("rank", "e"))
    return rows.select("root_id", (F.col("rank") + 1).alias("rank"), "e.eid", F.col("e.dst").alias("nbr"), F.col("e.ts").alias("ts"), (F.col("root_ts") - F.col("e.ts")).alias("dt"))


def uniform(events: DataFrame, roots: DataFrame, k: int, salt: int = 0) -> DataFrame:
    """(root_id, draw, eid, nbr, ts): k draws with replacement from the events strictly before each
    root, by a portable hash; roots with none get none.

    A root knows how many events come before it, by running counts over ranges; a draw is a place
    among those, joined by place.
    """
    e = time_sorted(events)
    marks = e.select(F.col("src").alias("node"), F.col("ts").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("root_id"), F.col("eid").alias("_order"))
    both = marks.unionByName(roots.select("node", F.col("root_ts").alias("at"), F.lit(0).alias("kind"), F.col("root_id").cast("long").alias("root_id"), F.col("root_id").cast("long").alias("_order")))
    counted = ranges.running(both, ["node"], ["at", "kind", "_order"], n=F.col("kind")).where("kind = 0 and n > 0")
    draws = counted.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("pos", mix(F.col("root_id"), F.col("draw"), salt) % F.col("n"))
    return draws.join(e.select(F.col("src").alias("node"), "pos", "eid", F.col("dst").alias("nbr"), "ts"), ["node", "pos"]).select("root_id", "draw", "eid", "nbr", "ts")


def mix(a: Column, b: Column, salt: int) -> Column:
    """A number from 0 to 2147483628 that any engine can compute."""
    return (a * 2654435761 + b * 40503 + salt) % 2147483629


def snapshots(events: DataFrame, roots: DataFrame, k: int, history: int, duration: int) -> DataFrame:
    """(root_id, window, rank, eid, nbr, ts): of each of `history` windows of `duration` before a
    root, the k latest events; window 0 is the nearest and a window's bounds don't belong to it.

    A window is looked for as recent() does, from a root that stands at the window's end, so a
    node's events are passed once and not met by all of its roots.
    """
    at = roots.withColumn("_w", F.explode(F.sequence(F.lit(0), F.lit(history - 1))))
    moved = at.select((F.col("root_id") * history + F.col("_w")).alias("root_id"), "node", (F.col("root_ts") - F.col("_w") * duration).alias("root_ts"))
    found = recent(events, moved, k).where(F.col("dt") < duration)
    return found.select(F.expr(f"root_id div {history}").alias("root_id"), (F.col("root_id") % history).alias("window"), "rank", "eid", "nbr", "ts")


def second_hop(first: DataFrame, roots: DataFrame, keep_root_time: bool) -> DataFrame:
    """Roots of the next layer from the neighbours of the first: (root_id, node, root_ts, parent, via),
    at the time of the root or of the event `via` that led to the neighbour."""
    ts = F.col("root_ts") if keep_root_time else F.col("ts")
    joined = first.join(roots.select("root_id", "root_ts"), "root_id")
    return joined.select(F.xxhash64("root_id", "eid").alias("root_id"), F.col("nbr").alias("node"), ts.alias("root_ts"), F.col("root_id").alias("parent"), F.col("eid").alias("via"))


def chronological_split(events: DataFrame, val_from: int, test_from: int) -> DataFrame:
    """Events with split: train before val_from, then val, and test from test_from on."""
    return events.withColumn("split", F.when(F.col("ts") < val_from, "train").when(F.col("ts") < test_from, "val").otherwise("test"))


def inductive(split: DataFrame) -> DataFrame:
    """All train and val events, and those of test with an end that train hasn't seen on either side."""
    train, test = split.where("split = 'train'"), split.where("split = 'test'")
    seen = train.select(F.col("src").alias("_id")).union(train.select("dst")).distinct()
    far = seen.select(F.col("_id").alias("_src")), seen.select(F.col("_id").alias("_dst"))
    new = test.join(far[0], F.col("src") == F.col("_src"), "left").join(far[1], F.col("dst") == F.col("_dst"), "left").where("_src is null or _dst is null")
    return split.where("split != 'test'").unionByName(new.select(*split.columns))


def batches(events: DataFrame, size: int, offset: int = 0) -> DataFrame:
    """Events with batch, their place in time order divided by size; `offset` shifts the borders.

    Places are counted in ranges of time and put together from the counts of the ranges.
    """
    return _numbered(events).withColumn("batch", F.floor((F.col("_i") + offset) / size)).drop("_i")


def _numbered(events: DataFrame) -> DataFrame:
    """Events with _i, their place in time order. All events are one key here, so the table of ranges
    has a row a range."""
    return ranges.placed(events.withColumn("_one", F.lit(0)), ["_one"], ["ts", "eid"], "_i").drop("_one")


def epoch_batches(events: DataFrame, size: int, chunks: int, epochs: int, seed: int = 0) -> DataFrame:
    """Events with epoch (from 0) and batch, once for each epoch: batches of `size` events in time
    order whose borders are moved back by a number of chunks (size / chunks events each) that is drawn
    for each epoch, so that epochs see other neighbours of a border. What comes before the first border
    is batch -1."""
    drawn = mix(F.col("epoch"), F.lit(seed), 0) % chunks * (size // chunks)
    rows = _numbered(events).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(epochs - 1).cast("long"))))
    return rows.withColumn("batch", F.floor((F.col("_i") - drawn) / size)).drop("_i")
