"""Random graphs, features, labels and splits by a portable hash: the same on every run and engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.structure import numbered
from weftgraph.operators.temporal import mix

#: Numbers that mix() can give.
RANGE = 2147483629


def uniform_graph(spark: SparkSession, nodes: int, edges: int, seed: int = 0) -> DataFrame:
    """(src, dst): random ends by hash, the same on every run."""
    end = lambda side: F.pmod(F.xxhash64(F.lit(seed), F.lit(side), "id"), F.lit(nodes)).alias(side)
    return spark.range(edges).select(end("src"), end("dst"))


def random_features(ids: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """(id, x): `dim` numbers from 0 to 1 (exclusive) for each of ids (id)."""
    places = F.sequence(F.lit(0).cast("long"), F.lit(dim - 1).cast("long"))
    return ids.select("id", F.transform(places, lambda j: mix(F.col("id") + 1, j + 1, seed) / RANGE).alias("x"))


def random_labels(ids: DataFrame, classes: int, seed: int = 0) -> DataFrame:
    """(id, label): one of `classes` for each of ids (id)."""
    return ids.select("id", (mix(F.col("id") + 1, F.lit(0), seed) % classes).alias("label"))


def random_split(ids: DataFrame, train: int = 65, val: int = 10, seed: int = 0) -> DataFrame:
    """(id, split): train, val and test shares in percent, exact but for rounding down, of ids (id) in a
    random order; ids are numbered range by range."""
    rows = numbered(ids.select("id", mix(F.col("id") + 1, F.lit(0), seed).alias("_h")), "_h", "id", name="_i")
    n = F.broadcast(ids.agg(F.count("*").alias("_n")))  # one row
    part = lambda k: F.expr(f"_n * {k} div 100")
    return rows.crossJoin(n).select("id", F.when(F.col("_i") < part(train), "train").when(F.col("_i") < part(train + val), "val").otherwise("test").alias("split"))
