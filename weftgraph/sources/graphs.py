"""Graphs over the star schema: part follows part in an order, suppliers supply parts, users act."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_steps(spark: SparkSession, sf_dir: str, above: int = 40) -> DataFrame:
    """(src, dst, w): parts that follow each other in an order with a quantity above `above`, as often as they do."""
    order = Window.partitionBy("l_orderkey").orderBy(*[F.asc_nulls_last(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")])
    # columns that are made before the window would be shuffled beside those they come from
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumn("dst", F.lead("l_partkey").over(order))
    return lines.select(F.col("l_partkey").alias("src"), "dst", F.col("l_quantity").cast("long").alias("w")).where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst")) & (F.col("w") > above))


def part_graph(spark: SparkSession, sf_dir: str, above: int = 40) -> DataFrame:
    """(src, dst, w): parts that follow each other in an order with a quantity above `above`."""
    return part_steps(spark, sf_dir, above).groupBy("src", "dst").agg(F.min("w").alias("w"))


PART_GRAPH = """l AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS dst,
  CAST(l_quantity AS BIGINT) AS w FROM lineitem),
e AS (SELECT src, dst, min(w) AS w FROM l WHERE dst IS NOT NULL AND src <> dst AND w > 40 GROUP BY src, dst)"""


def part_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id): the parts of small size, a training set as a table of vertices would give it."""
    return table(spark, sf_dir, "part").where("p_size <= 2").select(F.col("p_partkey").alias("id"))


SEEDS = "SELECT p_partkey AS id FROM part WHERE p_size <= 2"


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): supplier supplies part, once for each line."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): supplier supplies part."""
    return supplies(spark, sf_dir).distinct()


SUPPLY_GRAPH = "s AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


#: The id of the first type of event.
KINDS = 1_000_000_000


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, src, dst, ts, w): a user acts on a type of event; ts in microseconds. Types have ids from
    KINDS on, apart from those of users."""
    kinds = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}
    code = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()], F.lit(5)).cast("long") + KINDS
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), code.alias("dst"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ts"), F.col("value").alias("w"))


EVENT_GRAPH = """ev AS (SELECT event_id AS eid, user_id AS src, CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2
  WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE 5 END AS BIGINT) + 1000000000 AS dst, epoch_us(ts) AS ts, value AS w FROM events)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x): the vectors."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), x.alias("x"))


FEATURES = """f AS MATERIALIZED (SELECT vec_id AS id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"""


def part_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors (v, x), and (id, v) of every part: they are dealt out by part number modulo their number."""
    x = features(spark, sf_dir)
    n = x.agg(F.count("*").alias("n"))
    index = part_vertices(spark, sf_dir).crossJoin(F.broadcast(n)).select("id", (F.col("id") % F.col("n")).alias("v"))
    return x.withColumnRenamed("id", "v"), index


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x) of every part."""
    shared, index = part_vectors(spark, sf_dir)
    return index.join(shared, "v").select("id", "x")


PART_FEATURES = FEATURES + """,
pf AS MATERIALIZED (SELECT p_partkey AS id, pos, v FROM part JOIN f ON f.id = p_partkey % (SELECT count(*) FROM embeddings))"""
