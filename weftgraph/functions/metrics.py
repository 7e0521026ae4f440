"""Measures of predictions from counts of equal scores, so that no task ranks all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binary_metrics(rows: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(n, positives, accuracy, auc, average_precision) in one row.

    Running counts go over the distinct scores in ranges, put together from the ranges' sums. Ties
    count half in auc and together in average_precision."""
    by = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("q"))
    by = by.repartitionByRange(F.col("s").desc()).withColumn("_r", F.spark_partition_id())
    sums = by.groupBy("_r").agg(F.sum("p").alias("_p"), F.sum("q").alias("_q"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_r", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_p", "_q")])
    down = Window.partitionBy("_r").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = by.withColumns({"tp": F.sum("p").over(down), "fp": F.sum("q").over(down)}).join(F.broadcast(sums), "_r")  # a row a range
    run = run.withColumns({"tp": F.col("tp") + F.col("_p0"), "fp": F.col("fp") + F.col("_q0")})
    return run.agg(
        F.sum(F.col("p") + F.col("q")).alias("n"), F.sum("p").alias("positives"),
        (F.sum(F.when(F.col("s") >= 0.5, F.col("p")).otherwise(F.col("q"))) / F.sum(F.col("p") + F.col("q"))).alias("accuracy"),
        (F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("q"))).alias("auc"),
        (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("average_precision"),
    )


def micro_f1(rows: DataFrame, predicted: str = "predicted", label: str = "label") -> DataFrame:
    """(f1) over all classes together."""
    hit = (F.col(predicted) == F.col(label)).cast("long")
    miss = 1 - hit  # a false positive of one class and a false negative of another
    return rows.agg((2 * F.sum(hit) / (2 * F.sum(hit) + 2 * F.sum(miss))).alias("f1"))


def mean_reciprocal_rank(rows: DataFrame) -> DataFrame:
    """(mrr) of (query, score, label): 1 / (1 + negatives scored above the positive)."""
    pos = rows.where("label = 1").select("query", F.col("score").alias("_p"))
    each = rows.where("label = 0").join(pos, "query").groupBy("query").agg((1 / (1 + F.sum((F.col("score") > F.col("_p")).cast("long")))).alias("r"))
    return each.agg(F.avg("r").alias("mrr"))
