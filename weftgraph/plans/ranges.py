"""Rows dealt out by ranges of an order, for places, running sums and last rows of keys of any size.

A window by key puts all rows of the key into one task. Here rows are dealt by ranges of (key, order)
instead, so a busy key lies in several ranges, and windows are by key and range; what a range needs of
those before it comes from a table with one row (or k rows) for each key and range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.lineage import stored


def dealt(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """rows with _p, the number of their range of (key, order), written once so that every reader sees
    the same ranges. Rows that are equal in key and order are in one range."""
    by = [*key, *order]
    return stored(rows.repartitionByRange(*by).withColumn("_p", F.spark_partition_id()))


def before_ranges(rows: DataFrame, key: Sequence[str], **sums: Column) -> DataFrame:
    """(key, _p, <name>_before, <name>_all) of dealt rows: sums over the key's ranges before this one,
    and over all of them. A key has as many rows here as it has ranges."""
    by = rows.groupBy(*key, "_p").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()])
    whole = Window.partitionBy(*key)
    so_far = whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    out = [c for n in sums for c in (F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(f"{n}_before"), F.sum(n).over(whole).alias(f"{n}_all"))]
    return by.select(*key, "_p", *out)


def placed(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column], place: str = "pos", size: str | None = None) -> DataFrame:
    """rows with `place`, their place from 0 in the order of their key, and `size`, the key's rows."""
    ranged = dealt(rows, key, order)
    counts = before_ranges(ranged, key, _n=F.lit(1))
    here = F.row_number().over(Window.partitionBy(*key, "_p").orderBy(*order)) - 1
    out = ranged.withColumn("_here", here).join(counts, [*key, "_p"])
    sizes = [F.col("_n_all").alias(size)] if size else []
    return out.select(*rows.columns, (F.col("_n_before") + F.col("_here")).alias(place), *sizes)


def running(rows: DataFrame, key: Sequence[str], order: Sequence[str | Column], **sums: Column) -> DataFrame:
    """rows with the sums of the key's rows up to each, itself included."""
    ranged = dealt(rows, key, order)
    before = before_ranges(ranged, key, **{f"_{n}": c for n, c in sums.items()})
    so_far = Window.partitionBy(*key, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumns({f"_here_{n}": F.coalesce(F.sum(c).over(so_far), F.lit(0)) for n, c in sums.items()}).join(before, [*key, "_p"])
    return out.select(*rows.columns, *[(F.col(f"_{n}_before") + F.col(f"_here_{n}")).alias(n) for n in sums])


def last_before(rows: DataFrame, key: str, order: Sequence[str], item: str, k: int) -> DataFrame:
    """rows (key, order..., item, ...) in which those with a null item are given `last`, an array of the
    k latest items of their key before them in the order, the latest first; the others are left out.

    Within a range a window frame carries the items. A key that goes on from an earlier range gets the
    last k items of its earlier ranges, found in the same way among k items of each of its ranges.
    """
    ranged = dealt(rows, [key], order)
    parts = ranged.groupBy(key, "_p").agg(F.count("*").alias("_c"))
    several = parts.withColumn("_parts", F.count("*").over(Window.partitionBy(key))).where("_parts > 1").select(key, "_p")
    latest = Window.partitionBy(key, "_p").orderBy(*[F.col(c).desc() for c in order])
    tails = ranged.where(F.col(item).isNotNull()).join(several, [key, "_p"]).withColumn("_r", F.row_number().over(latest)).where(F.col("_r") <= k)
    marks = several.select(key, "_p", F.lit(0).alias("_kind"), F.lit(0).alias("_back"), F.lit(None).cast(rows.schema[item].dataType).alias(item))
    ends = marks.unionByName(tails.select(key, "_p", F.lit(1).alias("_kind"), (-F.col("_r")).alias("_back"), item))
    carry = _carried(ends, [key], ["_p", "_kind", "_back"], item, k).select(key, "_p", F.col("last").alias("_carry"))
    here = _carried(ranged, [key, "_p"], order, item, k)
    none = F.array().cast(here.schema["last"].dataType)
    both = here.join(carry, [key, "_p"], "left").withColumn("last", F.slice(F.concat("last", F.coalesce("_carry", none)), 1, k))
    return both.select(*rows.columns, "last")


def _carried(rows: DataFrame, key: Sequence[str], order: Sequence[str], item: str, k: int) -> DataFrame:
    """As last_before(), by windows over the key."""
    some = F.col(item).isNotNull()
    upto = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # items alone are counted, so that rows without one don't take places
    seen = rows.withColumn("_seen", F.coalesce(F.sum(some.cast("int")).over(upto), F.lit(0)))
    frame = Window.partitionBy(*key).orderBy("_seen").rangeBetween(-k + 1, 0)
    held = F.collect_list(F.when(some, F.struct(F.col("_seen").alias("n"), F.col(item).alias("item")))).over(frame)
    latest = F.transform(F.reverse(F.array_sort("_held")), lambda h: h["item"])
    return seen.withColumn("_held", held).where(~some).withColumn("last", latest).drop("_seen", "_held")
