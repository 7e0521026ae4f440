"""What the text operators share: the word pattern, column handling, hashed uniforms."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add. Every operator here replaces an input
    column that has the name of one of its outputs (compared without case, as Spark does)."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def as_row(df: DataFrame, *names: str) -> Column:
    """The columns of df less those named, as one struct `_row`, out of the way of all other names."""
    return F.struct(*[F.col(f"`{c}`") for c in without(df, *names).columns]).alias("_row")


def join_spread(rows: DataFrame, small: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows joined with small, which has one row of each key and the count of rows that have it.

    A key with more than one in `share` of all rows is spread over as many tasks as it has such
    shares; at most `share` keys are, so that their list may be broadcast. rows must be cut (the
    place of a row decides its task).
    """
    total = small.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = small.where(F.col(count) * share > total).select(F.col(key).alias("_hot"), F.ceil(F.col(count) * share / F.lit(max(1, total))).cast("int").alias("_times"))
    times, hot = F.coalesce("_times", F.lit(1)), F.broadcast(hot)
    dealt = rows.withColumn("_id", F.monotonically_increasing_id()).join(hot, F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64("_id"), times).cast("int")).drop("_hot", "_times", "_id")
    copies = small.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), times - 1))).drop("_hot", "_times")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def least_hashes(rows: DataFrame, group: str, h: str, most: int) -> DataFrame:
    """Of each group the rows of the `most` least hashes h (a long; null groups are left out), one
    row of each hash: rows that repeat one are taken for copies. Groups are few: labels or languages,
    each an output of the model that learns from the rows.

    Different hashes are counted in 4,096 ranges first, so that only the rows of the ranges that hold
    the least `most` of a group meet in its sort, however large the group is; copies meet before that,
    combined in each task.
    """
    place = F.shiftrightunsigned(F.col(h).bitwiseXOR(F.lit(-(1 << 63))), 52)
    known = rows.where(F.col(group).isNotNull())
    counts = known.select(group, h).distinct().groupBy(group, place.alias("_place")).agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy(group).orderBy("_place")) - F.col("_c")
    last = counts.withColumn("_before", before).where(F.col("_before") < most).groupBy(group).agg(F.max("_place").alias("_last"))
    near = known.join(F.broadcast(last), group).where(place <= F.col("_last")).drop("_last").dropDuplicates([group, h])
    return near.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(h))).where(F.col("_n") <= most).drop("_n")


def by_bytes(sizes: Iterable[int], most: int = 1 << 20) -> Iterator[slice]:
    """Slices of about `most` bytes, one item at least."""
    at = end = size = 0
    for n in sizes:
        end, size = end + 1, size + n
        if size >= most:
            yield slice(at, end)
            at, size = end, 0
    if end > at:
        yield slice(at, end)


def uniform(*cols: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the given columns alone (53 bits)."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + F.lit(0.5)) / F.lit(float(2**53))


def n_words(text: Column) -> Column:
    """Words in the whole text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of n rows to and from Python tasks in the actions within, for the sake of memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)
