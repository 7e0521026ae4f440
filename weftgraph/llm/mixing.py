"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import n_words, table, without
from weftgraph.plans.lineage import cut, stored

#: Documents that one task ranks at a time, on average.
BLOCK = 8192
OUT = ("size", "source_size", "target", "copies", "taken")


def source_targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """Target words of each source: sizes has one row (source, source_size) for each source. The rows
    also have `_rank`, the source's place from 0, which is never null.

    Sources in code-point order, null last, weigh weights[0], weights[1], ..., repeating. They share
    budget times the sum of all sizes in proportion to their weights, but a source gets at most
    `most` times its size and what is above that is shared again by weight. The fixed point of the
    resharing is the water level x with sum(min(most * size, x * weight)) = budget * total: in the
    order of most * size / weight, the sources before the level are full.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("_rank"), F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_fill = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy((F.col("_cap") / F.col("_w")).desc(), F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    level = (F.lit(float(budget)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(ahead)
    filled = ranked.withColumn("_level", level)
    # The first source that isn't filled by the level reached at its place gives the level of all.
    mine = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_rank").alias("b"), F.col("_level").alias("level")))).over(whole)
    filled = filled.withColumn("_at", mine["level"])
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at") * F.col("_w")))
    return filled.select("source", "source_size", target.alias("target"), "_rank")


def mix_sources(
    docs: DataFrame,
    size: Column,
    weights: Sequence[float] = (5, 2, 1),
    budget: float = 1.5,
    most: float = 2.0,
    favour: Column | None = None,
    seed: str = "mix",
    n_docs: int | None = None,
) -> DataFrame:
    """docs with size, source_size, target, copies and taken: the words the mix takes of each row.

    A source whose target is m times its size takes floor(m) whole copies of every document. The
    rest of its target is a Pareto order sample: each document has a uniform number u from its
    doc_id, its inclusion odds are favour * f / (1 - f) for the left fraction f, and documents are
    taken in the order of (u / (1 - u)) / odds until the words left are reached. The sample's size
    is fixed in words, so the last document in may be cut; copies counts it as a copy.
    favour (default 1) makes inclusion unequal within a source.

    No task ranks a whole source: ranks are cut into ranges of the order value with about BLOCK
    rows each, and running sums are put together from the sums of the ranges. Reruns agree.
    Whole rows are shuffled once, by source and range: the targets (a row for each source) are written
    first, so that Spark sees that they are small, and the sums of the ranges are joined by the same key.

    A null source is a source of its own, the last. Null or empty texts have size 0, take nothing
    and get copies of the source. Rows that agree in doc_id and size are interchangeable. An empty
    table gives no rows. Input columns named like an output are replaced.
    """
    favour = F.lit(1.0) if favour is None else favour
    row = F.struct(*[F.col(f"`{c}`") for c in without(docs, *OUT).columns])
    d = docs.select(row.alias("_row"), "doc_id", "source", size.alias("size"), favour.cast("double").alias("_favour"))
    sizes = d.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, budget, most).withColumnRenamed("source", "_source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("_whole", whole)
    plan = plan.withColumn("_left", F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long"))
    f = F.col("_left") / F.col("source_size")
    # odds of the left fraction; 1 where nothing is left or known, as the order then has no effect
    plan = plan.withColumn("_odds", F.when((F.col("_left") > 0) & (F.col("_left") < F.col("source_size")), f / (1 - f)).otherwise(1.0))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    d = d.join(stored(plan), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("_u", u).withColumn("_q", (F.col("_u") / (1 - F.col("_u"))) / (F.col("_favour") * F.col("_odds")))
    n_docs = docs.count() if n_docs is None else n_docs
    blocks = max(1, -(-n_docs // BLOCK))
    z = F.col("_q") * F.col("_odds")
    d = d.withColumn("_block", F.least(F.lit(blocks - 1), F.floor(z / (1 + z) * blocks)).cast("int"))
    within = Window.partitionBy("_rank", "_block").orderBy("_q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("_rank", "_block").agg(F.sum("size").alias("_sum"))
    so_far = Window.partitionBy("_rank").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_rank", "_block", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_base"))
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.join(sums, ["_rank", "_block"])
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_left") - F.col("_base") - F.col("_before")))
    d = d.withColumn("taken", (F.col("_whole") * F.col("size") + extra).cast("long"))
    d = d.withColumn("copies", (F.col("_whole") + (extra > 0).cast("long")).cast("long"))
    return d.select("_row.*", *OUT)


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as copies says, with copy_no from 1 (extra column; one of that
    name is replaced). Rows with null copies or none go; an empty table gives no rows."""
    out = without(mixed, "copy_no")
    return out.where("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


#: Production parameters of the query: an extra copy of a very long document is less likely.
LONG = 2000


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sources() of all documents, whose words are counted once. Nulls, empty texts, ties,
    repeats, an empty table and further columns as stated there."""
    docs = table(spark, sf_dir, "documents")
    d = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("_n")))
    out = mix_sources(d, F.col("_n"), favour=F.least(F.lit(1.0), F.lit(float(LONG)) / F.greatest(F.col("_n"), F.lit(1))))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source) - 1 AS rk FROM s),
w AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
     - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / sum(w) OVER (ORDER BY cap / w DESC, rk DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv FROM w),
a AS (SELECT lv AS at FROM l WHERE lv * w <= cap ORDER BY cap / w, rk LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN a.at IS NULL THEN cap ELSE least(cap, a.at * w) END AS target FROM l LEFT JOIN a ON true),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, CAST(round(target - whole * source_size) AS BIGINT) AS lft FROM p),
o AS (SELECT *, CASE WHEN lft > 0 AND lft < source_size THEN (lft / source_size) / (1 - lft / source_size) ELSE 1.0::DOUBLE END AS odds FROM q),
u AS (SELECT d.doc_id, d.source, d.size, o.source_size, o.target, o.whole, o.lft, o.odds,
      (CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source),
k AS (SELECT *, (u / (1 - u)) / ((CASE WHEN size > 0 THEN least(1.0::DOUBLE, 2000.0::DOUBLE / size) ELSE 1.0::DOUBLE END) * odds) AS q FROM u)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, lft
  - coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS BIGINT) AS taken
FROM k
"""
