"""Edge lists, binary compressed rows and result files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_edge_list(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst[, w]) of text lines: ids apart by white space or commas, # starts a comment, blank
    lines and further fields are passed over."""
    parts = F.split(F.trim(F.col("value")), r"[\s,]+")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(parts.alias("p"))
    cols = ["src", "dst", "w"][: 3 if weighted else 2]
    return lines.select(*[F.col("p")[i].cast("long").alias(c) for i, c in enumerate(cols)])


def write_edge_list(edges: DataFrame, path: str, *cols: str) -> None:
    edges.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols or ("src", "dst")])).write.text(path)


def read_point_pairs(spark: SparkSession, path: str, directed: bool) -> DataFrame:
    """As read_edge_list, with ids shifted so that the least is 0, and both ways if not directed."""
    e = read_edge_list(spark, path)
    least = e.agg(F.min(F.least("src", "dst")).alias("m"))
    e = e.crossJoin(F.broadcast(least)).select((F.col("src") - F.col("m")).alias("src"), (F.col("dst") - F.col("m")).alias("dst"))  # one row
    return e if directed else e.union(e.select("dst", "src"))


def _rows(data: bytes, weights: bytes | None) -> pd.DataFrame:
    n, m = np.frombuffer(data, "<u4", 2)
    start = np.frombuffer(data, "<u4", n, 8).astype(np.int64)
    end = np.frombuffer(data, "<u4", m, 8 + 4 * int(n)).astype(np.int64)
    src = np.repeat(np.arange(n, dtype=np.int64), np.diff(np.r_[start, m]))
    w = np.ones(m, np.int64) if weights is None else np.frombuffer(weights, "<u4", m, 4).astype(np.int64)
    return pd.DataFrame({"src": src, "dst": end, "w": w})


def read_binary(spark: SparkSession, path: str, weighted: bool = False) -> DataFrame:
    """(src, dst, w) of binary compressed rows: unsigned 32-bit n, m, n row starts, m ends, one graph
    a file. With weighted, a file of the same name and a w holds m and then m weights."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if weighted:
        side = spark.read.format("binaryFile").load(f"{path}w").select(F.expr("substring(path, 1, length(path) - 1)").alias("path"), F.col("content").alias("weights"))
        files = files.join(side, "path")
    else:
        files = files.withColumn("weights", F.lit(None).cast("binary"))

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for data, weights in zip(pdf["content"], pdf["weights"], strict=True):
                yield _rows(data, weights)

    return files.mapInPandas(decode, "src long, dst long, w long")


def to_binary(edges: DataFrame, parts: int, size: int) -> DataFrame:
    """(part, content, weights): each block of `size` sources as binary compressed rows with local
    source ids, in the format of read_binary. A task holds one block."""

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf.sort_values(["src", "dst"])
        local = e["src"].to_numpy() - key[0] * size
        n = size if key[0] < parts - 1 else int(local.max()) + 1
        start = np.searchsorted(local, np.arange(n)).astype("<u4")
        head = np.array([n, len(e)], "<u4").tobytes()
        return pd.DataFrame({"part": [key[0]], "content": [head + start.tobytes() + e["dst"].to_numpy().astype("<u4").tobytes()], "weights": [np.array([len(e)], "<u4").tobytes() + e["w"].to_numpy().astype("<u4").tobytes()]})

    part = F.least(F.floor(F.col("src") / size), F.lit(parts - 1)).cast("long")
    return edges.select(part.alias("part"), "src", "dst", F.col("w").cast("long")).groupBy("part").applyInPandas(encode, "part long, content binary, weights binary")


def from_binary(blocks: DataFrame, size: int) -> DataFrame:
    """(src, dst, w) of the blocks of to_binary, with the sources' ids restored."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for part, data, weights in zip(pdf["part"], pdf["content"], pdf["weights"], strict=True):
                rows = _rows(data, weights)
                yield rows.assign(src=rows["src"] + part * size)

    return blocks.mapInPandas(decode, "src long, dst long, w long")


def read_temporal(spark: SparkSession, path: str) -> DataFrame:
    """(eid, src, dst, ts, int_roll, ext_roll) of a CSV file with header; the first column counts."""
    schema = "eid long, src long, dst long, time double, int_roll int, ext_roll int"
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True).withColumnRenamed("time", "ts")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(label_id, node, ts, label, ext_roll) of a CSV file with header."""
    return spark.read.csv(path, header=True, schema="label_id long, node long, time double, label int, ext_roll int", enforceSchema=True).withColumnRenamed("time", "ts")


def rolled(events: DataFrame, which: str) -> DataFrame:
    """The events of one temporal graph: int_train, int_full or ext_full."""
    keep = {"int_train": "int_roll = 0", "int_full": "int_roll != 3", "ext_full": "true"}[which]
    return events.where(keep)


def write_results(values: DataFrame, path: str, first: int | None = None) -> None:
    """Lines "id value"; with `first`, those of the least ids only."""
    rows = values.select("id", "value") if first is None else values.select("id", "value").orderBy("id").limit(first)
    rows.select(F.concat_ws(" ", "id", "value")).write.text(path)


def write_parts(edges: DataFrame, path: str, part: str = "part") -> None:
    """One folder for each part, sorted by source; reads of one part touch its folder alone."""
    edges.repartition(part).sortWithinPartitions(part, "src").write.partitionBy(part).parquet(path)


def read_part(spark: SparkSession, path: str, part: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("part") == part)


def latest_versions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an embeddings table (id, version, x): the last version of each id."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*others), "version").alias("_r")).select("id", "_r.*")


def read_commented(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of tab-separated lines; lines that begin with # don't count."""
    return spark.read.csv(path, sep="\t", comment="#", schema="src long, dst long")


def split_targets(edges: DataFrame, train: int, val: int) -> DataFrame:
    """(id, split): the distinct targets of edges in the order of their ids, the first `train` tenths
    for training, `val` tenths for validation, the rest for tests. Places are counted range by range."""
    v = edges.select(F.col("dst").alias("id")).distinct().repartitionByRange("id").withColumn("_p", F.spark_partition_id())
    counts = v.groupBy("_p").agg(F.count("*").alias("_c"))
    run = Window.orderBy("_p")  # a row a range
    counts = counts.select("_p", (F.sum("_c").over(run) - F.col("_c")).alias("_base"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    i = F.col("_base") + F.row_number().over(Window.partitionBy("_p").orderBy("id")) - 1
    v = v.join(F.broadcast(counts), "_p").withColumn("_i", i)
    tenth = lambda k: F.expr(f"_n * {k} div 10")
    return v.select("id", F.when(F.col("_i") < tenth(train), "train").when(F.col("_i") < tenth(train + val), "val").otherwise("test").alias("split"))
