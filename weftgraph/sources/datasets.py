"""Whole graph data sets as a folder of tables: edges, features, labels, splits and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.structure import degrees, right_norm


def write_dataset(path: str, edges: DataFrame, features: DataFrame, labels: DataFrame, splits: DataFrame) -> None:
    """Tables `edges` (src, dst), `nodes` (id, x, label, split) and `info` (n_nodes, n_edges, dim,
    n_classes) in one row. Nodes are those with features; labels (id, label) and splits (id, split)
    may lack some, which are null there."""
    edges.select("src", "dst").write.parquet(f"{path}/edges")
    features.join(labels.select("id", "label"), "id", "left").join(splits.select("id", "split"), "id", "left").select("id", "x", "label", "split").write.parquet(f"{path}/nodes")
    spark = edges.sparkSession
    nodes = spark.read.parquet(f"{path}/nodes").agg(F.count("*").alias("n_nodes"), F.max(F.size("x")).alias("dim"), F.count_distinct("label").alias("n_classes"))
    spark.read.parquet(f"{path}/edges").agg(F.count("*").alias("n_edges")).crossJoin(nodes).select("n_nodes", "n_edges", "dim", "n_classes").write.parquet(f"{path}/info")  # one row each


def read_dataset(spark: SparkSession, path: str, *tables: str) -> tuple[DataFrame, ...]:
    """Tables of write_dataset(), by default edges and nodes."""
    return tuple(spark.read.parquet(f"{path}/{t}") for t in tables or ("edges", "nodes"))


def split_of_type(kind: Column) -> Column:
    """train, val and test of the node types 1, 2 and 3; other types are null."""
    return F.when(kind == 1, "train").when(kind == 2, "val").when(kind == 3, "test")


def derived(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, norm) of an edge list's vertices, norm being 1 / in-degree."""
    return degrees(edges, vertices).join(right_norm(edges, vertices), "id")
