"""Cutting the lineage of iterative plans, and making the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session.

    Only a local master may run without that setting; it then gets a fresh folder under the
    machine's temporary folder. On a cluster a missing setting is an error, because files in a
    machine's own folder are lost to the other machines.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-weftgraph-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files, so that neither the plan nor a
    recomputation after a lost executor reaches further back.

    The cut plan keeps df's partitioning, which joins by the same key use. But where a state is joined
    with changes and put together again by unions or outer joins, planning a round takes longer with
    each, and more than ten times as long after about fourteen: such loops go on from stored().
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark


def forget(spark: SparkSession, path: str) -> None:
    """Remove a table of the shared folder that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stored(df: DataFrame) -> DataFrame:
    """As cut(), as a compressed Parquet table in the shared folder; for wide or long results."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
