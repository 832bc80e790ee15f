"""Intermediate tables in the shared checkpoint folder, so that lost executors can be replaced."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. A local one only where all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not named and master != "local" and not master.startswith("local["):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all of it shares")
    return named or os.path.join(tempfile.gettempdir(), "assayer-checkpoints")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage and keeps one copy that every executor can read."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def tidy(df: DataFrame) -> DataFrame:
    """After a table was written: have the driver collect garbage, as Spark removes the shuffle files of what led to it
    only after that."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def release(df: DataFrame) -> None:
    """Delete what materialize() wrote, once nothing reads it any more, and tidy()."""
    path = getattr(df, "_stored_at", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        tidy(df)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
