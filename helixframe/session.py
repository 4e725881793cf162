"""Sessions and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "helixframe", **conf: str) -> SparkSession:
    """A session with adaptive plans and UTC times; in `conf` keys _ stands for a dot."""
    builder = SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workspace(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; only local mode may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/helixframe"
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to a shared folder and read it again: its rows are fixed and its lineage ends."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows over at least as many partitions as there are cores, for work that costs far more than a shuffle of its input.

    A small file may be one task, whatever its size in work. An input that is already in as
    many parts stays as it is; so do all large ones.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, *keys)
