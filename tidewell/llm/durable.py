"""Cutting lineage in the folder that the cluster shares, and holding columns in place."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; unset, a temporary one in local mode (tests), else an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def durable(df: DataFrame) -> DataFrame:
    """The same rows, read from a checkpoint that outlives executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """A durable copy, to be broadcast if it has so many rows at most; beyond that Spark shuffles it."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def held(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that the optimizer can't copy into later expressions and filters.

    Filters that joins infer or callers add are otherwise pushed down with the
    whole expression inlined, and a costly one is evaluated again and again.
    """
    return rows.select("*", F.explode(F.array(value)).alias(name))
