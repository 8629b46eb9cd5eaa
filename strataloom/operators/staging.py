"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); a local one only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="strataloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join by shuffling: one that grows with the subjects or their genotypes is not gathered on the driver and sent
    to all executors, however small Spark takes it to be (of rows that are exploded from few it only knows the few)."""
    return df.hint("merge")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new path and read again: its lineage ends there, and lost executors don't matter."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
