"""Cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; only a local master may do without spark.checkpoint.dir."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return at or "file:///tmp/tidemark-shared"


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder. Rows are fixed from here on."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; else the planner chooses. df is read to count it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
