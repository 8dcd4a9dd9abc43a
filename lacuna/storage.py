"""Intermediate results that outlive executors, and file sinks."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset and all tasks run on this machine, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_lacuna_shared", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        path = tempfile.mkdtemp(prefix="lacuna-")
        spark._lacuna_shared = path
    return path


def durable(df: DataFrame) -> DataFrame:
    """The rows in the checkpoint folder; plans start anew from them."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
