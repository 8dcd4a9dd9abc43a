"""Seeded synthetic data on the executors: labelled matrices whose gaps depend on the label."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def missing_by_label(spark: SparkSession, samples: int = 1000, rows: int = 100, columns: int = 10, rate: float = 0.1, last_rate: float = 0.2, seed: int = 0) -> DataFrame:
    """(sample, pos, var, v, y): normals; label 1 loses ``last_rate`` of the last column, else ``rate``."""
    base = spark.range(samples).select(F.col("id").alias("sample"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)).cast("int").alias("y"))
    cells = base.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("var", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    drop = F.when((F.col("var") == columns - 1) & (F.col("y") == 1), last_rate).otherwise(rate)
    return cells.withColumn("x", F.randn(seed)).withColumn("u", F.rand(seed + 1)).select("sample", "pos", "var", F.when(F.col("u") >= drop, F.col("x")).alias("v"), "y")


def oscillating_missing(spark: SparkSession, samples: int = 1000, rows: int = 100, columns: int = 10, rate: float = 0.1, swing: float = 0.05, seed: int = 0) -> DataFrame:
    """The same, but for label 1 the rate of the last column is rate + swing x sin(pi pos / (rows - 1))."""
    cells = missing_by_label(spark, samples, rows, columns, 0.0, 0.0, seed)
    wave = F.lit(rate) + F.lit(swing) * F.sin(F.lit(math.pi) * F.col("pos") / F.lit(float(max(rows - 1, 1))))
    drop = F.when((F.col("y") == 1) & (F.col("var") == columns - 1), wave).otherwise(rate)
    return cells.withColumn("u", F.rand(seed + 2)).withColumn("v", F.when(F.col("u") >= drop, F.col("v"))).drop("u")


def labelled_matrix(spark: SparkSession, rows: int = 1000, columns: int = 100, classes: int = 2, seed: int = 0) -> DataFrame:
    """(id, x0 .., y): normals; y a class, or with ``classes`` = 0 uniform in [1, 5]."""
    y = F.lit(1.0) + F.rand(seed + 1000) * 4 if classes == 0 else F.floor(F.rand(seed + 1000) * classes).cast("int")
    return spark.range(rows).select("id", *[F.randn(seed + i).alias(f"x{i}") for i in range(columns)], y.alias("y"))
