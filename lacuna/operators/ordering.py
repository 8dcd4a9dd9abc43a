"""Global order without a single-task window: range partitions, local windows, and offsets from one small row per partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.storage import durable


def running_sums(df: DataFrame, keys: Sequence[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of an expression over all rows up to this one in the order of ``keys``, which should be unique.

    Rows are dealt out by ranges of the keys and kept durably, so that the ranges stand still. Sums within a range come from a window, the totals of the ranges before it from
    a table of one row per range.
    """
    named = df.select("*", *[k.alias(f"__k{i}") for i, k in enumerate(keys)], *[s.alias(f"__s_{n}") for n, s in sums.items()])
    order = [f"__k{i}" for i in range(len(keys))]
    ranged = durable(named.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("__range").agg(*[F.sum(f"__s_{n}").alias(f"__t_{n}") for n in sums])
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range: as many as there are shuffle partitions.
    out = ranged.join(F.broadcast(totals), "__range")
    out = out.select("*", *[(F.col(f"__b_{n}") + F.sum(f"__s_{n}").over(within)).alias(n) for n in sums])
    return out.select(*df.columns, *sums)


def global_index(df: DataFrame, keys: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``keys`` (unique)."""
    return running_sums(df, keys, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def equal_bins(df: DataFrame, keys: Sequence[Column], bins: int, name: str = "bin_id") -> DataFrame:
    """Cuts the ordered rows into bins of floor(n / bins); the last one takes the remainder (not what ``ntile`` does)."""
    n = df.count()
    size = max(1, n // bins)
    return global_index(df, keys, "__at").withColumn(name, F.least(F.floor(F.col("__at") / size), F.lit(bins - 1)).cast("int")).drop("__at")
