"""Joins between episodes, labels, statistics, parameters and patches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_join(episodes: DataFrame, labels: DataFrame, key: str = "episode_id") -> DataFrame:
    """Episodes with their labels; unlabelled ones are dropped."""
    return episodes.join(labels, key)


def static_join(episodes: DataFrame, static: DataFrame, key: str = "episode_id") -> DataFrame:
    return episodes.join(static, key, "left")


def without_listed(df: DataFrame, ids: Sequence, key: str = "episode_id") -> DataFrame:
    """Rows whose key is not on a short list."""
    return df.where(F.col(key).isNull() | ~F.col(key).isin(list(ids)))


def clamped_patch_join(rows: DataFrame, patches: DataFrame, half: int, key: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Each row (key, idx, len) with the patch whose centre is nearest: idx clamped to [half, len - half - 1]. Episodes too short for a patch drop out."""
    at = rows.withColumn("centre", F.least(F.greatest(F.col("idx"), F.lit(half)), F.col("len") - half - 1))
    return at.join(patches.withColumnRenamed("idx", "centre"), [*key, "centre"])


def cluster_temporal_mean(patches: DataFrame, patch: str = "patch", fallback: float | None = None) -> DataFrame:
    """(bin_id, cluster_id, mean): the mean over window positions of the mean over patches, missing ones skipped; not the pooled mean."""
    each = patches.select("bin_id", "cluster_id", F.posexplode(patch).alias("pos", "x"))
    per = each.groupBy("bin_id", "cluster_id", "pos").agg(F.avg("x").alias("m"))
    return per.groupBy("bin_id", "cluster_id").agg(F.coalesce(F.avg("m"), F.lit(fallback).cast("double")).alias("mean"))
