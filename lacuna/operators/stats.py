"""Dataset statistics, normalisation, filters and the four-stat features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.arrays import l2_norm, total
from lacuna.operators.series import KEY, series_window


def var_stats(df: DataFrame) -> DataFrame:
    """Per variable: observed cells, mean, population deviation."""
    return df.groupBy("var").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def missing_rate(df: DataFrame) -> DataFrame:
    """Per variable of a dense grid: missing cells over all cells."""
    return df.groupBy("var").agg(F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"))


def metadata(df: DataFrame) -> DataFrame:
    """Per variable of a dense grid: mean, std and missing rate in one aggregation."""
    return df.groupBy("var").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.avg(F.col("v").isNull().cast("double")).alias("missing_rate"))


def seq_len_stats(df: DataFrame) -> DataFrame:
    """One row: mean, largest, smallest length of the episodes (distinct times) and its population deviation."""
    lengths = df.groupBy("episode_id", "t").agg(F.lit(1).alias("one")).groupBy("episode_id").agg(F.count("one").alias("len"))
    return lengths.agg(F.avg("len").alias("mean_seq_len"), F.max("len").alias("max_seq_len"), F.min("len").alias("min_seq_len"), F.stddev_pop("len").alias("sigma_seq_len"))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and share of each class; the window runs over the classes only."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def drop_sparse_vars(df: DataFrame, meta: DataFrame, most: float) -> DataFrame:
    """Rows of variables whose missing rate is at most ``most``."""
    return df.join(F.broadcast(meta.where(F.col("missing_rate") <= most).select("var")), "var", "left_semi")


def drop_const_vars(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows of variables whose training deviation is not 0."""
    return df.join(F.broadcast(meta.where(F.col("std") != 0).select("var")), "var", "left_semi")


def zscore(df: DataFrame, meta: DataFrame) -> DataFrame:
    """``z`` by the training mean and deviation; NULL where the deviation is 0."""
    return df.join(F.broadcast(meta.select("var", F.col("mean").alias("__m"), F.col("std").alias("__s"))), "var").withColumn("z", F.try_divide(F.col("v") - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def minmax_norm(long: DataFrame, by: Sequence[str] = ("feature",), value: str = "x") -> DataFrame:
    """``norm`` = (x - min) / (max - min + 1e-5) within each group; the statistics are one row per group."""
    lim = long.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return long.join(lim, list(by)).withColumn("norm", (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + F.lit(1e-5))).drop("__lo", "__hi")


def outlier_filter(long: DataFrame, deviations: float = 2.0, value: str = "x") -> DataFrame:
    """Rows within ``deviations`` population deviations of their feature's mean, the bounds included."""
    s = long.groupBy("feature").agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    return long.join(F.broadcast(s), "feature").where(F.col(value).between(F.col("__m") - deviations * F.col("__s"), F.col("__m") + deviations * F.col("__s"))).drop("__m", "__s")


def drop_const_patch(df: DataFrame, patch: str, least: float = 1e-5) -> DataFrame:
    return df.where(total(F.col(patch)) > least)


def max_l2_norm(df: DataFrame, vector: str) -> DataFrame:
    return df.agg(F.max(l2_norm(F.col(vector))).alias("max_norm"))


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, cov): sample covariances of all pairs of columns, a <= b, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.covar_samp(a, b).alias(f"c{k}") for k, (a, b) in enumerate(pairs)])
    items = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{k}").alias("cov")) for k, (a, b) in enumerate(pairs)])
    return one.select(F.explode(items).alias("x")).select("x.*")


def class_histogram(df: DataFrame, value: str, label: str, bins: int) -> DataFrame:
    """(label, bin, n): equal-width bins between the smallest and largest value, per class."""
    lim = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    b = F.least(F.floor((F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    return df.crossJoin(F.broadcast(lim)).select(label, b.alias("bin")).groupBy(label, "bin").agg(F.count(F.lit(1)).alias("n"))  # one row of limits


def simple_features(obs: DataFrame, variables: Sequence[str], means: DataFrame | None = None) -> DataFrame:
    """Mean, deviation, and mean and deviation of successive differences of each (episode, variable).

    A variable never observed in an episode has its global mean and zeros. The second aggregation densifies: one row per episode carries its features by variable, and the
    listed variables are exploded from it, so no join of episodes with variables takes place.
    """
    diff = F.col("v") - F.lag("v").over(series_window())
    seen = obs.where(F.col("v").isNotNull()).withColumn("d", diff)
    per = seen.groupBy(*KEY).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("diff_mean"), F.coalesce(F.stddev_pop("d"), F.lit(0.0)).alias("diff_std"))
    packed = per.groupBy("episode_id").agg(F.map_from_entries(F.collect_list(F.struct("var", F.struct("mean", "std", "diff_mean", "diff_std")))).alias("m"))
    dense = packed.select("episode_id", "m", F.explode(F.array(*[F.lit(v) for v in variables])).alias("var")).withColumn("f", F.try_element_at("m", F.col("var")))
    means = obs.groupBy("var").agg(F.avg("v").alias("mean")) if means is None else means
    out = dense.join(F.broadcast(means.select("var", F.col("mean").alias("__g"))), "var", "left")
    zero = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(0.0)).alias(c)
    return out.select("episode_id", "var", F.coalesce("f.mean", "__g", F.lit(0.0)).alias("mean"), zero("std"), zero("diff_mean"), zero("diff_std"))


def features_wide(features: DataFrame, variables: Sequence[str]) -> DataFrame:
    """One row per episode, one column per (statistic, variable)."""
    stats = ("mean", "std", "diff_mean", "diff_std")
    out = features.groupBy("episode_id").pivot("var", list(variables)).agg(*[F.first(s).alias(s) for s in stats])
    return out
