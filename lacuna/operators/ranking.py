"""Supervised feature ranking by the best two-way split of each feature.

For every feature and equal-width cut the rows fall left (<= cut) or right (> cut), and the feature's loss is the smallest loss over the cuts. All features go through one pass:
unpivot, one aggregation per (feature, bin), then running sums over at most ``n_bins`` rows per feature.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalar import steps_below
from lacuna.operators.stats import outlier_filter


def unpivoted(df: DataFrame, features: Sequence[str], *keep: str) -> DataFrame:
    """(keep.., feature, x)."""
    return df.select(*keep, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(list(keep), [f"`{f}`" for f in features], "feature", "x")


def _xlog2(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def _binary_bits(n: Column, s: Column) -> Column:
    """n times the entropy of a 0/1 label with sum s, in bits."""
    p = F.try_divide(s, n)
    return F.when(n > 0, -n * (_xlog2(p) + _xlog2(F.lit(1.0) - p))).otherwise(0.0)


def _sse(n: Column, s: Column, q: Column) -> Column:
    return F.when(n > 0, F.greatest(q - F.try_divide(s * s, n), F.lit(0.0))).otherwise(0.0)


def split_losses(df: DataFrame, features: Sequence[str], label: str, n_bins: int, loss: str = "bce", outliers: bool = False) -> DataFrame:
    """(feature, loss). ``loss``: bce (0/1 label, bits), ce (any classes, bits) or rmse. ``outliers`` first drops values over two deviations from the mean.

    A constant feature has the loss of all rows on the left; a feature with a missing value has an infinite loss.
    """
    if loss not in ("bce", "ce", "rmse"):
        raise ValueError(loss)
    long = unpivoted(df.withColumn("__y", F.col(label)), features, "__y")
    if outliers:
        long = outlier_filter(long)
    lim = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum(F.col("x").isNull().cast("int")).alias("gaps"))
    binned = long.join(F.broadcast(lim), "feature")  # one row per feature
    binned = binned.withColumn("bin", F.when(F.col("gaps") > 0, 0).otherwise(steps_below(F.col("x"), F.col("lo"), (F.col("hi") - F.col("lo")) / n_bins, n_bins)))
    up = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("feature")
    if loss == "ce":
        up = Window.partitionBy("feature", "__y").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counts = binned.groupBy("feature", "gaps", "__y", "bin").agg(F.count(F.lit(1)).alias("n"))
        # Every class needs a row at every bin for its running count.
        grid = counts.select("feature", "gaps", "bin").distinct().join(counts.select("feature", "__y").distinct(), "feature")
        full = grid.join(counts, ["feature", "gaps", "__y", "bin"], "left").fillna(0, ["n"])
        run = full.withColumn("l", F.sum("n").over(up)).withColumn("t", F.sum("n").over(Window.partitionBy("feature", "__y")))
        side = lambda c: -F.sum(F.when(c > 0, c * F.log2(c)).otherwise(0.0)) + F.when(F.sum(c) > 0, F.sum(c) * F.log2(F.sum(c))).otherwise(0.0)
        cuts = run.groupBy("feature", "gaps", "bin").agg(F.sum("l").alias("nl"), F.sum("t").alias("nt"), side(F.col("l")).alias("bl"), side(F.col("t") - F.col("l")).alias("br"))
        # An empty right side is no split, except for a constant feature.
        value = F.when((F.col("nl") < F.col("nt")) | (F.count(F.lit(1)).over(whole) == 1), (F.col("bl") + F.col("br")) / F.col("nt"))
        cuts = cuts.withColumn("loss", value)
    else:
        y = F.col("__y").cast("double")
        sums = binned.groupBy("feature", "gaps", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
        run = sums.select("feature", "gaps", "bin", *[F.sum(c).over(up).alias(f"{c}l") for c in "nsq"], *[F.sum(c).over(whole).alias(f"{c}t") for c in "nsq"])
        n, s, q = ((F.col(f"{c}l"), F.col(f"{c}t") - F.col(f"{c}l")) for c in "nsq")
        if loss == "bce":
            value = (_binary_bits(n[0], s[0]) + _binary_bits(n[1], s[1])) / F.col("nt")
        else:
            value = F.sqrt((_sse(n[0], s[0], q[0]) + _sse(n[1], s[1], q[1])) / F.col("nt"))
        cuts = run.where((F.col("bin") < n_bins - 1) | (F.col("gaps") > 0)).withColumn("loss", value)
    return cuts.groupBy("feature").agg(F.when(F.max("gaps") > 0, F.lit(float("inf"))).otherwise(F.min("loss")).alias("loss"))


def ranked(losses: DataFrame) -> DataFrame:
    """Adds ``rank`` from 1 by rising loss; ties by feature. One row per feature."""
    return losses.withColumn("rank", F.row_number().over(Window.orderBy("loss", "feature")))


def top_features(losses: DataFrame, k: int) -> DataFrame:
    return ranked(losses).where(F.col("rank") <= k)


def bottom_features(losses: DataFrame, k: int) -> DataFrame:
    """The k features of largest loss; ``rank`` counts from the best."""
    return ranked(losses).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("rank") > F.col("__n") - k).drop("__n")  # one row per feature


def select_features(df: DataFrame, losses: DataFrame, k: int, *keep: str) -> DataFrame:
    """``df`` with ``keep`` and the k best features, best first."""
    names = [r["feature"] for r in top_features(losses, k).orderBy("rank").collect()]
    return df.select(*keep, *names)


def rank_pairs(train: DataFrame, valid: DataFrame) -> DataFrame:
    """(feature, train_rank, valid_rank) of two sets of losses."""
    return ranked(train).select("feature", F.col("rank").alias("train_rank")).join(ranked(valid).select("feature", F.col("rank").alias("valid_rank")), "feature")


def top_union(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Features among the k best of either set."""
    return top_features(first, k).select("feature").union(top_features(second, k).select("feature")).distinct()


def gain_by_variable(importance: DataFrame) -> DataFrame:
    """(var, gain): importances of (var, pos, gain) summed over positions."""
    return importance.groupBy("var").agg(F.sum("gain").alias("gain"))


def top_variables(gains: DataFrame, k: int) -> DataFrame:
    """(var, gain, kept): whether a variable is among the k of largest gain. One row per variable."""
    return gains.withColumn("kept", F.row_number().over(Window.orderBy(F.desc("gain"), "var")) <= k)
