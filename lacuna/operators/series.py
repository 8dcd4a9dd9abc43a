"""Time-series operators per (episode, variable): masks, intervals, imputation, windows, padding.

All of them use one window specification, so chained operators share one exchange and one sort. Ties in time are ordered by ``seq``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ("episode_id", "var")
ORDER = ("t", "seq")


def series_window(key: Sequence[str] = KEY, order: Sequence[str] = ORDER):
    return Window.partitionBy(*key).orderBy(*order)


def pivot_mean(obs: DataFrame, variables: Sequence[str], key: Sequence[str] = ("episode_id", "t"), var: str = "var", value: str = "v") -> DataFrame:
    """One row per (episode, time), one column per listed variable: means of duplicates, NULL where nothing was observed; other variables are dropped."""
    return obs.groupBy(*key).pivot(var, list(variables)).agg(F.avg(value))


def dense_grid(obs: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(episode_id, seq, t, var, v) with a row for every listed variable at every time of an episode.

    Pivot and unpivot: one aggregation, no join of times with variables.
    """
    wide = pivot_mean(obs, variables)
    long = wide.unpivot(["episode_id", "t"], [f"`{v}`" for v in variables], "var", "v")
    return long.select("episode_id", F.lit(0).cast("long").alias("seq"), "t", "var", "v")


def with_mask(df: DataFrame, inverted: bool = False) -> DataFrame:
    """``mask``: observed. ``inverted`` gives the opposite flag, as one of the source formats stores it."""
    m = F.col("v").isNull() if inverted else F.col("v").isNotNull()
    return df.withColumn("mask", m)


def obs_interval(df: DataFrame) -> DataFrame:
    """``interval``: time since the last observation strictly before; since 0 without any."""
    w = series_window().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("v").isNotNull(), F.col("t")), ignorenulls=True).over(w)
    return df.withColumn("interval", F.col("t") - F.coalesce(last, F.lit(0.0)))


def obs_diff(df: DataFrame) -> DataFrame:
    """Observed rows with ``diff``, the change since the previous observation."""
    return df.where(F.col("v").isNotNull()).withColumn("diff", F.col("v") - F.lag("v").over(series_window()))


def with_var_mean(df: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Adds ``__mean`` per variable; from ``means`` (var, mean) of a training split, or from ``df`` itself. One row per variable is broadcast."""
    means = df.groupBy("var").agg(F.avg("v").alias("mean")) if means is None else means
    return df.join(F.broadcast(means.select("var", F.col("mean").alias("__mean"))), "var", "left")


def impute_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("imputed", F.coalesce("v", F.lit(0.0)))


def impute_mean(df: DataFrame, means: DataFrame | None = None) -> DataFrame:
    return with_var_mean(df, means).withColumn("imputed", F.coalesce("v", "__mean", F.lit(0.0))).drop("__mean")


def _forward(c: Column | str = "v") -> Column:
    return F.last(c, ignorenulls=True).over(series_window().rowsBetween(Window.unboundedPreceding, 0))


def impute_ffill(df: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """The last observation; the variable's mean before the first."""
    return with_var_mean(df, means).withColumn("imputed", F.coalesce(_forward(), F.col("__mean"), F.lit(0.0))).drop("__mean")


def impute_ffill_zero(df: DataFrame) -> DataFrame:
    return df.withColumn("imputed", F.coalesce(_forward(), F.lit(0.0)))


def _around(df: DataFrame) -> DataFrame:
    """``__p`` and ``__n``: the observations at or before and at or after each row, each with the one beyond it."""
    w = series_window()
    seen = F.when(F.col("v").isNotNull(), F.struct("t", "v"))
    back = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.first(seen, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = df.withColumn("__b", back).withColumn("__a", ahead)
    own = F.when(F.col("v").isNotNull(), F.struct("t", "v", F.col("__b").alias("o")))
    own_n = F.when(F.col("v").isNotNull(), F.struct("t", "v", F.col("__a").alias("o")))
    p = F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = F.first(own_n, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("__p", p).withColumn("__n", n).drop("__b", "__a")


def _line(a: Column, b: Column) -> Column:
    """The line through two observations at t; NULL if one is missing or both have the same time."""
    return a["v"] + F.try_divide((b["v"] - a["v"]) * (F.col("t") - a["t"]), b["t"] - a["t"])


def impute_linear(df: DataFrame) -> DataFrame:
    """Linear between observations, 0 before the first, the last value after the last, 0 without any."""
    p, n = F.col("__p"), F.col("__n")
    inner = F.when(p.isNotNull() & n.isNotNull(), F.coalesce(_line(p, n), p["v"]))
    return _around(df).withColumn("imputed", F.coalesce("v", inner, p["v"], F.lit(0.0))).drop("__p", "__n")


def impute_linear_extrap(df: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """Linear between observations and along the outer two beyond them; one observation is held, none gives the variable's mean."""
    p, n = F.col("__p"), F.col("__n")
    value = (
        F.when(p.isNotNull() & n.isNotNull(), F.coalesce(_line(p, n), p["v"]))
        .when(n.isNotNull(), F.coalesce(_line(n, n["o"]), n["v"]))
        .when(p.isNotNull(), F.coalesce(_line(p["o"], p), p["v"]))
        .otherwise(F.coalesce("__mean", F.lit(0.0)))
    )
    return with_var_mean(_around(df), means).withColumn("imputed", F.coalesce("v", value)).drop("__p", "__n", "__mean")


def window_confidence(df: DataFrame, half: int) -> DataFrame:
    """``conf``: 1 where observed, else the share of observed cells over all variables in the rows i-half .. i+half of the episode, cut at its ends."""
    # Times of an episode are numbered, so that a range of numbers spans whole rows of the grid: one exchange by episode serves all windows.
    episode = Window.partitionBy("episode_id").orderBy("t")
    rows = df.withColumn("__row", F.dense_rank().over(episode))
    w = Window.partitionBy("episode_id").orderBy("__row").rangeBetween(-half, half)
    share = F.count("v").over(w) / F.count(F.lit(1)).over(w)
    return rows.withColumn("conf", F.when(F.col("v").isNotNull(), 1.0).otherwise(share)).drop("__row")


def sliding_patches(df: DataFrame, half: int, stride: int = 1, value: str = "v") -> DataFrame:
    """(episode_id, var, idx, patch): windows of 2 half + 1 rows around centres half, half + stride, ... of each series."""
    w = series_window()
    rows = df.select("episode_id", "var", (F.row_number().over(w) - 1).alias("idx"), F.count(F.lit(1)).over(Window.partitionBy(*KEY)).alias("__len"), F.collect_list(value).over(w.rowsBetween(-half, half)).alias("patch"))
    return rows.where((F.col("idx") >= half) & (F.col("idx") < F.col("__len") - half) & ((F.col("idx") - half) % stride == 0)).drop("__len")


def row_positions(df: DataFrame, length: int | None = None) -> DataFrame:
    """``pos``: the place of each row after padding on the left to the longest episode (or ``length``)."""
    w = series_window()
    sized = df.withColumn("__len", F.count(F.lit(1)).over(Window.partitionBy(*KEY))).withColumn("__rn", F.row_number().over(w))
    if length is None:
        sized = sized.crossJoin(F.broadcast(sized.agg(F.max("__len").alias("__max"))))  # one row
    else:
        sized = sized.withColumn("__max", F.lit(length))
    return sized.withColumn("pos", (F.col("__max") - F.col("__len") + F.col("__rn") - 1).cast("int")).drop("__len", "__rn", "__max")


def padded_series(df: DataFrame, length: int | None = None, side: str = "left", fill: float | None = None, value: str = "v") -> DataFrame:
    """(episode_id, var, series): arrays of one length, that of the longest series; the side is filled.

    With ``length``, arrays of this length: longer series are cut to their last (left) or first (right) values.
    """
    items = F.transform(F.array_sort(F.collect_list(F.struct(*ORDER, F.col(value).alias("x")))), lambda s: s["x"])
    got = df.groupBy(*KEY).agg(items.alias("a"))
    if length is None:
        most = df.groupBy(*KEY).agg(F.count(F.lit(1)).alias("__len")).agg(F.max("__len").cast("int").alias("__most"))
        got = got.crossJoin(F.broadcast(most))  # one row
        kept, size = F.col("a"), F.col("__most")
    else:
        kept, size = F.when(F.size("a") <= length, F.col("a")).otherwise(F.slice("a", -length if side == "left" else 1, length)), F.lit(length)
    gap = F.array_repeat(F.lit(fill).cast("double"), F.greatest(size - F.size("a"), F.lit(0)))
    return got.select(*KEY, (F.concat(gap, kept) if side == "left" else F.concat(kept, gap)).alias("series"))


def input_blocks(df: DataFrame, blocks: Sequence[str] = ("value", "mask", "interval")) -> DataFrame:
    """(episode_id, var, t, seq) with the chosen blocks of a model's input: values (gaps as 0), masks, intervals."""
    made = {"value": F.coalesce("v", F.lit(0.0)), "mask": F.col("v").isNotNull(), "interval": F.col("interval")}
    base = obs_interval(df) if "interval" in blocks else df
    return base.select("episode_id", "var", "t", "seq", *[made[b].alias(b) for b in blocks])


def last_rows(df: DataFrame, *values: str, key: str = "episode_id", first: bool = False) -> DataFrame:
    """The values of each episode's last (or first) row in the order of (t, seq)."""
    pick = F.min_by if first else F.max_by
    return df.groupBy(key).agg(*[pick(v, F.struct(*ORDER)).alias(v) for v in values])


def interpolate_by_row(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Linear by row number over ``order`` within each group of ``episode_id``, ends held. All columns share one exchange and one sort."""
    w = Window.partitionBy("episode_id").orderBy(order)
    numbered = df.withColumn("__row", F.row_number().over(w).cast("double"))

    def filled(c: str) -> Column:
        seen = F.when(F.col(c).isNotNull(), F.struct(F.col("__row").alias("t"), F.col(c).cast("double").alias("v")))
        p = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        n = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
        line = p["v"] + F.try_divide((n["v"] - p["v"]) * (F.col("__row") - p["t"]), n["t"] - p["t"])
        return F.coalesce(F.col(c), line, p["v"], n["v"])

    return numbered.select(*[filled(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def plot_frame(df: DataFrame, value: str = "imputed") -> DataFrame:
    """(episode_id, var, t, value, observed): what a plot of filled series with their observations marked needs."""
    return df.select("episode_id", "var", "t", F.col(value).alias("value"), F.col("v").isNotNull().alias("observed"))
