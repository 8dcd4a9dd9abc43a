"""Incremental forms of the per-row operators, for series that keep arriving.

Episodes are bounded files in the batch world; here an unbounded stream of observations is summed per variable and time window with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_var_stats(stream: DataFrame, ts: str = "ts", length: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Observed cells, mean and population deviation per variable and window; rows later than ``lateness`` are dropped."""
    timed = stream.withWatermark(ts, lateness)
    return timed.groupBy(F.window(ts, length), "var").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).select(F.col("window.start").alias("start"), "var", "n", "mean", "std")
