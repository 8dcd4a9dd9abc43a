"""Model-based imputers: cubic spline, cluster means of confident patches, boosted trees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators.joins import clamped_patch_join, cluster_temporal_mean
from lacuna.operators.ordering import equal_bins
from lacuna.operators.series import impute_ffill, sliding_patches, window_confidence, with_var_mean
from lacuna.operators.subspace import fit_saab, transform
from lacuna.storage import durable


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The not-a-knot cubic spline through (x, y), extended beyond its ends; two points give a line, three a parabola."""
    n = len(x)
    if n == 2:
        return y[0] + (y[1] - y[0]) * (at - x[0]) / (x[1] - x[0])
    if n == 3:
        return np.polyval(np.polyfit(x - x[0], y, 2), at - x[0])
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    # Unknown second derivatives; inner rows are smoothness, outer rows say that the third derivative does not jump at the second and the last but one knot.
    a, r = np.zeros((n, n)), np.zeros(n)
    i = np.arange(1, n - 1)
    a[i, i - 1], a[i, i], a[i, i + 1], r[i] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:], 6 * np.diff(d)
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    t, hk = at - x[k], h[k]
    slope = d[k] - hk * (2 * m[k] + m[k + 1]) / 6
    return y[k] + t * (slope + t * (m[k] / 2 + t * (m[k + 1] - m[k]) / (6 * hk)))


def spline_series(t: np.ndarray, v: np.ndarray, mean: float) -> np.ndarray:
    """One series with its gaps filled: observed cells stay; repeated times fall back to straight lines; one value is held; none gives the mean."""
    seen = ~np.isnan(v)
    x, y = t[seen], v[seen]
    if not len(x):
        return np.full(len(v), mean)
    if len(x) == 1:
        return np.where(seen, v, y[0])
    gaps = t[~seen]
    out = v.copy()
    if (np.diff(x) > 0).all():
        out[~seen] = not_a_knot(x, y, gaps)
    else:
        x, at = np.unique(x, return_index=True)
        y = y[at]
        if len(x) == 1:
            out[~seen] = y[0]
        else:
            k = np.clip(np.searchsorted(x, gaps, side="right") - 1, 0, len(x) - 2)
            out[~seen] = y[k] + (y[k + 1] - y[k]) * (gaps - x[k]) / (x[k + 1] - x[k])
    return out


def impute_spline(df: DataFrame, means: DataFrame | None = None) -> DataFrame:
    """``imputed`` by a spline per (episode, variable).

    Rows are dealt out and sorted by (episode, variable) and streamed in Arrow batches: a task holds one series at a time, not an episode with all its variables.
    """
    df = df.drop("imputed")
    base = with_var_mean(df, means).select(*df.columns, F.coalesce("__mean", F.lit(0.0)).alias("__mean"))
    schema = T.StructType(df.schema.fields[:]).add("imputed", "double")
    names = df.columns

    def done(rows: pa.Table) -> pa.Table:
        """Whole series, sorted, with their values."""
        e, var = rows.column("episode_id").to_pandas().to_numpy(), rows.column("var").to_pandas().to_numpy()
        t, v, mean = (rows.column(c).cast(pa.float64()).to_pandas().to_numpy(float) for c in ("t", "v", "__mean"))
        starts = np.flatnonzero(np.concatenate(([True], (e[1:] != e[:-1]) | (var[1:] != var[:-1]))))
        out = np.concatenate([spline_series(t[a:b], v[a:b], float(mean[a])) for a, b in zip(starts, [*starts[1:], len(t)], strict=True)])
        return rows.select(names).append_column("imputed", pa.array(out, pa.float64()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows = pa.Table.from_batches(held)
            last = (rows.column("episode_id")[-1], rows.column("var")[-1])
            if (rows.column("episode_id")[0], rows.column("var")[0]) == last:
                continue
            e, var = rows.column("episode_id").to_pandas().to_numpy(), rows.column("var").to_pandas().to_numpy()
            end = int(np.flatnonzero((e != e[-1]) | (var != var[-1]))[-1]) + 1  # the last series may go on
            yield from done(rows.slice(0, end)).to_batches()
            held = rows.slice(end).combine_chunks().to_batches()
        if held:
            yield from done(pa.Table.from_batches(held)).to_batches()

    return base.repartition("episode_id", "var").sortWithinPartitions("episode_id", "var", "t", "seq").mapInArrow(fill, schema)


def impute_kmeans(df: DataFrame, half: int = 3, bins: int = 4, kernels: int = 16, clusters: int = 16, seed: int = 0, means: DataFrame | None = None) -> DataFrame:
    """``imputed`` = conf x spline + (1 - conf) x the mean of the cluster of the nearest patch; short series keep the spline.

    Spline and confidence are computed once and kept. Patches of all series are ordered by falling confidence and cut into bins of equal size; each bin gets its
    own subspace and clusters.
    """
    filled = durable(window_confidence(impute_spline(df, means), half))
    w = Window.partitionBy("episode_id", "var").orderBy("t", "seq")
    rows = filled.withColumn("idx", F.row_number().over(w) - 1).withColumn("len", F.count(F.lit(1)).over(Window.partitionBy("episode_id", "var")))
    cut = sliding_patches(filled, half, value="imputed").join(rows.select("episode_id", "var", "idx", "conf"), ["episode_id", "var", "idx"])
    cut = durable(equal_bins(cut, [-F.col("conf"), F.col("episode_id"), F.col("var"), F.col("idx")], bins))
    named = None
    for b in range(bins):  # a few bins, each a small fit
        part = cut.where(F.col("bin_id") == b)
        n = part.count()
        if not n:
            continue
        columns = ("episode_id", "var", "idx", "bin_id", "cluster_id", "patch")
        if min(clusters, n) < 2:  # a single cluster needs no search
            got = part.withColumn("cluster_id", F.lit(0)).select(*columns)
            named = got if named is None else named.unionByName(got)
            continue
        model = fit_saab(part, "patch", min(kernels, 2 * half + 1))
        reduced = transform(part, model, "patch", "__f").withColumn("__vec", array_to_vector("__f"))
        got = KMeans(k=min(clusters, n), seed=seed, featuresCol="__vec", predictionCol="cluster_id").fit(reduced).transform(reduced).select(*columns)
        named = got if named is None else named.unionByName(got)
    if named is None:
        return filled.select(*df.columns, "imputed")
    named = durable(named)
    centre = cluster_temporal_mean(named).withColumnRenamed("mean", "__cluster")
    near = clamped_patch_join(rows.where(F.col("len") > 2 * half), named.drop("patch"), half, ("episode_id", "var")).join(F.broadcast(centre), ["bin_id", "cluster_id"])  # bins x clusters rows
    blend = F.col("conf") * F.col("imputed") + (1 - F.col("conf")) * F.col("__cluster")
    long = near.select(*df.columns, blend.alias("imputed"))
    short = rows.where(F.col("len") <= 2 * half).select(*df.columns, "imputed")
    return long.unionByName(short)


def impute_trees(df: DataFrame, variables: Sequence[str], half: int = 3, trees: int = 100, depth: int = 3, seed: int = 0, means: DataFrame | None = None) -> DataFrame:
    """``imputed`` by a boosted regression per variable on the window of all variables with its own centre hidden; ends are filled forward.

    Trees take no missing values: gaps become 0 beside a flag. Predictions never feed later ones.
    """
    wide = df.groupBy("episode_id", "t").pivot("var", list(variables)).agg(F.avg("v"))
    w = Window.partitionBy("episode_id").orderBy("t")
    names = []
    lagged = wide
    for i, v in enumerate(variables):
        for o in range(-half, half + 1):
            shifted = F.lag(f"`{v}`", -o).over(w)
            lagged = lagged.withColumn(f"x{i}_{o + half}", F.coalesce(shifted, F.lit(0.0))).withColumn(f"m{i}_{o + half}", shifted.isNull().cast("double"))
            names += [(i, f"x{i}_{o + half}", o), (i, f"m{i}_{o + half}", o)]
    inner = (F.row_number().over(w) > half) & (F.row_number().over(Window.partitionBy("episode_id").orderBy(F.desc("t"))) > half)
    lagged = durable(lagged.withColumn("__inner", inner))
    out = None
    for i, v in enumerate(variables):
        features = [n for j, n, o in names if not (j == i and o == 0)]
        table = VectorAssembler(inputCols=features, outputCol="__vec").transform(lagged.withColumn("__y", F.col(f"`{v}`")))
        known = table.where(F.col("__y").isNotNull() & F.col("__inner"))
        if known.isEmpty():
            got = lagged.select("episode_id", "t", F.lit(v).alias("var"), F.lit(None).cast("double").alias("__p"))
        else:
            model = GBTRegressor(labelCol="__y", featuresCol="__vec", predictionCol="__p", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(known)
            got = model.transform(table.where(F.col("__inner"))).select("episode_id", "t", F.lit(v).alias("var"), "__p")
        out = got if out is None else out.unionByName(got)
    base = impute_ffill(df, means)
    return base.join(out, ["episode_id", "t", "var"], "left").withColumn("imputed", F.coalesce("v", "__p", "imputed")).drop("__p")


def impute(df: DataFrame, strategy: str, **how) -> DataFrame:
    """Dispatch by name: zero, mean, forward, forward_zero, linear, linear_zero, spline, kmeans, trees."""
    from lacuna.operators import series as S

    known = {"zero": S.impute_zero, "mean": S.impute_mean, "forward": S.impute_ffill, "forward_zero": S.impute_ffill_zero, "linear": S.impute_linear_extrap, "linear_zero": S.impute_linear, "spline": impute_spline, "kmeans": impute_kmeans, "trees": impute_trees}
    if strategy not in known:
        raise ValueError(f"strategy {strategy}; known: {', '.join(known)}")
    return known[strategy](df, **how)
