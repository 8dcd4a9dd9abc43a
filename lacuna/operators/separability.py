"""How well single features separate classes: variance ratios, entropies of bins, cross-entropies of cuts, Wasserstein distances."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scalar import equal_width_bin
from lacuna.operators.ordering import running_sums
from lacuna.operators.ranking import unpivoted
from lacuna.storage import durable


def anova_f(df: DataFrame, features: Sequence[str], label: str, textbook: bool = False) -> DataFrame:
    """(feature, f_value) = mean square between classes over mean square within; the latter divides by N, or by N - K in textbook form."""
    long = unpivoted(df.withColumn("__y", F.col(label)), features, "__y")
    per = long.groupBy("feature", "__y").agg(F.count("x").cast("double").alias("n"), F.sum("x").alias("s"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("sse"))
    tot = per.groupBy("feature").agg(F.sum("n").alias("N"), F.count(F.lit(1)).alias("K"), F.sum("sse").alias("sse"), (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("s") * F.sum("s") / F.sum("n")).alias("ssb"))
    within = F.col("sse") / (F.col("N") - F.col("K") if textbook else F.col("N"))
    return tot.select("feature", F.try_divide(F.col("ssb") / (F.col("K") - 1), within).alias("f_value"))


def anova_topk(df: DataFrame, features: Sequence[str], label: str, k: int) -> DataFrame:
    f = anova_f(df, features, label, textbook=True)
    return f.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f_value"), "feature"))).where(F.col("rank") <= k)  # one row per feature


def cross_entropy(df: DataFrame, p_true: Column, classes: int) -> DataFrame:
    """One row: mean of -ln of the probability given to the true class (clipped, + 1e-9), over ln(classes)."""
    p = F.least(F.greatest(p_true, F.lit(1e-12)), F.lit(1.0 - 1e-12)) + F.lit(1e-9)
    return df.agg((F.avg(-F.ln(p)) / F.ln(F.lit(float(classes)))).alias("cross_entropy"))




def weighted_ce(df: DataFrame, value: str, label: str, cuts: DataFrame, classes: int) -> DataFrame:
    """(bound, weighted_ce) for every row of ``cuts`` (a few): class-balanced cross-entropy of the sides < bound and >= bound, weighted by their rows.

    Counting per cut uses one aggregation over rows x cuts; cuts are few by construction.
    """
    totals = df.groupBy(F.col(label).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("t"))
    sides = df.select(F.col(value).alias("x"), F.col(label).alias("c")).crossJoin(F.broadcast(cuts)).groupBy("bound", (F.col("x") >= F.col("bound")).alias("right"), "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
    shares = sides.join(F.broadcast(totals), "c").withColumn("s", F.col("n") / F.col("t"))
    side = Window.partitionBy("bound", "right")
    p = F.least(F.greatest(F.col("s") / F.sum("s").over(side), F.lit(1e-12)), F.lit(1.0 - 1e-12)) + F.lit(1e-9)
    per = shares.withColumn("ce", -F.ln(p) * F.col("n"))
    # Weight of a side x its mean = its sum over all rows.
    return per.groupBy("bound").agg((F.sum("ce") / F.sum("n") / F.ln(F.lit(float(classes)))).alias("weighted_ce"))


def interior_cuts(df: DataFrame, value: str, steps: int = 8) -> DataFrame:
    """(bound): min + i (max - min) / steps for i = 1 .. steps - 2."""
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return lim.select(F.explode(F.sequence(F.lit(1), F.lit(steps - 2))).alias("i"), "lo", "hi").where(F.col("hi") > F.col("lo")).select((F.col("lo") + F.col("i") * ((F.col("hi") - F.col("lo")) / steps)).alias("bound"))


def cut_counts(long: DataFrame, steps: int = 8) -> DataFrame:
    """(feature, lo, hi, bin, c, n) of rows (feature, x, c): ``bin`` counts the interior cuts min + i (max - min) / steps, i = 1 .. steps - 2, at or below x.

    One aggregation for all features and cuts; all that follows works on features x steps x classes rows.
    """
    lim = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    x, lo, width = F.col("x"), F.col("lo"), (F.col("hi") - F.col("lo")) / steps
    at = sum(((x >= lo + i * width).cast("int") for i in range(1, steps - 1)), F.lit(0))
    return long.join(F.broadcast(lim), "feature").groupBy("feature", "lo", "hi", F.when(width > 0, at).otherwise(0).alias("bin"), "c").agg(F.count(F.lit(1)).cast("double").alias("n"))  # one row of limits per feature


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1.0 - 1e-12)) + F.lit(1e-9)


def best_ce_splits(counts: DataFrame, classes: int, steps: int = 8) -> DataFrame:
    """(feature, cut, bound, weighted_ce) from :func:`cut_counts`: the interior cut of least weighted cross-entropy; ties go to the lowest. Constant features have none."""
    sides = counts.where("hi > lo").withColumn("cut", F.explode(F.sequence(F.lit(1), F.lit(steps - 2))))
    sides = sides.groupBy("feature", "lo", "hi", "cut", (F.col("bin") >= F.col("cut")).alias("right"), "c").agg(F.sum("n").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("feature", "cut", "c"))
    sides = sides.withColumn("s", share)
    p = _clipped(F.col("s") / F.sum("s").over(Window.partitionBy("feature", "cut", "right")))
    scored = sides.withColumn("h", -F.ln(p) * F.col("n")).groupBy("feature", "lo", "hi", "cut").agg((F.sum("h") / F.sum("n") / F.ln(F.lit(float(classes)))).alias("weighted_ce"))
    bound = F.col("lo") + F.col("cut") * ((F.col("hi") - F.col("lo")) / steps)
    return scored.groupBy("feature").agg(F.min(F.struct("weighted_ce", "cut", bound.alias("bound"))).alias("b")).select("feature", "b.cut", "b.bound", "b.weighted_ce")


def best_ce_split(df: DataFrame, value: str, label: str, classes: int, steps: int = 8) -> DataFrame:
    """One row: bound and weighted_ce of the best cut of one column."""
    long = df.select(F.lit(value).alias("feature"), F.col(value).alias("x"), F.col(label).alias("c"))
    return best_ce_splits(cut_counts(long, steps), classes, steps).select("bound", "weighted_ce")


def bin_cross_entropy2_all(long: DataFrame, classes: int, steps: int = 8) -> DataFrame:
    """(feature, score) of rows (feature, x, c): cross-entropy of class shares in the two bins of the best cut, each class count over its total + 1e-5, rows normalised with + 1e-5.

    A constant feature has the uniform distribution.
    """
    counts = cut_counts(long, steps)
    best = best_ce_splits(counts, classes, steps).select("feature", "cut")
    sides = counts.join(F.broadcast(best), "feature", "left").groupBy("feature", F.coalesce((F.col("bin") >= F.col("cut")).cast("int"), F.lit(-1)).alias("side"), "c").agg(F.sum("n").alias("n"))
    shares = sides.withColumn("s", F.col("n") / (F.sum("n").over(Window.partitionBy("feature", "c")) + F.lit(1e-5)))
    p = F.when(F.col("side") < 0, F.lit(1.0 / classes)).otherwise(F.col("s") / (F.sum("s").over(Window.partitionBy("feature", "side")) + F.lit(1e-5)))
    return shares.withColumn("h", -F.ln(_clipped(p)) * F.col("n")).groupBy("feature").agg((F.sum("h") / F.sum("n") / F.ln(F.lit(float(classes)))).alias("score"))


def binned(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """``df`` with the equal-width bin of a value, the top edge in the last bin."""
    lim = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return df.crossJoin(F.broadcast(lim)).withColumn(name, equal_width_bin(F.col(value), F.col("__lo"), F.col("__hi"), bins)).drop("__lo", "__hi")


def dominant_bins(df: DataFrame, value: str, label: str, bins: int) -> DataFrame:
    """(bin, dominant): the class with the largest share of its own rows in each bin; ties, and empty bins, go to the lowest class."""
    counts = binned(df.select(value, label), value, bins).groupBy("bin", label).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(label).agg(F.sum("n").alias("t"))
    best = counts.join(F.broadcast(totals), label).groupBy("bin").agg(F.max(F.struct((F.col("n") / F.col("t")).alias("s"), (-F.col(label)).alias("c"))).alias("b"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    lowest = F.lit(0)
    return every.join(best, "bin", "left").select("bin", F.coalesce((-F.col("b.c")).cast("int"), lowest).alias("dominant"))


def bin_cross_entropy(df: DataFrame, value: str, label: str, classes: int, bins: int, class_weight: Sequence[float] | None = None) -> DataFrame:
    """One row: with p_c the share of bins that class c dominates, the mean over classes of (rows of c / N) x -log10(p_c + 1e-5) / log10(classes)."""
    dom = dominant_bins(df, value, label, bins).groupBy(F.col("dominant").alias("c")).agg((F.count(F.lit(1)) / F.lit(float(bins))).alias("p"))
    per = df.groupBy(F.col(label).cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    weight = F.lit(1.0) if class_weight is None else F.element_at(F.array(*[F.lit(float(w)) for w in class_weight]), F.col("c") + 1) * F.lit(float(classes))
    joined = per.join(dom, "c", "left").withColumn("h", F.col("n") * weight * (-F.log10(F.coalesce("p", F.lit(0.0)) + F.lit(1e-5)) / F.log10(F.lit(float(classes)))))
    return joined.agg((F.sum("h") / F.sum("n") / F.lit(float(classes))).alias("bin_ce"))


def bin_cross_entropy2(df: DataFrame, value: str, label: str, classes: int, steps: int = 8) -> DataFrame:
    """One row: :func:`bin_cross_entropy2_all` of one column."""
    long = df.select(F.lit(value).alias("feature"), F.col(value).alias("x"), F.col(label).alias("c"))
    return bin_cross_entropy2_all(long, classes, steps).select(F.col("score").alias("bin_ce2"))


def wasserstein(df: DataFrame, value: str, group: Column) -> DataFrame:
    """One row: the area between the distribution functions of the rows where ``group`` is true and where it is false."""
    at = df.select(F.col(value).cast("double").alias("x"), group.alias("g")).groupBy("x").agg(F.sum(F.col("g").cast("double")).alias("a"), F.sum((~F.col("g")).cast("double")).alias("b"))
    run = running_sums(at, [F.col("x")], {"fa": F.col("a"), "fb": F.col("b")})
    tot = run.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    # The next distinct value: one more ordered pass over distinct values, by the running index.
    step = running_sums(run, [F.col("x")], {"i": F.lit(1).cast("long")})
    nxt = step.select((F.col("i") - 1).alias("i"), F.col("x").alias("x2"))
    gaps = step.join(nxt, "i").crossJoin(F.broadcast(tot))  # one row of totals
    return gaps.agg(F.sum(F.abs(F.col("fa") / F.col("ta") - F.col("fb") / F.col("tb")) * (F.col("x2") - F.col("x"))).alias("distance"))


def wasserstein_multi(df: DataFrame, value: str, label: str, classes: Sequence) -> DataFrame:
    """One row: the mean distance over all pairs of classes.

    One ordered pass carries a running count for every class; a pair's distance is the sum over steps of |F_a - F_b| x gap, so no pair is scanned apart.
    """
    one = [F.sum((F.col("c") == F.lit(c)).cast("double")).alias(f"n{i}") for i, c in enumerate(classes)]
    at = df.select(F.col(value).cast("double").alias("x"), F.col(label).alias("c")).groupBy("x").agg(*one)
    run = running_sums(at, [F.col("x")], {**{f"f{i}": F.col(f"n{i}") for i in range(len(classes))}, "i": F.lit(1).cast("long")})
    tot = run.agg(*[F.sum(f"n{i}").alias(f"t{i}") for i in range(len(classes))])
    nxt = run.select((F.col("i") - 1).alias("i"), F.col("x").alias("x2"))
    f = [F.col(f"f{i}") / F.col(f"t{i}") for i in range(len(classes))]
    pairs = [(i, j) for i in range(len(classes)) for j in range(i + 1, len(classes))]
    area = sum((F.abs(f[i] - f[j]) for i, j in pairs), F.lit(0.0)) * (F.col("x2") - F.col("x")) / F.lit(float(len(pairs)))
    return run.join(nxt, "i").crossJoin(F.broadcast(tot)).agg(F.sum(area).alias("distance"))


def lloyd_1d(x: np.ndarray, k: int, rounds: int = 50) -> np.ndarray:
    """Sorted centroids of one-dimensional k-means from evenly spaced starts; empty ones stay where they are."""
    c = np.linspace(x.min(), x.max(), k)
    for _ in range(rounds):
        edge = (c[1:] + c[:-1]) / 2
        at = np.searchsorted(edge, x, side="right")
        n, s = np.bincount(at, minlength=k), np.bincount(at, weights=x, minlength=k)
        new = np.sort(np.where(n > 0, s / np.maximum(n, 1), c))
        if np.allclose(new, c, rtol=0, atol=1e-12):
            break
        c = new
    return c


def _histogram(long: DataFrame) -> DataFrame:
    """(feature, x, c, n) of rows (feature, x, c): distinct values counted once and kept."""
    return durable(long.where(F.col("x").isNotNull()).groupBy("feature", F.col("x").cast("double").alias("x"), "c").agg(F.count(F.lit(1)).cast("double").alias("n")))


def _quantisers(counted: DataFrame, bins: int, rounds: int) -> dict[str, np.ndarray]:
    """Lloyd-Max centroids of every feature of a histogram. A round is one aggregation for all features that still move; only centroids reach the driver. Constant features have none."""
    lim = counted.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).collect()  # one row per feature
    span = {r["feature"]: r["hi"] - r["lo"] for r in lim if r["lo"] < r["hi"]}
    c = {r["feature"]: np.linspace(r["lo"], r["hi"], bins) for r in lim if r["feature"] in span}
    moving = set(c)
    for _ in range(rounds):
        if not moving:
            break
        edges = F.create_map(*[x for f in sorted(moving) for x in (F.lit(f), F.array(*[F.lit(float(e)) for e in (c[f][1:] + c[f][:-1]) / 2]))])
        here = counted.where(F.col("feature").isin(sorted(moving)))
        b = F.size(F.filter(F.element_at(edges, F.col("feature")), lambda e: F.col("x") >= e))
        got: dict[str, dict[int, float]] = {}
        for r in here.groupBy("feature", b.alias("b")).agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m")).collect():  # features x bins rows
            got.setdefault(r["feature"], {})[r["b"]] = r["m"]
        for f in sorted(moving):
            new = np.sort(np.array([got[f].get(i, c[f][i]) for i in range(bins)]))
            if np.abs(new - c[f]).max() < 1e-9 * max(1.0, span[f]):
                moving.discard(f)
            else:
                c[f] = new
    return c


def lloyd_max(df: DataFrame, value: str, bins: int, rounds: int = 20) -> list[float]:
    """Boundaries of the Lloyd-Max quantiser of a column: midpoints of its sorted centroids, with infinite ends."""
    c = _quantisers(_histogram(df.select(F.lit(value).alias("feature"), F.col(value).alias("x"), F.lit(0).alias("c"))), bins, rounds).get(value)
    return [float("-inf"), float("inf")] if c is None else [float("-inf"), *((c[1:] + c[:-1]) / 2).tolist(), float("inf")]


def kmeans_bin_entropy_all(long: DataFrame, classes: int, bins: int, rounds: int = 20) -> DataFrame:
    """(feature, entropy, cross_entropy) of rows (feature, x, c): class shares in the bins of each feature's Lloyd-Max quantiser, weighted by rows. 0 if pure, -1 with fewer rows than bins."""
    counted = _histogram(long)
    c = _quantisers(counted, bins, rounds)
    edges = F.create_map(F.lit(""), F.array().cast("array<double>"), *[x for f, m in sorted(c.items()) for x in (F.lit(f), F.array(*[F.lit(float(e)) for e in (m[1:] + m[:-1]) / 2]))])
    b = F.size(F.filter(F.coalesce(F.element_at(edges, F.col("feature")), F.array().cast("array<double>")), lambda e: F.col("x") >= e))
    counts = counted.groupBy("feature", b.alias("bin"), "c").agg(F.sum("n").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("feature", "bin"))
    h = counts.withColumn("h", -F.col("n") * F.ln(p))
    value = F.sum("h") / F.sum("n") / F.ln(F.lit(float(classes)))
    few = F.sum("n") < bins
    return h.groupBy("feature").agg(F.when(few, -1.0).when(F.countDistinct("c") <= 1, 0.0).otherwise(value).alias("entropy"), F.when(few, -1.0).otherwise(value).alias("cross_entropy"))


def kmeans_bin_entropy(df: DataFrame, value: str, label: str, classes: int, bins: int) -> DataFrame:
    """One row: :func:`kmeans_bin_entropy_all` of one column."""
    return kmeans_bin_entropy_all(df.select(F.lit(value).alias("feature"), F.col(value).alias("x"), F.col(label).alias("c")), classes, bins).drop("feature")


def bin_cross_entropy_all(long: DataFrame, classes: int, bins: int) -> DataFrame:
    """(feature, score) of rows (feature, x, c): :func:`bin_cross_entropy` of every feature in one pass."""
    rows = long.where(F.col("x").isNotNull())
    lim = rows.groupBy("feature").agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))  # one row per feature
    counts = rows.join(F.broadcast(lim), "feature").groupBy("feature", F.when(F.col("__lo") < F.col("__hi"), equal_width_bin(F.col("x"), F.col("__lo"), F.col("__hi"), bins)).otherwise(0).alias("bin"), F.col("c").cast("int").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    shares = counts.withColumn("t", F.sum("n").over(Window.partitionBy("feature", "c")))
    best = shares.groupBy("feature", "bin").agg(F.max(F.struct((F.col("n") / F.col("t")).alias("s"), (-F.col("c")).alias("c"))).alias("b"))
    won = best.groupBy("feature", (-F.col("b.c")).alias("c")).agg(F.count(F.lit(1)).alias("won"))
    # Bins without rows go to class 0.
    empty = best.groupBy("feature").agg((F.lit(bins) - F.count(F.lit(1))).alias("empty"))
    per = counts.groupBy("feature", "c").agg(F.sum("n").alias("n")).join(won, ["feature", "c"], "left").join(empty, "feature")
    p = (F.coalesce("won", F.lit(0)) + F.when(F.col("c") == 0, F.col("empty")).otherwise(0)) / F.lit(float(bins))
    h = per.withColumn("h", F.col("n") * (-F.log10(p + F.lit(1e-5)) / F.log10(F.lit(float(classes)))))
    return h.groupBy("feature").agg((F.sum("h") / F.sum("n") / F.lit(float(classes))).alias("score"))


def all_feature_scores(df: DataFrame, features: Sequence[str], label: str, classes: int, bins: int, mode: str = "bin2") -> DataFrame:
    """(feature, score) of every feature, in passes over all of them: modes ``bin``, ``bin2`` and ``kmeans``."""
    long = unpivoted(df.withColumn("c", F.col(label)), features, "c")
    if mode == "bin2":
        return bin_cross_entropy2_all(long, classes)
    if mode == "bin":
        return bin_cross_entropy_all(long, classes, bins)
    if mode == "kmeans":
        return kmeans_bin_entropy_all(long, classes, bins).select("feature", F.col("cross_entropy").alias("score"))
    raise ValueError(mode)
