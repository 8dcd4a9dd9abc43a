"""Model evaluation: areas, accuracies, confusing class pairs, ensembles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions.arrays import argsort_desc
from lacuna.operators.ordering import running_sums


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: the share of (positive, negative) pairs in the right order, ties counting half. Distinct scores are counted first; their running sums are distributed."""
    at = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).groupBy("s").agg(F.sum("y").alias("p"), F.sum(1.0 - F.col("y")).alias("n"))
    run = running_sums(at, [F.col("s")], {"below": F.col("n")})
    return run.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") - F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auroc"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, fpr, tpr): the curve's point for each distinct score as the lowest that counts as positive."""
    at = df.select(F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("y")).groupBy("score").agg(F.sum("y").alias("p"), F.sum(1.0 - F.col("y")).alias("n"))
    run = running_sums(at, [-F.col("score")], {"tp": F.col("p"), "fp": F.col("n")})
    total = run.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))  # one row
    return run.crossJoin(F.broadcast(total)).select("score", F.try_divide("fp", "all_n").alias("fpr"), F.try_divide("tp", "all_p").alias("tpr"))


def topk_accuracy(df: DataFrame, prob: Column, label: Column, k: int) -> DataFrame:
    """One row: the share of rows whose class is among the k likeliest."""
    hit = F.array_contains(F.slice(argsort_desc(prob), 1, k), label.cast("int"))
    return df.agg(F.avg(hit.cast("double")).alias("accuracy"))


def top_pair_counts(df: DataFrame, prob: Column, classes: int) -> DataFrame:
    """(a, b, n), a < b: rows whose likeliest class is a and second b, pairs without rows included."""
    order = argsort_desc(prob)
    got = df.select(F.element_at(order, 1).alias("a"), F.element_at(order, 2).alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("a"), (F.col("id") % classes).cast("int").alias("b")).where("a < b")
    return every.join(got, ["a", "b"], "left").fillna(0, ["n"])


def class_group(df: DataFrame, label: str, group: Sequence[int], prob: Column | None = None, name: str = "group_label") -> DataFrame:
    """Rows of the listed classes, renumbered from 0; with ``prob`` only those whose likeliest classes are the list, in its order."""
    kept = df.where(F.col(label).isin(list(group)))
    if prob is not None:
        kept = kept.where(F.slice(argsort_desc(prob), 1, len(group)) == F.array(*[F.lit(g) for g in group]))
    code = F.coalesce(*[F.when(F.col(label) == g, F.lit(i)) for i, g in enumerate(group)])
    return kept.withColumn(name, code)


def prob_ensemble(models: DataFrame, *key: str, prob: str = "p") -> DataFrame:
    """Mean probability over models of each (key)."""
    return models.groupBy(*key).agg(F.avg(prob).alias("p"))
