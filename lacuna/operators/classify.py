"""Classifiers over feature columns, by Spark ML, with held-out area under the curve."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators.evaluate import auroc
from lacuna.operators.ordering import running_sums
from lacuna.storage import durable

SENTINEL = 0.0


def with_missing_flags(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Gaps become 0 beside a 0/1 flag per column, as trees take no missing values."""
    out = df.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__gap") for c in columns]).fillna(SENTINEL, list(columns))
    return out, [*columns, *[f"{c}__gap" for c in columns]]


def classifier(kind: str, label: str, **how):
    """gbt (two classes), gbt_multi (one against the rest), forest or logistic."""
    if kind == "gbt":
        return GBTClassifier(labelCol=label, featuresCol="__vec", **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, "seed": 0, **how})
    if kind == "gbt_multi":
        return OneVsRest(labelCol=label, featuresCol="__vec", classifier=GBTClassifier(labelCol=label, featuresCol="__vec", **{"maxIter": 500, "maxDepth": 3, "stepSize": 0.2, "seed": 0, **how}))
    if kind == "forest":
        return RandomForestClassifier(labelCol=label, featuresCol="__vec", **{"numTrees": 50, "seed": 0, **how})
    if kind == "logistic":
        return LogisticRegression(labelCol=label, featuresCol="__vec", **{"maxIter": 100, **how})
    raise ValueError(kind)


def fit(df: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", **how) -> PipelineModel:
    """Rows are kept durably first: every round of boosting reads them anew, and must not compute them anew."""
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="__vec"), classifier(kind, label, **how)]).fit(durable(df.select(*features, label)))


def with_scores(model: PipelineModel, df: DataFrame, out: str = "score") -> DataFrame:
    """``df`` with the probability of class 1."""
    return model.transform(df).withColumn(out, F.element_at(vector_to_array("probability"), 2)).drop("__vec", "rawPrediction", "probability", "prediction")


def fit_and_test(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, kind: str = "gbt", **how) -> DataFrame:
    """One row: the area under the curve on ``test``."""
    return auroc(with_scores(fit(train, features, label, kind, **how), test), "score", label)


def gains(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """(feature, gain) of a tree model."""
    v = model.stages[-1].featureImportances
    return spark.createDataFrame([(f, float(v[i])) for i, f in enumerate(features)], "feature string, gain double")


def sweep(train: DataFrame, test: DataFrame, ordered: Sequence[str], label: str, ks: Sequence[int], kind: str = "gbt", **how) -> DataFrame:
    """(k, auroc) of the k best features, for each k; both inputs are cached while it runs."""
    train, test = train.cache(), test.cache()
    rows = [(k, fit_and_test(train, test, ordered[:k], label, kind, **how).first()[0]) for k in ks]
    train.unpersist()
    test.unpersist()
    return train.sparkSession.createDataFrame(rows, "k int, auroc double")


def logistic_sweep(train: DataFrame, test: DataFrame, ordered: Sequence[str], label: str, l2: float = 1e-6, rounds: int = 25) -> DataFrame:
    """(k, auroc) of logistic models of the k best features, for every k from 1 to all.

    All models take their Newton steps together: a round is one pass over the rows, whose gradients and curvatures are summed on the executors; the driver gets one small row and solves a system of k + 1
    unknowns for each model. Features are standardised by the training rows; ``l2`` keeps separable data finite.
    """
    d, names = len(ordered), [*ordered, label]
    one = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(ordered)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(ordered)], F.count(F.lit(1)).alias("n")).first()
    mean = np.array([one[f"m{i}"] or 0.0 for i in range(d)])
    spread = np.array([one[f"s{i}"] or 1.0 for i in range(d)])
    weights = [np.zeros(k + 1) for k in range(1, d + 1)]
    kept = durable(train.select(*[F.col(c).cast("double").alias(c) for c in names]))
    if not one["n"]:
        return train.sparkSession.createDataFrame([], "k int, auroc double")

    def matrix(b: pa.RecordBatch) -> np.ndarray:
        x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ordered], axis=1)
        return np.concatenate((np.ones((len(x), 1)), (np.nan_to_num(x, nan=0.0) - mean) / spread), axis=1)

    def step(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(sum((k + 1) * (k + 2) for k in range(1, d + 1)))
            for b in batches:
                if not b.num_rows:
                    continue
                x, y, parts = matrix(b), b.column(label).to_numpy(zero_copy_only=False), []
                for w in shared.value:
                    xk = x[:, : len(w)]
                    p = 1 / (1 + np.exp(-np.clip(xk @ w, -40, 40)))
                    parts += [xk.T @ (y - p), (xk.T @ (xk * (p * (1 - p))[:, None])).ravel()]
                total += np.concatenate(parts)
            yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total)), pa.int32()), "v": total})

        return run

    for _ in range(rounds):
        shared = train.sparkSession.sparkContext.broadcast(weights)
        sums = kept.mapInArrow(step(shared), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # a bounded number of sums
        v, at, moved = np.array([r["v"] for r in sums]), 0, 0.0
        new = []
        for w in weights:
            k = len(w)
            ridge = l2 * one["n"] * np.concatenate(([0.0], np.ones(k - 1)))
            g, h = v[at : at + k] - ridge * w, v[at + k : at + k + k * k].reshape(k, k) + np.diag(ridge + 1e-9)
            at += k + k * k
            move = np.linalg.lstsq(h, g, rcond=None)[0]
            move *= min(1.0, 5.0 / max(1e-12, np.abs(move).max()))
            moved = max(moved, float(np.abs(move).max()))
            new.append(w + move)
        weights = new
        if moved < 1e-8:
            break
    scaled = [(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(ordered, mean, spread, strict=True)]
    linear = [sum((x * F.lit(float(a)) for x, a in zip(scaled, w[1:], strict=False)), F.lit(float(w[0]))) for w in weights]
    # All areas in one pass: per model the running number of negatives below, ties counting half.
    long = test.select(F.col(label).cast("double").alias("y"), F.posexplode(F.array(*linear)).alias("k", "s"))
    at = long.groupBy("k", "s").agg(F.sum("y").alias("p"), F.sum(1.0 - F.col("y")).alias("n"))
    parts = running_sums(at, [F.col("k"), F.col("s")], {"below": F.col("n")})
    before = at.groupBy("k").agg(F.sum("n").alias("all_n")).withColumn("before", F.coalesce(F.sum("all_n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("all_n")  # one row per model
    area = F.try_divide(F.sum(F.col("p") * (F.col("below") - F.col("before") - F.col("n") / 2)), F.sum("p") * F.sum("n"))
    return parts.join(F.broadcast(before), "k").groupBy("k").agg(area.alias("auroc")).select((F.col("k") + 1).alias("k"), "auroc")


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values by column means."""
    return Imputer(inputCols=list(columns), outputCols=list(columns)).fit(df).transform(df)
