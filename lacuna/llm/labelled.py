"""Labelled rows for the classifiers: a bounded, reproducible sample of each class, and their features on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import arrow_map, cut, held_out

#: Least gain of a feature that is used: half the likelihood ratio statistic of its presence against the class (4: less than one in 200 features that tell nothing).
LEAST_GAIN = 4.0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled documents of each class outside the held-out fold.

    Ids are taken in the order of their hash. An id with several labels has the largest; null ids and labels other than 0 and 1 are left out. The ids,
    2 x ``per_class`` at most, are broadcast, so the documents are read once and not shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("__id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("__id")))
    known = known.groupBy("__id").agg(F.max("y").alias("y"))
    picked = [known.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    some = picked[0].unionByName(picked[1])
    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(some), "__id").withColumnRenamed("__id", "doc_id")


def gain(n1: Column, n: Column, t1: Column, t: Column) -> Column:
    """Half the likelihood ratio statistic, smoothed, of a feature that ``n`` of ``t`` documents have, ``n1`` of the ``t1`` of class 1 among them."""
    n0, t0 = n - n1, t - t1
    p1, p0, p = (n1 + 0.5) / (t1 + 1), (n0 + 0.5) / (t0 + 1), (n + 1) / (t + 2)
    return t1 * (p1 * F.ln(p1 / p) + (1 - p1) * F.ln((1 - p1) / (1 - p))) + t0 * (p0 * F.ln(p0 / p) + (1 - p0) * F.ln((1 - p0) / (1 - p)))


def selected_features(sample: DataFrame, features: Callable[[str], np.ndarray], least_docs: int, least_gain: float = LEAST_GAIN, always: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(y, starts, features, names): ``names`` are the 64-bit features of at least ``least_docs`` sampled documents and ``least_gain``; ``features`` are those of each document among them and ``always``, sorted.

    Whole texts count, one document per id (the smallest, if texts differ). Features are counted by class and chosen on the executors; the driver gets what is chosen.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t or "") for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "y", "f"])

    rows = arrow_map(sample.select("doc_id", "y", "text"), run, "doc_id long, y int, f array<long>")
    once = cut(rows.groupBy("doc_id").agg(F.min(F.struct("y", "f")).alias("r")).select("doc_id", "r.y", "r.f"))
    t, t1 = once.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    counts = once.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("n1"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_docs)
    names = np.sort(counts.where(gain(F.col("n1"), F.col("n"), F.lit(float(t1)), F.lit(float(t))) >= least_gain).select("f").toArrow().column("f").to_numpy().astype(np.int64))
    shared = sample.sparkSession.sparkContext.broadcast(np.union1d(names, np.array(always, dtype=np.int64)))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [np.intersect1d(x.values.to_numpy(), shared.value, assume_unique=True) for x in b.column("f")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(kept, pa.list_(pa.int64()))], names=["doc_id", "y", "f"])

    got = arrow_map(once, chosen, "doc_id long, y int, f array<long>").toArrow().combine_chunks()
    order = np.argsort(got.column("doc_id").to_numpy())
    y = got.column("y").to_numpy()[order]
    if not len(y):
        return y, np.zeros(1, np.int64), np.zeros(0, np.int64), names
    lists = got.column("f").chunk(0)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    parts = [values[offsets[i] : offsets[i + 1]] for i in order]
    return y, np.concatenate(([0], np.cumsum([len(p) for p in parts]))), np.concatenate(parts), names


def scored(docs: DataFrame, score: Callable[[], Callable[[str], float]], column: str, text: str = "text") -> DataFrame:
    """``docs`` with a score column; ``score`` makes a worker's scoring function. A column of that name is replaced."""
    out = docs.drop(column)
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = score()
        for b in batches:
            made = pa.array([of(t or "") for t in b.column(text).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], names=[*names, column])

    return arrow_map(out, run, T.StructType(out.schema.fields[:]).add(column, "double"))
