"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Every block of vectors (``BLOCK`` at most, so memory is bounded) keeps one sorted array for each of ``m`` random projections. A query opens a window around its own
projection in every array. Virtual rehashing widens all windows together, radius R by factor ``growth``, and only the newly covered ends are counted. A vector that has collided in at least ``threshold``
arrays is verified: its exact distance is computed. The search of a query in a block ends once its k-th best distance is no more than R; a bound known from earlier blocks is the radius at once.

A vector at distance R lies in a window of half-width R with probability 0.683 (normal projections), independently in each array, a nearer one with a higher; the threshold
is the largest number that a vector at distance R reaches with probability ``found`` (:func:`threshold_for`), so each true neighbour is missed with probability 1 - found at most, whatever the
data. How many others are verified depends on how much farther they lie: ``m`` is chosen so that vectors at 1.2 R mostly stay out. The starting radius comes from a bounded sample of vectors; it changes the work, not the guarantee.

Queries come in passes of at most ``QUERY_BYTES`` of vectors, of one length each: a pass is one broadcast of bounded size and one scan of the vectors, its rows are written to the shared folder, and the plan of
the result does not grow with the number of passes. Tasks return k rows a query, and a window over these gives the result.

Defined cases: vectors that are null, all zero, or that hold a null or non-finite component take no part, nor do rows with a null id; a query meets the vectors of its own
length; of rows that repeat an id divisible by ``every`` the smallest vector is the query, and a query never finds rows of its own id; ties go to the smaller id; fewer than k candidates give
fewer rows; no queries or an empty table give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, cut, read_table, scratch

M, FOUND, GROWTH = 320, 0.94, 1.03
BLOCK, QUERY_BYTES, SAMPLE = 8192, 16 << 20, 1024
#: The share of a normal distribution within one standard deviation.
WITHIN = math.erf(1 / math.sqrt(2))
FOUND_ROWS = "query_id long, vec_id long, score double"


def threshold_for(m: int, found: float, p: float = WITHIN) -> int:
    """The largest t with P(Binomial(m, p) >= t) >= found."""
    tail = 0.0
    for t in range(m, 0, -1):
        tail += math.comb(m, t) * p**t * (1 - p) ** (m - t)
        if tail >= found:
            return t
    return 1


class SortedProjections:
    """The arrays of one block of vectors. ``verified`` counts the distances that searches have computed."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors, self.verified = ids, vectors, 0
        proj = vectors @ directions  # (n, m)
        self.n, self.m = proj.shape
        order = np.argsort(proj, axis=0, kind="stable")
        # All arrays in one ascending line: array i is moved up by i times more than any span.
        self.step = 4 * float(np.abs(proj).max(initial=0.0)) + 1.0
        self.up = self.step * np.arange(self.m)
        self.line = (np.take_along_axis(proj, order, axis=0).T + self.up[:, None]).ravel()
        self.flat = np.ascontiguousarray(order.T.astype(np.int32)).ravel()
        self.base = np.arange(self.m) * self.n

    def search(self, query_id: int, q: np.ndarray, proj: np.ndarray, best: list[tuple[float, int]], k: int, radius: float, threshold: int, growth: float) -> list[tuple[float, int]]:
        """``best`` (distance, id; ascending, at most k) with what this block adds."""
        n, count = self.n, np.zeros(self.n, dtype=np.int32)
        seen = np.zeros(n, dtype=bool)
        lim = self.step / 2  # a window reaches no further than its own array
        lo = hi = None
        if len(best) == k:
            radius = max(radius, best[-1][0])
        while True:
            new_lo = np.clip(np.searchsorted(self.line, np.maximum(proj - radius, -lim) + self.up, side="left"), self.base, self.base + n)
            new_hi = np.clip(np.searchsorted(self.line, np.minimum(proj + radius, lim) + self.up, side="right"), self.base, self.base + n)
            new_hi = np.maximum(new_hi, new_lo)
            if lo is None:
                lo = hi = np.clip(np.searchsorted(self.line, np.clip(proj, -lim, lim) + self.up), new_lo, new_hi)
            parts = [self.flat[a:b] for a, b in zip(np.concatenate((new_lo, hi)).tolist(), np.concatenate((lo, new_hi)).tolist(), strict=True) if b > a]
            lo, hi = new_lo, new_hi
            if parts:
                count += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
                new = np.flatnonzero((count >= threshold) & ~seen)
                if len(new):
                    seen[new] = True
                    new = new[self.ids[new] != query_id]
                    self.verified += len(new)
                    d = self.vectors[new] - q
                    d = np.sqrt((d * d).sum(axis=1))
                    if len(best) == k:
                        near = d <= best[-1][0]
                        new, d = new[near], d[near]
                    if len(new) > k:
                        top = np.lexsort((self.ids[new], d))[:k]
                        new, d = new[top], d[top]
                    best = sorted([*best, *zip(d.tolist(), self.ids[new].tolist(), strict=True)])[:k]
            if len(best) == k and best[-1][0] <= radius or (hi - lo == n).all():
                return best
            radius *= growth


def start_radius(queries: np.ndarray, some: np.ndarray, k: int) -> float:
    """A low guess of the distance to the k-th neighbour: nine tenths of the lower decile of those of a few queries within a bounded sample."""
    if not len(some):
        return 1.0
    d = np.sqrt(((queries[:64, None, :] - some[None, :, :]) ** 2).sum(axis=2))
    kth = np.sort(np.where(d > 0, d, np.inf), axis=1)[:, min(k, d.shape[1]) - 1]
    guess = 0.9 * float(np.quantile(kth, 0.1, method="lower"))
    return guess if np.isfinite(guess) and guess > 0 else 1.0


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    x = F.col("embedding")
    ok = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))


def passes(queries: DataFrame, query_bytes: int) -> Iterator[list[Row]]:
    """The queries, streamed to the driver, in lists of one vector length and a bounded number of bytes."""
    held: list[Row] = []
    for r in queries.orderBy(F.size("embedding"), "vec_id").toLocalIterator():
        dim = len(r["embedding"])
        if held and (len(held[0]["embedding"]) != dim or (len(held) + 1) * dim * 8 > query_bytes):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, m: int = M, found: float = FOUND, growth: float = GROWTH, block: int = BLOCK, query_bytes: int = QUERY_BYTES, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs as :func:`usable` returns them, query ids being distinct."""
    spark = vectors.sparkSession
    threshold, path, n_passes = threshold_for(m, found), scratch(spark, "neighbours"), 0

    def one_pass(rows: list[Row]) -> DataFrame:
        dim = len(rows[0]["embedding"])
        same = vectors.where(F.size("embedding") == dim)
        directions = np.random.default_rng(seed).standard_normal((dim, m))
        ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        q = np.array([r["embedding"] for r in rows], dtype=np.float64)
        some = same.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow().column(1)
        start = start_radius(q, np.array(some.to_pylist(), dtype=np.float64).reshape(-1, dim), k)
        shared = spark.sparkContext.broadcast((ids, q, directions, start))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, directions, radius = shared.value
            proj = q @ directions
            best: list[list[tuple[float, int]]] = [[] for _ in ids]

            def use(parts: list[pa.RecordBatch]) -> None:
                got = pa.Table.from_batches(parts).combine_chunks()
                index = SortedProjections(got.column(0).to_numpy(), _matrix(got.column(1).chunk(0), q.shape[1]), directions)
                for i in range(len(ids)):
                    best[i] = index.search(int(ids[i]), q[i], proj[i], best[i], k, radius, threshold, growth)

            parts: list[pa.RecordBatch] = []
            n = 0
            for b in batches:
                for a in range(0, b.num_rows, block):
                    piece = b.slice(a, block)
                    if n and n + piece.num_rows > block:
                        use(parts)
                        parts, n = [], 0
                    parts.append(piece)
                    n += piece.num_rows
            if n:
                use(parts)
                flat = [(int(i), v, d) for i, found in zip(ids, best, strict=True) for d, v in found]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int64()), pa.array([x[1] for x in flat], pa.int64()), pa.array([x[2] for x in flat], pa.float64())], names=["query_id", "vec_id", "score"])

        return arrow_map(same, scan, FOUND_ROWS)

    for rows in passes(cut(queries), query_bytes):
        one_pass(rows).write.mode("append").parquet(path)
        n_passes += 1
    if not n_passes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return spark.read.schema(FOUND_ROWS).parquet(path).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    queries = vectors.where(F.col("vec_id") % 100 == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return nearest(vectors, queries)


OP8_SQL = """
WITH ok AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0
),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM ok q JOIN ok c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""
