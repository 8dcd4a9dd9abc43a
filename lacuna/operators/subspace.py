"""Subspace features: PCA, the Saab transform and its channel-wise trees, least-squares projections.

What is learned from rows are second moments. Executors accumulate them in numpy, one small row per partition and node; partial rows are summed in two steps, so neither the driver nor a
task gets a row per partition. The driver decomposes d x d matrices and broadcasts the kernels; applying them is a matrix product on Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOMENTS = "node int, n double, s array<double>, g array<double>, norm double, dc double, dc2 double"


def matrix_of(column: pa.Array) -> np.ndarray:
    """(rows, d) of a list column without gaps."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Moments:
    """Count, sum and centred Gram matrix of rows after their own mean is taken off, largest norm, and sums of the means."""

    n: float
    s: np.ndarray
    g: np.ndarray
    norm: float
    dc: float
    dc2: float

    @property
    def mean(self) -> np.ndarray:
        return self.s / max(self.n, 1.0)

    @property
    def cov(self) -> np.ndarray:
        return self.g / max(self.n - 1, 1.0)


def _row(node: int, x: np.ndarray, remove_dc: bool, constant: bool) -> dict:
    dc = x.mean(axis=1)
    norm = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0)) if not remove_dc else 0.0
    if remove_dc:
        x = x - dc[:, None]
        norm = float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))
    if constant:
        x = x[x.sum(axis=1) > 1e-5]
    centred = x - x.mean(axis=0) if len(x) else x
    return {"node": node, "n": float(len(x)), "s": x.sum(axis=0), "g": (centred.T @ centred).ravel(), "norm": norm, "dc": float(dc.sum()), "dc2": float((dc * dc).sum())}


def _add(parts: pd.DataFrame) -> dict:
    """Sums of parts; Gram matrices stay centred: each part adds what its mean lies off the common one, so that large means cost no digits."""
    n, s = parts["n"].to_numpy(float), np.stack(list(parts["s"]))
    off = s / np.maximum(n, 1.0)[:, None] - s.sum(axis=0) / max(n.sum(), 1.0)
    g = np.sum(np.stack(list(parts["g"])), axis=0) + ((off * n[:, None]).T @ off).ravel()
    return {"n": n.sum(), "s": s.sum(axis=0), "g": g, "norm": parts["norm"].max(), "dc": parts["dc"].sum(), "dc2": parts["dc2"].sum()}


def moments(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]], remove_dc: bool = True, constant: bool = False) -> dict[int, Moments]:
    """Moments of each node; ``rows`` gives (node, matrix) for a batch. ``constant`` leaves out rows whose sum is not above 1e-5 (after the mean is off)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        for b in batches:
            if not b.num_rows:
                continue
            for node, x in rows(b):
                new = _row(node, x, remove_dc, constant)
                held[node] = new if node not in held else {"node": node, **_add(pd.DataFrame([held[node], new]))}
        if held:
            t = pa.Table.from_pylist([{k: (v.tolist() if isinstance(v, np.ndarray) else v) for k, v in r.items()} for r in held.values()], schema=_ARROW)
            yield from t.to_batches()

    parts = df.mapInArrow(partial, MOMENTS).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(64)).cast("int"))
    once = parts.groupBy("node", "salt").applyInPandas(lambda p: pd.DataFrame([{"node": int(p["node"].iloc[0]), **_add(p)}]), MOMENTS)
    total = once.groupBy("node").applyInPandas(lambda p: pd.DataFrame([{"node": int(p["node"].iloc[0]), **_add(p)}]), MOMENTS)
    out = {}
    for r in total.collect():  # one row per node
        d = len(r["s"])
        out[r["node"]] = Moments(r["n"], np.array(r["s"]), np.array(r["g"]).reshape(d, d), r["norm"], r["dc"], r["dc2"])
    return out


_ARROW = pa.schema([("node", pa.int32()), ("n", pa.float64()), ("s", pa.list_(pa.float64())), ("g", pa.list_(pa.float64())), ("norm", pa.float64()), ("dc", pa.float64()), ("dc2", pa.float64())])


def principal(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvectors as rows and eigenvalues, falling; each vector's largest entry (the first, of entries equal to nine digits) is positive."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, rows = values[::-1], vectors.T[::-1]
    sign = np.sign(rows[np.arange(len(rows)), np.abs(rows).round(9).argmax(axis=1)])
    return rows * np.where(sign == 0, 1, sign)[:, None], np.maximum(values, 0.0)


@dataclass
class Subspace:
    """A linear model: features = (x + bias_in - mean) @ kernels.T, scaled and shifted as its kind asks."""

    kernels: np.ndarray
    mean: np.ndarray
    energy: np.ndarray
    bias_in: float = 0.0
    bias_out: float = 0.0
    kind: str = "saab"
    bits: int = 0

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.kind == "pca":  # the data are not centred
            y = x @ self.kernels.T
        elif self.kind == "dc":  # a bias that makes the first response positive, taken off again
            y = (x - self.mean + self.bias_out) @ self.kernels.T
            y[:, 0] -= self.bias_out
        else:
            y = (x + self.bias_in - self.mean) @ self.kernels.T
        return np.trunc(y) if self.bits else y

    def invert(self, y: np.ndarray) -> np.ndarray:
        """Rows from features; exact only with all kernels and orthonormal rows."""
        if self.kind == "pca":
            x = y @ self.kernels
            return np.round(x / 2.0 ** (2 * self.bits)) if self.bits else x
        if self.kind == "dc":
            y = y.copy()
            y[:, 0] += self.bias_out
            x = y @ self.kernels - self.bias_out + self.mean
            return np.round(x / 2.0 ** (2 * self.bits)) if self.bits else x
        return y @ self.kernels - self.bias_in + self.mean

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @staticmethod
    def from_json(text: str) -> Subspace:
        d = json.loads(text)
        return Subspace(**{k: np.array(v) if isinstance(v, list) else v for k, v in d.items()})


def from_moments(m: Moments, kernels: int = -1, bias_in: float = 0.0) -> Subspace:
    """The Saab transform: a constant kernel, then the principal directions of what is left, the last one dropped."""
    d = len(m.s)
    rows, values = principal(m.cov)
    k = d if kernels == -1 else kernels
    rows, values = rows[:k], values[:k]
    mean_dc = m.dc / max(m.n, 1.0)
    dc_energy = max(m.dc2 / max(m.n, 1.0) - mean_dc * mean_dc, 0.0) * d
    energy = np.concatenate(([dc_energy], values[:-1]))
    return Subspace(np.vstack((np.full((1, d), 1 / np.sqrt(d)), rows[:-1])), m.mean, energy / max(energy.sum(), 1e-300), bias_in, m.norm)


def _vectors(column: str) -> Callable[[pa.RecordBatch], Iterator[tuple[int, np.ndarray]]]:
    def rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        yield 0, matrix_of(b.column(column))

    return rows


def fit_saab(df: DataFrame, column: str, kernels: int = -1, bias_in: float = 0.0, drop_constant: bool = False) -> Subspace:
    """Saab over rows of an array<double> column."""
    one = _vectors(column)

    def rows(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        for node, x in one(b):
            yield node, x + bias_in

    return from_moments(moments(df.select(column), rows, constant=drop_constant)[0], kernels, bias_in)


def fit_pca(df: DataFrame, column: str, components: int | float = -1, bits: int = 0) -> Subspace:
    """Principal directions; a fraction keeps as many as reach that share of the energy. ``bits``: fixed-point kernels."""
    m = moments(df.select(column), _vectors(column), remove_dc=False)[0]
    rows, values = principal(m.cov)
    energy = values / max(values.sum(), 1e-300)
    k = len(rows) if components == -1 else int(components) if components >= 1 else int(np.searchsorted(np.cumsum(energy), components) + 1)
    rows = rows[:k]
    return Subspace(np.round(rows * 2.0**bits) if bits else rows, m.mean, energy[:k], kind="pca", bits=bits)


def fit_dc_saab(df: DataFrame, column: str, kernels: int | float = -1, use_dc: bool = True, bits: int = 0) -> Subspace:
    """The invertible variant: with ``use_dc`` the constant kernel is scaled by the deviation of the means; the bias is the largest norm over sqrt(d).

    ``kernels``: their number, or a share of the energy; with a share, kernels are kept up to the one with which the sum of their energies exceeds it.
    """
    share, kernels = (kernels, -1) if isinstance(kernels, float) else (None, kernels)
    raw = moments(df.select(column), _vectors(column), remove_dc=False)[0]
    d = len(raw.s)
    bias = raw.norm / np.sqrt(d)
    m = moments(df.select(column), _vectors(column))[0] if use_dc else raw
    rows, values = principal(m.cov)
    k = d if kernels == -1 else kernels
    rows, values = rows[:k], values[:k]
    if not use_dc:
        energy = values / max(values.sum(), 1e-300)
        some = _enough(energy, share)
        return Subspace((np.round(rows * 2.0**bits) if bits else rows)[:some], m.mean, energy[:some], 0.0, bias, "pca", bits)
    mean_dc = m.dc / m.n
    var = max(m.dc2 / m.n - mean_dc * mean_dc, 1e-300) * d
    rows = np.vstack((np.full((1, d), 1 / np.sqrt(d) / np.sqrt(var)), rows[:-1]))
    energy = np.concatenate(([var], values[:-1]))
    energy = energy / energy.sum()
    some = _enough(energy, share)
    return Subspace((np.round(rows * 2.0**bits) if bits else rows)[:some], m.mean, energy[:some], 0.0, bias, "dc", bits)


def _enough(energy: np.ndarray, share: float | None) -> int:
    """How many leading energies it takes for their sum to exceed a share; all without one."""
    return len(energy) if share is None else min(len(energy), int(np.searchsorted(np.cumsum(energy), share, side="right")) + 1)


def transform(df: DataFrame, model: Subspace, column: str, out: str = "features", inverse: bool = False) -> DataFrame:
    """``df`` with the features of a vector column (or the vectors that features stand for)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    base = df.drop(out)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column(column))
            y = m.invert(x) if inverse else m.apply(x)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], names=[*names, out])

    return base.mapInArrow(run, T.StructType(base.schema.fields[:]).add(out, T.ArrayType(T.DoubleType())))


# ---------------------------------------------------------------- trees over images


@dataclass(frozen=True)
class Hop:
    """One layer: windows of size x size at a stride (0: the size); ``channelwise``: one model per incoming channel."""

    size: int | tuple[int, int] = 2
    stride: int | tuple[int, int] = 0
    channelwise: bool = True
    kernels: int = -1

    @property
    def window(self) -> tuple[int, int]:
        return self.size if isinstance(self.size, tuple) else (self.size, self.size)

    @property
    def step(self) -> tuple[int, int]:
        s = self.stride or self.window
        return s if isinstance(s, tuple) else (s, s)


def patches(maps: np.ndarray, hop: Hop) -> np.ndarray:
    """(n, rows, cols, d) from (n, h, w, c): windows flattened as (row, column, channel)."""
    (a, b), (sa, sb) = hop.window, hop.step
    view = np.lib.stride_tricks.sliding_window_view(maps, (a, b), axis=(1, 2))[:, ::sa, ::sb]
    n, r, c = view.shape[:3]
    return view.transpose(0, 1, 2, 4, 5, 3).reshape(n, r, c, -1)


def folded(rows: np.ndarray, hop: Hop, height: int, width: int, average: bool = False) -> np.ndarray:
    """Images of windows put back: overlaps are added up, or averaged."""
    (a, b), (sa, sb) = hop.window, hop.step
    n, r, c, d = rows.shape
    out, count = np.zeros((n, height, width, d // (a * b))), np.zeros((1, height, width, 1))
    blocks = rows.reshape(n, r, c, a, b, -1)
    for i in range(r):
        for j in range(c):
            out[:, i * sa : i * sa + a, j * sb : j * sb + b] += blocks[:, i, j]
            count[:, i * sa : i * sa + a, j * sb : j * sb + b] += 1
    return out / (count + 1e-5) if average else out


@dataclass
class Node:
    """A fitted model and where its input comes from: a channel of a node of the layer before (None: all channels of the input)."""

    model: Subspace
    parent: tuple[int, int] | None = None
    energy: np.ndarray = field(default_factory=lambda: np.zeros(0))


@dataclass
class HopTree:
    """Layers of nodes. ``keep``: what a channel must reach to be an input of the next layer; ``discard``: channels below this energy are removed.

    ``split`` says what must reach ``keep``: the channel's own energy (``energy``); that over the share of the first principal direction of its mean-free windows (``ratio``); or, exceeding it, the mean over
    its windows of their mean magnitude over that of their first entry (``mean_abs``). ``retain``: kernels of each layer's models, in place of those of the hops.
    """

    hops: Sequence[Hop]
    shape: tuple[int, int, int]
    keep: float = 0.01
    discard: float = 0.005
    layers: list[list[Node]] = field(default_factory=list)
    split: str = "energy"
    retain: Sequence[int] | None = None

    def _inputs(self, layer: int) -> list[tuple[int, int] | None]:
        hop = self.hops[layer]
        if not hop.channelwise:
            return [None]
        if layer == 0:
            return [(0, c) for c in range(self.shape[2])]
        return [(i, j) for i, node in enumerate(self.layers[layer - 1]) for j in range(len(node.energy)) if self.split != "energy" or node.energy[j] >= self.keep]

    def _mean_abs(self, df: DataFrame, column: str, layer: int, inputs: Sequence[tuple[int, int]]) -> dict[int, float]:
        """Mean over each input's windows of their mean magnitude over that of their first entry; windows that begin with 0 are left out."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tree = shared.value
                images = matrix_of(b.column(column)).reshape(-1, *tree.shape)
                maps = tree._maps(images, layer)
                for i, parent in enumerate(inputs):
                    p = np.abs(tree._patches(images, maps, layer, parent))
                    p = p.reshape(-1, p.shape[-1])
                    p = p[p[:, 0] > 0]
                    yield pa.RecordBatch.from_pydict({"node": pa.array([i], pa.int32()), "n": [float(len(p))], "s": [float((p.mean(axis=1) / p[:, 0]).sum())]})

        rows = df.select(column).mapInArrow(run, "node int, n double, s double").groupBy("node").agg((F.sum("s") / F.sum("n")).alias("m")).collect()  # one row per input
        return {r["node"]: r["m"] or 0.0 for r in rows}

    def _chosen(self, df: DataFrame, column: str, layer: int, inputs: Sequence[tuple[int, int] | None], found: dict[int, Moments]) -> list[int]:
        """The inputs that get a model, by the modes that look at their windows."""
        if layer == 0 or self.split == "energy" or None in inputs:
            return list(range(len(inputs)))
        if self.split == "mean_abs":
            means = self._mean_abs(df, column, layer, inputs)
            return [i for i in range(len(inputs)) if means.get(i, 0.0) > self.keep]
        if self.split != "ratio":
            raise ValueError(self.split)
        out = []
        for i, (node, channel) in enumerate(inputs):
            values = principal(found[i].cov)[1]
            if self.layers[layer - 1][node].energy[channel] / max(values[0] / max(values.sum(), 1e-300), 1e-300) >= self.keep:
                out.append(i)
        return out

    def _maps(self, images: np.ndarray, upto: int) -> list[list[np.ndarray]]:
        """Outputs of each node of each layer below ``upto``."""
        out: list[list[np.ndarray]] = []
        for layer in range(upto):
            out.append([node.model.apply((p := self._patches(images, out, layer, node.parent)).reshape(-1, p.shape[-1])).reshape(*p.shape[:3], -1) for node in self.layers[layer]])
        return out

    def _patches(self, images: np.ndarray, maps: list[list[np.ndarray]], layer: int, parent: tuple[int, int] | None) -> np.ndarray:
        if layer == 0:
            x = images if parent is None else images[..., [parent[1]]]
        else:
            x = np.concatenate(maps[layer - 1], axis=-1) if parent is None else maps[layer - 1][parent[0]][..., [parent[1]]]
        return patches(x, self.hops[layer])

    def _bias(self, layer: int, parent: tuple[int, int] | None) -> float:
        if layer == 0:
            return 0.0
        return self.layers[layer - 1][parent[0] if parent else 0].model.bias_out

    def fit(self, df: DataFrame, column: str) -> HopTree:
        """One pass over the images per layer."""
        for layer, hop in enumerate(self.hops):
            inputs = self._inputs(layer)
            if not inputs:
                break
            shared = df.sparkSession.sparkContext.broadcast(self)
            biases = [self._bias(layer, p) for p in inputs]

            def rows(b: pa.RecordBatch, shared=shared, layer=layer, inputs=inputs, biases=biases) -> Iterator[tuple[int, np.ndarray]]:
                tree = shared.value
                images = matrix_of(b.column(column)).reshape(-1, *tree.shape)
                maps = tree._maps(images, layer)
                for i, parent in enumerate(inputs):
                    p = tree._patches(images, maps, layer, parent)
                    yield i, p.reshape(-1, p.shape[-1]) + biases[i]

            found = moments(df.select(column), rows)
            nodes = []
            for i in self._chosen(df, column, layer, inputs, found):
                parent = inputs[i]
                m = from_moments(found[i], self.retain[layer] if self.retain is not None else hop.kernels, biases[i])
                energy = m.energy * (self.layers[layer - 1][parent[0]].energy[parent[1]] if layer and parent else 1.0)
                some = energy >= self.discard
                m.kernels, m.energy = m.kernels[some], m.energy[some]
                nodes.append(Node(m, parent, energy[some]))
            if not nodes:
                break
            self.layers.append([n for n in nodes if len(n.energy)])
        return self

    def features(self, images: np.ndarray, layer: int) -> np.ndarray:
        return np.concatenate(self._maps(images, layer + 1)[layer], axis=-1)

    def transform(self, df: DataFrame, column: str, layer: int = -1, out: str = "features") -> DataFrame:
        """The flattened output of a layer."""
        layer = layer % len(self.layers)
        shared = df.sparkSession.sparkContext.broadcast(self)
        base = df.drop(out)
        names = base.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                tree = shared.value
                y = tree.features(matrix_of(b.column(column)).reshape(-1, *tree.shape), layer).reshape(b.num_rows, -1)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), made], names=[*names, out])

        return base.mapInArrow(run, T.StructType(base.schema.fields[:]).add(out, T.ArrayType(T.DoubleType())))

    def table(self, spark) -> DataFrame:
        """(layer, node, parent_node, parent_channel, channel, energy, kernel): the tree as rows."""
        rows = [(li, ni, n.parent[0] if n.parent else None, n.parent[1] if n.parent else None, k, float(e), [float(v) for v in n.model.kernels[k]]) for li, layer in enumerate(self.layers) for ni, n in enumerate(layer) for k, e in enumerate(n.energy)]
        return spark.createDataFrame(rows, "layer int, node int, parent_node int, parent_channel int, channel int, energy double, kernel array<double>")


def round_trip_error(df: DataFrame, model: Subspace, column: str) -> DataFrame:
    """One row: the largest absolute difference of vectors and what their features invert to."""
    back = transform(transform(df.select(column), model, column, "__f"), model, "__f", "__b", inverse=True)
    worst = F.array_max(F.zip_with(F.col(column), F.col("__b"), lambda a, b: F.abs(a - b)))
    return back.agg(F.max(worst).alias("max_error"))


# ---------------------------------------------------------------- projections


def least_squares_direction(df: DataFrame, columns: Sequence[str], label: str) -> np.ndarray:
    """Coefficients of the centred least-squares fit of a 0/1 (or real) label: one aggregation of covariances."""
    names = [*columns, label]
    one = df.agg(*[F.covar_pop(a, b).alias(f"{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]).first()
    k = len(columns)
    c = np.array([[one[f"{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)], dtype=float)
    return np.linalg.lstsq(c[:k, :k], c[:k, k], rcond=None)[0]


def two_way_groupings(classes: Sequence) -> list[tuple]:
    """Every way to cut the classes in two, as the group that holds the first class; larger groups of early classes come first."""
    first, *rest = sorted(classes)
    subsets = [(first, *(c for c, inside in zip(rest, mask, strict=True) if inside)) for mask in product((True, False), repeat=len(rest))]
    return subsets[1:]


def grouped_directions(df: DataFrame, columns: Sequence[str], label: str, classes: Sequence) -> list[tuple[tuple, np.ndarray]]:
    """(group, coefficients) of the centred least-squares fit of each two-way grouping of the label: one aggregation, with one indicator per class."""
    k = len(columns)
    hits = [F.coalesce((F.col(label) == F.lit(c)).cast("double"), F.lit(0.0)) for c in classes]
    pairs = [F.covar_pop(a, b).alias(f"x{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]
    one = df.agg(*pairs, *[F.covar_pop(F.col(a), h).alias(f"y{i}_{c}") for i, a in enumerate(columns) for c, h in enumerate(hits)]).first()
    xx = np.array([[one[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    xy = np.array([[one[f"y{i}_{c}"] for c in range(len(classes))] for i in range(k)], dtype=float)
    at = {c: i for i, c in enumerate(classes)}
    return [(g, np.linalg.lstsq(xx, xy[:, [at[c] for c in g]].sum(axis=1), rcond=None)[0]) for g in two_way_groupings(classes)]


def projected(df: DataFrame, columns: Sequence[str], theta: Sequence[float], out: str = "projection") -> DataFrame:
    """Adds the projection of the columns, centred on this very data, along a direction."""
    means = df.agg(*[F.avg(c).alias(f"__m{i}") for i, c in enumerate(columns)])
    value = sum(((F.col(c) - F.col(f"__m{i}")) * F.lit(float(t)) for i, (c, t) in enumerate(zip(columns, theta, strict=True))), F.lit(0.0))
    return df.crossJoin(F.broadcast(means)).withColumn(out, value).drop(*[f"__m{i}" for i in range(len(columns))])  # one row of means


def select_positions(scores: DataFrame, share: float | None = None, below: float | None = None) -> DataFrame:
    """(channel, pos) of the lowest-scoring share of each channel's positions, or of those below a threshold. Positions are few."""
    from pyspark.sql import Window

    if share is None:
        return scores.where(F.col("score") < below).select("channel", "pos")
    w = Window.partitionBy("channel")
    ranked = scores.withColumn("__rn", F.row_number().over(w.orderBy("score", "pos"))).withColumn("__n", F.count(F.lit(1)).over(w))
    return ranked.where(F.col("__rn") <= F.floor(F.col("__n") * F.lit(share))).select("channel", "pos")


def gated_channels(scores: DataFrame, below: float, more_than: int = 5) -> DataFrame:
    """Channels with over ``more_than`` positions that score below a threshold."""
    return scores.groupBy("channel").agg(F.sum((F.col("score") < below).cast("int")).alias("good")).where(F.col("good") > more_than).select("channel")
