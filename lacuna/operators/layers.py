"""Stacks of window transforms, and per-channel transforms over selected positions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.operators.subspace import Hop, Subspace, folded, from_moments, matrix_of, moments, patches


def _listed(y: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(y).ravel()))


@dataclass
class LayerStack:
    """Layers over (rows, columns, channels) arrays: one model each, or one per channel, whose outputs stand side by side.

    All kernels are kept, so that forward and inverse undo each other where windows do not overlap; overlapping windows are summed, or averaged.
    """

    hops: Sequence[Hop]
    shape: tuple[int, int, int]
    models: list[list[Subspace]] = field(default_factory=list)

    def _rows(self, x: np.ndarray, layer: int) -> list[np.ndarray]:
        """Window rows of each model of a layer."""
        hop = self.hops[layer]
        return [patches(x[..., [c]], hop) for c in range(x.shape[-1])] if hop.channelwise else [patches(x, hop)]

    def forward(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        for layer in range(len(self.models) if upto is None else upto):
            x = np.concatenate([m.apply(p.reshape(-1, p.shape[-1])).reshape(*p.shape[:3], -1) for m, p in zip(self.models[layer], self._rows(x, layer), strict=True)], axis=-1)
        return x

    def inverse(self, y: np.ndarray, average: bool = False) -> np.ndarray:
        sizes = [self.shape]
        for hop in self.hops[: len(self.models)]:
            h, w, c = sizes[-1]
            (a, b), (sa, sb) = hop.window, hop.step
            sizes.append(((h - a) // sa + 1, (w - b) // sb + 1, c * a * b))
        for layer in range(len(self.models) - 1, -1, -1):
            h, w, _ = sizes[layer]
            parts = np.split(y, len(self.models[layer]), axis=-1)
            y = np.concatenate([folded(m.invert(p.reshape(-1, p.shape[-1])).reshape(p.shape), self.hops[layer], h, w, average) for m, p in zip(self.models[layer], parts, strict=True)], axis=-1)
        return y

    def fit(self, df: DataFrame, column: str) -> LayerStack:
        """A pass over the data per layer; the bias of a channel's model before is added to what follows it."""
        for layer in range(len(self.hops)):
            shared = df.sparkSession.sparkContext.broadcast(self)
            bias = [m.bias_out for m in self.models[-1] for _ in range(len(m.kernels))] if layer and self.hops[layer].channelwise else None

            def rows(b: pa.RecordBatch, shared=shared, layer=layer, bias=bias) -> Iterator[tuple[int, np.ndarray]]:
                stack = shared.value
                x = stack.forward(matrix_of(b.column(column)).reshape(-1, *stack.shape))
                for i, p in enumerate(stack._rows(x, layer)):
                    yield i, p.reshape(-1, p.shape[-1]) + (bias[i] if bias else 0.0)

            found = moments(df.select(column), rows)
            self.models.append([from_moments(found[i], bias_in=bias[i] if bias else 0.0) for i in sorted(found)])
        return self

    @property
    def parameters(self) -> int:
        """Numbers held by all layers: kernels, means and biases."""
        return sum(m.kernels.size + m.mean.size + 1 for layer in self.models for m in layer)

    def apply(self, df: DataFrame, column: str, out: str = "features", inverse: bool = False) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)
        base = df.drop(out)
        names = base.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    s = shared.value
                    x = matrix_of(b.column(column))
                    if inverse:
                        probe = s.forward(np.zeros((1, *s.shape)))
                        y = s.inverse(x.reshape(-1, *probe.shape[1:]))
                    else:
                        y = s.forward(x.reshape(-1, *s.shape))
                    yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), _listed(y.reshape(len(x), -1))], names=[*names, out])

        return base.mapInArrow(run, T.StructType(base.schema.fields[:]).add(out, T.ArrayType(T.DoubleType())))


def global_transform(df: DataFrame, column: str, shape: tuple[int, int, int], positions: DataFrame | None = None, out: str = "features", absolute: bool = False) -> tuple[dict[int, Subspace], DataFrame]:
    """Per channel, a transform over (selected) positions: ({channel: model}, ``df`` with all channels' responses side by side).

    ``positions``: (channel, pos); channels without any are left out. ``absolute`` works on magnitudes.
    """
    h, w, c = shape
    if positions is None:
        chosen = {i: list(range(h * w)) for i in range(c)}
    else:
        chosen = {}
        for r in positions.orderBy("channel", "pos").collect():  # at most h x w x c rows
            chosen.setdefault(r["channel"], []).append(r["pos"])

    def of(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        x = matrix_of(b.column(column)).reshape(-1, h * w, c)
        for ch, pos in chosen.items():
            yield ch, np.abs(x[:, pos, ch]) if absolute else x[:, pos, ch]

    models = {ch: from_moments(m) for ch, m in sorted(moments(df.select(column), of).items())}
    shared = df.sparkSession.sparkContext.broadcast(models)
    base = df.drop(out)
    names = base.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = np.concatenate([shared.value[ch].apply(x) for ch, x in sorted(of(b), key=lambda z: z[0])], axis=1)
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), _listed(y)], names=[*names, out])

    return models, base.mapInArrow(run, T.StructType(base.schema.fields[:]).add(out, T.ArrayType(T.DoubleType())))


def coefficient_variance(df: DataFrame, column: str) -> DataFrame:
    """(k, variance): population variance of each entry of a vector column."""
    return df.select(F.posexplode(column).alias("k", "x")).groupBy("k").agg(F.var_pop("x").alias("variance"))


def split_score(df: DataFrame, column: str, energy: float, mode: str = "energy") -> float:
    """What decides whether a channel's windows (a vector column) get a transform of their own.

    energy: its own energy. ratio: its energy over the share of the first principal direction of its mean-free windows. mean_abs: the mean over windows of the mean
    magnitude over that of the first entry.
    """
    if mode == "energy":
        return energy
    if mode == "ratio":
        m = moments(df.select(column), lambda b: iter([(0, matrix_of(b.column(column)))]))[0]
        values = np.linalg.eigvalsh(m.cov)
        return float(energy / max(values[-1] / max(values.sum(), 1e-300), 1e-300))
    if mode == "mean_abs":
        size = F.aggregate(column, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(column)
        return df.agg(F.avg(F.try_divide(size, F.abs(F.element_at(column, 1))))).first()[0] or 0.0
    raise ValueError(mode)


def should_split(df: DataFrame, column: str, energy: float, threshold: float, mode: str = "energy") -> bool:
    """Whether :func:`split_score` reaches the threshold (ratio) or exceeds it."""
    score = split_score(df, column, energy, mode)
    return score >= threshold if mode == "ratio" else score > threshold
