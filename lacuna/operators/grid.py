"""Pooling, patches and augmentation of images kept as array<double>, row by row. Arrays are worked on in place: nothing here shuffles but pooling by a learned position."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions import arrays as A
from lacuna.operators.separability import bin_cross_entropy2_all
from lacuna.operators.subspace import matrix_of


def pool(df: DataFrame, image: str, height: int, width: int, step: int, how: str, out: str = "pooled") -> DataFrame:
    """``how``: max, avg, median (zero-filled edges) or direct (every step-th pixel)."""
    of = {"max": F.array_max, "avg": A.mean, "median": A.median, "direct": lambda b: F.element_at(b, 1)}[how]
    return df.withColumn(out, A.blocks(F.col(image), height, width, step, of))


def pool_arg(df: DataFrame, image: str, height: int, width: int, step: int, absolute: bool = True, out: str = "pooled") -> DataFrame:
    """array of struct(v, i): each block's element of largest (absolute) value, with its sign, and its index; the first of equals."""
    key = F.abs if absolute else (lambda x: x)
    return df.withColumn(out, A.blocks(F.col(image), height, width, step, lambda b: A.arg_by(b, key)))


def pool_min_ce(df: DataFrame, image: str, label: str, height: int, width: int, step: int, classes: int, out: str = "pooled") -> DataFrame:
    """Each block's pixel at the position whose absolute values separate the classes best. Scores are one per position; positions are few."""
    rows = df.select(F.col(label).alias("c"), F.posexplode(image).alias("pos", "x")).where(F.col("pos") < height * width)
    got = bin_cross_entropy2_all(rows.select(F.col("pos").alias("feature"), F.abs("x").alias("x"), "c"), classes).collect()  # one row per position
    scores = {r["feature"]: r["score"] for r in got}
    score = F.array(*[F.lit(float(scores.get(p, 0.0))) for p in range(height * width)])
    grid = A.blocks(score, height, width, step, lambda b: A.arg_by(b, lambda x: -x)["i"])
    picked = A.blocks(F.col(image), height, width, step, lambda b: b)
    return df.withColumn(out, F.zip_with(picked, grid, lambda b, i: F.element_at(b, i + 1)))


def as_rows(df: DataFrame, array: str, width: int, *key: str) -> DataFrame:
    """(key, h, w, v) of an image column."""
    return df.select(*key, F.posexplode(array).alias("pos", "v")).select(*key, F.floor(F.col("pos") / width).cast("int").alias("h"), (F.col("pos") % width).cast("int").alias("w"), "v")


def patch_rows(df: DataFrame, image: str, height: int, width: int, size: int, stride: int, *key: str) -> DataFrame:
    """(key, h, w, patch) of every window."""
    return df.select(*key, F.explode(A.windows(F.col(image), height, width, size, stride)).alias("p")).select(*key, "p.h", "p.w", "p.patch")


def hop_concat(df: DataFrame, hops: Sequence[tuple[str, int]], height: int, width: int, out: str = "features") -> DataFrame:
    """array<array<double>>: at each pixel the values of all hops, the k-th one read at (h >> k, w >> k). ``hops``: (column, width)."""
    at = lambda k, w, h_w: F.element_at(F.col(h_w[0]), (F.shiftright(F.floor(k / width).cast("int"), w) * h_w[1] + F.shiftright((k % width).cast("int"), w) + 1).cast("int"))
    return df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: F.array(*[at(k, i, h) for i, h in enumerate(hops)])))


def resized(img: np.ndarray, height: int, width: int, lobes: int = 4) -> np.ndarray:
    """(n, h, w) images at another size by separable Lanczos weights."""

    def weights(n: int, m: int) -> np.ndarray:
        at = (np.arange(m) + 0.5) * n / m - 0.5
        k = np.floor(at).astype(int)[:, None] + np.arange(1 - lobes, lobes + 1)
        x = at[:, None] - k
        v = np.sinc(x) * np.sinc(x / lobes) * (np.abs(x) < lobes)
        w = np.zeros((m, n))
        np.add.at(w, (np.repeat(np.arange(m), k.shape[1]), np.clip(k, 0, n - 1).ravel()), v.ravel())
        return w / w.sum(axis=1, keepdims=True)

    return np.einsum("ph,nhw,qw->npq", weights(img.shape[1], height), img, weights(img.shape[2], width))


def rotated(img: np.ndarray, degrees: float) -> np.ndarray:
    """(n, h, w) images turned about their centre, bilinear, edges held."""
    n, h, w = img.shape
    a = np.deg2rad(degrees)
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    sy, sx = np.cos(a) * y - np.sin(a) * x + (h - 1) / 2, np.sin(a) * y + np.cos(a) * x + (w - 1) / 2
    sy, sx = np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)
    y0, x0 = np.minimum(sy.astype(int), h - 2), np.minimum(sx.astype(int), w - 2)
    fy, fx = sy - y0, sx - x0
    return img[:, y0, x0] * (1 - fy) * (1 - fx) + img[:, y0, x0 + 1] * (1 - fy) * fx + img[:, y0 + 1, x0] * fy * (1 - fx) + img[:, y0 + 1, x0 + 1] * fy * fx


def stretched(img: np.ndarray) -> np.ndarray:
    """Each image over its own range, 0 to 1."""
    lo = img.min(axis=(1, 2), keepdims=True)
    return (img - lo) / ((img - lo).max(axis=(1, 2), keepdims=True) + 1e-5)


def equalised(img: np.ndarray) -> np.ndarray:
    """Histogram equalisation: each pixel becomes the share of its image's pixels that are no brighter."""
    return np.stack([(np.searchsorted(np.sort(i.ravel()), i.ravel(), side="right") / i.size).reshape(i.shape) for i in img])


def _seeded(img: np.ndarray, salt: int) -> list[np.random.Generator]:
    """A generator per image that only its content and the salt decide: a repeated task makes the same images."""
    return [np.random.default_rng((salt, zlib.crc32(np.ascontiguousarray(i).tobytes()))) for i in img]


def cropped_at_random(img: np.ndarray, share: float = 0.875, square: bool = True, salt: int = 0) -> np.ndarray:
    """Each (h, w) image cut to a share of its sides (of the shorter one, if square) at a place of its own, and brought back to its size."""
    n, h, w = img.shape
    out = []
    for i, rng in zip(img, _seeded(img, salt), strict=True):
        a, b = (int(min(h, w) * share),) * 2 if square else (int(h * share), int(w * rng.uniform(share, 1.0)))
        y, x = rng.integers(0, h - a + 1), rng.integers(0, w - b + 1)
        out.append(resized(i[None, y : y + a, x : x + b], h, w)[0])
    return np.stack(out)


def colour_shifted(img: np.ndarray, salt: int = 0, mean: float = 0.1, deviation: float = 0.25) -> np.ndarray:
    """(n, h, w, 3) images moved along the principal directions of their standardised colours by normal weights, cut to 0 .. 1."""
    out = []
    for i, rng in zip(img, _seeded(img, salt), strict=True):
        x = i.reshape(-1, 3)
        centre, spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
        values, vectors = np.linalg.eigh(np.cov((x - centre) / spread, rowvar=False))
        shift = vectors @ (rng.normal(mean, deviation, 3) * values)
        out.append(np.clip(((x - centre) / spread + shift) * spread + centre, 0, 1).reshape(i.shape))
    return np.stack(out)


AUGMENTS = {
    "same": lambda x: x,
    "mirror": lambda x: x[:, :, ::-1],
    "contrast": lambda x: equalised(x) ** 0.5,
    "crop_square": cropped_at_random,
    "crop_rectangle": lambda x: cropped_at_random(x, square=False),
    "gamma_dark": lambda x: stretched(x) ** 1.5,
    "gamma_light": lambda x: stretched(x) ** 0.75,
    "rotate_left": lambda x: rotated(x, 10.0),
    "rotate_right": lambda x: rotated(x, -10.0),
}


def numbered_augments() -> dict[str, tuple[str, ...]]:
    """Steps of the numbered modes 0 to 11: pairs of a change without and with a mirror image before it."""
    kinds = ("same", "crop_square", "crop_rectangle", "contrast", "rotate_left", "rotate_right")
    return {str(2 * i + m): ("mirror",) * m + (k,) for i, k in enumerate(kinds) for m in (0, 1)}


def augment(df: DataFrame, image: str, height: int, width: int, modes: Sequence[str], *key: str) -> DataFrame:
    """(key, mode, image): one row per mode of each image. A mode is a name of ``AUGMENTS`` or a number from 0 to 11."""
    numbered = numbered_augments()
    schema = T.StructType(df.select(*key).schema.fields[:]).add("mode", "string").add(image, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix_of(b.column(image)).reshape(-1, height, width)
            for m in modes:
                y = x
                for step in numbered.get(m, (m,)):
                    y = AUGMENTS[step](y)
                y = y.reshape(len(x), -1)
                made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(np.ascontiguousarray(y).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in key), pa.array([m] * len(y)), made], names=[*key, "mode", image])

    return df.select(*key, F.col(image).cast("array<double>").alias(image)).mapInArrow(run, schema)


def colour_jitter(df: DataFrame, image: str, height: int, width: int, salt: int = 0) -> DataFrame:
    """``df`` with the colours of its (h, w, 3) images shifted."""
    names = df.columns
    base = df.withColumn(image, F.col(image).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = colour_shifted(matrix_of(b.column(image)).reshape(-1, height, width, 3), salt).reshape(b.num_rows, -1)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([made if c == image else b.column(c) for c in names], names=names)

    return base.mapInArrow(run, base.schema)


def resize(df: DataFrame, image: str, height: int, width: int, new_height: int, new_width: int) -> DataFrame:
    """``df`` with its image column at another size."""
    names = df.columns
    base = df.withColumn(image, F.col(image).cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            y = resized(matrix_of(b.column(image)).reshape(-1, height, width), new_height, new_width).reshape(b.num_rows, -1)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1]), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([made if c == image else b.column(c) for c in names], names=names)

    return base.mapInArrow(run, base.schema)
