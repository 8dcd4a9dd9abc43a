"""Expressions over array<double>: class probabilities, vectors and images stored row by row. None of them shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def entropy(p: Column, classes: int) -> Column:
    """Entropy over ln(classes), with 0 ln 0 = 0."""
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + F.when(x > 0, x * F.ln(x)).otherwise(0.0)) / F.ln(F.lit(float(classes)))


def argsort_desc(p: Column) -> Column:
    """Indexes from 0 by falling value; ties by index."""
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda z: z["i"])


def mark_top(p: Column, k: int) -> Column:
    """1 for values strictly above the (k+1)-th largest, else -1."""
    bar = F.element_at(F.sort_array(p, asc=False), k + 1)
    return F.transform(p, lambda x: F.when(x - bar > 0, F.when(x > 0, 1.0).otherwise(x)).otherwise(-1.0))


def adaptive_top(p: Column) -> Column:
    """The top 2 classes, or 3 if the decision is unsure, ascending; 10 fills an unused place.

    Unsure: the largest value is below 0.9 and, among the two last steps of the ascending values, one is less than the sum of all below it by over 0.01.
    """
    s = F.sort_array(p)
    n = F.size(s)
    below = lambda k: total(F.slice(s, F.lit(1), k))
    last, second = F.element_at(s, -1), F.element_at(s, -2)
    unsure = (last < 0.9) & ((last - below(n - 1) < -0.01) | (second - below(n - 2) < -0.01))
    order = argsort_desc(p)
    return F.sort_array(F.when(unsure, F.slice(order, 1, 3)).otherwise(F.concat(F.slice(order, 1, 2), F.array(F.lit(10)))))


def pixel(img: Column, row: Column, col: Column, height: int, width: int) -> Column:
    """A pixel, 0 outside the image."""
    inside = (row < height) & (col < width)
    return F.when(inside, F.element_at(img, F.when(inside, row * width + col + 1).otherwise(1).cast("int"))).otherwise(0.0)


def blocks(img: Column, height: int, width: int, step: int, of: Callable[[Column], Column]) -> Column:
    """One value per step x step block, row by row; ``of`` gets a block's pixels. Ragged edges are filled with zeros."""
    rows, cols = -(-height // step), -(-width // step)

    def block(k: Column) -> Column:
        r, c = F.floor(k / cols) * step, (k % cols) * step
        return of(F.transform(F.sequence(F.lit(0), F.lit(step * step - 1)), lambda o: pixel(img, r + F.floor(o / step), c + o % step, height, width)))

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), block)


def median(a: Column) -> Column:
    s, n = F.sort_array(a), F.size(a)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2).cast("int") + 1)) / 2


def arg_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """struct(v, i): the element of largest key and its index from 0; ties go to the first."""
    return F.array_min(F.transform(a, lambda x, i: F.struct((-key(x)).alias("k"), i.alias("i"), x.alias("v"))))


def windows(img: Column, height: int, width: int, size: int, stride: int) -> Column:
    """array of struct(h, w, patch): every size x size window at the stride, pixels row by row."""
    rows, cols = (height - size) // stride + 1, (width - size) // stride + 1

    def one(k: Column) -> Column:
        r, c = F.floor(k / cols).cast("int"), (k % cols).cast("int")
        patch = F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda o: pixel(img, r * stride + F.floor(o / size), c * stride + o % size, height, width))
        return F.struct(r.alias("h"), c.alias("w"), patch.alias("patch"))

    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), one)


def mirrored(img: Column, height: int, width: int) -> Column:
    """The image with its columns in reverse."""
    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), lambda k: pixel(img, F.floor(k / width), width - 1 - k % width, height, width))


def cropped(img: Column, height: int, width: int, top: int, left: int, rows: int, cols: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(rows * cols - 1)), lambda k: pixel(img, top + F.floor(k / cols), left + k % cols, height, width))


def padded(img: Column, height: int, width: int, by: int, mode: str = "zero") -> Column:
    """The image with ``by`` more pixels at each side: zero, or reflect (without repeating the edge)."""
    w2 = width + 2 * by

    def at(k: Column) -> Column:
        r, c = F.floor(k / w2) - by, k % w2 - by
        if mode == "reflect":
            bounce = lambda x, n: (n - 1) - F.abs((n - 1) - F.abs(x))
            return pixel(img, bounce(r, height), bounce(c, width), height, width)
        inside = (r >= 0) & (c >= 0)
        return F.when(inside, pixel(img, F.when(inside, r).otherwise(0), F.when(inside, c).otherwise(0), height, width)).otherwise(0.0)

    return F.transform(F.sequence(F.lit(0), F.lit((height + 2 * by) * w2 - 1)), at)


def evened(img: Column, height: int, width: int) -> Column:
    """An odd-sized axis gains a copy of its middle line; only the first odd axis is mended."""
    if height % 2:
        mid = height // 2
        return F.concat(F.slice(img, 1, (mid + 1) * width), F.slice(img, mid * width + 1, (height - mid) * width))
    if width % 2:
        mid, w2 = width // 2, width + 1
        return F.transform(F.sequence(F.lit(0), F.lit(height * w2 - 1)), lambda k: pixel(img, F.floor(k / w2), F.when(k % w2 <= mid, k % w2).otherwise(k % w2 - 1), height, width))
    return img


def overlap_average(patches: Column, height: int, width: int, eps: float = 1e-5) -> Column:
    """The image that overlapping windows (struct h0, w0, size, patch) average to: sum / (count + eps)."""
    def at(k: Column) -> Column:
        r, c = F.floor(k / width), k % width
        hit = F.filter(patches, lambda p: (r >= p["h0"]) & (r < p["h0"] + p["size"]) & (c >= p["w0"]) & (c < p["w0"] + p["size"]))
        s = F.aggregate(hit, F.lit(0.0), lambda a, p: a + F.element_at(p["patch"], ((r - p["h0"]) * p["size"] + (c - p["w0"]) + 1).cast("int")))
        return s / (F.size(hit) + F.lit(eps))

    return F.transform(F.sequence(F.lit(0), F.lit(height * width - 1)), at)
