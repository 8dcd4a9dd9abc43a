"""Quality by naive Bayes support vectors.

Features are indicators of n-grams over the chunks of a text (what stands between ASCII white space): of their words in lower case (n = 1 and 2), and of their shapes (n = 1 to 3): letter case, digits, signs as
they are at its ends, and whether the chunk repeats one of the two before it. Case, digits and signs are Unicode's. A word n-gram's indicator says that it occurs, a shape n-gram's that it makes up at least one of some
shares of the text's n-grams, so that a rare mark in a long text is another feature than one at every word. Indicators are scaled by their class log-count ratio; a linear hinge-loss model over these is
fitted by dual coordinate descent, and a logistic curve through its margins gives the score.

The model is fitted on a bounded sample (``PER_CLASS`` labelled rows of each class, outside the held-out fold) with the features of ``LEAST_DOCS`` sampled documents and a least gain
(:data:`~lacuna.llm.labelled.LEAST_GAIN`). All documents are read and scored over their whole texts.

Defined cases: null and empty texts have no n-grams and the score of the bias; very long texts are read in pieces, and n-grams run across these; a sample without both
classes or without a telling feature gives its own share of good rows as every score (1 without rows, and no less than ``THRESHOLD`` in the second case: nothing is rejected); repeated rows are scored alike;
extra columns are carried along.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import held_out, read_table, spread
from lacuna.llm.labelled import labelled_sample, scored, selected_features

PER_CLASS, LEAST_DOCS, THRESHOLD = 3000, 4, 0.3
CACHE = 300_000
#: Bytes of a text that are split at once.
PIECE = 1 << 20
#: Shares of a text's n-grams at which an indicator is set; 0: the n-gram occurs at all.
SHARES = (0.0, 0.01, 0.05, 0.2, 0.5)
N, WORD_N = 3, 2


#: A byte's class: U and l for ASCII letters, N for digits; white space, signs and bytes of other characters stay as they are.
_CLASS = bytes(0x55 if chr(b).isupper() and b < 0x80 else 0x6C if chr(b).islower() and b < 0x80 else 0x4E if 0x30 <= b < 0x3A else b for b in range(256))
_INNER = "UlNh"


class _Classes(dict):
    """Characters by their class, learnt as they come: U, l, N as above, h for letters without case and marks; signs and blanks stay."""

    def __missing__(self, c: int) -> int:
        if c < 0x80:
            found = _CLASS[c]
        else:
            kind = unicodedata.category(chr(c))
            found = ord({"Lu": "U", "Lt": "U", "Ll": "l"}.get(kind) or {"L": "h", "M": "h", "N": "N"}.get(kind[0]) or chr(c))
        self[c] = found
        return found


_CLASSES = _Classes()


def classes_of(piece: bytes) -> bytes:
    """A piece with each character's class in its place; white space stays."""
    if piece.isascii():
        return piece.translate(_CLASS)
    return piece.decode("utf-8", "surrogatepass").translate(_CLASSES).encode("utf-8", "surrogatepass")


def shape(classes: str) -> str:
    """The shape of a chunk, given by the classes of its characters: one letter for its inside, then its outer signs, two at most at each side.

    U: upper case, T: begins with an upper-case letter, l: other letters, N: digits, M: anything else; + marks a long one.
    """
    a, b = 0, len(classes)
    while a < b and classes[a] not in _INNER:
        a += 1
    while b > a and classes[b - 1] not in _INNER:
        b -= 1
    head, core, tail = classes[:a], classes[a:b], classes[b:]
    inside = set(core)
    if not core:
        kind = ""
    elif inside <= set("Ulh"):
        kind = "l" if "U" not in inside else "U" if "l" not in inside and len(core) > 1 else "T" if core[0] == "U" else "l"
        kind += "+" if len(core) > 20 else ""
    else:
        kind = "N" if inside == {"N"} else "M"
    return head[:2] + kind + tail[-2:]


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def pieces(raw: bytes) -> Iterator[bytes]:
    """A long text in pieces of bounded size, cut at white space."""
    at = 0
    while len(raw) - at > PIECE:
        end = max(raw.rfind(b" ", at, at + PIECE), raw.rfind(b"\n", at, at + PIECE)) + 1
        if end <= at:
            end = min((p for c in (b" ", b"\n") if (p := raw.find(c, at + PIECE)) >= 0), default=len(raw) - 1) + 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a sequence of codes."""
    h = code
    for i in range(1, n):
        h = h[:-1] * _GOLDEN + code[i:]
        h = h ^ (h >> np.uint64(31))
    return h * _GOLDEN + np.uint64(n)


class Counts:
    """n-grams and their numbers, merged piece by piece, so that memory grows with the distinct ones only. n-grams run across pieces."""

    def __init__(self, most: int):
        self.most, self.last = most, np.zeros(0, np.uint64)
        self.names = [np.zeros(0, np.uint64)] * most
        self.count = [np.zeros(0, np.int64)] * most

    def add(self, code: np.ndarray) -> None:
        whole = np.concatenate((self.last, code))
        for n in range(1, self.most + 1):
            part = whole[max(0, len(self.last) - n + 1) :]
            if len(part) < n:
                continue
            names, count = np.unique(_grams(part, n), return_counts=True)
            if len(self.names[n - 1]):
                names, at = np.unique(np.concatenate((self.names[n - 1], names)), return_inverse=True)
                count = np.bincount(at, weights=np.concatenate((self.count[n - 1], count))).astype(np.int64)
            self.names[n - 1], self.count[n - 1] = names, count
        self.last = whole[max(0, len(whole) - self.most + 1) :]


class Shapes:
    """64-bit features of a text; the codes of words and of class patterns are kept in bounded caches."""

    def __init__(self):
        self.cache: dict[bytes, int] = {}
        self.words: dict[bytes, int] = {}

    def _codes(self, piece: bytes, before: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Codes of a piece's shapes and words, and its last two chunks; ``before``: those of the piece before."""
        cache, words = self.cache, self.words
        if len(cache) > CACHE:
            cache.clear()
        if len(words) > CACHE:
            words.clear()
        part, patterns, low = piece.split(), classes_of(piece).split(), piece.lower().split()
        for c in [c for c in set(patterns) if c not in cache]:
            cache[c] = zlib.crc32(shape(c.decode("utf-8", "surrogatepass")).encode("utf-8", "surrogatepass")) << 2
        for w in [w for w in set(low) if w not in words]:
            words[w] = xxhash.xxh64_intdigest(w, 5)
        n = len(part)
        shapes = np.fromiter(map(cache.__getitem__, patterns), dtype=np.uint64, count=n)
        run, k = before + part, len(before)
        again = np.zeros(len(run), dtype=np.uint64)
        again[1:] = np.fromiter(map(eq, run, run[1:]), dtype=bool, count=max(len(run) - 1, 0))
        again[2:] |= np.fromiter(map(eq, run, run[2:]), dtype=bool, count=max(len(run) - 2, 0)).astype(np.uint64) << np.uint64(1)
        return shapes + again[k:], np.fromiter(map(words.__getitem__, low), dtype=np.uint64, count=n), run[-2:]

    def __call__(self, text: str) -> np.ndarray:
        shapes, words, last = Counts(N), Counts(WORD_N), []
        for piece in pieces(text.encode("utf-8", "surrogatepass")):
            of_shapes, of_words, last = self._codes(piece, last)
            shapes.add(of_shapes)
            words.add(of_words)
        out = [w ^ np.uint64(0x94D049BB133111EB) for w in words.names]
        for names, count in zip(shapes.names, shapes.count, strict=True):
            share = count / max(1, count.sum())
            for level, least in enumerate(SHARES):
                some = names[share >= least] if least else names
                out.append((some ^ (some >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(level))
        return np.unique(np.concatenate(out)).view(np.int64)


@dataclass
class QualityModel:
    """margin = bias + sum of weights; score = 1 / (1 + exp(-(slope x margin + shift)))."""

    bias: float
    slope: float
    shift: float
    names: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def margin(self, feats: np.ndarray) -> float:
        if not len(self.names) or not len(feats):
            return self.bias
        at = np.minimum(np.searchsorted(self.names, feats), len(self.names) - 1)
        return self.bias + float(self.weights[at[self.names[at] == feats]].sum())

    def scorer(self) -> Callable[[str], float]:
        features = Shapes()
        return lambda text: 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * self.margin(features(text)) + self.shift))))


def dual_coordinate_descent(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, d: int, c: np.ndarray, epochs: int = 30, seed: int = 3, least: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised squared hinge loss; rows as (columns, values), y in -1, 1, c the cost of each row."""
    w, b = np.zeros(d), 0.0
    alpha = np.zeros(len(y))
    norm = np.array([float(v @ v) + 1.0 for _, v in x]) + 0.5 / c
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            cols, v = x[i]
            g = y[i] * (float(w[cols] @ v) + b) - 1 + 0.5 * alpha[i] / c[i]
            if alpha[i] == 0 and g >= 0:
                continue
            new = max(0.0, alpha[i] - g / norm[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[cols] += step * v
                b += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < least:
            break
    return w, b


def logistic_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps on smoothed targets."""
    n1, n0 = (y == 1).sum(), (y != 1).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -60, 60)))
        r, h = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * margin).sum() + 1e-6 * a, r.sum()])
        m = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(max(a, 1e-3)), float(b)


def train(y: np.ndarray, starts: np.ndarray, feats: np.ndarray, names: np.ndarray, alpha: float = 1.0, cost: float = 1.0) -> QualityModel:
    """Log-count ratios of ``names``, hinge-loss weights and the curve."""
    if not len(y) or y.min() == y.max() or not len(names):
        p = float(np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3))
        p = max(p, THRESHOLD + 1e-3) if len(y) and y.min() != y.max() else p
        return QualityModel(0.0, 1.0, math.log(p / (1 - p)))
    doc, cols = np.repeat(np.arange(len(y)), np.diff(starts)), np.searchsorted(names, feats)
    n1 = np.bincount(cols, weights=y[doc], minlength=len(names))
    n0 = np.bincount(cols, minlength=len(names)) - n1
    ratio = np.log((n1 + alpha) / (n1.sum() + alpha * len(names))) - np.log((n0 + alpha) / (n0.sum() + alpha * len(names)))
    vals = ratio[cols]
    cut = np.searchsorted(doc, np.arange(len(y) + 1))
    rows = [(cols[a:b], vals[a:b]) for a, b in zip(cut, cut[1:], strict=False)]
    sign = np.where(y == 1, 1.0, -1.0)
    c = np.where(y == 1, cost * 0.5 * len(y) / (y == 1).sum(), cost * 0.5 * len(y) / (y == 0).sum())
    w, b = dual_coordinate_descent(rows, sign, len(names), c)
    margin = np.array([float(w[k] @ v) + b for k, v in rows])
    slope, shift = logistic_curve(margin, y)
    weights = w * ratio
    some = np.abs(weights) > 1e-7
    return QualityModel(float(b), slope, shift, names[some], weights[some])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text", **how) -> QualityModel:
    sample = labelled_sample(docs, labels, "quality", per_class, text=text)
    return train(*selected_features(sample, lambda t: Shapes()(t), LEAST_DOCS), **how)


def with_quality(docs: DataFrame, model: QualityModel, text: str = "text", column: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda: shared.value.scorer(), column, text)


def drop_poor(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", **how) -> DataFrame:
    """The documents that reach the threshold, with their columns."""
    return with_quality(docs, fit(docs, labels, text=text, **how), text, "__quality").where(F.col("__quality") >= threshold).drop("__quality")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = with_quality(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
