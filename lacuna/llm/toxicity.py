"""Toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words and of their beginnings (4 and 5 letters, so that unseen inflections count). For every labelled document that
holds identity terms, counterfactuals are made by swapping each term for the others of its group, a neutral word among them. Training adds ``penalty`` x the mean squared
change of the score under these swaps, so group mentions by themselves move no score, whatever the sample says about them.

The model is fitted on a bounded sample (``PER_CLASS`` labelled rows of each class, outside the held-out fold) with the features of ``LEAST_DOCS`` sampled documents and a least gain
(:data:`~lacuna.llm.labelled.LEAST_GAIN`), and all identity terms. All documents are read and scored over their whole texts.

Defined cases: null and empty texts have the score of the bias alone; very long texts are read in pieces; a sample without both classes, or without any feature in ``LEAST_DOCS`` documents, gives its own share of
toxic rows as every score (0 without rows; below one half in the second case); repeated rows are scored alike; extra columns are carried along.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import held_out, read_table, spread
from lacuna.llm.labelled import labelled_sample, scored, selected_features
from lacuna.llm.tokencount import PIECE

PER_CLASS, LEAST_DOCS = 4000, 4
THRESHOLD = 0.5
CACHE = 300_000

#: Identity terms by group; within a group any may replace any. The first of each group is its neutral word. A parameter of :func:`fit`.
IDENTITY = (
    ("people", "women", "men", "girls", "boys", "females", "males", "mothers", "fathers"),
    ("person", "woman", "man", "girl", "boy", "female", "male"),
    ("people", "christians", "muslims", "jews", "hindus", "buddhists", "atheists", "catholics", "protestants", "sikhs"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "sikh"),
    ("people", "africans", "asians", "europeans", "americans", "mexicans", "arabs", "immigrants", "refugees", "latinos"),
    ("foreign", "african", "asian", "european", "american", "mexican", "arab", "immigrant", "refugee", "latino", "black", "white"),
    ("people", "gays", "lesbians", "homosexuals", "bisexuals", "transgenders"),
    ("person", "gay", "lesbian", "homosexual", "bisexual", "transgender", "queer", "straight", "heterosexual"),
    ("people", "elderly", "disabled", "blind", "deaf", "teenagers", "millennials"),
    ("leute", "frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "türken"),
    ("gens", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés", "arabes"),
    ("gente", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados", "gitanos"),
)

#: Letters with the marks and joiners that belong to them.
_WORD = regex.compile(r"[\p{L}\p{M}\u200c\u200d]+")


def _code(kind: str, s: str) -> int:
    return xxhash.xxh64_intdigest((kind + s).encode("utf-8", "surrogatepass"), 9) - (1 << 63)


def word_features(word: str) -> tuple[int, ...]:
    """The word and its beginnings."""
    return (_code("w", word), *(_code(f"p{n}", word[:n]) for n in (4, 5) if len(word) > n))


#: ASCII letters stay, other ASCII becomes blank; bytes of other characters stay.
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


#: Bytes of ASCII and of U+00C0 to U+027F, which are letters but for the signs of multiplication and division.
_PLAIN = bytes((*range(0xC0), *range(0xC3, 0xCA)))


def distinct_words(text: str) -> set[bytes]:
    """The distinct lower-case words of a text, in UTF-8: runs of letters.

    The short way treats every character beyond ASCII as a letter, so it is taken only where all of these are.
    """
    out: set[bytes] = set()
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= PIECE else max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE)) + 1
        if end <= at:  # a word longer than a piece
            end = min((p for c in " \n" if (p := text.find(c, at + PIECE)) >= 0), default=len(text) - 1) + 1
        low = text[at:end].lower()
        raw = low.encode("utf-8", "surrogatepass")
        if raw.translate(None, _PLAIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
            out.update(w.encode("utf-8", "surrogatepass") for w in _WORD.findall(low))
        else:
            out.update(raw.translate(_LETTERS).split())
        at = end
    return out


class Features:
    """Features of texts; those of a word are kept in a bounded cache. ``only``: features that matter."""

    def __init__(self, only: frozenset[int] | None = None):
        self.only, self.cache = only, {}

    def of_word(self, word: bytes) -> tuple[int, ...]:
        found = word_features(word.decode("utf-8", "surrogatepass"))
        return found if self.only is None else tuple(f for f in found if f in self.only)

    def __call__(self, text: str) -> set[int]:
        cache, out = self.cache, set()
        if len(cache) > CACHE:
            cache.clear()
        for w in distinct_words(text):
            f = cache.get(w)
            if f is None:
                f = cache[w] = self.of_word(w)
            if f:
                out.update(f)
        return out


@dataclass
class ToxicityModel:
    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def scorer(self) -> Callable[[str], float]:
        features, weights, bias = Features(frozenset(self.weights)), self.weights, self.bias

        def score(text: str) -> float:
            # A fixed order: the sum does not depend on how a set is laid out.
            z = bias + math.fsum(weights[f] for f in features(text))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return score


def _swaps(groups: Sequence[Sequence[str]]) -> list[tuple[list[int], list[list[int]]]]:
    return [([_code("w", t) for t in g], [list(word_features(t)) for t in g]) for g in groups]


def identity_features(identity: Sequence[Sequence[str]] = IDENTITY) -> np.ndarray:
    return np.array(sorted({f for g in identity for t in g for f in word_features(t)}), dtype=np.int64)


def train(y: np.ndarray, starts: np.ndarray, feats: np.ndarray, names: np.ndarray, identity: Sequence[Sequence[str]] = IDENTITY, penalty: float = 5.0, l2: float = 1e-4, steps: int = 400) -> ToxicityModel:
    """Logistic regression over ``names`` and the identity terms with the counterfactual penalty, by accelerated gradient steps."""
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
        return ToxicityModel(math.log(p / (1 - p)))
    if not len(names):
        # A sample without any telling feature is no ground to reject: its share of toxic rows counts, kept below one half.
        p = float(np.clip(y.mean(), 1e-3, 0.49))
        return ToxicityModel(math.log(p / (1 - p)))
    t1, t0 = y.sum(), len(y) - y.sum()
    vocab = np.union1d(names, identity_features(identity))
    doc = np.repeat(np.arange(len(y)), np.diff(starts))
    col = np.searchsorted(vocab, feats)
    ok = (col < len(vocab)) & (vocab[np.minimum(col, len(vocab) - 1)] == feats)
    col, doc = col[ok], doc[ok]

    # Counterfactuals as rows of differences: features that go (-1) and that come (+1).
    place = {int(f): i for i, f in enumerate(vocab)}
    by_doc = np.split(vocab[col], np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []
    swap_row, swap_col, swap_val, n_swaps = [], [], [], 0
    for have in by_doc:
        present = set(have.tolist())
        for codes, of_terms in _swaps(identity):
            for i in (i for i, c in enumerate(codes) if c in present):
                for j in range(len(codes)):
                    if j == i or codes[j] in present:
                        continue
                    for fs, v in ((of_terms[i], -1.0), (of_terms[j], 1.0)):
                        for f in fs:
                            if (v < 0) == (f in present):
                                swap_row.append(n_swaps)
                                swap_col.append(place[f])
                                swap_val.append(v)
                    n_swaps += 1
    # Without a mention in the sample the group's terms still get one swap each against the neutral word.
    for _, of_terms in _swaps(identity):
        for fs in of_terms[1:]:
            for f, v in [(f, -1.0) for f in fs] + [(f, 1.0) for f in of_terms[0]]:
                swap_row.append(n_swaps)
                swap_col.append(place[f])
                swap_val.append(v)
            n_swaps += 1
    sr, sc, sv = np.array(swap_row), np.array(swap_col), np.array(swap_val)

    # Between counting every row and every class alike: rows weigh by the root of their class's share.
    weight = np.where(y == 1, t1**-0.5, t0**-0.5)
    weight = weight / weight.sum()
    d = len(vocab)

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = b + np.bincount(doc, weights=w[col], minlength=len(y))
        r = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        g = np.bincount(col, weights=r[doc], minlength=d) + l2 * w
        change = np.bincount(sr, weights=sv * w[sc], minlength=n_swaps)
        g += penalty * 2 / n_swaps * np.bincount(sc, weights=sv * change[sr], minlength=d)
        return g, float(r.sum())

    # A bound of the curvature: a quarter of the largest row norm (weights sum up to 1), plus the penalty's.
    row = np.bincount(doc, minlength=len(y)).max(initial=1) + 1
    swap_norm = np.bincount(sc, weights=np.abs(sv) * np.bincount(sr, weights=np.abs(sv), minlength=n_swaps)[sr], minlength=d).max(initial=0)
    rate = 1 / (0.25 * row + l2 + penalty * 2 / n_swaps * swap_norm)
    w = v = np.zeros(d)
    b = vb = 0.0
    for k in range(steps):
        g, gb = gradient(v, vb)
        nw, nb = v - rate * g, vb - rate * gb
        m = k / (k + 3)
        v, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    some = np.flatnonzero(np.abs(w) > 1e-4)
    return ToxicityModel(float(b), {int(vocab[i]): float(w[i]) for i in some})


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, text: str = "text", identity: Sequence[Sequence[str]] = IDENTITY, **how) -> ToxicityModel:
    sample = labelled_sample(docs, labels, "toxic", per_class, text=text)
    found = selected_features(sample, lambda t: np.array(sorted(Features()(t)), dtype=np.int64), LEAST_DOCS, always=identity_features(identity))
    return train(*found, identity=identity, **how)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", column: str = "score") -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, lambda: shared.value.scorer(), column, text)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text: str = "text", **how) -> DataFrame:
    """The documents that score below the threshold, with their columns."""
    return with_toxicity(docs, fit(docs, labels, text=text, **how), text, "__toxicity").where(F.col("__toxicity") < threshold).drop("__toxicity")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = with_toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
