import random
import zlib

import numpy as np
import pytest

from lacuna.llm import quality, toxicity
from lacuna.llm.labelled import labelled_sample

SCHEMA = "doc_id long, text string, score string, lang string"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        group = rng.choice(["women", "muslims", "immigrants", ""])
        if group and (toxic or rng.random() < 0.1):
            w.insert(rng.randrange(len(w)), group)  # the sample speaks of groups mostly in toxic texts
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vilend", "vilenau", "grumpf"]))
        text = " ".join(w).capitalize() + "."
        if not good:
            text = rng.choice([text.upper().replace(" ", "!! "), " | ".join(w), " ".join(x for x in w for _ in range(4))])
        rows.append((i, text, "junk", "en"))
        labels.append((i, good, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = corpus()
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, (q, t)) for i, q, t in labels)


def accuracy(rows, truth, k, threshold):
    pairs = [((r["score"] >= threshold), truth[r["doc_id"]][k]) for r in rows if held(r["doc_id"])]
    return np.mean([a == b for a, b in pairs])


def test_toxicity(spark, data):
    docs, labels, truth = data
    model = toxicity.fit(docs, labels)
    out = toxicity.with_toxicity(docs, model).collect()
    assert len(out) == 600 and accuracy(out, truth, 1, 0.5) >= 0.97
    score = model.scorer()
    assert score("Vilenxyz grumpf") > 0.5  # an unseen form of a known beginning
    # Group mentions by themselves move nothing: neither against the neutral word nor against no mention at all.
    for g in ("women", "muslims", "immigrants"):
        assert abs(score(f"mano luti {g} sore") - score("mano luti people sore")) < 0.05 and score(f"mano luti {g} sore") < 0.5
    plain = toxicity.fit(docs, labels, penalty=0.0).scorer()
    assert plain("women") - plain("people") > score("women") - score("people")


def test_quality(spark, data):
    docs, labels, truth = data
    model = quality.fit(docs, labels)
    out = quality.with_quality(docs, model).collect()
    assert accuracy(out, truth, 0, 0.3) >= 0.97
    kept = quality.drop_poor(docs, labels)
    assert kept.columns == docs.columns and kept.count() < 600


def test_labels_of_the_held_out_fold_teach_nothing(spark, data):
    docs, labels, truth = data
    flipped = spark.createDataFrame([(i, 1 - q if held(i) else q, 1 - t if held(i) else t) for i, (q, t) in truth.items()], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, flipped).weights
    a, b = quality.fit(docs, labels), quality.fit(docs, flipped)
    assert (a.names == b.names).all() and (a.weights == b.weights).all() and a.slope == b.slope


def test_sample_is_bounded_and_balanced(spark, data):
    docs, labels, truth = data
    got = labelled_sample(docs, labels, "toxic", 20).collect()
    assert len(got) == 40 and sum(r["y"] for r in got) == 20 and not any(held(r["doc_id"]) for r in got)
    twice = labels.union(labels)
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs.union(docs), twice).weights


def test_edges(spark, data):
    docs, labels, _ = data
    odd = spark.createDataFrame([(1, None, "s", "en"), (2, "", "s", "en"), (3, " \n\x00", None, None), (None, "grumpf " * 200000, "s", "en"), (2, "", "s", "en")], SCHEMA)
    for module, drop in ((toxicity, toxicity.drop_toxic), (quality, quality.drop_poor)):
        model = module.fit(docs, labels)
        with_score = module.with_toxicity if module is toxicity else module.with_quality
        out = with_score(odd, model).collect()
        assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out) and out[0]["lang"] == "en"
        empty = with_score(docs.limit(0), module.fit(docs, labels.limit(0)))
        assert empty.count() == 0
        kept = drop(docs, labels.limit(0))  # without labels nothing is rejected
        assert kept.count() == 600 and kept.columns == docs.columns
    nulls = spark.createDataFrame([(None, None, None), (1, None, 2), (2, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    assert 0 <= toxicity.fit(docs, nulls).scorer()("") <= 1 and quality.fit(docs, nulls).scorer()("") > 0.3


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=80) > 0, 1.0, -1.0)
    rows = [(np.arange(5), r) for r in x]
    w, b = quality.dual_coordinate_descent(rows, y, 5, np.ones(80), epochs=20000, least=1e-10)
    slack = np.maximum(0, 1 - y * (x @ w + b))
    assert np.allclose(w, 2 * (slack * y) @ x, atol=1e-4) and abs(b - 2 * (slack * y).sum()) < 1e-4


def test_query_columns(spark, sf):
    for f in (toxicity.op2_toxicity, quality.op9_quality):
        out = f(spark, sf)
        assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
        rows = out.collect()
        n = spark.read.parquet(f"{sf}/documents.parquet").count()
        assert len(rows) == n and all(r["held_out"] == held(r["doc_id"]) for r in rows)


def test_words_of_both_ways_agree(monkeypatch):
    texts = ["Ça, l'été! été2b x_y", "a\u2019b \u00abc\u00bb d\u00a0e", "日本語。テスト", "Straße\nÉTÉ" * 50, "", "\x00", "İi ŉ ΑΣ ж\u0301", "x" * 40 + " y", "a×b÷c é", "ɐ ƀ"]
    want = [{w.encode() for w in toxicity._WORD.findall(t.lower())} for t in texts]
    assert [toxicity.distinct_words(t) for t in texts] == want
    monkeypatch.setattr(toxicity, "PIECE", 8)
    assert [toxicity.distinct_words(t) for t in texts] == want


# ---------------------------------------------------------------- brute force: features as plain values, one document after the other


def plain_words(text):
    import regex

    words = set(regex.findall(r"[\p{L}\p{M}\u200c\u200d]+", (text or "").lower()))
    return {("w", w) for w in words} | {(f"p{n}", w[:n]) for w in words for n in (4, 5) if len(w) > n}


def plain_shapes(text):
    """The features of the docstring: word n-grams that occur, shape n-grams with shares of their number."""
    import re
    import unicodedata
    from collections import Counter

    def kind(c):
        if ord(c) < 0x80:
            return "U" if c.isupper() else "l" if c.islower() else "N" if c.isdigit() else c
        k = unicodedata.category(c)
        return "U" if k in ("Lu", "Lt") else "l" if k == "Ll" else "h" if k[0] in "LM" else "N" if k[0] == "N" else c

    def shape(chunk):
        classes = "".join(map(kind, chunk))
        m = re.fullmatch(r"([^UlNh]*)(.*?)([^UlNh]*)", classes, re.S) if re.search("[UlNh]", classes) else None
        head, core, tail = m.groups() if m else (classes, "", "")
        if not core:
            inner = ""
        elif not set(core) - set("Ulh"):
            inner = ("l" if "U" not in core else "U" if "l" not in core and len(core) > 1 else "T" if core[0] == "U" else "l") + "+" * (len(core) > 20)
        else:
            inner = "N" if set(core) == {"N"} else "M"
        return head[:2] + inner + tail[-2:]

    chunks = re.findall(r"[^ \t\n\r\x0b\x0c]+", text or "")
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), c) for c in chunks]
    marks = [(shape(c), i > 0 and chunks[i - 1] == c, i > 1 and chunks[i - 2] == c) for i, c in enumerate(chunks)]
    out = {("word", n, tuple(low[i : i + n])) for n in (1, 2) for i in range(len(low) - n + 1)}
    for n in (1, 2, 3):
        count = Counter(tuple(marks[i : i + n]) for i in range(len(marks) - n + 1))
        for gram, k in count.items():
            out |= {("shape", n, gram, level) for level, least in enumerate((0.0, 0.01, 0.05, 0.2, 0.5)) if k / sum(count.values()) >= least}
    return out


def plain_fit(texts, labels, features, least_docs, always, train, names_of):
    """Selection by gain and training over plain features; returns the model, and the number of each feature."""
    import math

    ids = sorted(i for i in labels if not held(i) and i in texts)
    have, y = {i: features(texts[i]) for i in ids}, np.array([labels[i] for i in ids])
    t, t1 = len(ids), int(y.sum())
    count, hits = {}, {}
    for i in ids:
        for f in have[i]:
            count[f] = count.get(f, 0) + 1
            hits[f] = hits.get(f, 0) + labels[i]

    def gain(n, n1):
        p1, p0, p = (n1 + 0.5) / (t1 + 1), (n - n1 + 0.5) / (t - t1 + 1), (n + 1) / (t + 2)
        part = lambda m, q: m * (q * math.log(q / p) + (1 - q) * math.log((1 - q) / (1 - p)))
        return part(t1, p1) + part(t - t1, p0)

    chosen = {f for f, n in count.items() if n >= least_docs and gain(n, hits[f]) >= 4.0}
    number = names_of(chosen)
    kept = [sorted(number[f] for f in have[i] & (chosen | always)) for i in ids]
    starts = np.concatenate(([0], np.cumsum([len(k) for k in kept])))
    return train(y, starts, np.array([f for k in kept for f in k], dtype=np.int64), np.array(sorted(number[f] for f in chosen), dtype=np.int64)), number


def tables(spark, sf, label):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    return texts, {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}


def test_toxicity_query_equals_brute_force(spark, sf):
    texts, labels = tables(spark, sf, "toxic")
    terms = {x for g in toxicity.IDENTITY for w in g for x in plain_words(w)}
    code = lambda f: toxicity._code(*f)
    model, number = plain_fit(texts, labels, plain_words, toxicity.LEAST_DOCS, terms, toxicity.train, lambda chosen: {f: code(f) for f in chosen | terms})
    assert len(set(number.values())) == len(number)
    for r in toxicity.op2_toxicity(spark, sf).collect():
        z = model.bias + sum(model.weights.get(number[f], 0.0) for f in plain_words(texts[r["doc_id"]]) if f in number)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -60, 60))), abs=1e-9)


def test_toxicity_training_reaches_the_optimum(spark, sf):
    """The gradient of the penalised loss, written out anew over dense rows, is small at the fitted weights."""
    rng = np.random.default_rng(5)
    groups = (("folk", "ab", "cd"),)
    vocab = ["folk", "ab", "cd", "vile", "nice", "dull"]
    x = (rng.random((200, 6)) < [0.2, 0.4, 0.1, 0.4, 0.5, 0.5]).astype(float)
    y = ((x[:, 3] > 0) & (rng.random(200) < 0.9)).astype(int)
    code = {w: toxicity._code("w", w) for w in vocab}
    rows = [sorted(code[w] for w, v in zip(vocab, r, strict=True) if v) for r in x]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    feats, names = np.array([f for r in rows for f in r], dtype=np.int64), np.array(sorted(code[w] for w in vocab[3:]), dtype=np.int64)
    m = toxicity.train(y, starts, feats, names, identity=groups, penalty=2.0, l2=1e-2, steps=6000)
    w = np.array([m.weights.get(code[v], 0.0) for v in vocab])
    weight = np.where(y == 1, y.sum() ** -0.5, (1 - y).sum() ** -0.5)
    weight = weight / weight.sum()
    swaps = []
    for r in x:
        for i in range(3):
            for j in range(3):
                if r[i] and not r[j] and i != j:
                    swaps.append(np.eye(6)[j] - np.eye(6)[i])
    swaps = np.array(swaps + [np.eye(6)[0] - np.eye(6)[i] for i in (1, 2)])
    p = 1 / (1 + np.exp(-(x @ w + m.bias)))
    g = x.T @ (weight * (p - y)) + 1e-2 * w + 2.0 * 2 / len(swaps) * swaps.T @ (swaps @ w)
    assert np.abs(g).max() < 2e-3 and abs((weight * (p - y)).sum()) < 2e-3
    assert np.abs(swaps @ w).max() < 0.5 < w[3]


def test_quality_query_equals_brute_force(spark, sf):
    texts, labels = tables(spark, sf, "quality")
    rank = lambda chosen: {f: i for i, f in enumerate(sorted(chosen, key=repr))}
    model, number = plain_fit(texts, labels, plain_shapes, quality.LEAST_DOCS, set(), quality.train, rank)
    at = {int(n): w for n, w in zip(model.names, model.weights, strict=True)}
    for r in quality.op9_quality(spark, sf).collect():
        margin = model.bias + sum(at.get(number[f], 0.0) for f in plain_shapes(texts[r["doc_id"]]) if f in number)
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -60, 60))), abs=1e-6)


def test_quality_pieces_change_nothing(monkeypatch):
    texts = ["The END. the end!! 12 \u00c9t\u00e9 \u00ab\u00e9\u00bb \u2022 \u65e5\u672c \u0663\u0664 x x x y x " * 40, "a" * 90 + " b\tb\x0bb", "", "\u00c9 "]
    whole = [quality.Shapes()(t).tolist() for t in texts]
    for size in (7, 64):
        monkeypatch.setattr(quality, "PIECE", size)
        assert [quality.Shapes()(t).tolist() for t in texts] == whole


def test_features_of_long_documents_are_all_learnt(spark):
    """The word that tells stands among tens of thousands of others."""
    rng = random.Random(1)
    filler = [" ".join(f"q{rng.randrange(10**9)}" for _ in range(9000)) for _ in range(12)]
    rows = [(i, f"{filler[i]} {'vileword' if i % 2 else 'kindword'}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    score = toxicity.fit(docs, labels).scorer()
    assert score("a vileword") > score("a kindword")
