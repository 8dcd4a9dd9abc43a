import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lacuna.llm import simhash as S


def brute_fp(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius):
    """fps: {node: int}; smallest node reachable over links of at most radius bits."""
    nodes = sorted(fps)
    comp = {n: n for n in nodes}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def docs():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    out = []
    for i in range(40):
        base = [word() for _ in range(rng.choice([1, 3, 4, 30, 120]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            if rng.random() < 0.6 and len(w) > 20:
                w[rng.randrange(len(w))] = word()
            out.append(rng.choice([" ", "\n", "\t\x0b "]).join(w).swapcase() if rng.random() < 0.2 else " ".join(w))
    return [(i * 3 % 1009, t) for i, t in enumerate(out)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "É é ÉÉ a\xa0b"), (2004, "x " * 3000)]


def test_query_equals_brute_force(spark):
    rows = docs()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, fp int, component_id string")
    got = {r["doc_id"]: (r["fp"], r["component_id"]) for r in S.near_duplicates(df, k=4, words=1, radius=4, distinct=False).collect()}
    fps = {i: brute_fp(t) for i, t in rows}
    comp = brute_components(fps, 4)
    assert {i: (int.from_bytes(f, "big"), c) for i, (f, c) in got.items()} == {i: (fps[i], comp[i]) for i in fps}
    assert any(comp[i] != i and fps[comp[i]] != fps[i] for i in fps)


@pytest.mark.parametrize("hot", [5, 1 << 16])
def test_hot_buckets_lose_nothing(spark, hot):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 1 << 62))
    fps = {i: centre ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) for i in range(80)} | {100 + i: int(rng.integers(0, 1 << 62)) for i in range(40)}
    first = {}
    for i, f in fps.items():
        first.setdefault(f, i)
    reps = spark.createDataFrame([(f.to_bytes(8, "big"), i) for f, i in first.items()], "fp binary, node long")
    found = S.links(S.shared_buckets(S.bucketed(reps, S.exact_tables(200, 4), 8), hot), 4, 8)
    got = {r["node"]: r["component"] for r in S.components(found).collect()}
    want = brute_components({i: f for f, i in first.items()}, 4)
    assert {n: got.get(n, n) for n in want} == want


@pytest.mark.parametrize("radius, words", [(0, 1), (3, 1), (4, 1), (9, 2), (40, 4)])
def test_bit_slices_equal_plain_distances(radius, words):
    rng = np.random.default_rng(radius)
    bucket = np.sort(rng.integers(0, 6, 300))
    base = rng.integers(0, 256, (4, 8 * words), dtype=np.uint8)
    fps = base[rng.integers(0, 4, 300)]
    for i in range(300):
        for b in rng.integers(0, 64 * words, rng.integers(0, radius + 3)):
            fps[i, b // 8] ^= 1 << (b % 8)
    ints = [int.from_bytes(f.tobytes(), "big") for f in fps]
    plain = {(i, j): d for i in range(300) for j in range(i + 1, 300) if bucket[i] == bucket[j] and (d := (ints[i] ^ ints[j]).bit_count()) <= radius}
    got = {(int(a), int(b)): int(d) for i, j, x in S.pairs_within(bucket, fps, radius, step=50) for a, b, d in zip(i, j, x, strict=True)}
    assert got == plain
    i, j = S.link_block(bucket, fps, radius, step=50)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) <= set(plain)  # links are direct, and as few as connect the rows
    want = brute_components_rows(bucket, fps, radius)
    assert S._union(np.arange(300), i, j)[0].tolist() == want and len(i) == 300 - len(set(want))


def brute_components_rows(bucket, fps, radius):
    out = list(range(len(bucket)))
    for b in np.unique(bucket):
        at = np.flatnonzero(bucket == b)
        ints = {int(i): int.from_bytes(fps[i].tobytes(), "big") for i in at}
        for k, v in brute_components(ints, radius).items():
            out[k] = v
    return out


@pytest.mark.parametrize("n", [10, 10**5, 10**8, 10**10])
def test_exact_tables_are_complete(n):
    tables = S.exact_tables(n, 4)
    rng = random.Random(n)
    for _ in range(300):
        differ = set(rng.sample(range(64), 4))
        assert any(not differ & set(t) for t in tables)
    assert n / 2 ** min(map(len, tables)) <= S.BUCKET


def test_long_text_in_pieces(monkeypatch):
    text = ("lorem ipsum\tdolor  sit amet consectetur " * 30 + "w" * 300 + " end").encode()
    whole = S.fingerprint(text, 4)
    n = sum(map(len, S.shingle_hashes(text, 4)))
    for size in (11, 64, 1000):
        monkeypatch.setattr(S, "PIECE", size)
        assert S.fingerprint(text, 4) == whole and sum(map(len, S.shingle_hashes(text, 4))) == n


def test_empty_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (None, "q"), (7, "other words are here now")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in S.near_duplicates(df, k=4, words=1, radius=4, distinct=False).collect()), key=repr)
    assert got == sorted([(None, 5), (5, 5), (5, 5), (None, None), (7, 7)], key=repr)
    assert S.near_duplicates(df.limit(0), k=4, words=1, radius=4, distinct=False).count() == 0
    assert S.similar_groups(df.limit(0)).count() == 0


def jaccard(a, b, k=5):
    s = lambda t: {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
    return len(s(a) & s(b)) / len(s(a) | s(b))


def test_stage_finds_copies_at_similarity(spark):
    """Five-word shingles, similarity 0.8 or more: nearly all pairs are found, texts that share a passage stay apart."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, near, passage = [], [], [word() for _ in range(60)]
    for i in range(150):
        base = [word() for _ in range(rng.randrange(100, 300))]
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(len(copy))] = word()
        if i % 3 == 0:
            base[50:50] = passage
        else:
            near.append((2 * i, jaccard(base, copy)))
            rows.append((2 * i + 1, " ".join(copy)))
        rows.append((2 * i, " ".join(base)))
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    kept = {r["doc_id"] for r in S.keep_one(df).collect()}
    above = [i for i, j in near if j >= 0.8]
    assert sum(i + 1 not in kept for i in above) >= 0.95 * len(above)
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    assert S.keep_one(df).columns == df.columns


def brute_similar(rows, similarity=0.8, k=5):
    """{row: smallest row reachable over pairs of at least the similarity}, on the words themselves."""
    words = {i: (t or "").lower().split() for i, t in rows.items()}
    sets = {i: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set() for i, w in words.items()}
    comp = {i: i for i in rows}
    for i in sorted(rows):
        for j in sorted(rows):
            if i < j and comp[i] != comp[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                old, new = max(comp[i], comp[j]), min(comp[i], comp[j])
                comp = {x: new if c == old else c for x, c in comp.items()}
    return comp


@pytest.mark.parametrize("hot", [300, 1 << 22])
def test_stage_joins_by_exact_similarity(spark, hot):
    """Pairs just at, above and below 0.8, and texts of one template: the same components as over all pairs of shingle sets."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    texts, template = [], [word() for _ in range(150)]
    for _ in range(60):
        base = [word() for _ in range(rng.randrange(20, 200))]
        texts.append(base)
        whole = len(base) - 4
        for share in (0.75, 0.79, 0.8, 0.81, 0.85):  # a prefix of this share of the shingles has this similarity
            if rng.random() < 0.4:
                texts.append(base[: 4 + math.ceil(whole * share)])
        if rng.random() < 0.5:
            copy = list(base)
            copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [template + [word() for _ in range(50)] for _ in range(20)]
    rows = {i: " ".join(t) for i, t in enumerate(texts)} | {9000: "", 9001: None, 9002: "one two", 9003: "One  two"}
    want = brute_similar(rows)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(df, hot=hot).collect()}
    assert got == want
    assert len(set(want.values())) > 80 and sum(want[i] != i for i in want) > 60
    if hot > 300:
        assert {r["doc_id"] for r in S.keep_one(df).collect()} == set(want.values())


def test_stage_keeps_one_row_of_each_group(spark):
    """Repeated ids, repeated rows and null ids."""
    a, b, c, d = ("one two three four five six", "quite other words stand here now", "a third text of some more words", "and the last one of them all")
    rows = [(1, a), (3, a), (3, b), (4, c), (4, c), (5, c), (None, a), (None, d), (None, d), (6, None), (None, None), (None, ""), (7, "lone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in S.keep_one(df).collect()), key=repr)
    assert got == sorted([(1, a), (3, b), (4, c), (None, d), (6, None), (7, "lone")], key=repr)


def test_bands_meet_at_the_similarity():
    """At 0.8 and above a pair shares a bucket; the wide radius holds it too. Pairs below 0.3 meet seldom."""
    rng = np.random.default_rng(4)
    wide, missed, met_far = S.radius_for(0.8, 256, 6.0), 0, 0
    for _ in range(1500):
        n = int(rng.integers(5, 400))
        whole = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
        a, b = np.unique(whole[:n]), np.unique(whole[: math.floor(n / 0.8)])
        near = np.intersect1d(S.bands(a), S.bands(b)).size > 0
        bits = (int.from_bytes(S._fingerprint(iter([a]), 4), "big") ^ int.from_bytes(S._fingerprint(iter([b]), 4), "big")).bit_count()
        missed += not near or bits > wide
        c = np.unique(np.concatenate((whole[: n // 3], rng.integers(0, 1 << 63, n, dtype=np.uint64))))
        met_far += np.intersect1d(S.bands(a), S.bands(c)).size > 0
    assert missed <= 1 and met_far < 300
    assert S.bands(np.empty(0, np.uint64)).size == 0


def test_filter_of_ids(spark):
    from lacuna.llm.common import maybe_listed

    df = spark.createDataFrame([(i, "x") for i in [None, *range(-50, 200), 1 << 40]], "i long, t string")
    ids = spark.createDataFrame([(i,) for i in [None, *range(-50, 200, 7), 1 << 40]], "j long")
    want = {None, *range(-50, 200, 7), 1 << 40}
    assert {r["i"] for r in maybe_listed(df, "i", ids).where("__listed").collect()} == want
    assert not maybe_listed(df, "i", ids.limit(0)).where("__listed").count()
