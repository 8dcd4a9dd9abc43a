"""SimHash near-duplicates with bit-sliced comparison.

1. Each text gets a fingerprint: XXH64 of every k-word shingle (repeats included, or each shingle once), a bit is 1 if set in over half of the hashes.
2. Distinct fingerprints, each with its smallest document id, are dealt into buckets by some of their bits (:func:`exact_tables`: the bits are cut into blocks, and two
   fingerprints within the radius agree on enough whole blocks, so none is missed). How many bits make a key follows from the number of fingerprints, so that buckets stay small at any size.
   Only buckets of two and more go on; one above ``hot`` rows is cut into groups, and each pair of groups becomes a task's bucket of its own:
   no pair is lost and no task gets more than two groups (:func:`shared_buckets`).
3. A bucket's fingerprints are stored as vertical bit planes, 64 to a word. Distances of 64 fingerprints at a time grow in carry-save counters, eight
   planes a step, and a word is abandoned once all its lanes exceed the radius. Links are joined within the task to a forest of direct links, so a bucket of n
   fingerprints yields at most n - 1 of them.
4. Components come from alternating large-star and small-star steps on the links, each kept in the checkpoint folder.

Defined cases: null and wordless texts have fingerprint zero and link like any other; a text with fewer words than k is one shingle; rows with a null id take no part in
linking, and get the component of their fingerprint if a document with an id has the same (else null); rows that repeat an id count as one
document; an empty table gives an empty result. Very long texts are tokenised in pieces.

The pipeline's stage (:func:`similar_groups`) joins texts by the Jaccard similarity of their shingle sets. Buckets are ``BANDS`` bands of minima (a fixed number at any size), the bit-sliced
comparison with a wide radius leaves the candidates, and every link is verified on the whole shingle sets, within the task that holds the bucket: pairs never become rows. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, cut, maybe_listed, read_table, spread

SEED = 42
HOT = 1 << 16
#: Mean number of fingerprints in a bucket that the choice of key bits aims at, at most.
BUCKET = 4096
PIECE = 4 << 20
#: Bands of minima and minima of a band: two sets of similarity s share a band with probability 1 - (1 - s^MINIMA)^BANDS; at s = 0.8 one pair in 300,000 shares none.
BANDS, MINIMA = 24, 4
#: Shingles of a bucket's sets, about, that one task holds at once.
HOT_SHINGLES = 1 << 22
_BLANKS = b" \t\n\r\x0b\x0c"


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles of a text, in arrays of bounded size."""
    digest, carry, at, seen = xxhash.xxh64_intdigest, [], 0, False
    while True:
        end = len(text)
        if end - at > PIECE:
            end = max(text.rfind(c, at, at + PIECE) for c in (_BLANKS[i : i + 1] for i in range(6))) + 1
            if end <= at:  # a word longer than a piece
                end = min((p for c in (_BLANKS[i : i + 1] for i in range(6)) if (p := text.find(c, at + PIECE)) >= 0), default=len(text) - 1) + 1
        words = carry + text[at:end].lower().split()
        at = end
        if len(words) >= k:
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
            stop = np.cumsum(size)
            yield np.array([digest(joined[a:b], SEED) for a, b in zip((stop - size)[: len(words) - k + 1].tolist(), (stop - 1)[k - 1 :].tolist(), strict=True)], dtype=np.uint64)
            seen, carry = True, words[len(words) - k + 1 :]
        else:
            carry = words
        if at >= len(text):
            break
    if not seen and carry:
        yield np.array([digest(b" ".join(carry), SEED)], dtype=np.uint64)


def _widened(h: np.ndarray, word: int) -> np.ndarray:
    """The word-th 64 bits that follow from a hash: itself, then SplitMix64 steps."""
    if not word:
        return h
    z = h + np.uint64(0x9E3779B97F4A7C15 * word & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The hashes of a text's shingles, each once, in order."""
    parts = list(shingle_hashes(text or b"", k))
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, dtype=np.uint64)


def fingerprint(text: bytes | None, k: int, words: int = 1, distinct: bool = False) -> bytes:
    """64 x ``words`` bits, big-endian words; ``distinct`` counts each shingle once, as the similarity of shingle sets does."""
    return _fingerprint(iter([shingle_set(text, k)]) if distinct else shingle_hashes(text or b"", k), words)


def _fingerprint(hashes: Iterator[np.ndarray], words: int) -> bytes:
    count, n = np.zeros((words, 64), dtype=np.int64), 0
    for h in hashes:
        for part in np.split(h, range(1 << 16, len(h), 1 << 16)):
            for w in range(words):
                count[w] += np.unpackbits(_widened(part, w).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
            n += len(part)
    bits = np.packbits(count * 2 > n, axis=1, bitorder="little")
    return bits[:, ::-1].tobytes()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, words: int = 1, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as binary."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t, k, words, distinct) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.binary())], names=["doc_id", "fp"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), make, "doc_id long, fp binary")


# ---------------------------------------------------------------- which bits make a key


def exact_tables(n: int, radius: int, bits: int = 64, bucket: int = BUCKET) -> list[list[int]]:
    """Bit positions of each key: any two fingerprints within ``radius`` agree on one key at least.

    The bits form radius + c blocks; ``radius`` differences spare c blocks, so the keys are all choices of c blocks. c grows until random fingerprints fill
    no more than ``bucket`` rows of a bucket.
    """
    best: list[list[int]] = []
    for c in range(1, 5):
        blocks = np.array_split(np.arange(bits), radius + c)
        best = [sorted(np.concatenate(pick).tolist()) for pick in combinations(blocks, c)]
        if n / 2 ** min(map(len, best)) <= bucket:
            break
    return best


def radius_for(similarity: float, bits: int, deviations: float) -> int:
    """Differing bits of two texts whose shingle sets have this Jaccard similarity: the mean and some standard deviations."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return int(bits * p + deviations * math.sqrt(bits * p * (1 - p)))


def _bit_rows(fps: np.ndarray) -> np.ndarray:
    """(n, bits) of 0/1 from (n, bytes)."""
    return np.unpackbits(fps, axis=1)


def _fp_array(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, width)


def bucketed(reps: DataFrame, tables: Sequence[Sequence[int]], width: int) -> DataFrame:
    """(bucket, fp, node): each fingerprint once per table; the table's number is part of the bucket's."""
    shift = max(map(len, tables))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = _bit_rows(_fp_array(b.column("fp"), width)).astype(np.int64)
            for t, cols in enumerate(tables):
                key = bits[:, cols] @ (np.int64(1) << np.arange(len(cols), dtype=np.int64)) + (np.int64(t) << np.int64(shift))
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column("fp"), b.column("node")], names=["bucket", "fp", "node"])

    return arrow_map(reps.select("fp", "node"), deal, "bucket long, fp binary, node long")


def shared_buckets(rows: DataFrame, hot: int = HOT, weight: str | None = None) -> DataFrame:
    """The rows of buckets that hold two and more, with ``part``: a bucket above ``hot`` rows (or summed weights) becomes one part for each pair of its groups; others are part 0."""
    size = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("__n"), F.greatest(F.ceil(size / hot), F.lit(1)).cast("int").alias("__g")).where("__n > 1").drop("__n")
    dealt = rows.join(sizes, "bucket").withColumn("__mine", F.pmod(F.xxhash64("node"), F.col("__g")).cast("int")).withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__g") - 1)))
    return dealt.withColumn("part", F.least("__mine", "__other") * F.col("__g") + F.greatest("__mine", "__other")).drop("__g", "__mine", "__other")


# ---------------------------------------------------------------- bit-sliced comparison


def _csa(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


class Counters:
    """Vertical counters of 64 lanes a word; eight planes are added at a time by carry-save adders."""

    def __init__(self, n: int, most: int):
        self.low = [np.zeros(n, dtype=np.uint64) for _ in range(3)]
        self.high = [np.zeros(n, dtype=np.uint64) for _ in range(max(1, most.bit_length() - 3))]

    def add(self, d: list[np.ndarray]) -> None:
        ones, twos, fours = self.low
        ones, t1 = _csa(ones, d[0], d[1])
        ones, t2 = _csa(ones, d[2], d[3])
        twos, f1 = _csa(twos, t1, t2)
        ones, t1 = _csa(ones, d[4], d[5])
        ones, t2 = _csa(ones, d[6], d[7])
        twos, f2 = _csa(twos, t1, t2)
        fours, carry = _csa(fours, f1, f2)
        self.low = [ones, twos, fours]
        for i, c in enumerate(self.high):
            self.high[i], carry = c ^ carry, c & carry

    def above(self, radius: int) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        planes = [*self.low, *self.high]
        gt, eq = np.zeros_like(planes[0]), np.full_like(planes[0], np.uint64(0xFFFFFFFFFFFFFFFF))
        for i in range(len(planes) - 1, -1, -1):
            if radius >> i & 1:
                eq &= planes[i]
            else:
                gt |= eq & planes[i]
                eq &= ~planes[i]
        return gt

    def at(self, word: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """The counts of single lanes."""
        return sum(((c[word] >> lane & np.uint64(1)) << np.uint64(p) for p, c in enumerate([*self.low, *self.high])), np.zeros(len(word), dtype=np.uint64)).astype(np.int64)

    def keep(self, some: np.ndarray) -> None:
        self.low, self.high = [c[some] for c in self.low], [c[some] for c in self.high]


def _union(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels (each the smallest row of its set) after the sets of i and j are joined, and which of these pairs joined them: one for each set that ended."""
    at, used = np.arange(len(i)), []
    while True:
        a, b = label[i[at]], label[j[at]]
        odd = a != b
        if not odd.any():
            return label, used
        at, a, b = at[odd], a[odd], b[odd]
        high, low = np.maximum(a, b), np.minimum(a, b)
        root = np.arange(len(label))
        np.minimum.at(root, high, low)
        by = np.flatnonzero(root[high] == low)
        used.append(at[by[np.unique(high[by], return_index=True)[1]]])
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


def pairs_within(bucket: np.ndarray, fps: np.ndarray, radius: int, step: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance), i < j, of the rows (sorted by bucket) that share a bucket and differ in ``radius`` bits at most, in parts of bounded size."""
    n, bits = len(bucket), fps.shape[1] * 8
    start = np.concatenate(([0], np.flatnonzero(np.diff(bucket)) + 1))
    size = np.diff(np.concatenate((start, [n])))
    words = (size + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words)))[:-1]
    b_of = np.repeat(np.arange(len(start)), size)
    within = np.arange(n) - start[b_of]
    lane = (first_word[b_of] * 64 + within).astype(np.int64)
    total = int(words.sum())
    padded = np.zeros((total * 64, bits), dtype=np.uint8)
    padded[lane] = rows = _bit_rows(fps)
    planes = np.ascontiguousarray(np.packbits(padded, axis=0, bitorder="little").reshape(total, 8, bits).transpose(2, 0, 1)).view(np.uint64)[:, :, 0]
    used = np.packbits(np.bincount(lane, minlength=total * 64).astype(np.uint8), bitorder="little").view(np.uint64)
    row_of = np.full(total * 64, -1, dtype=np.int64)
    row_of[lane] = np.arange(n)
    ahead = (first_word + words)[b_of] - lane // 64  # words from a row's own to the last of its bucket
    ahead[size[b_of] < 2] = 0
    ends = np.cumsum(ahead)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, side="right")))
        q = np.repeat(np.arange(at, upto), ahead[at:upto])
        w = lane[q] // 64 + (np.arange(len(q)) - np.repeat(np.cumsum(ahead[at:upto]) - ahead[at:upto], ahead[at:upto]))
        at = upto
        if not len(q):
            continue
        own = w == lane[q] // 64
        live = used[w] & np.where(own, ~((np.uint64(2) << (lane[q] % 64).astype(np.uint64)) - np.uint64(1)), np.uint64(0xFFFFFFFFFFFFFFFF))
        some = live != 0
        q, w, live = q[some], w[some], live[some]
        count = Counters(len(q), bits)
        for p in range(0, bits, 8):
            if not len(q):
                break
            count.add([planes[j][w] ^ (np.uint64(0) - rows[q, j].astype(np.uint64)) for j in range(p, p + 8)])
            live &= ~count.above(radius)
            some = live != 0
            if some.sum() < 0.8 * len(q):
                q, w, live = q[some], w[some], live[some]
                count.keep(some)
        for k in range(0, len(q), 1 << 14):  # pairs of a part of the words at once
            c, bit = np.nonzero(np.unpackbits(live[k : k + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64))
            if len(c):
                yield q[k + c], row_of[w[k + c] * 64 + bit], count.at(k + c, bit.astype(np.uint64))


def link_block(bucket: np.ndarray, fps: np.ndarray, radius: int, step: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by bucket: direct links (i, j) within the radius, one fewer than the rows that they connect."""
    label, ends = np.arange(len(bucket)), []
    for i, j, _ in pairs_within(bucket, fps, radius, step):
        label, used = _union(label, i, j)
        ends += [(i[u], j[u]) for u in used]
    return tuple(np.concatenate([e[x] for e in ends] or [np.empty(0, np.int64)]) for x in (0, 1))


def whole_buckets(batches: Iterator[pa.RecordBatch], block: int = 1 << 16, most: int = 1 << 26) -> Iterator[pa.Table]:
    """Rows sorted by bucket and part in tables of about ``block`` rows or ``most`` bytes that cut no part."""
    held: list[pa.RecordBatch] = []
    n = size = 0
    for batch in batches:
        held.append(batch)
        n, size = n + batch.num_rows, size + batch.nbytes
        if n < block and size < most:
            continue
        table = pa.Table.from_batches(held)
        b, p = table.column("bucket").to_numpy(), table.column("part").to_numpy()
        border = np.flatnonzero((b[1:] != b[:-1]) | (p[1:] != p[:-1]))
        if len(border):
            end = int(border[-1]) + 1
            yield table.slice(0, end)
            rest = table.slice(end).combine_chunks()
            held, n, size = rest.to_batches(), rest.num_rows, rest.nbytes
    if n:
        yield pa.Table.from_batches(held)


def in_buckets(rows: DataFrame, compare: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, block: int = 1 << 16) -> DataFrame:
    """``compare`` over tables of whole buckets, sorted; its second argument numbers their (bucket, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_buckets(batches, block):
            part = part.combine_chunks()
            b, p = part.column("bucket").to_numpy(), part.column("part").to_numpy()
            yield from compare(part, np.cumsum(np.concatenate(([False], (np.diff(b) != 0) | (np.diff(p) != 0)))))

    return arrow_map(rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part"), run, schema)


def _pairs(a: np.ndarray, b: np.ndarray, **more: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array(np.maximum(a, b)), "b": pa.array(np.minimum(a, b)), **{k: pa.array(v) for k, v in more.items()}})


def links(rows: DataFrame, radius: int, width: int, block: int = 1 << 16) -> DataFrame:
    """(a, b), a > b: enough links between nodes to connect what lies within the radius."""

    def compare(part: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        node = part.column("node").to_numpy()
        i, j = link_block(group, _fp_array(part.column("fp"), width), radius)
        if len(i):
            yield _pairs(node[i], node[j])

    return in_buckets(rows, compare, "a long, b long", block).where("a <> b").distinct()


# ---------------------------------------------------------------- components


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge, by large-star and small-star steps; component is the smallest node."""
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        sign = now
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4, words: int = 1, radius: int = 4, distinct: bool = False, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fp, component_id, by the distance of fingerprints alone. A radius up to an eighth of the bits keeps the number of keys small."""
    bits, width = 64 * words, 8 * words
    fps = cut(fingerprints(docs, doc_id, text, k, words, distinct))
    reps = cut(fps.where(F.col("doc_id").isNotNull()).groupBy("fp").agg(F.min("doc_id").alias("node")))
    rows = cut(bucketed(reps, exact_tables(reps.count(), radius, bits), width))
    whole = components(links(shared_buckets(rows, hot), radius, width))
    named = reps.join(whole, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- similarity of shingle sets


def _least(share: float, n: np.ndarray | int) -> np.ndarray:
    """The smallest whole number that is not below ``share * n``."""
    return np.ceil(share * np.asarray(n) - 1e-9).astype(np.int64)


_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, size=(BANDS, MINIMA), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands(hashes: np.ndarray, step: int = 1024) -> np.ndarray:
    """A set's ``BANDS`` buckets: hashes of ``MINIMA`` minima each, under permutations of the shingle hashes (products with odd numbers). None for the empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    least = np.full(_ODD.size, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k in range(0, len(hashes), step):
        np.minimum(least, (hashes[None, k : k + step] * _ODD.reshape(-1, 1)).min(axis=1), out=least)
    return _widened((least.reshape(BANDS, MINIMA) * _ODD[:, ::-1]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64), 1).view(np.int64)


def shingle_sets(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(node, s) of nodes (node, key, doc_id): their sets, made anew from the texts. Of ``docs``, only rows that may have one of the ids are shuffled."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k).tobytes() for t in b.column("text").cast(pa.binary()).to_pylist()]
            own = pa.array([xxhash.xxh3_128_digest(s) == key for s, key in zip(sets, b.column("key").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "s"]).filter(own)

    texts = maybe_listed(docs, "doc_id", nodes.select("doc_id")).where("__listed").withColumn("__h", F.xxhash64("text"))
    met = texts.join(nodes.withColumnRenamed("doc_id", "__id"), texts["doc_id"].eqNullSafe(F.col("__id")))
    return arrow_map(met.dropDuplicates(["__id", "node", "__h"]).select("node", "key", "text"), make, "node long, s binary")


class Meetings:
    """Candidate pairs of a bucket's rows: within the radius, of sizes that the similarity allows, and only where the two share no earlier band, so that each pair is looked at once."""

    def __init__(self, part: pa.Table, similarity: float, wide: int, width: int):
        self.band, self.n = part.column("band").to_numpy(), part.column("n").to_numpy().astype(np.int64)
        self.bands = part.column("bands").combine_chunks().values.to_numpy().reshape(len(part), -1)
        self.fps, self.similarity, self.wide = _fp_array(part.column("fp"), width), similarity, wide

    def pairs(self, group: np.ndarray, open_: Callable[[np.ndarray, np.ndarray], np.ndarray], step: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(i, j, distance) in parts; pairs that are not ``open_`` any more are passed over."""
        for i, j, d in pairs_within(group, self.fps, self.wide):
            for k in range(0, len(i), step):
                a, b, e = i[k : k + step], j[k : k + step], d[k : k + step]
                some = open_(a, b) & (np.minimum(self.n[a], self.n[b]) >= _least(self.similarity, np.maximum(self.n[a], self.n[b])))
                a, b, e = a[some], b[some], e[some]
                first = (self.bands[a] == self.bands[b]).argmax(axis=1) == self.band[a]
                if first.any():
                    yield a[first], b[first], e[first]


def meeting_places(placed: DataFrame, similarity: float, wide: int, width: int) -> DataFrame:
    """(bucket, part, band, node): where each node has a candidate to be compared with."""

    def compare(part: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        near = np.zeros(len(part), dtype=bool)
        for i, j, _ in Meetings(part, similarity, wide, width).pairs(group, lambda i, j: ~(near[i] & near[j])):
            near[i] = near[j] = True
        yield from part.select(["bucket", "part", "band", "node"]).filter(pa.array(near)).to_batches()

    return in_buckets(placed, compare, "bucket long, part int, band int, node long")


def verified_links(met: DataFrame, similarity: float, wide: int, width: int) -> DataFrame:
    """(a, b): links between nodes whose whole sets (column ``s``) have at least the similarity, one fewer in each bucket than the nodes that they connect.

    Nearest candidates come first, and pairs that links connect already are passed over; what fails is followed by ever larger shares of the rest.
    """

    def similar(x: bytes, y: bytes) -> bool:
        x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= int(_least(similarity, len(x) + len(y) - both))

    def compare(part: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, sets = part.column("node").to_numpy(), [memoryview(x.as_buffer()) for x in part.column("s").combine_chunks()]
        label = np.arange(len(node))
        for i, j, d in Meetings(part, similarity, wide, width).pairs(group, lambda i, j: (label[i] != label[j]) & (node[i] != node[j])):
            order = np.argsort(d, kind="stable")
            i, j, more = i[order], j[order], 0
            while len(i):
                _, used = _union(label, i, j)
                take = np.zeros(len(i), dtype=bool)
                take[:more] = True
                take[np.concatenate(used)] = True
                good = take.copy()
                good[take] = [similar(sets[a], sets[b]) for a, b in zip(i[take].tolist(), j[take].tolist(), strict=True)]
                label, used = _union(label, i[good], j[good])
                for u in used:
                    yield _pairs(node[i[good][u]], node[j[good][u]])
                left = ~take & (label[i] != label[j])
                i, j, more = i[left], j[left], 2 * int(take.sum())

    return in_buckets(met, compare, "a long, b long", block=1 << 13).distinct()


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, similarity: float = 0.8, words: int = 4, hot: int = HOT_SHINGLES) -> DataFrame:
    """(doc_id, key, component, component_id) of every row: components of the texts whose sets of k-word shingles have at least the Jaccard similarity.

    Equal sets are one node (``key``, 128 bits of its hashes). Nodes meet in the buckets of their bands; a bucket above ``hot`` shingles is dealt out as pairs of groups. Bit-sliced comparison of
    fingerprints finds candidates (six standard deviations beyond the similarity's mean); only nodes that have one get their sets, made anew from the texts, and only in the buckets where they have one.
    component_id is the smallest id of the component, null if it has none.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    bits, width = 64 * words, 8 * words

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([_fingerprint(iter([s]), words) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "fp", "n", "bands"],
            )

    rows = cut(arrow_map(spread(docs), make, "doc_id long, key binary, fp binary, n int, bands array<long>"))
    nodes = cut(rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("fp", "n", "bands")]).withColumn("node", F.monotonically_increasing_id()))
    met = shared_buckets(nodes.select(F.posexplode("bands").alias("band", "bucket"), "node", "n"), hot, "n").drop("n")
    about = nodes.select("node", "fp", "n", "bands")
    wide = radius_for(similarity, bits, 6.0)
    places = cut(meeting_places(met.join(about, "node"), similarity, wide, width))
    wanted = nodes.join(places.select("node").distinct(), "node")
    sets = shingle_sets(wanted.select("node", "key", "doc_id"), docs, k)
    links_ = verified_links(places.join(wanted.select("node", "fp", "n", "bands"), "node").join(sets, "node"), similarity, wide, width)
    whole = nodes.select("key", "doc_id", "node").join(components(links_), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = whole.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return rows.select("doc_id", "key").join(whole.select("key", "component"), "key").join(least, "component").select("doc_id", "key", "component", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, **how) -> DataFrame:
    """One row of each group of near duplicates, of those with its smallest id; a row with a null id is kept only where its group has no other id."""
    groups = cut(similar_groups(docs, doc_id, text, k, **how).select("doc_id", "key", "component"))
    # One text per component: (id, key) of the smallest id, nulls last. Where an id has one row only, the id is enough to find it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    kept = groups.groupBy("component").agg(first).select("first.doc_id", "first.key")
    often = groups.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("__often"))
    kept = cut(kept.join(often, kept["doc_id"].eqNullSafe(often["doc_id"])).select(kept["doc_id"].alias("__kept"), F.col("key").alias("__key"), "__often"))
    # Most documents are kept, and their ids occur once: only the others, and few that a bitmap takes for them, are joined with their texts.
    others = cut(often.join(kept.where("not __often").select("__kept"), often["doc_id"].eqNullSafe(F.col("__kept")), "left_anti").select("doc_id"))
    marked = maybe_listed(docs.withColumn("__own", F.col(doc_id).cast("long")), "__own", others)
    unsure, same = marked.where("__listed").select(*docs.columns), F.col(doc_id).cast("long").eqNullSafe(F.col("__kept"))
    once = marked.where("not __listed").select(*docs.columns).unionByName(unsure.join(kept.where("not __often").select("__kept"), same, "left_semi"))
    keys = kept.where("__often")
    if keys.isEmpty():
        return once
    # Rows of repeated ids are told apart by their texts, and of equal ones any is kept.
    rows = unsure.join(keys.select("__kept").distinct(), same, "left_semi")
    found = arrow_map(rows.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).alias("__text")).distinct(), lambda batches: _keyed(batches, k), "__id long, __text string, __key binary")
    found = found.join(keys.withColumnRenamed("__key", "__want"), F.col("__id").eqNullSafe(F.col("__kept")) & (F.col("__key") == F.col("__want"))).groupBy("__id", "__want").agg(F.min("__text").alias("__text"))
    exact = rows.join(found.select("__id", "__text"), F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & F.col(text).eqNullSafe(F.col("__text")))
    one = exact.withColumn("__at", F.row_number().over(Window.partitionBy("__id", "__text").orderBy(F.lit(0)))).where("__at = 1")
    return once.unionByName(one.select(*docs.columns))


def _keyed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [xxhash.xxh3_128_digest(shingle_set(t, k).tobytes()) for t in b.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary())], names=["__id", "__text", "__key"])


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = near_duplicates(docs, k=4, words=1, radius=4, distinct=False)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
