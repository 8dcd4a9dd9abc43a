"""Benchmark decontamination: a broadcast hash set of test n-grams against the token windows of training text.

Words are runs of bytes outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after lower-casing A-Z. A window is ``n`` consecutive
words of an item; an item of fewer words is one window of its own length. Every document word inside any occurrence of a window
is hit. A window's 64-bit hash finds candidates, a comparison of its word ids verifies them, so no hash collision counts.

The test set is read in blocks of at most ``block_bytes`` of text; each block makes one broadcast of a size that this parameter
bounds, and one pass over the documents. A benchmark within one block (any usual one) costs one pass and no shuffle; a larger one costs a pass
per block, and what is found by each but the last is written to the shared folder, by a digest of the text: documents themselves are never written or, but for the few with hits, shuffled.

Defined cases: null or wordless texts have no words and no hits; an item that is null or wordless has no windows; items with a null id
mark words but are not listed; repeated item ids count once; an empty benchmark leaves every document clean; columns of the
input named like a result column are replaced by it. Long texts are cut into pieces at word borders while they are tokenised, and windows run across the pieces.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import arrow_map, maybe_listed, read_table, scratch, spread

N = 10
BLOCK_BYTES = 4 << 20
#: Bytes of a text that are turned into word objects at once.
PIECE = 4 << 20

_WORD = np.zeros(256, dtype=bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True
#: Lower-cases A-Z and turns every byte that is no word byte into a blank; positions stay.
TABLE = bytes(b if _WORD[b] else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded size."""
    at = 0
    while len(text) - at > PIECE:
        piece = text[at : at + PIECE].translate(TABLE)
        end = piece.rfind(b" ") + 1
        if not end:  # one word longer than a piece
            while (more := text[at + len(piece) : at + len(piece) + PIECE].translate(TABLE)) and b" " not in more:
                piece += more
            end = len(piece) + more.find(b" ") + 1 if more else len(piece)
            piece += more
        yield piece[:end].split()
        at += end
    yield text[at:].translate(TABLE).split()


class WindowSet:
    """The windows of some items, by length: hashes in order, where each window stands in the items' word ids, and the items that hold it. Arrays only, but for the words."""

    def __init__(self, items: Iterable[tuple[str | None, bytes | None]], n: int):
        self.vocab: dict[bytes, int] = {}
        names, parts = [], []
        for item, text in items:
            names.append(item)
            parts.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for ws in word_pieces(text or b"") for w in ws], dtype=np.int32))
        self.names = names
        self.ids = np.concatenate([*parts, np.zeros(0, np.int32)])
        self.code = np.random.default_rng(7).integers(1, 1 << 63, len(self.vocab) + 1, dtype=np.uint64)
        size = np.array([len(p) for p in parts], dtype=np.int64)
        start = np.cumsum(size) - size
        self.by_length = {}
        for m in sorted({min(n, k) for k in size.tolist() if k}):
            some = np.flatnonzero(np.minimum(size, n) == m)
            windows = size[some] - m + 1
            item = np.repeat(some, windows)
            at = start[item] + np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
            h = self.hashes(self.ids, at, m)
            order = np.lexsort((item, h))
            h, at, item = h[order], at[order], item[order]
            # Equal windows become one with all its items; windows that differ in spite of one hash stay apart.
            other = np.ones(len(h), dtype=bool)
            other[1:] = (h[1:] != h[:-1]) | (self._words(at[1:], m) != self._words(at[:-1], m)).any(axis=1)
            first = np.flatnonzero(other)
            self.by_length[m] = (h[first], at[first], np.append(first, len(h)), item)

    def _words(self, at: np.ndarray, m: int) -> np.ndarray:
        return self.ids[at[:, None] + np.arange(m)]

    def items(self, m: int, k: int) -> set[str]:
        """The ids of the items that hold the k-th window of length m; null ids are left out."""
        _, _, first, item = self.by_length[m]
        return {self.names[i] for i in item[first[k] : first[k + 1]].tolist()} - {None}

    def hashes(self, ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for j in range(m):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.code[ids[at + j]]
        return h ^ (h >> np.uint64(29))

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, positions, windows) of what occurs in ``ids``; -1 is a word of no item."""
        gap = np.concatenate(([0], np.cumsum(ids < 0)))
        for m, (hashes, place, _, _) in self.by_length.items():
            if len(ids) < m:
                continue
            at = np.flatnonzero(gap[m:] == gap[:-m])
            if not len(at):
                continue
            h = self.hashes(ids, at, m)
            lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            # Different windows of one hash: each is compared.
            for step in range(int((hi - lo).max(initial=0))):
                k = lo + step
                some = np.flatnonzero(k < hi)
                same = (self._words(place[k[some]], m) == ids[at[some, None] + np.arange(m)]).all(axis=1)
                if same.any():
                    yield m, at[some][same], k[some][same]


RESULT = ("n_words", "hit_spans", "hit_items")


def _spans(text: bytes, words: np.ndarray) -> list[dict[str, int]]:
    """Byte ranges of runs of hit words."""
    mask = _WORD[np.frombuffer(text.translate(TABLE), dtype=np.uint8)]
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], words.view(np.int8), [0])))
    return [{"start": int(starts[a]), "end": int(ends[b - 1]), "words": int(b - a), "first": int(a)} for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1), strict=True)]


def scan_batch(texts: list[bytes | None], windows: WindowSet) -> tuple[list[int], list[list], list[list[str]]]:
    """Words, hit spans and items of each text; the windows of a batch are looked up together."""
    get, parts, first, n_words = windows.vocab.get, [], [0], []
    for text in texts:
        n = 0
        for ws in word_pieces(text or b""):
            parts.append(np.fromiter((get(w, -1) for w in ws), dtype=np.int32, count=len(ws)))
            n += len(ws)
        parts.append(np.array([-1], dtype=np.int32))  # no window runs across texts
        n_words.append(n)
        first.append(first[-1] + n + 1)
    ids, starts = np.concatenate(parts or [np.zeros(0, np.int32)]), np.array(first)
    spans: list[list] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    for m, at, which in windows.occurrences(ids):
        np.add.at(edge, at, 1)
        np.add.at(edge, at + m, -1)
        for d, k in set(zip((np.searchsorted(starts, at, side="right") - 1).tolist(), which.tolist(), strict=True)):
            items[d] |= windows.items(m, k)
    if edge.any():
        hit = np.cumsum(edge[:-1]) > 0
        for d in np.unique(np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1).tolist():
            spans[d] = _spans(texts[d], hit[starts[d] : starts[d + 1] - 1])
    return n_words, spans, [sorted(x) for x in items]


def _merge(one: list[dict], other: list[dict]) -> list[dict]:
    """Union of two lists of spans of one text, by their word ranges."""
    out: list[dict] = []
    for s in sorted([*one, *other], key=lambda x: x["first"]):
        if out and s["first"] <= out[-1]["first"] + out[-1]["words"]:
            if s["first"] + s["words"] > out[-1]["first"] + out[-1]["words"]:
                out[-1] = out[-1] | {"end": s["end"], "words": s["first"] + s["words"] - out[-1]["first"]}
        else:
            out.append(dict(s))
    return out


SPANS = "array<struct<start:bigint,end:bigint,words:bigint,first:bigint>>"
_SPANS_ARROW = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "end", "words", "first")]))


def blocks_of(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The items, streamed to the driver in blocks of bounded size."""
    block, held = [], 0
    for r in items.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        if held >= block_bytes:
            yield block
            block, held = [], 0
        block.append((r["i"], bytes(r["t"]) if r["t"] is not None else None))
        held += len(block[-1][1] or b"")
    yield block


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = N, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, hit_spans (byte ranges) and hit_items (sorted ids as strings)."""
    spark = docs.sparkSession
    out = docs.drop(*RESULT)
    carried = out.columns
    result = T._parse_datatype_string(f"n_words bigint, hit_spans {SPANS}, hit_items array<string>").fields
    blocks, path = blocks_of(items, item, item_text, block_bytes), None
    block = next(blocks)
    for following in blocks:  # more than one block: what each but the last finds goes to the shared folder, by a digest of the text
        path = path or scratch(spark, "contamination")
        shared = spark.sparkContext.broadcast(WindowSet(block, n))

        def hits(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, spans, found = scan_batch(batch.column("text").cast(pa.binary()).to_pylist(), shared.value)
                some = pa.array([bool(s) for s in spans], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, _SPANS_ARROW), pa.array(found, pa.list_(pa.string()))], names=["key", "hit_spans", "hit_items"]).filter(some)

        keyed = out.select(F.md5(F.col(text).cast("binary")).alias("key"), F.col(text).alias("text"))
        arrow_map(keyed, hits, f"key string, hit_spans {SPANS}, hit_items array<string>").write.mode("append").parquet(path)
        block = following
    shared = spark.sparkContext.broadcast(WindowSet(block, n))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, found = scan_batch(batch.column(text).cast(pa.binary()).to_pylist(), shared.value)
            if "__found" in batch.schema.names:
                for i, earlier in enumerate(batch.column("__found").to_pylist()):
                    for more in earlier or ():
                        spans[i], found[i] = _merge(spans[i], more["hit_spans"]), sorted({*found[i], *more["hit_items"]})
            arrays = [*(batch.column(c) for c in carried), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, *RESULT])

    schema = T.StructType([*out.schema.fields, *result])
    if path is None:
        return arrow_map(out, scan, schema)
    # Only documents that may have hits of earlier blocks are joined with these.
    earlier = spark.read.parquet(path)
    marked = maybe_listed(out.withColumn("__key", F.md5(F.col(text).cast("binary"))), "__key", earlier.select("key"))
    found = earlier.groupBy("key").agg(F.collect_set(F.struct("hit_spans", "hit_items")).alias("__found"))
    listed = marked.where("__listed").join(found.withColumnRenamed("key", "__key"), "__key", "left")
    return arrow_map(marked.where("not __listed").select(*carried), scan, schema).unionByName(arrow_map(listed.select(*carried, "__found"), scan, schema))


def remove_documents(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """The documents without any hit, with their columns."""
    if {c.lower() for c in docs.columns} & set(RESULT):  # these names are taken: the rows travel beside the result
        found = find_contamination(docs.withColumn("__kept", F.struct("*")), items, text, **how)
        return found.where(F.size("hit_spans") == 0).select("__kept.*")
    return find_contamination(docs, items, text, **how).where(F.size("hit_spans") == 0).select(*docs.columns)


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **how) -> DataFrame:
    """All documents, with each run of hit words (and what stands between its words) cut out of the text."""
    found = find_contamination(docs.withColumn("__kept", F.struct("*")), items, text, **how)
    body = F.col(f"__kept.`{text}`").cast("binary")
    start = F.struct(F.lit(b"").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate("hit_spans", start, lambda a, s: F.struct(F.concat(a["out"], F.substring(body, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))).alias("out"), s["end"].alias("at")))
    clean = F.concat(cut["out"], F.substring(body, (cut["at"] + 1).cast("int"), F.octet_length(body))).cast("string")
    return found.select(*[F.when(F.size("hit_spans") == 0, F.col(f"__kept.`{text}`")).otherwise(clean).alias(text) if c == text else F.col(f"__kept.`{c}`").alias(c) for c in docs.columns])


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return found.select(
        "doc_id",
        "n_words",
        hits.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) u(i) WHERE len(w) > 0
),
lens AS (SELECT DISTINCT m FROM win),
grams AS (
  SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS gram FROM d, lens, unnest(range(1, len(w) - m + 2)) u(i)
),
occ AS (SELECT g.doc_id, g.i, g.m, win.item_id FROM grams g JOIN win ON win.m = g.m AND win.gram = g.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM occ, unnest(range(i, i + m)) u(p) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM occ GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
