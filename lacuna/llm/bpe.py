"""BPE encoding and decoding by tree concatenation.

A text is cut at white space into chunks, chunks into pre-tokens, pre-tokens into tokens; chunks seen before come from a bounded cache. A
pre-token longer than ``LEAF`` symbols (text that nothing splits) is halved again and again: its leaves are encoded side by
side in one native call that uses several threads, then neighbours are joined pairwise, level by level. At each join a window around the border, ``reach`` tokens
to each side, is encoded anew; it doubles until the first token of the left side and the last token of the right side come
out as they were (or the window covers everything). Both sides then agree exactly: what stands outside the window has not been touched by any merge across the border. All windows of a level are
encoded in one native call as well.

Exactness rests on merges having growing ranks: no merge makes a token that an earlier one uses (:func:`ranks_grow`; checked when the file is loaded).

Normalisation and pre-tokenisation of texts below U+0300 are done by one regular expression whose classes are built from Unicode's categories; other
texts go through the tokenizer file's own normaliser and pre-tokeniser.

Defined cases: null is the empty text, with no tokens; special strings in a text become their ids, as in the library; very long texts are encoded in
pieces cut at white space, with running digests; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import arrow_map, read_table, spread

#: Symbols of a leaf, tokens of the first window to each side of a border, chunks in the cache of a worker.
LEAF, REACH, CACHE = 256, 4, 250_000
#: Characters of a text that are encoded at once.
PIECE = 1 << 20
_SIMPLE = 0x300
#: Where a long text may be cut: before a blank or line end that follows anything else; for other layouts of a tokenizer, between two words of ASCII letters.
_BORDER, _PLAIN_BORDER = re.compile(r"(?<=\S)[ \n]"), re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def _class(*kinds: str) -> str:
    """A regular expression class of the characters below U+0300 of some categories."""
    return "".join(re.escape(chr(c)) for c in range(_SIMPLE) if unicodedata.category(chr(c)).startswith(kinds))


#: White space as Unicode has it; unlike Python's, without U+001C to U+001F.
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
_L, _N, _S = _class("L"), _class("N"), re.escape(SPACE)
PRETOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_CHUNK = re.compile(f"[^{_S}]+")
_ODD = re.compile(f"[^\x00-\x1b\x20-{chr(_SIMPLE - 1)}]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def ranks_grow(merges: list[tuple[str, str]]) -> bool:
    """Whether every merge comes after all merges that make its parts."""
    made = {}
    for r, (a, b) in enumerate(merges):
        made.setdefault(a + b, r)
    return all(made.get(x, -1) < r for r, (a, b) in enumerate(merges) for x in (a, b))


class Encoder:
    """Encoding and decoding with one tokenizer file."""

    def __init__(self, path: str, leaf: int = LEAF, reach: int = REACH):
        from tokenizers import Tokenizer, models

        spec = json.load(open(path, encoding="utf-8"))
        self.leaf, self.reach = leaf, reach
        self.whole = Tokenizer.from_file(path)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        if not ranks_grow(merges):
            raise ValueError("tree concatenation needs merges in the order of their making")
        self.suffix = model["end_of_word_suffix"] or ""
        # Two bare models: one whose last symbol ends a word, one for pieces from inside a word.
        self.ending = Tokenizer(models.BPE(model["vocab"], merges, end_of_word_suffix=self.suffix or None))
        self.inner = Tokenizer(models.BPE(model["vocab"], merges))
        self.symbol = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        # Only this layout of a tokenizer has the short way; another one takes the file's own steps for every text.
        self.short = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token = [""] * size
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.token[i] = t
        self.length = [len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.token]
        #: Ids of chunks and of pre-tokens, as bytes.
        self.cache: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    # -- unsplit text

    def _run(self, pieces: list[tuple[str, bool]], threads: bool = True) -> list[list[int]]:
        """Token ids of pieces; the flag says whether the piece ends its word. One native call for each kind, over several threads if these are long."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads else "false"
        out: list[list[int]] = [[] for _ in pieces]
        for kind, tok in ((False, self.inner), (True, self.ending)):
            some = [i for i, (_, e) in enumerate(pieces) if e is kind]
            if some:
                for i, enc in zip(some, tok.encode_batch([pieces[i][0] for i in some], add_special_tokens=False), strict=True):
                    out[i] = enc.ids
        return out

    def encode_unsplit(self, symbols: str) -> list[int]:
        """Ids of one pre-token, given in byte symbols."""
        n = len(symbols)
        if n <= self.leaf:
            return self._run([(symbols, True)], threads=False)[0]
        borders = [0, n]
        while borders[1] > self.leaf:  # halves of halves
            borders = sorted({*borders, *((a + b) // 2 for a, b in zip(borders, borders[1:], strict=False))})
        parts = self._run([(symbols[a:b], b == n) for a, b in zip(borders, borders[1:], strict=False)])
        while len(parts) > 1:
            joined: list[list[int] | None] = [None] * (len(parts) // 2)
            reach = [self.reach] * len(joined)
            while todo := [i for i, x in enumerate(joined) if x is None]:
                windows = []
                for i in todo:
                    left, right = parts[2 * i][-reach[i] :], parts[2 * i + 1][: reach[i]]
                    at = borders[2 * i + 1]
                    a, b = at - sum(self.length[t] for t in left), at + sum(self.length[t] for t in right)
                    windows.append((symbols[a:b], b == n))
                for i, got in zip(todo, self._run(windows), strict=True):
                    left, right, k = parts[2 * i], parts[2 * i + 1], reach[i]
                    # A side agrees if its outermost token is as before, or if the window holds the whole side.
                    if (k >= len(left) or got[0] == left[-k]) and (k >= len(right) or got[-1] == right[k - 1]):
                        joined[i] = left[: max(0, len(left) - k)] + got + right[k:]
                    reach[i] = 2 * k
            parts = joined + parts[len(parts) // 2 * 2 :]
            borders = borders[::2] if len(borders) % 2 else [*borders[::2], borders[-1]]
        return parts[0]

    # -- texts

    def _ids(self, symbols: str) -> bytes:
        return np.array(self.encode_unsplit(symbols), dtype="<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        """Puts the ids of chunks into the cache; their new short pre-tokens are encoded in one native call."""
        pre, words, symbol = [PRETOKEN.findall(c) for c in chunks], self.words, self.symbol
        new = list({p for ps in pre for p in ps if p not in words})
        spelled = ["".join(map(symbol.__getitem__, p.encode())) for p in new]
        short = [i for i, s in enumerate(spelled) if len(s) <= self.leaf]
        for i, ids in zip(short, self._run([(spelled[i], True) for i in short], threads=False), strict=True):
            words[new[i]] = array("I", ids).tobytes() if _LITTLE else np.array(ids, dtype="<u4").tobytes()
        for p, s in zip(new, spelled, strict=True):
            if p not in words:
                words[p] = self._ids(s)
        for c, ps in zip(chunks, pre, strict=True):
            self.cache[c] = words[ps[0]] if len(ps) == 1 else b"".join(map(words.__getitem__, ps))

    def _section(self, text: str) -> bytes:
        """Ids of text without special strings, little-endian."""
        if not self.short or _ODD.search(text):
            t = self.whole
            text = t.normalizer.normalize_str(text) if t.normalizer else text
            ids: list[int] = []
            for p, _ in t.pre_tokenizer.pre_tokenize_str(text):
                ids += self.encode_unsplit(p)
            return np.array(ids, dtype="<u4").tobytes()
        chunks = _CHUNK.findall(text.lower()) if "\x85" in text or "\xa0" in text else text.lower().split()
        if len(self.cache) > CACHE:
            self.cache.clear()
        if len(self.words) > CACHE:
            self.words.clear()
        if new := list({c for c in chunks if c not in self.cache}):
            self._learn(new)
        return b"".join(map(self.cache.__getitem__, chunks))

    def pieces(self, text: str) -> Iterator[str]:
        """A long text in pieces that end before white space. Nothing joins across it: it composes with no character before it, and no pre-token or special string holds it."""
        border, at = _BORDER if self.short else _PLAIN_BORDER, 0
        while len(text) - at > PIECE:
            end = None
            for m in border.finditer(text, at + PIECE // 2, at + PIECE):
                end = m.start()
            if end is None:
                m = border.search(text, at + PIECE - 1)
                if m is None:
                    break
                end = m.start()
            yield text[at:end]
            at = end
        yield text[at:]

    def encode_pieces(self, text: str) -> Iterator[bytes]:
        for piece in self.pieces(text):
            if self.split is None or "<|" not in piece:
                yield self._section(piece)
                continue
            for part in self.split.split(piece):
                if part in self.special:
                    yield np.array([self.special[part]], dtype="<u4").tobytes()
                elif part:
                    yield self._section(part)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_pieces(text or "")), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The library's decoding without a decoder: tokens joined by blanks."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker and file."""
    return Encoder(path)


def encode_texts(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text (array of int)."""
    out = docs.drop(ids)
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            found = pa.array([enc.encode(t).astype(np.int32) for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), found], names=[*names, ids])

    return arrow_map(out, run, T.StructType(out.schema.fields[:]).add(ids, T.ArrayType(T.IntegerType())))


def decode_ids(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text that their ids decode to."""
    out = rows.drop(text)
    names = out.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            made = [enc.decode(np.array(i or [], dtype=np.uint32)) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(made, pa.string())], names=[*names, text])

    return arrow_map(out, run, T.StructType(out.schema.fields[:]).add(text, "string"))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoding_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of its tokens and the digests of its ids and of what they decode to, piece by piece in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            n_tokens, of_ids, of_text = [], [], []
            for t in b.column(1).to_pylist():
                n, di, dt = 0, hashlib.sha256(), hashlib.sha256()
                for raw in enc.encode_pieces(t or ""):
                    ids = np.frombuffer(raw, dtype="<u4")
                    if len(ids):
                        di.update(raw)
                        dt.update(b" " * (n > 0) + enc.decode(ids).encode())
                        n += len(ids)
                n_tokens.append(n)
                of_ids.append(di.hexdigest())
                of_text.append(dt.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_tokens, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, DIGESTS)


def default_path() -> str:
    """The 49k word vocabulary of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encoding_digests(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), path or default_path())
