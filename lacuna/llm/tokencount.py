"""Token counts under a unigram model, by a trie of pre-tokens.

A pre-token is a chunk between white space with the mark U+2581 before it. Its segmentation is the one of highest total log-probability (ties: fewer tokens). Distinct
pre-tokens are inserted into a trie whose nodes carry the forward score and token count of their prefix: pre-tokens share the work of common
prefixes, a new node looks at the pieces that end at it and at the nodes above it, and the terminal's count answers every later occurrence. The trie of a worker is
bounded by ``nodes``; when it is full a new one is begun, in the middle of a pre-token too, which changes no result: a forward score needs no more of the prefix than the longest piece.

Scores are a parameter (piece to log-probability). By default they are those of the SentencePiece file if it is a unigram model. A file that numbers its merges in place of scores gives only the order of
frequency of its pieces; its model then takes Zipf's law, log p = -log(rank + 2.7) - log(normaliser). Characters of no piece cost one token for each UTF-8 byte.

Defined cases: null and blank texts have no pre-tokens and no tokens; very long texts are cut into pieces at white space, a very long pre-token goes through the trie like
any other; repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm.common import arrow_map, read_table, spread

NODES = 600_000
MARK = "▁"
PIECE = 1 << 20


class UnigramTrie:
    def __init__(self, scores: dict[str, float], nodes: int = NODES):
        self.nodes = nodes
        # Pieces by their letters from the last to the first: what ends at a place is found by walking back from it.
        self.ends: dict = {}
        for p, s in scores.items():
            at = self.ends
            for c in reversed(p):
                at = at.setdefault(c, {})
            at[None] = s
        self.longest = max(map(len, scores))
        self.byte_score = min(scores.values()) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def _forward(self, word: str, end: int, score: list[float], count: list[int], first: int) -> tuple[float, int]:
        """Best score and fewest tokens of word[:end], from those of its prefixes of ``first`` and more letters."""
        n = len(word[end - 1].encode("utf-8", "surrogatepass"))
        best, fewest = score[end - 1 - first] + n * self.byte_score, count[end - 1 - first] + n
        node, at = self.ends, end
        while at:
            at -= 1
            node = node.get(word[at])
            if node is None:
                break
            s = node.get(None)
            if s is not None:
                s += score[at - first]
                if s > best or s == best and count[at - first] + 1 < fewest:
                    best, fewest = s, count[at - first] + 1
        return best, fewest

    def insert(self, word: str) -> int:
        """Tokens of a pre-token; the nodes of its known prefix are used, those of its new part are made."""
        child, node, path = self.child, 0, [0]
        for c in word:
            node = child.get((node, c))
            if node is None:
                break
            path.append(node)
        else:
            return self.count[node]
        known, node = len(path) - 1, path[-1]
        first = max(0, known - self.longest)
        score, count = [self.score[x] for x in path[first:]], [self.count[x] for x in path[first:]]
        for i in range(known, len(word)):
            s, k = self._forward(word, i + 1, score, count, first)
            if len(self.score) > self.nodes:
                # The rest of this pre-token hangs from a node that no other one reaches.
                self.clear()
                child, node = self.child, 1
                self.score.append(score[-1])
                self.count.append(count[-1])
            child[node, word[i]] = node = len(self.score)
            self.score.append(s)
            self.count.append(k)
            score.append(s)
            count.append(k)
            if len(score) > 2 * self.longest + 1024:
                drop = len(score) - self.longest - 1
                del score[:drop], count[:drop]
                first += drop
        return count[-1]

    def tokens(self, chunk: str) -> int:
        found = self.terminal.get(chunk)
        if found is None:
            if len(self.score) > self.nodes:
                self.clear()
            found = self.insert(MARK + chunk)
            self.terminal[chunk] = found
        return found


def zipf_scores(pieces: list[str]) -> dict[str, float]:
    total = math.log(sum(1 / (r + 2.7) for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r + 2.7) - total for r, p in enumerate(pieces, 1)}


def file_scores(path: str) -> dict[str, float]:
    """Piece to log-probability of a SentencePiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces, scores = [sp.id_to_piece(i) for i in plain], [sp.get_score(i) for i in plain]
    # A numbering: a piece's score is its place, or a mark for pieces that no merge makes.
    numbered = sum(s == scores[-1] + len(scores) - 1 - i for i, s in enumerate(scores)) > 0.9 * len(scores)
    return zipf_scores(pieces) if numbered else dict(zip(pieces, scores, strict=True))


@lru_cache(maxsize=2)
def trie(path: str) -> UnigramTrie:
    return UnigramTrie(file_scores(path))


def chunks(text: str) -> Iterator[list[str]]:
    """The pre-tokens of a text without their mark, in lists of bounded size."""
    at, blank = 0, re.compile(r"\s")
    while len(text) - at > PIECE:
        m = blank.search(text, at + PIECE)
        if not m:
            break
        yield text[at : m.start()].split()
        at = m.end()
    yield text[at:].split()


def count_tokens(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", scores: dict[str, float] | None = None, nodes: int = NODES) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) per row, with the model of a file or with given ``scores``."""
    shared = None if scores is None else docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = trie(path) if shared is None else UnigramTrie(shared.value, nodes)
        for b in batches:
            n_pre, n_tok = [], []
            for body in b.column(1).to_pylist():
                p = k = 0
                for part in chunks(body or ""):
                    p += len(part)
                    k += sum(map(t.tokens, part))
                n_pre.append(p)
                n_tok.append(k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())], names=["doc_id", "n_pretokens", "n_tokens"])

    return arrow_map(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, "doc_id long, n_pretokens long, n_tokens long")


def default_path() -> str:
    """The 32k piece vocabulary of the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op6_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return count_tokens(spread(read_table(spark, sf_dir, "documents").select("doc_id", "text")), path or default_path())
