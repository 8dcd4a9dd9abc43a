import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("tokenizers")
from lacuna.llm import bpe

TEXTS = [
    "", " ", "Hello  World's\n\tI'LL <|endoftext|> <|endoftext|>x 12 3!!ok ΑΣ ß İ é é \xa0x　y \x00 \x1f a​b x\x85y", "�\U0001f600<|startoftext|>",
    "'S 'sx 'll", "a<|endoftext|>b<|x|>", "½²ªµ ʰx ¿¡", "th" * 3000, "<" * 900, "</w>" * 700, "x</w> y</w>", "日本語テキスト" * 200, "nos\x1cplit", "ǅ ŉ",
]


def sample():
    rng = random.Random(1)
    more = ["".join(rng.choice(a) for _ in range(n)) for n in (300, 1500, 6000) for a in ("etaoinshrdlu", ["th", "the", "in", "er", "ing", "a"], "!?.,#<>/*=-", [chr(0x4E00 + i) for i in range(500)])]
    return TEXTS + more


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("leaf, reach", [(256, 4), (7, 1), (33, 2)])
def test_equals_library(library, leaf, reach):
    enc = bpe.Encoder(bpe.default_path(), leaf, reach)
    for t in sample():
        want = library.encode(t, add_special_tokens=False).ids
        assert enc.encode(t).tolist() == want, t[:50]
        assert enc.decode(np.array(want, dtype=np.uint32)) == library.decode(want, skip_special_tokens=False)


def test_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "PIECE", 40)
    enc = bpe.Encoder(bpe.default_path())
    for t in (*TEXTS, "It is what it is, isn't it? " * 30, "x" * 500 + " y"):
        assert "".join(enc.pieces(t)) == t
        assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_merges_must_grow():
    assert bpe.ranks_grow([("a", "b"), ("ab", "c")]) and not bpe.ranks_grow([("ab", "c"), ("a", "b")])


def test_query_rows(spark, library):
    rows = [(i, t, 1) for i, t in enumerate(sample())] + [(500, None, 1), (0, TEXTS[0], 1), (None, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.encoding_digests(df, bpe.default_path()).collect()
    assert len(out) == len(rows)
    texts = {i: t or "" for i, t, _ in rows}
    for r in out:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoding_digests(df.limit(0), bpe.default_path()).count() == 0
    both = bpe.decode_ids(bpe.encode_texts(df, bpe.default_path()), bpe.default_path())
    assert both.where("doc_id = 4").first()["decoded"] == library.decode(library.encode(TEXTS[4], add_special_tokens=False).ids, skip_special_tokens=False)


def test_pieces_of_any_script(library, monkeypatch):
    """Long texts are cut before white space in every script; ids are those of the library."""
    rng = random.Random(9)
    parts = ["日本語", "тест", "ΑΣ", "Σ", "é", "é", "́", "ﬁ", "123", "x'll", "<|endoftext|>", "हिन्दी", "‍", "İ", "a" * 40, "…", "\U0001f600", "ß", "\x85", "\xa0"]
    enc = bpe.Encoder(bpe.default_path())
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n", "  ", " \n\t"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    for size in (5, 17, 64):
        monkeypatch.setattr(bpe, "PIECE", size)
        for t in texts:
            pieces = list(enc.pieces(t))
            assert "".join(pieces) == t
            assert enc.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, t
    monkeypatch.setattr(bpe, "PIECE", 1000)
    long = "слово и ещё одно, " * 2000
    assert max(map(len, enc.pieces(long))) <= 1000
