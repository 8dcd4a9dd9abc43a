import random

import pytest

from lacuna.llm import tokencount as T


def brute(word, scores, byte_score):
    """Best (score, fewest tokens) by plain dynamic programming over prefixes."""
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        n = len(word[i - 1].encode())
        options = [(best[i - 1][0] + n * byte_score, -(best[i - 1][1] + n))]
        options += [(best[j][0] + scores[word[j:i]], -(best[j][1] + 1)) for j in range(max(0, i - 64), i) if word[j:i] in scores]
        s, k = max(options)
        best.append((s, -k))
    return best[-1][1]


def test_equals_brute_force():
    rng = random.Random(0)
    pieces = list({"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))) for _ in range(60)})
    scores = {p: -rng.randrange(1, 9) / 2 for p in pieces}
    for nodes in (10**6, 40):
        trie = T.UnigramTrie(scores, nodes)
        for _ in range(600):
            w = "".join(rng.choice("abcdé") for _ in range(rng.randrange(0, 12)))
            assert trie.tokens(w) == brute(T.MARK + w, scores, trie.byte_score), w
    for long in ("ab" * 300, "".join(rng.choice("abcdé") for _ in range(3000))):
        for nodes in (10**6, 40, 3):  # a trie that is full in the middle of a pre-token
            trie = T.UnigramTrie(scores, nodes)
            assert [trie.tokens(w) for w in ("abca", long, "abcab", long)] == [brute(T.MARK + w, scores, trie.byte_score) for w in ("abca", long, "abcab", long)]
            assert len(trie.score) <= max(nodes, 3010) + 3


def test_prefixes_are_shared():
    trie = T.UnigramTrie({"a": -1.0, "b": -1.0, "ab": -1.5, T.MARK: -1.0})
    trie.tokens("abab")
    n = len(trie.score)
    trie.tokens("aba")
    assert len(trie.score) == n
    trie.tokens("ababb")
    assert len(trie.score) == n + 1


def test_query(spark, monkeypatch):
    pytest.importorskip("sentencepiece")
    t = T.trie(T.default_path())
    rows = [(1, "the theory of them", 5), (2, None, 5), (3, " \n", 5), (1, "the theory of them", 5), (None, "日本 é", 5), (4, "x" * 5000 + " the", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in T.count_tokens(df, T.default_path()).collect()}
    want = {i: (len((x or "").split()), sum(t.tokens(w) for w in (x or "").split())) for i, x, _ in rows}
    assert out == want and want[2] == (0, 0) and want[1][1] <= 5
    assert T.count_tokens(df.limit(0), T.default_path()).count() == 0
    monkeypatch.setattr(T, "PIECE", 7)
    assert [w for ws in T.chunks("a bb  ccc dddddddddddd e f g\nh") for w in ws] == "a bb ccc dddddddddddd e f g h".split()


def test_query_equals_brute_force(spark, sf):
    pytest.importorskip("sentencepiece")
    scores = T.file_scores(T.default_path())
    assert max(map(len, scores)) <= 64
    least, known = min(scores.values()) - 10.0, {}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = {i: sum(known.get(w) or known.setdefault(w, brute(T.MARK + w, scores, least)) for w in t.split()) for i, t in texts.items()}
    assert {r["doc_id"]: r["n_tokens"] for r in T.op6_token_counts(spark, sf).collect()} == want


def test_given_scores(spark):
    df = spark.createDataFrame([(1, "ab aab"), (2, "é")], "doc_id long, text string")
    out = T.count_tokens(df, scores={T.MARK: -1.0, "a": -2.0, "b": -2.0, "ab": -1.0})
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {1: 5, 2: 3}
