import random

from oracle import rows_of, rows_of_sql
from plain import brute_force

from lacuna.llm import decontaminate as D


def test_equals_sql(spark, sf):
    assert rows_of(D.op4_decontamination(spark, sf)) == rows_of_sql(D.OP4_SQL, sf)


def digest(df):
    import hashlib

    return {r["doc_id"]: (r["n_words"], sum(s["words"] for s in r["hit_spans"]), len(r["hit_items"]), hashlib.sha256(",".join(r["hit_items"]).encode()).hexdigest(), bool(r["hit_spans"])) for r in df.collect()}


def corpus():
    rng = random.Random(4)
    words = ["the", "a", "é", "Ärger", "x1", "10", "of", "日本"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 5, 10, 12, 20]))) for i in range(40)] + [(100, None), (101, "..."), (None, "Ärger of 日本 x1 10"), (7, "é é é")]
    docs = [(i, text(rng.randrange(60)) + (rng.choice(items)[1] or "").upper() + text(5)) for i in range(150)] + [(900, None), (901, ""), (902, " . "), (903, "é É é")]
    return docs, items


def frames(spark):
    docs, items = corpus()
    return docs, items, spark.createDataFrame([(i, t, 3, "keep") for i, t in docs], "doc_id long, text string, n_words int, source string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    docs, items, df, bench = frames(spark)
    want = brute_force(docs, items)
    assert digest(D.find_contamination(df, bench)) == want
    assert digest(D.find_contamination(df, bench, block_bytes=60)) == want  # many blocks
    assert digest(D.find_contamination(df, bench.limit(0))) == brute_force(docs, [])
    assert D.find_contamination(df.limit(0), bench).count() == 0


def test_removal(spark):
    docs, items, df, bench = frames(spark)
    want = brute_force(docs, items)
    kept = D.remove_documents(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, w in want.items() if not w[4]}
    cut = D.remove_spans(df, bench)
    assert cut.columns == df.columns
    texts = dict(docs)
    for r in cut.collect():
        n = want[r["doc_id"]]
        left = sum(len(w) for w in D.word_pieces((r["text"] or "").encode()))
        assert left == n[0] - n[1] if n[1] else r["text"] == texts[r["doc_id"]]


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = " ".join("w" * rng.randrange(1, 30) for _ in range(400)).encode()
    whole = [w for ws in D.word_pieces(text) for w in ws]
    for size in (7, 50, 333):
        monkeypatch.setattr(D, "PIECE", size)
        assert [w for ws in D.word_pieces(text) for w in ws] == whole == text.split()
