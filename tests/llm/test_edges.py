"""Every query over tables of odd rows, over empty tables, and over tables with further columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lacuna.llm.registry import QUERIES

DOCS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it all.", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t\x00 ", "en"),
    (6, "x" * 70000, "en"),
    (7, "word " * 30000, None),
    (8, "日本語 \U0001f600 é́ ﬁ <|endoftext|> \r\n\r\nWARC/1.1 </turn> ### \\", "ja"),
    (8, "the same id again", "en"),
    (9, "the same row", "en"),
    (9, "the same row", "en"),
    (None, "no id here", "en"),
    (None, None, None),
]
CLASH = ("score", "n_tokens", "size", "fp", "component_id", "n_words", "hit_spans", "predicted", "payload", "formatted", "rank", "ids", "shard", "slot", "y", "doc")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    tables = {
        "documents": spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in [(i, t, lang) for i, t, lang in DOCS]], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 0, None), (None, 1, 1), (7, 0, 1), (7, 1, 0), (8, 1, 0), (99, 0, 1)], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, "quick brown fox jumps over the lazy dog and runs away from it"), (1, None), (2, "..."), (3, "same row"), (None, "no id here")], "item_id long, text string"),
        "pages": spark.createDataFrame([(r[0], None if i % 3 else "http://h/ x\r\n", r[1]) for i, r in enumerate(DOCS)], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(100, [1.0, 0.0]), (200, [0.0, 0.0]), (300, None), (1, [0.5, float("nan")]), (2, [None, 1.0]), (3, [1.0, 0.1]), (4, [1.0, 0.1]), (None, [1.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>").withColumn("label", F.lit(1)),
        "conversations": spark.createDataFrame([(1, 0, "user", r[1]) for r in DOCS] + [(1, None, None, None), (None, 0, "assistant", "a"), (2, 3, "assistant", "b"), (2, 3, "assistant", "b")], "conv_id long, turn long, role string, text string"),
    }
    for name, df in tables.items():
        df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns}).write.parquet(f"{d}/{name}.parquet")
        df.limit(0).write.parquet(f"{d}/empty/{name}.parquet")
    return d


ROWS = {"op5_warc": len(DOCS), "op8_ann": 2, "op10_chat_formatting": 4}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    assert len(rows) == ROWS.get(name, len(DOCS))
    if name == "op8_ann":
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in rows) == [(100, 1, 3), (100, 2, 4)]
    elif name not in ROWS:
        key = lambda v: (v is None, v)
        assert sorted((r["doc_id"] for r in rows), key=key) == sorted((d[0] for d in DOCS), key=key)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, odd, name):
    rows = QUERIES[name](spark, f"{odd}/empty").collect()
    assert len(rows) == (1 if name == "op10_chat_formatting" else 0)


def test_pipeline(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, odd)
        assert kept.columns == docs.columns, name
        assert kept.count() <= len(DOCS)
    assert corpus_pipeline.run(spark, odd).count() > 0
