import zlib

from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

from lacuna.llm import sharding


def test_equals_sql(spark, sf):
    assert rows_of(sharding.op3_sharding(spark, sf)) == rows_of_sql(sharding.OP3_SQL, sf)


def test_edges(spark):
    rows = [(1, "a", "x", 9), (1, "a", "x", 9), (2, None, "y", 9), (None, "é", "z", 9), (None, None, None, 9), (3, "", "w", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, slot int")
    out = sharding.shard_records(df, keep=("source", "slot")).collect()
    assert len(out) == 6 and "source" in out[0].asDict()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        text = {1: "a", 2: "", 3: ""}.get(r["doc_id"], "é" if r["size"] == 18 else "")
        assert r["size"] == 16 + len(text.encode()) and r["text_crc32"] == zlib.crc32(text.encode())
        assert r["grown_shard"] in (r["shard"], 40)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.shard_records(df.limit(0)).count() == 0


def test_weights_and_growth(spark):
    df = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shard_records(df, weights=(1.0, 2.0, 1.0), grown=(1.0, 2.0, 1.0, 1.0)).groupBy("shard", "grown_shard").count().collect()
    n = {s: sum(r["count"] for r in out if r["shard"] == s) for s in range(3)}
    assert abs(n[1] / 20000 - 0.5) < 0.02 and abs(n[0] / 20000 - 0.25) < 0.02
    assert all(r["shard"] == r["grown_shard"] or r["grown_shard"] == 3 for r in out)
    assert abs(sum(r["count"] for r in out if r["grown_shard"] == 3) / 20000 - 0.2) < 0.02


def test_same_shard_whatever_the_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    a = rows_of(sharding.shard_records(df.repartition(1)))
    assert a == rows_of(sharding.shard_records(df.repartition(7)))


def test_many_repeats_of_one_record(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 7)
    df = spark.range(500).select(F.when(F.col("id") < 300, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    by = {}
    for r in sharding.shard_records(df).collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert sum(map(len, by.values())) == 500 and all(sorted(s) == list(range(len(s))) for s in by.values())
