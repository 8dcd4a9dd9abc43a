"""Weighted rendezvous sharding, in DataFrame functions only.

Every record key draws one exponential variate per shard from a hash of (key, shard) and goes to the shard whose
variate, divided by the shard's weight, is smallest. Only the key and the list of shards decide, so a new shard takes
records into itself alone, about its share of the weight, and no record moves between old shards.

Slots number the records of each shard from 0 without gaps. No task ever holds a whole shard: equal rows are counted first, with map-side
combining; records fall into ``buckets`` ranges of a second hash (of key and content, so that neither one hot key nor one hot text fills a
range); the sizes of the ranges (at most shards x buckets rows, a fixed bound) give each its first slot, and a window numbers records within it.

Defined cases: a null key hashes like the empty string; a null text has 0 bytes and the CRC of the empty text; repeated
rows keep one slot each; an empty table gives an empty result; of the input's other columns those named in ``keep`` are carried along unless
their name is one of the result's, which then replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.llm.common import cut, read_table

SHARDS = 40
BUCKETS = 1024
#: Slots of one record's repeats that are made at once.
STEP = 100_000
#: Bits of the hash that a draw uses; a double holds them exactly.
DRAW_HEX, DRAW_RANGE = 13, float(1 << 52)


def draw(key: Column, shard: Column) -> Column:
    """An exponential variate of rate 1 that only (key, shard) decide."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), shard.cast("string")).cast("binary")), 1, DRAW_HEX), 16, 10).cast("double")
    return -F.ln((h + F.lit(0.5)) / F.lit(DRAW_RANGE))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0 .. len(weights)-1) with the smallest weighted draw; ties, should they occur, go to the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])
    scored = F.transform(shards, lambda x: F.struct((draw(key, x["s"]) / x["w"]).alias("d"), x["s"].alias("s")))
    return F.array_min(scored)["s"]


def with_slots(df: DataFrame, shard: str, scatter: Column, order: Sequence[str], times: str, buckets: int = BUCKETS, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each shard: each row of ``df`` gets ``times`` of them and becomes as many rows. ``scatter`` is an integer that spreads records over ranges."""
    ranged = df.withColumn("__bucket", F.pmod(scatter, F.lit(buckets)).cast("int"))
    counts = ranged.groupBy(shard, "__bucket").agg(F.sum(times).alias("__n"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(shard, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    # At most shards x buckets rows: a bound that the parameters fix, whatever the input.
    placed = ranged.join(F.broadcast(first), [shard, "__bucket"])
    within = Window.partitionBy(shard, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = placed.withColumn("__start", F.col("__first") + F.coalesce(F.sum(times).over(within), F.lit(0)))
    # Repeats are told apart in two steps, so that no array grows with their number, and the steps of one record are dealt out.
    steps = start.withColumn("__step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / STEP)))).repartition("__start", "__step")
    last = F.least(F.col(times), (F.col("__step") + 1) * STEP) - 1
    return steps.withColumn("__i", F.explode(F.sequence(F.col("__step") * STEP, last))).withColumn(slot, F.col("__start") + F.col("__i")).drop("__bucket", "__first", "__start", "__step", "__i", times)


def shard_records(df: DataFrame, key: str = "doc_id", text: str = "text", weights: Sequence[float] = (1.0,) * SHARDS, grown: Sequence[float] | None = None, buckets: int = BUCKETS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row: ``key``, ``keep``, size, text_crc32, law, shard, slot and grown_shard (the shard under ``grown`` weights)."""
    grown = [*weights, 1.0] if grown is None else grown
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard", key}
    rows = df.select(
        F.col(key),
        *[F.col(c) for c in keep if c not in made],
        (F.octet_length(body).cast("long") + 16).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights).alias("shard"),
        rendezvous(k, grown).alias("grown_shard"),
        F.conv(F.substring(F.md5(F.concat(F.lit("slot|"), k).cast("binary")), 1, 8), 16, 10).cast("long").alias("__h"),
    )
    # Texts are read once; equal rows become one with their number, so that repeats of one record never meet as rows.
    distinct = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__times")))
    out = with_slots(distinct, "shard", F.col("__h") + F.col("text_crc32"), ["__h", key, "text_crc32", "size"], "__times", buckets)
    return out.drop("__h")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_records(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


#: CRC-32 has no DuckDB function: the table comes from the polynomial, the sum from a fold over the text's bytes.
OP3_SQL = f"""
WITH RECURSIVE poly(n, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8
),
crc AS (SELECT list(c ORDER BY n) AS t FROM poly WHERE k = 8),
rows AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, strlen(coalesce(text, '')) + 16 AS size,
    list_transform(range(strlen(coalesce(text, ''))), lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT) AS b
  FROM documents
),
summed AS (
  SELECT doc_id, k, size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, crc.t[xor(c & 255, x) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM rows, crc
),
placed AS (
  SELECT *, ('0x' || substr(md5('slot|' || k), 1, 8))::BIGINT AS h,
    (SELECT arg_min(s, -ln((('0x' || substr(md5(k || '|' || s), 1, {DRAW_HEX}))::BIGINT::DOUBLE + 0.5) / {DRAW_RANGE})) FROM range({SHARDS}) r(s)) AS shard,
    (SELECT arg_min(s, -ln((('0x' || substr(md5(k || '|' || s), 1, {DRAW_HEX}))::BIGINT::DOUBLE + 0.5) / {DRAW_RANGE})) FROM range({SHARDS + 1}) r(s)) AS grown_shard
  FROM summed
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY (h + text_crc32) % {BUCKETS}, h, doc_id, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard
FROM placed
"""
