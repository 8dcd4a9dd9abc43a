"""The test tables in the engine's forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_MICROS = 1704067200000000  # 2024-01-01
VARIABLES = ("click", "error", "purchase", "signup", "view")
FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: Column) -> Column:
    """Six digits; the small offset keeps exact halves from falling to either side."""
    return F.round(c + F.lit(1.3e-8), 6)


def r(sql: str) -> str:
    """The same in SQL."""
    return f"round(({sql}) + 1.3e-8, 6)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a long series: user, event type, hours since 2024."""
    t = (F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_MICROS)) / F.lit(3.6e9)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), t.alias("t"), F.col("event_type").alias("var"), F.col("value").alias("v"))


def episode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(episode_id, y): whether k of the user's last event is 50 or more."""
    k = F.get_json_object("props", "$.k").cast("int")
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("episode_id")).agg(F.max_by(k, F.struct("ts", "event_id")).alias("k"))
    return last.select("episode_id", (F.col("k") >= 50).cast("int").alias("y"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as 8 x 8 images."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("image"), F.col("label").cast("int").alias("label"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, p): ten entries of an embedding, made positive and normalised."""
    head = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 10), lambda x: F.round(F.abs(x), 6) + F.lit(0.001))
    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), head.alias("h"))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    return raw.withColumn("s", total).select("vec_id", "label", F.transform("h", lambda x: x / F.col("s")).alias("p"))


OBS = f"""obs AS (
  SELECT user_id AS episode_id, event_id AS seq, (epoch_us(ts) - {EPOCH_MICROS}) / 3.6e9 AS t, event_type AS var, value AS v FROM events
)"""
GRID = f"""{OBS},
grid AS (
  SELECT g.episode_id, g.t, x.var, c.v
  FROM (SELECT DISTINCT episode_id, t FROM obs) g
  CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS var) x
  LEFT JOIN (SELECT episode_id, t, var, avg(v) AS v FROM obs GROUP BY ALL) c ON c.episode_id = g.episode_id AND c.t = g.t AND c.var = x.var
)"""
LABELS = """labels_of AS (
  SELECT user_id AS episode_id, CASE WHEN arg_max(CAST(json_extract_string(props, '$.k') AS INT), (ts, event_id)) >= 50 THEN 1 ELSE 0 END AS y FROM events GROUP BY user_id
)"""
PROBS = """raw AS (
  SELECT vec_id, label::INT AS label, list_transform(embedding[1:10], lambda x: round(abs(x::DOUBLE), 6) + 0.001::DOUBLE) AS h FROM embeddings
),
probs AS (SELECT vec_id, label, list_transform(h, lambda x: x / list_sum(h)) AS p FROM raw),
long_p AS (SELECT vec_id, label, unnest(p) AS p, unnest(range(10))::INT AS c FROM probs)"""
LONG = """long AS (
  SELECT l_returnflag, l_extendedprice AS target, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem
)"""
PIXELS = """px AS (
  SELECT vec_id, label::INT AS label, unnest(range(64)) AS k, unnest(embedding)::DOUBLE AS v FROM embeddings
),
pix AS (SELECT vec_id, label, (k // 8)::INT AS h, (k % 8)::INT AS w, v FROM px)"""
