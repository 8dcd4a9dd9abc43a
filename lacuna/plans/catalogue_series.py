"""Queries of readers, sinks and series whose results the SQL builds from the same tables: record texts are written from rows and read back by the engine's parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import arrays as A
from lacuna.functions import scalar as C
from lacuna.operators import classify, joins, modelled, sampling, series, stats
from lacuna.plans.registered import query
from lacuna.plans.tables import EPOCH_MICROS, GRID, OBS, VARIABLES, observations, r, rounded, table
from lacuna.sources import episodes, sinks
from lacuna.storage import durable, shared_dir

# ------------------------------------------------------------------ readers

_MINUTES = f"((epoch_us(ts) - {EPOCH_MICROS}) // 60000000)"
_ICU = f"""ev AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, {_MINUTES} AS m, event_type, value FROM events)"""


def _icu_texts(spark, d) -> DataFrame:
    """events as record files: a header, the id, five descriptors, then time,param,value; hours pass 24."""
    name = F.create_map(*[F.lit(x) for kv in (("click", "HR"), ("error", "Temp"), ("purchase", "GCS"), ("signup", "Weight"), ("view", "Unlisted")) for x in kv])
    minute = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_MICROS)) / 60000000).cast("long")
    line = F.format_string("%02d:%02d,%s,%s", F.floor(minute / 60), minute % 60, F.element_at(name, F.col("event_type")), F.col("value").cast("string"))
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id", line.alias("line")).alias("s"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"]), "\n")
    u = F.col("user_id")
    head = F.format_string(
        "Time,Parameter,Value\n00:00,RecordID,%d\n00:00,Age,%d\n00:00,Gender,%d\n00:00,Height,-1\n00:00,ICUType,4\n00:00,Weight,%d\n", u, 20 + u % 60, u % 2, F.when(u % 3 == 0, -1).otherwise(50 + u % 40)
    )
    return rows.groupBy("user_id").agg(body.alias("body")).select(u.cast("string").alias("episode_id"), F.concat(head, "body", F.lit("\n")).alias("value"))


@query(f"""WITH {_ICU} SELECT user_id::VARCHAR AS episode_id, 5 + i AS seq, {r('m // 60 + (m % 60) / 60.0::DOUBLE')} AS t, CASE event_type WHEN 'click' THEN 'HR' WHEN 'error' THEN 'Temp' WHEN 'purchase' THEN 'GCS' ELSE 'Weight' END AS var, value AS v FROM ev WHERE event_type <> 'view'
UNION ALL SELECT DISTINCT user_id::VARCHAR, 4, {r('0.0::DOUBLE')}, 'Weight', (50 + user_id % 40)::DOUBLE FROM ev WHERE user_id % 3 <> 0""")
def icu_series(spark, d):
    obs, _ = episodes.icu_rows(_icu_texts(spark, d))
    return obs.withColumn("t", rounded(F.col("t")))


@query(f"""WITH {_ICU}, u AS (SELECT DISTINCT user_id AS u FROM ev) SELECT u::VARCHAR AS episode_id, var, v::DOUBLE AS v FROM (
SELECT u, 'Age' AS var, 20 + u % 60 AS v FROM u UNION ALL SELECT u, 'Gender', u % 2 FROM u UNION ALL SELECT u, 'Height', -1 FROM u UNION ALL SELECT u, 'ICUType', 4 FROM u UNION ALL SELECT u, 'Weight', CASE WHEN u % 3 = 0 THEN -1 ELSE 50 + u % 40 END FROM u)""")
def icu_static(spark, d):
    return episodes.icu_rows(_icu_texts(spark, d))[1]


def _hourly(spark, d) -> DataFrame:
    """lineitem as hourly files: an order is an episode, a line an hour; flags of every fourth order contradict each other."""
    o = F.col("l_orderkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_returnflag"))
    nan = F.lit(float("nan"))
    num = lambda c: c.cast("double")
    return table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), o.cast("string")).alias("episode_id"),
        F.when(n % 3 == 0, nan).otherwise(num(F.col("l_quantity"))).alias("HR"),
        num(F.col("l_extendedprice")).alias("O2Sat"),
        num(40 + o % 50).alias("Age"),
        num(o % 2).alias("Gender"),
        F.when(o % 4 == 2, nan).otherwise(num(F.when(o % 4 == 1, 0).otherwise(1))).alias("Unit1"),
        F.when(o % 4 == 2, nan).otherwise(num(F.when(o % 4 == 0, 0).otherwise(1))).alias("Unit2"),
        num(n * -1.5).alias("HospAdmTime"),
        num(n).alias("ICULOS"),
        num(F.col("l_returnflag") == "R").alias("SepsisLabel"),
    )


_HOURLY = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_returnflag) AS hr FROM lineitem WHERE l_orderkey % 4 <> 3)"


@query(f"""WITH {_HOURLY} SELECT 'p' || l_orderkey AS episode_id, 0::BIGINT AS seq, hr::DOUBLE AS t, 'HR' AS var, CASE WHEN hr % 3 <> 0 THEN l_quantity::DOUBLE END AS v FROM l
UNION ALL SELECT 'p' || l_orderkey, 0, hr, 'O2Sat', l_extendedprice FROM l""")
def hourly_series(spark, d):
    return episodes.hourly_rows(_hourly(spark, d), ["HR", "O2Sat"])[0]


@query(f"""WITH {_HOURLY} SELECT 'p' || l_orderkey AS episode_id, (40 + l_orderkey % 50)::INT AS age, (l_orderkey % 2)::INT AS gender, CASE l_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS unit_id, min(hr) * -1.5::DOUBLE AS hosp_adm_time,
max(hr)::DOUBLE AS icu_los, arg_max((l_returnflag = 'R')::INT, hr) AS label FROM l GROUP BY l_orderkey""")
def hourly_static(spark, d):
    return episodes.hourly_rows(_hourly(spark, d), ["HR", "O2Sat"])[1]


@query("""WITH c AS (SELECT *, ['4 Spontaneously', 'To Speech', 'to pain', 'No Response', 'other'][(c_custkey % 5) + 1] AS eye FROM customer WHERE c_custkey % 11 <> 0),
w AS (SELECT c_custkey || '_episode' || (c_custkey % 12) AS episode_id, c_custkey / 4.0::DOUBLE AS t, CASE WHEN c_acctbal / 10 BETWEEN 0 AND 300 THEN c_acctbal / 10 END::DOUBLE AS weight, CASE WHEN eye LIKE '%Respon%' THEN 0 WHEN eye LIKE '%pain%' THEN 1 WHEN eye LIKE '%Speech%' THEN 2 WHEN eye LIKE '%Spont%' THEN 3 END::DOUBLE AS eye,
(c_custkey % 13)::DOUBLE AS total, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 90)::DOUBLE END AS rate FROM c)
SELECT episode_id, 0::BIGINT AS seq, t, x.var, CASE x.var WHEN 'weight' THEN round(weight, 6) WHEN 'glascow_coma_scale_eye_opening' THEN eye WHEN 'glascow_coma_scale_total' THEN total ELSE rate END AS v
FROM w, (SELECT unnest(['weight', 'glascow_coma_scale_eye_opening', 'glascow_coma_scale_total', 'heart_rate']) AS var) x""")
def episode_series(spark, d):
    """customer as rows of episode files, all text; names of every eleventh fit no episode."""
    k = F.col("c_custkey")
    answers = F.array(*[F.lit(x) for x in ("4 Spontaneously", "To Speech", "to pain", "No Response", "other")])
    raw = table(spark, d, "customer").select(
        F.when(k % 11 == 0, F.concat(k.cast("string"), F.lit(".csv"))).otherwise(F.format_string("%d_episode%02d_timeseries.csv", k, k % 12)).alias("file_name"),
        (k / 4.0).cast("string").alias("Hours"),
        F.element_at(answers, (k % 5 + 1).cast("int")).alias("Glascow coma scale eye opening"),
        ((k % 13 + 3) + F.lit(0.5)).cast("string").alias("Glascow coma scale total"),
        F.when(k % 7 == 0, F.lit("x")).otherwise((k % 90).cast("string")).alias("Heart Rate"),
        (F.col("c_acctbal") / 10).cast("string").alias("Weight"),
    )
    return episodes.episode_rows(raw).withColumn("v", F.round("v", 6))


@query("SELECT c_custkey || '_episode' || (c_custkey % 12) AS key, count(*) AS n FROM customer WHERE c_custkey % 11 <> 0 GROUP BY ALL")
def regex_key(spark, d):
    k = F.col("c_custkey")
    name = F.when(k % 11 == 0, F.concat(k.cast("string"), F.lit(".csv"))).otherwise(F.format_string("%07d_episode%02d_timeseries.csv", k, k % 12))
    got = episodes.episode_rows(table(spark, d, "customer").select(name.alias("file_name"), F.lit("1").alias("Hours"), F.lit("70").alias("Weight")))
    return got.groupBy(F.col("episode_id").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey::VARCHAR AS episode_id, CASE WHEN o_orderkey % 3 = 0 THEN -7 ELSE o_custkey END::DOUBLE AS sofa, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END::DOUBLE AS died FROM orders""")
def outcomes(spark, d):
    """Two files of outcomes; ids of the second one replace those of the first."""
    path, o = f"{shared_dir(spark).rstrip('/')}/outcomes", F.col("o_orderkey")
    rows = lambda sofa, died: [o.alias("RecordID"), F.lit(1).alias("SAPS-I"), sofa.alias("SOFA"), F.lit(5).alias("Length_of_stay"), F.lit(-1).alias("Survival"), F.lit(died).alias("In-hospital_death")]
    orders = table(spark, d, "orders")
    orders.select(*rows(F.col("o_custkey"), 0)).write.mode("overwrite").csv(f"{path}/a", header=True)
    orders.where(o % 3 == 0).select(*rows(F.lit(-7), 1)).write.mode("overwrite").csv(f"{path}/b", header=True)
    got = episodes.read_outcomes(spark, [f"{path}/a", f"{path}/b"])
    return got.select("episode_id", F.col("SOFA").alias("sofa"), F.col("`In-hospital_death`").alias("died"))


@query("SELECT c_custkey || '_episode' || (c_custkey % 12) AS episode_id, (c_acctbal > 0)::INT AS y_true FROM customer WHERE c_custkey % 11 <> 0")
def listfile(spark, d):
    path, k = f"{shared_dir(spark).rstrip('/')}/listfile", F.col("c_custkey")
    name = F.when(k % 11 == 0, F.lit("bad")).otherwise(F.format_string("%d_episode%02d_timeseries.csv", k, k % 12))
    table(spark, d, "customer").select(name.alias("stay"), (F.col("c_acctbal") > 0).cast("int").alias("y_true")).write.mode("overwrite").csv(path, header=True)
    return episodes.read_listfile(spark, path)


@query(f"WITH {OBS} SELECT CASE WHEN episode_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, var, count(*) AS n, {r('sum(v)')} AS total FROM obs GROUP BY ALL")
def dataset_roundtrip(spark, d):
    """A dataset written by split and loaded again."""
    path = f"{shared_dir(spark).rstrip('/')}/dataset_roundtrip"
    rows = observations(spark, d).withColumn("split", F.when(F.col("episode_id") % 5 == 0, "test").otherwise("train"))
    sinks.save_dataset(rows, path, stats.metadata(rows), "split")
    return sinks.load_dataset(spark, path).groupBy("split", "var").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("v")).alias("total"))


@query(f"WITH {OBS} SELECT var, {r('avg(v)')} AS mean, {r('avg((v IS NULL)::INT)')} AS missing_rate FROM obs GROUP BY var")
def metadata_roundtrip(spark, d):
    path = f"{shared_dir(spark).rstrip('/')}/metadata_roundtrip"
    rows = observations(spark, d)
    sinks.save_dataset(rows.limit(0), path, stats.metadata(rows))
    return sinks.load_metadata(spark, path).select("var", rounded(F.col("mean")).alias("mean"), rounded(F.col("missing_rate")).alias("missing_rate"))


@query("SELECT vec_id, list_sum(list_transform(embedding[17:], lambda x: round(x::DOUBLE * 1048576)))::DOUBLE AS total, len(embedding[17:])::INT AS n FROM embeddings WHERE label <> 3")
def stored_vectors(spark, d):
    """Vectors without their first 16 entries, of the listed rows only."""
    kept = table(spark, d, "embeddings").where("label <> 3").select("vec_id")
    got = sinks.vectors_from(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")), "x", 16, kept, "vec_id")
    return got.select("vec_id", A.total(F.transform("x", lambda v: F.round(v * 1048576))).alias("total"), F.size("x").alias("n"))


# ------------------------------------------------------------------ expressions


@query(f"SELECT event_id, {r('day(ts) * 24 + hour(ts) + minute(ts) / 60.0::DOUBLE')} AS hours FROM events")
def hhmm_to_hours(spark, d):
    text = F.format_string("%d:%s", F.dayofmonth("ts") * 24 + F.hour("ts"), F.date_format("ts", "mm"))
    return table(spark, d, "events").select("event_id", rounded(C.hhmm_to_hours(text)).alias("hours"))


@query("SELECT l_orderkey, l_linenumber, (l_quantity > 10 AND l_discount > 0.02 AND l_tax > 0.01) AS every, (l_quantity > 45 OR l_discount > 0.09 OR l_tax > 0.07) AS some, abs(l_quantity - 25)::DOUBLE AS off, least(greatest(l_quantity, 10), 40)::DOUBLE AS clipped FROM lineitem")
def flags_and_clips(spark, d):
    q, disc, tax = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    every, some = C.all_of(q > 10, disc > 0.02, tax > 0.01), C.any_of(q > 45, disc > 0.09, tax > 0.07)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", every.alias("every"), some.alias("some"), F.abs(q - 25).cast("double").alias("off"), F.least(F.greatest(q, F.lit(10)), F.lit(40)).cast("double").alias("clipped"))


# ------------------------------------------------------------------ series


@query(f"""WITH {OBS}, a AS (SELECT episode_id, var, list(v ORDER BY t, seq) AS a FROM obs GROUP BY ALL), m AS (SELECT max(len(a)) AS most FROM a),
p AS (SELECT episode_id, var, list_concat(list_transform(range(most - len(a)), lambda i: 0.0::DOUBLE), a) AS s FROM a, m)
SELECT episode_id, var, len(s)::INT AS n, {r('list_sum(s)')} AS total, s[1] AS first, s[-1] AS last FROM p""")
def padded_series(spark, d):
    """Padded to the longest series; nothing is cut."""
    s = series.padded_series(observations(spark, d), side="left", fill=0.0)
    return s.select("episode_id", "var", F.size("series").alias("n"), rounded(A.total(F.col("series"))).alias("total"), F.element_at("series", 1).alias("first"), F.element_at("series", -1).alias("last"))


@query(f"WITH {OBS}, n AS (SELECT *, row_number() OVER (PARTITION BY episode_id, var ORDER BY t, seq) - 1 AS idx, count(*) OVER (PARTITION BY episode_id, var) AS len FROM obs) SELECT seq, lag(seq) OVER w AS before, lead(seq) OVER w AS after FROM n WINDOW w AS (PARTITION BY episode_id, var ORDER BY idx) QUALIFY idx >= 1 AND idx < len - 1")
def patch_to_segment(spark, d):
    """Each patch with the row that it is centred on."""
    w = Window.partitionBy("episode_id", "var").orderBy("t", "seq")
    obs = observations(spark, d).withColumn("idx", F.row_number().over(w) - 1)
    got = series.sliding_patches(obs.drop("idx"), 1, value="seq").join(obs.select("episode_id", "var", "idx", "seq"), ["episode_id", "var", "idx"])
    return got.select("seq", F.element_at("patch", 1).alias("before"), F.element_at("patch", 3).alias("after"))


_BLOCKS = """blk AS (SELECT user_id * 1000000 + rn // 5 AS episode_id, (rn % 5)::DOUBLE AS t, event_type AS var, value AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)),
cell AS (SELECT g.episode_id, g.t, x.var, b.v FROM (SELECT DISTINCT episode_id, t FROM blk) g CROSS JOIN (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS var) x LEFT JOIN blk b ON b.episode_id = g.episode_id AND b.t = g.t AND b.var = x.var),
seen AS (SELECT episode_id, var, list(t ORDER BY t) AS ts, list(v ORDER BY t) AS vs FROM cell WHERE v IS NOT NULL GROUP BY ALL),
mean AS (SELECT var, avg(v) AS m FROM cell GROUP BY var),
spl AS (SELECT episode_id, t, var, v, CASE WHEN v IS NOT NULL THEN v WHEN ts IS NULL THEN m ELSE list_sum(list_transform(range(1, len(ts) + 1), lambda i: vs[i] * coalesce(list_aggregate(list_transform(list_filter(range(1, len(ts) + 1), lambda j: j <> i), lambda j: (t - ts[j]) / (ts[i] - ts[j])), 'product'), 1))) END AS y
  FROM cell LEFT JOIN seen USING (episode_id, var) JOIN mean USING (var))"""


def _blocks(spark, d) -> DataFrame:
    """Five events of a user are an episode, their places its times: a series has four observations at most where it has a gap, and its spline is the polynomial through them."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = table(spark, d, "events").withColumn("rn", rn)
    obs = rows.select((F.col("user_id") * 1000000 + F.floor(F.col("rn") / 5)).alias("episode_id"), F.col("event_id").alias("seq"), (F.col("rn") % 5).cast("double").alias("t"), F.col("event_type").alias("var"), F.col("value").alias("v"))
    return series.dense_grid(obs, VARIABLES)


@query(f"WITH {_BLOCKS} SELECT episode_id, var, t, {r('y')} AS imputed FROM spl")
def impute_spline_blocks(spark, d):
    return modelled.impute_spline(_blocks(spark, d)).select("episode_id", "var", "t", rounded(F.col("imputed")).alias("imputed"))


@query(f"""WITH {_BLOCKS}, len AS (SELECT episode_id, count(DISTINCT t) AS len FROM cell GROUP BY 1),
rws AS (SELECT episode_id, t, count(v) AS n, count(*) AS c FROM cell GROUP BY ALL), sh AS (SELECT episode_id, t, sum(n) OVER w / sum(c) OVER w AS share FROM rws WINDOW w AS (PARTITION BY episode_id ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
pat AS (SELECT lag(y) OVER w AS a, y AS b, lead(y) OVER w AS c, t, len FROM spl JOIN len USING (episode_id) WINDOW w AS (PARTITION BY episode_id, var ORDER BY t)),
cl AS (SELECT (avg(a) + avg(b) + avg(c)) / 3 AS k FROM pat WHERE t >= 1 AND t < len - 1)
SELECT episode_id, var, t, {r('CASE WHEN len <= 2 OR v IS NOT NULL THEN y ELSE share * y + (1 - share) * k END')} AS imputed FROM spl JOIN len USING (episode_id) JOIN sh USING (episode_id, t), cl""")
def impute_kmeans_single(spark, d):
    """One bin and one cluster: the cluster's mean is that of all patches."""
    got = modelled.impute_kmeans(_blocks(spark, d), half=1, bins=1, kernels=2, clusters=1)
    return got.select("episode_id", "var", "t", rounded(F.col("imputed")).alias("imputed"))


@query(f"""WITH {GRID}, m AS (SELECT var, avg(v) AS m FROM grid GROUP BY 1), w AS (SELECT episode_id, var, t, v, m, last_value(v IGNORE NULLS) OVER (PARTITION BY episode_id, var ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM grid JOIN m USING (var))
SELECT var, {r('sum(coalesce(v, 0))')} AS zero, {r('sum(coalesce(v, m))')} AS mean, {r('sum(coalesce(f, m))')} AS forward, {r('sum(coalesce(f, 0))')} AS forward_zero FROM w GROUP BY var""")
def impute_by_name(spark, d):
    """Strategies by name; sums per variable."""
    grid = durable(series.dense_grid(observations(spark, d), VARIABLES))
    out = None
    for s in ("zero", "mean", "forward", "forward_zero"):
        got = modelled.impute(grid, s).groupBy("var").agg(rounded(F.sum("imputed")).alias(s))
        out = got if out is None else out.join(got, "var")
    return out


_BY_ROW = """CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}p IS NOT NULL AND {c}n IS NOT NULL THEN {c}p.v + ({c}n.v - {c}p.v) * (i - {c}p.i) / ({c}n.i - {c}p.i) ELSE coalesce({c}p.v, {c}n.v) END"""


@query(f"""WITH {GRID}, wide AS (SELECT episode_id, t, max(v) FILTER (var = 'click') AS click, max(v) FILTER (var = 'view') AS view_ FROM grid GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY t) AS i FROM wide),
a AS (SELECT *, {', '.join(f"last_value(CASE WHEN {c} IS NOT NULL THEN {{'v': {c}, 'i': i}} END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}p, first_value(CASE WHEN {c} IS NOT NULL THEN {{'v': {c}, 'i': i}} END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS {c}n" for c in ('click', 'view_'))} FROM n)
SELECT episode_id, {r('t')} AS t, {r(_BY_ROW.format(c='click'))} AS click, {r(_BY_ROW.format(c='view_'))} AS view_ FROM a""")
def interpolate_rows(spark, d):
    wide = series.pivot_mean(observations(spark, d), ("click", "view")).withColumnRenamed("view", "view_")
    got = series.interpolate_by_row(wide, ("click", "view_"), "t")
    return got.select("episode_id", *[rounded(F.col(c)).alias(c) for c in ("t", "click", "view_")])


@query(f"""WITH {GRID}, wide AS (SELECT episode_id, t, max(v) FILTER (var = 'click') AS click FROM grid GROUP BY ALL) SELECT episode_id, {r('t')} AS t, {r('coalesce(click, avg(click) OVER ())')} AS click FROM wide""")
def column_means(spark, d):
    wide = series.pivot_mean(observations(spark, d), ("click",))
    return classify.column_means(wide, ["click"]).select("episode_id", rounded(F.col("t")).alias("t"), rounded(F.col("click")).alias("click"))


@query(f"WITH {OBS} SELECT episode_id, var, t, coalesce(v, 0) AS value, v IS NOT NULL AS observed FROM obs")
def plot_frame(spark, d):
    return series.plot_frame(series.impute_zero(observations(spark, d)))


# ------------------------------------------------------------------ learners over one flag, whose areas have a closed form

_FLAG = """f AS (SELECT ((l_orderkey % 2147483648) * 2654435761) % 4294967296 / 4294967296.0::DOUBLE < 0.8 AS train, (l_linenumber <= 2)::INT AS x, (l_returnflag = 'R')::INT AS y FROM lineitem),
rate AS (SELECT sign(avg(y) FILTER (train AND x = 1) - avg(y) FILTER (train AND x = 0)) AS s FROM f),
n AS (SELECT count(*) FILTER (x = 1 AND y = 1)::DOUBLE AS a, count(*) FILTER (x = 0 AND y = 1)::DOUBLE AS b, count(*) FILTER (x = 1 AND y = 0)::DOUBLE AS c, count(*) FILTER (x = 0 AND y = 0)::DOUBLE AS d FROM f WHERE NOT train)"""


@query(f"WITH {_FLAG} SELECT kind, {r('0.5 + s * ((a * d - b * c) / ((a + b) * (c + d))) / 2')} AS auroc FROM n, rate, (SELECT unnest(['gbt', 'logistic']) AS kind)")
def learners_on_a_flag(spark, d):
    """Any learner can only order the two groups by their rate in training."""
    rows = sampling.hash_split(table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") <= 2).cast("double").alias("x"), (F.col("l_returnflag") == "R").cast("int").alias("y")), "l_orderkey")
    train, test = durable(rows.where("split = 'train'")), durable(rows.where("split <> 'train'"))
    out = None
    for kind, how in (("gbt", {"maxIter": 3}), ("logistic", {})):
        got = classify.fit_and_test(train, test, ["x"], "y", kind, **how).select(F.lit(kind).alias("kind"), rounded(F.col("auroc")).alias("auroc"))
        out = got if out is None else out.unionByName(got)
    return out
