"""Every operator as a named query over the test tables, with the SQL of its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import arrays as A
from lacuna.functions import scalar as C
from lacuna.operators import evaluate, grid, joins, layers, modelled, ordering, ranking, sampling, separability, series, stats, subspace
from lacuna.plans.registered import ORACLE_SQL, QUERIES, query
from lacuna.plans.tables import FEATURES, GRID, LABELS, LONG, OBS, PIXELS, PROBS, SIDE, VARIABLES, episode_labels, images, observations, probabilities, r, rounded, table
from lacuna.plans import catalogue_models, catalogue_series  # noqa: F401  they register queries too
from lacuna.sources.episodes import EYE_OPENING

__all__ = ["ORACLE_SQL", "QUERIES"]


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return series.dense_grid(observations(spark, d), VARIABLES)


def _items(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, d, "lineitem").select("*", (flag == "R").cast("int").alias("y"), F.when(flag == "A", 0).when(flag == "N", 1).otherwise(2).alias("c"))


# ------------------------------------------------------------------ scans and scalar expressions


@query(f"WITH {OBS} SELECT episode_id, var, count(*) AS n, {r('min(t)')} AS t0, {r('max(t)')} AS t1, {r('sum(v)')} AS total FROM obs GROUP BY ALL")
def obs_scan(spark, d):
    return observations(spark, d).groupBy("episode_id", "var").agg(F.count(F.lit(1)).alias("n"), rounded(F.min("t")).alias("t0"), rounded(F.max("t")).alias("t1"), rounded(F.sum("v")).alias("total"))


@query(f"WITH {GRID} SELECT episode_id, var, count(*) FILTER (v IS NOT NULL) AS observed, count(*) AS cells FROM grid GROUP BY ALL")
def obs_mask(spark, d):
    return series.with_mask(_grid(spark, d)).groupBy("episode_id", "var").agg(F.sum(F.col("mask").cast("long")).alias("observed"), F.count(F.lit(1)).alias("cells"))


@query("SELECT o_orderkey, CASE WHEN lower(o_orderpriority) LIKE '%urgent%' THEN 3 WHEN lower(o_orderpriority) LIKE '%high%' THEN 2 WHEN lower(o_orderpriority) LIKE '%medium%' THEN 1 WHEN lower(o_orderpriority) LIKE '%low%' THEN 0 END AS code FROM orders")
def cat_encode(spark, d):
    return table(spark, d, "orders").select("o_orderkey", C.encode_ordered(F.col("o_orderpriority"), (("urgent", 3), ("high", 2), ("medium", 1), ("low", 0))).alias("code"))


@query("SELECT event_id, CASE WHEN value BETWEEN 1 AND 50 THEN value END AS value FROM events")
def bounds_null(spark, d):
    return table(spark, d, "events").select("event_id", C.within(F.col("value"), 1.0, 50.0).alias("value"))


@query("""WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN (o_orderstatus = 'F')::INT END AS u1, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderstatus = 'O')::INT END AS u2 FROM orders)
SELECT o_orderkey, CASE WHEN u1 IS NULL OR u2 IS NULL THEN -1 ELSE u2 END AS unit_id FROM f WHERE u1 IS NULL OR u2 IS NULL OR u1 + u2 = 1""")
def flag_case(spark, d):
    s = F.col("o_orderstatus")
    flags = table(spark, d, "orders").select("o_orderkey", F.when(s != "P", (s == "F").cast("int")).alias("u1"), F.when(F.col("o_orderkey") % 7 != 0, (s == "O").cast("int")).alias("u2"))
    return flags.where(C.units_agree(F.col("u1"), F.col("u2"))).select("o_orderkey", C.unit_id(F.col("u1"), F.col("u2")).alias("unit_id"))


@query("SELECT vec_id, list_transform(range(10), lambda k: CASE WHEN k = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)[label + 1] AS own, 10 AS width FROM embeddings")
def one_hot(spark, d):
    h = C.one_hot(F.col("label"), 10)
    return images(spark, d).select("vec_id", F.element_at(h, F.col("label") + 1).alias("own"), F.size(h).alias("width"))


# ------------------------------------------------------------------ joins and filters


@query(f"WITH {OBS}, {LABELS} SELECT y, count(*) AS n, {r('sum(v)')} AS total FROM obs JOIN labels_of USING (episode_id) WHERE episode_id % 3 <> 0 GROUP BY y")
def label_join(spark, d):
    labels = episode_labels(spark, d).where(F.col("episode_id") % 3 != 0)
    return joins.label_join(observations(spark, d), labels).groupBy("y").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("v")).alias("total"))


@query(f"WITH {OBS} SELECT episode_id, any_value(c_mktsegment) AS segment, any_value(c_acctbal) AS balance, count(*) AS n FROM obs LEFT JOIN customer ON c_custkey = episode_id GROUP BY episode_id")
def static_join(spark, d):
    static = table(spark, d, "customer").select(F.col("c_custkey").alias("episode_id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    return joins.static_join(observations(spark, d).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n")), static).select("episode_id", "segment", "balance", "n")


@query(f"WITH {OBS} SELECT episode_id, count(*) AS n FROM obs WHERE episode_id NOT IN (3, 5, 8, 13, 21) GROUP BY episode_id")
def blacklist_anti(spark, d):
    return joins.without_listed(observations(spark, d), (3, 5, 8, 13, 21)).groupBy("episode_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LABELS} SELECT episode_id, y FROM labels_of")
def last_row_label(spark, d):
    return episode_labels(spark, d)


@query(f"WITH {OBS} SELECT episode_id, arg_min(var, (t, seq)) AS first_var, arg_min(v, (t, seq)) AS first_v, arg_max(v, (t, seq)) AS last_v FROM obs GROUP BY episode_id")
def first_last_rows(spark, d):
    obs = observations(spark, d)
    first = series.last_rows(obs, "var", "v", first=True).select("episode_id", F.col("var").alias("first_var"), F.col("v").alias("first_v"))
    return first.join(series.last_rows(obs, "v").withColumnRenamed("v", "last_v"), "episode_id")


# ------------------------------------------------------------------ statistics


@query(f"WITH {OBS} SELECT var, count(v) AS n, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std FROM obs GROUP BY var")
def var_stats(spark, d):
    return stats.var_stats(observations(spark, d)).select("var", "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("std")).alias("std"))


@query(f"WITH {GRID} SELECT var, {r('avg((v IS NULL)::INT)')} AS missing_rate FROM grid GROUP BY var")
def missing_rate(spark, d):
    return stats.missing_rate(_grid(spark, d)).select("var", rounded(F.col("missing_rate")).alias("missing_rate"))


@query(f"WITH {OBS}, n AS (SELECT episode_id, count(DISTINCT t) AS len FROM obs GROUP BY 1) SELECT {r('avg(len)')} AS mean_seq_len, max(len) AS max_seq_len, min(len) AS min_seq_len, {r('stddev_pop(len)')} AS sigma_seq_len FROM n")
def seq_len_stats(spark, d):
    s = stats.seq_len_stats(observations(spark, d))
    return s.select(rounded(F.col("mean_seq_len")).alias("mean_seq_len"), "max_seq_len", "min_seq_len", rounded(F.col("sigma_seq_len")).alias("sigma_seq_len"))


@query(f"SELECT l_returnflag, count(*) AS n, {r('count(*) / sum(count(*)) OVER ()')} AS ratio FROM lineitem GROUP BY l_returnflag")
def class_balance(spark, d):
    return stats.class_balance(table(spark, d, "lineitem"), "l_returnflag").withColumn("ratio", rounded(F.col("ratio")))


@query("""WITH lim AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT l_returnflag, least(floor((l_extendedprice - lo) / (hi - lo) * 16)::INT, 15) AS bin, count(*) AS n FROM lineitem, lim GROUP BY ALL""")
def class_histogram(spark, d):
    return stats.class_histogram(table(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", 16)


@query(f"WITH {OBS} SELECT episode_id, {r('t')} AS t, " + ", ".join(f"{r(f'''avg(v) FILTER (var = '{v}')''')} AS {v}" for v in VARIABLES) + " FROM obs GROUP BY episode_id, obs.t")
def pivot_mean(spark, d):
    return series.pivot_mean(observations(spark, d), VARIABLES).select("episode_id", rounded(F.col("t")).alias("t"), *[rounded(F.col(v)).alias(v) for v in VARIABLES])


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'covar_samp({a}, {b})')} AS cov FROM lineitem" for i, a in enumerate(FEATURES) for b in FEATURES[i:]))
def covariance(spark, d):
    return stats.covariance(table(spark, d, "lineitem"), FEATURES).withColumn("cov", rounded(F.col("cov")))


@query(f"WITH {OBS}, m AS (SELECT var, avg(v) AS mean, stddev_pop(v) AS std FROM obs WHERE episode_id % 5 <> 0 GROUP BY var) SELECT seq, {r('(v - mean) / std')} AS z FROM obs JOIN m USING (var)")
def zscore_train(spark, d):
    obs = observations(spark, d)
    return stats.zscore(obs, stats.var_stats(obs.where(F.col("episode_id") % 5 != 0))).select("seq", rounded(F.col("z")).alias("z"))


@query(f"WITH {PIXELS}, m AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM pix GROUP BY 1) SELECT vec_id, h, w, {r('(v - lo) / (hi - lo + 1e-5)')} AS norm FROM pix JOIN m USING (vec_id)")
def minmax_norm(spark, d):
    rows = grid.as_rows(images(spark, d), "image", SIDE, "vec_id").withColumnRenamed("v", "x")
    return stats.minmax_norm(rows, ("vec_id",)).select("vec_id", "h", "w", rounded(F.col("norm")).alias("norm"))


@query(f"WITH {LONG}, s AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS d FROM long GROUP BY 1) SELECT feature, count(*) AS n, {r('avg(x)')} AS mean FROM long JOIN s USING (feature) WHERE x BETWEEN m - 2 * d AND m + 2 * d GROUP BY feature")
def outlier_2sigma(spark, d):
    return stats.outlier_filter(ranking.unpivoted(table(spark, d, "lineitem"), FEATURES)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("x")).alias("mean"))


@query(f"WITH {GRID}, m AS (SELECT var, avg((v IS NULL)::INT) AS rate FROM grid GROUP BY 1) SELECT var, count(v) AS n FROM grid JOIN m USING (var) WHERE rate <= 0.8 GROUP BY var")
def drop_sparse_vars(spark, d):
    g = _grid(spark, d)
    return stats.drop_sparse_vars(g, stats.missing_rate(g), 0.8).groupBy("var").agg(F.count("v").alias("n"))


@query("WITH w AS (SELECT event_type AS var, CASE WHEN event_type = 'view' THEN 1.0 ELSE value END AS v FROM events), m AS (SELECT var, stddev_pop(v) AS s FROM w GROUP BY 1) SELECT var, count(*) AS n FROM w JOIN m USING (var) WHERE s <> 0 GROUP BY var")
def drop_const_vars(spark, d):
    obs = observations(spark, d).withColumn("v", F.when(F.col("var") == "view", 1.0).otherwise(F.col("v")))
    return stats.drop_const_vars(obs, stats.var_stats(obs)).groupBy("var").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id FROM embeddings WHERE list_sum(list_transform(embedding, lambda x: x::DOUBLE)) > 1e-5")
def drop_const_patch(spark, d):
    return stats.drop_const_patch(images(spark, d), "image").select("vec_id")


@query(f"SELECT {r('max(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))')} AS max_norm FROM embeddings")
def max_l2_norm(spark, d):
    return stats.max_l2_norm(images(spark, d), "image").select(rounded(F.col("max_norm")).alias("max_norm"))


# ------------------------------------------------------------------ time series

_W = "(PARTITION BY episode_id, var ORDER BY t)"
_P = "OVER (PARTITION BY episode_id, var ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_N = "OVER (PARTITION BY episode_id, var ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_B = "OVER (PARTITION BY episode_id, var ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_F = "OVER (PARTITION BY episode_id, var ORDER BY t ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"


def _cells(df: DataFrame, value: str) -> DataFrame:
    return df.select("episode_id", "var", rounded(F.col("t")).alias("t"), rounded(F.col(value)).alias(value))


def _cells_sql(expr: str, name: str, source: str = "grid", more: str = "") -> str:
    return f"WITH {GRID}{more} SELECT episode_id, var, {r('t')} AS t, {r(name)} AS {name} FROM (SELECT episode_id, var, t, {expr} AS {name} FROM {source})"


@query(_cells_sql(f"t - coalesce(last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) {_B}, 0)", "interval"))
def obs_interval(spark, d):
    return _cells(series.obs_interval(_grid(spark, d)), "interval")


@query(f"WITH {OBS} SELECT seq, {r('v - lag(v) OVER (PARTITION BY episode_id, var ORDER BY t, seq)')} AS diff FROM obs")
def obs_diff(spark, d):
    return series.obs_diff(observations(spark, d)).select("seq", rounded(F.col("diff")).alias("diff"))


@query(_cells_sql("coalesce(v, 0)", "imputed"))
def impute_zero(spark, d):
    return _cells(series.impute_zero(_grid(spark, d)), "imputed")


@query(_cells_sql("coalesce(v, avg(v) OVER (PARTITION BY var))", "imputed"))
def impute_mean(spark, d):
    return _cells(series.impute_mean(_grid(spark, d)), "imputed")


@query(_cells_sql(f"coalesce(last_value(v IGNORE NULLS) {_P}, avg(v) OVER (PARTITION BY var))", "imputed"))
def impute_ffill(spark, d):
    return _cells(series.impute_ffill(_grid(spark, d)), "imputed")


@query(_cells_sql(f"coalesce(last_value(v IGNORE NULLS) {_P}, 0)", "imputed"))
def impute_ffill_zero(spark, d):
    return _cells(series.impute_ffill_zero(_grid(spark, d)), "imputed")


_AROUND = f""",
two AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN {{'t': t, 'v': v}} END IGNORE NULLS) {_B} AS b, first_value(CASE WHEN v IS NOT NULL THEN {{'t': t, 'v': v}} END IGNORE NULLS) {_F} AS a, avg(v) OVER (PARTITION BY var) AS m FROM grid),
near AS (
  SELECT episode_id, var, t, v, m, last_value(CASE WHEN v IS NOT NULL THEN {{'t': t, 'v': v}} END IGNORE NULLS) {_P} AS p, last_value(CASE WHEN v IS NOT NULL THEN {{'b': b}} END IGNORE NULLS) {_P} AS pp,
    first_value(CASE WHEN v IS NOT NULL THEN {{'t': t, 'v': v}} END IGNORE NULLS) {_N} AS n, first_value(CASE WHEN v IS NOT NULL THEN {{'a': a}} END IGNORE NULLS) {_N} AS nn
  FROM two
)"""


@query(_cells_sql("CASE WHEN v IS NOT NULL THEN v WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (t - p.t) / (n.t - p.t) WHEN p IS NOT NULL THEN p.v ELSE 0 END", "imputed", "near", _AROUND))
def impute_linear(spark, d):
    return _cells(series.impute_linear(_grid(spark, d)), "imputed")


@query(_cells_sql("CASE WHEN v IS NOT NULL THEN v WHEN p IS NOT NULL AND n IS NOT NULL THEN p.v + (n.v - p.v) * (t - p.t) / (n.t - p.t) WHEN n IS NOT NULL THEN coalesce(n.v + (nn.a.v - n.v) * (t - n.t) / (nn.a.t - n.t), n.v) WHEN p IS NOT NULL THEN coalesce(pp.b.v + (p.v - pp.b.v) * (t - pp.b.t) / (p.t - pp.b.t), p.v) ELSE m END", "imputed", "near", _AROUND))
def impute_linear_extrap(spark, d):
    return _cells(series.impute_linear_extrap(_grid(spark, d)), "imputed")


@query(f"""WITH {GRID}, rws AS (SELECT episode_id, t, count(v) AS n, count(*) AS c FROM grid GROUP BY ALL),
sh AS (SELECT episode_id, t, sum(n) OVER w / sum(c) OVER w AS share FROM rws WINDOW w AS (PARTITION BY episode_id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT episode_id, var, {r('grid.t')} AS t, {r('CASE WHEN v IS NOT NULL THEN 1.0 ELSE share END')} AS conf FROM grid JOIN sh USING (episode_id, t)""")
def window_confidence(spark, d):
    return _cells(series.window_confidence(_grid(spark, d), 3), "conf")


@query(f"""WITH {OBS}, p AS (SELECT episode_id, var, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY episode_id, var) AS len, lag(v) OVER w AS p0, v AS p1, lead(v) OVER w AS p2 FROM obs WINDOW w AS (PARTITION BY episode_id, var ORDER BY t, seq))
SELECT episode_id, var, idx::INT AS idx, p0, p1, p2 FROM p WHERE idx >= 1 AND idx < len - 1 AND (idx - 1) % 2 = 0""")
def sliding_patches(spark, d):
    p = series.sliding_patches(observations(spark, d), 1, 2)
    return p.select("episode_id", "var", "idx", *[F.element_at("patch", i + 1).alias(f"p{i}") for i in range(3)])


@query(f"""WITH {OBS}, n AS (SELECT *, count(*) OVER (PARTITION BY episode_id, var) AS len, row_number() OVER (PARTITION BY episode_id, var ORDER BY t, seq) AS rn FROM obs), m AS (SELECT max(len) AS most FROM n)
SELECT seq, (most - len + rn - 1)::INT AS pos FROM n, m""")
def left_pad(spark, d):
    return series.row_positions(observations(spark, d)).select("seq", "pos")


@query("""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) - 1 AS i, count(*) OVER () AS n FROM events) SELECT event_id, least(i // (n // 7), 6)::INT AS bin_id FROM o""")
def equal_bins(spark, d):
    return ordering.equal_bins(table(spark, d, "events").select("event_id", "value"), [-F.col("value"), F.col("event_id")], 7).select("event_id", "bin_id")


@query("SELECT event_id, row_number() OVER (ORDER BY value, event_id) - 1 AS rank FROM events")
def global_rank(spark, d):
    return ordering.global_index(table(spark, d, "events").select("event_id", "value"), [F.col("value"), F.col("event_id")]).select("event_id", "rank")


@query(f"""WITH {OBS}, i AS (SELECT episode_id, seq, row_number() OVER (PARTITION BY episode_id ORDER BY t, seq) - 1 AS idx, count(*) OVER (PARTITION BY episode_id) AS len FROM obs)
SELECT a.episode_id, a.seq, least(greatest(a.idx, 3), a.len - 4)::INT AS centre, b.seq AS centre_seq FROM i a JOIN i b ON b.episode_id = a.episode_id AND b.idx = least(greatest(a.idx, 3), a.len - 4)""")
def clamped_patch_join(spark, d):
    w = Window.partitionBy("episode_id")
    rows = observations(spark, d).select("episode_id", "seq", (F.row_number().over(w.orderBy("t", "seq")) - 1).alias("idx"), F.count(F.lit(1)).over(w).alias("len"))
    return joins.clamped_patch_join(rows, rows.select("episode_id", "idx", F.col("seq").alias("centre_seq")), 3).select("episode_id", "seq", F.col("centre").cast("int").alias("centre"), "centre_seq")


@query(f"""WITH p AS (SELECT label AS cluster_id, vec_id % 4 AS bin_id, embedding[1:7] AS e FROM embeddings), l AS (SELECT bin_id, cluster_id, unnest(range(7)) AS pos, unnest(e)::DOUBLE AS x FROM p), m AS (SELECT bin_id, cluster_id, pos, avg(x) AS m FROM l GROUP BY ALL)
SELECT bin_id, cluster_id, {r('avg(m)')} AS mean FROM m GROUP BY ALL""")
def cluster_temporal_mean(spark, d):
    p = images(spark, d).select((F.col("vec_id") % 4).alias("bin_id"), F.col("label").alias("cluster_id"), F.slice("image", 1, 7).alias("patch"))
    return joins.cluster_temporal_mean(p, "patch").select("bin_id", "cluster_id", rounded(F.col("mean")).alias("mean"))


@query(f"WITH {GRID} SELECT episode_id, var, {r('t')} AS t, {r('coalesce(v, 0)')} AS value, (v IS NOT NULL)::INT AS mask, {r('t - coalesce(last_value(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) ' + _B + ', 0)')} AS interval FROM grid")
def input_blocks(spark, d):
    b = series.input_blocks(_grid(spark, d))
    return b.select("episode_id", "var", rounded(F.col("t")).alias("t"), rounded(F.col("value")).alias("value"), F.col("mask").cast("int").alias("mask"), rounded(F.col("interval")).alias("interval"))


@query("WITH g AS (SELECT event_type AS var, sum(value) AS gain FROM events GROUP BY 1), top AS (SELECT var FROM g ORDER BY gain DESC, var LIMIT 2) SELECT var, var IN (SELECT var FROM top) AS kept FROM g")
def top_variables(spark, d):
    gains = ranking.gain_by_variable(observations(spark, d).select("var", F.col("seq").alias("pos"), F.col("v").alias("gain")))
    return ranking.top_variables(gains, 2).select("var", "kept")


@query()
def impute_spline(spark, d):
    return _cells(modelled.impute_spline(_grid(spark, d)), "imputed")


@query()
def impute_kmeans(spark, d):
    return _cells(modelled.impute_kmeans(_grid(spark, d)), "imputed")


@query()
def impute_trees(spark, d):
    return _cells(modelled.impute_trees(_grid(spark, d), VARIABLES, trees=10), "imputed")


# ------------------------------------------------------------------ features

_FEATURES_SQL = f"""WITH {OBS}, dif AS (SELECT *, v - lag(v) OVER (PARTITION BY episode_id, var ORDER BY t, seq) AS d FROM obs),
per AS (SELECT episode_id, var, avg(v) AS mean, stddev_pop(v) AS std, coalesce(avg(d), 0) AS diff_mean, coalesce(stddev_pop(d), 0) AS diff_std FROM dif GROUP BY ALL),
g AS (SELECT var, avg(v) AS gm FROM obs GROUP BY 1),
dense AS (SELECT e.episode_id, g.var, coalesce(mean, gm) AS mean, coalesce(std, 0) AS std, coalesce(diff_mean, 0) AS diff_mean, coalesce(diff_std, 0) AS diff_std FROM (SELECT DISTINCT episode_id FROM obs) e CROSS JOIN g LEFT JOIN per ON per.episode_id = e.episode_id AND per.var = g.var)"""
_STATS = ("mean", "std", "diff_mean", "diff_std")


@query(f"{_FEATURES_SQL} SELECT episode_id, var, " + ", ".join(f"{r(s)} AS {s}" for s in _STATS) + " FROM dense")
def simple_features(spark, d):
    return stats.simple_features(observations(spark, d), VARIABLES).select("episode_id", "var", *[rounded(F.col(s)).alias(s) for s in _STATS])


@query(f"{_FEATURES_SQL}, {LABELS} SELECT episode_id, " + ", ".join(f"{r(f'''max({s}) FILTER (var = '{v}')''')} AS {v}_{s}" for v in VARIABLES for s in _STATS) + ", any_value(y) AS y FROM dense JOIN labels_of USING (episode_id) GROUP BY episode_id")
def simple_features_wide(spark, d):
    obs = observations(spark, d)
    wide = stats.features_wide(stats.simple_features(obs, VARIABLES), VARIABLES)
    return joins.label_join(wide, episode_labels(spark, d)).select("episode_id", *[rounded(F.col(f"{v}_{s}")).alias(f"{v}_{s}") for v in VARIABLES for s in _STATS], "y")


# ------------------------------------------------------------------ ranking


def _losses_sql(y: str, value: str, source: str = "long", bins: int = 16) -> str:
    """Losses per feature and cut by running sums over (feature, bin)."""
    return f"""lim AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM {source} GROUP BY 1),
b AS (SELECT s.feature, {y} AS y, len(list_filter(range(1, {bins}), lambda i: x > lo + i * ((hi - lo) / {bins}))) AS bin FROM {source} s JOIN lim USING (feature)),
sums AS (SELECT feature, bin, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS s, sum(y * y)::DOUBLE AS q FROM b GROUP BY ALL),
run AS (SELECT feature, bin, sum(n) OVER u AS nl, sum(s) OVER u AS sl, sum(q) OVER u AS ql, sum(n) OVER t AS nt, sum(s) OVER t AS st, sum(q) OVER t AS qt FROM sums WINDOW u AS (PARTITION BY feature ORDER BY bin), t AS (PARTITION BY feature)),
losses AS (SELECT feature, min({value}) AS loss FROM run WHERE bin < {bins - 1} GROUP BY feature)"""


def _bits(n: str, s: str) -> str:
    p = f"({s} / nullif({n}, 0))"
    return f"(CASE WHEN {n} > 0 THEN -{n} * ((CASE WHEN {p} > 0 THEN {p} * log2({p}) ELSE 0 END) + (CASE WHEN 1 - {p} > 0 THEN (1 - {p}) * log2(1 - {p}) ELSE 0 END)) ELSE 0 END)"


def _sse_sql(n: str, s: str, q: str) -> str:
    return f"(CASE WHEN {n} > 0 THEN greatest({q} - {s} * {s} / nullif({n}, 0), 0) ELSE 0 END)"


_BCE = f"({_bits('nl', 'sl')} + {_bits('(nt - nl)', '(st - sl)')}) / nt"
_RMSE = f"sqrt(({_sse_sql('nl', 'sl', 'ql')} + {_sse_sql('(nt - nl)', '(st - sl)', '(qt - ql)')}) / nt)"
_BCE_SQL = _losses_sql("(l_returnflag = 'R')::INT", _BCE)
_KEPT = "sd AS (SELECT feature, avg(x) AS m, stddev_pop(x) AS d FROM long GROUP BY 1), kept AS (SELECT long.* FROM long JOIN sd USING (feature) WHERE x BETWEEN m - 2 * d AND m + 2 * d)"


def _losses(df: DataFrame) -> DataFrame:
    return df.select("feature", rounded(F.col("loss")).alias("loss"))


@query(f"WITH {LONG}, {_BCE_SQL} SELECT feature, {r('loss')} AS loss FROM losses")
def dft_bce(spark, d):
    return _losses(ranking.split_losses(_items(spark, d), FEATURES, "y", 16, "bce"))


@query(f"""WITH {LONG}, lim AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY 1),
b AS (SELECT s.feature, l_returnflag AS y, len(list_filter(range(1, 16), lambda i: x > lo + i * ((hi - lo) / 16))) AS bin FROM long s JOIN lim USING (feature)),
n AS (SELECT feature, y, bin, count(*)::DOUBLE AS n FROM b GROUP BY ALL),
full_ AS (SELECT k.feature, c.y, k.bin, coalesce(n, 0) AS n FROM (SELECT DISTINCT feature, bin FROM n) k CROSS JOIN (SELECT DISTINCT y FROM n) c LEFT JOIN n USING (feature, y, bin)),
run AS (SELECT feature, y, bin, sum(n) OVER (PARTITION BY feature, y ORDER BY bin) AS l, sum(n) OVER (PARTITION BY feature, y) AS t FROM full_),
cut AS (SELECT feature, bin, sum(l) AS nl, sum(t) AS nt, -sum(CASE WHEN l > 0 THEN l * log2(l) ELSE 0 END) + CASE WHEN sum(l) > 0 THEN sum(l) * log2(sum(l)) ELSE 0 END AS bl, -sum(CASE WHEN t - l > 0 THEN (t - l) * log2(t - l) ELSE 0 END) + CASE WHEN sum(t - l) > 0 THEN sum(t - l) * log2(sum(t - l)) ELSE 0 END AS br FROM run GROUP BY ALL)
SELECT feature, {r('min((bl + br) / nt)')} AS loss FROM cut WHERE nl < nt GROUP BY feature""")
def dft_ce(spark, d):
    return _losses(ranking.split_losses(_items(spark, d), FEATURES, "c", 16, "ce"))


@query(f"WITH {LONG}, {_losses_sql('target', _RMSE)} SELECT feature, {r('loss')} AS loss FROM losses")
def rft_rmse(spark, d):
    return _losses(ranking.split_losses(_items(spark, d), FEATURES, "l_extendedprice", 16, "rmse"))


@query(f"WITH {LONG}, {_KEPT}, {_losses_sql('target', _RMSE, 'kept')} SELECT feature, {r('loss')} AS loss FROM losses")
def rft_rmse_outliers(spark, d):
    return _losses(ranking.split_losses(_items(spark, d), FEATURES, "l_extendedprice", 16, "rmse", outliers=True))


@query(f"WITH {LONG}, {_BCE_SQL} SELECT feature, {r('loss')} AS loss, row_number() OVER (ORDER BY loss, feature)::INT AS rank FROM losses QUALIFY rank <= 2")
def dft_topk(spark, d):
    return ranking.top_features(ranking.split_losses(_items(spark, d), FEATURES, "y", 16, "bce"), 2).withColumn("loss", rounded(F.col("loss")))


def _halves(spark, d, k: int = 0):
    even = F.col("l_orderkey") % 2 == 0
    items = _items(spark, d)
    return (ranking.split_losses(items.where(c), FEATURES, "y", 16, "bce") for c in (even, ~even))


def _half_sql(which: int, name: str) -> str:
    return f"{name} AS (WITH {LONG.replace('FROM lineitem', f'FROM lineitem WHERE l_orderkey % 2 = {which}')}, {_BCE_SQL} SELECT feature, row_number() OVER (ORDER BY loss, feature)::INT AS rank FROM losses)"


@query(f"WITH {_half_sql(0, 'a')}, {_half_sql(1, 'b')} SELECT feature, a.rank AS train_rank, b.rank AS valid_rank FROM a JOIN b USING (feature)")
def rank_join(spark, d):
    return ranking.rank_pairs(*_halves(spark, d))


@query(f"WITH {_half_sql(0, 'a')}, {_half_sql(1, 'b')} SELECT DISTINCT feature FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 2")
def topk_union(spark, d):
    return ranking.top_union(*_halves(spark, d), 2)


@query(f"SELECT event_type AS var, {r('sum(value)')} AS gain FROM events GROUP BY 1")
def gain_by_variable(spark, d):
    gains = observations(spark, d).select("var", F.col("seq").alias("pos"), F.col("v").alias("gain"))
    return ranking.gain_by_variable(gains).withColumn("gain", rounded(F.col("gain")))


# ------------------------------------------------------------------ separability


def _anova_sql(y: str, within: str, source: str = "long") -> str:
    return f"""per AS (SELECT feature, {y} AS y, count(x)::DOUBLE AS n, sum(x) AS s, avg(x) AS m, var_pop(x) * count(x) AS sse FROM {source} GROUP BY ALL),
f AS (SELECT feature, (sum(n * m * m) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / (sum(sse) / ({within})) AS f_value FROM per GROUP BY feature)"""


def _f_value(df: DataFrame) -> DataFrame:
    return df.withColumn("f_value", F.round("f_value", 4))


@query(f"WITH {LONG}, {_anova_sql(chr(40) + 'l_returnflag = ' + chr(39) + 'R' + chr(39) + ')::INT', 'sum(n)')} SELECT feature, round(f_value, 4) AS f_value FROM f")
def anova_f_binary(spark, d):
    return _f_value(separability.anova_f(_items(spark, d), FEATURES, "y"))


@query(f"WITH {LONG}, {_anova_sql('l_returnflag', 'sum(n)')} SELECT feature, round(f_value, 4) AS f_value FROM f")
def anova_f_multi(spark, d):
    return _f_value(separability.anova_f(_items(spark, d), FEATURES, "c"))


@query(f"WITH {LONG}, {_anova_sql('l_returnflag', 'sum(n) - count(*)')} SELECT feature, round(f_value, 4) AS f_value, row_number() OVER (ORDER BY f_value DESC, feature)::INT AS rank FROM f QUALIFY rank <= 2")
def anova_topk(spark, d):
    return _f_value(separability.anova_topk(_items(spark, d), FEATURES, "c", 2))


@query(f"WITH {PROBS} SELECT {r('avg(-ln(least(greatest(p, 1e-12), 1 - 1e-12) + 1e-9)) / ln(10)')} AS cross_entropy FROM long_p WHERE c = label")
def cross_entropy(spark, d):
    p = probabilities(spark, d)
    return separability.cross_entropy(p, F.element_at("p", F.col("label") + 1), 10).select(rounded(F.col("cross_entropy")).alias("cross_entropy"))


@query(f"WITH {PROBS} SELECT vec_id, {r('-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(10)')} AS entropy FROM long_p GROUP BY vec_id")
def row_entropy(spark, d):
    return probabilities(spark, d).select("vec_id", rounded(A.entropy(F.col("p"), 10)).alias("entropy"))


_CUTS = "lim AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), cuts AS (SELECT lo + i * ((hi - lo) / 8) AS bound FROM lim, range(1, 7) r(i))"
_WCE = f"""{_CUTS}, tot AS (SELECT l_returnflag AS c, count(*)::DOUBLE AS t FROM lineitem GROUP BY 1),
n AS (SELECT bound, l_extendedprice >= bound AS rgt, l_returnflag AS c, count(*)::DOUBLE AS n FROM lineitem, cuts GROUP BY ALL),
s AS (SELECT *, n / t AS s FROM n JOIN tot USING (c)), p AS (SELECT *, s / sum(s) OVER (PARTITION BY bound, rgt) AS p FROM s),
w AS (SELECT bound, sum(-ln(least(greatest(p, 1e-12), 1 - 1e-12) + 1e-9) * n) / sum(n) / ln(3) AS weighted_ce FROM p GROUP BY bound)"""


@query(f"WITH {_WCE} SELECT {r('bound')} AS bound, {r('weighted_ce')} AS weighted_ce FROM w")
def weighted_ce(spark, d):
    items = _items(spark, d)
    out = separability.weighted_ce(items, "l_extendedprice", "c", separability.interior_cuts(items, "l_extendedprice"), 3)
    return out.select(rounded(F.col("bound")).alias("bound"), rounded(F.col("weighted_ce")).alias("weighted_ce"))


@query(f"WITH {_WCE} SELECT {r('bound')} AS bound, {r('weighted_ce')} AS weighted_ce FROM w ORDER BY w.weighted_ce, w.bound LIMIT 1")
def best_ce_split(spark, d):
    out = separability.best_ce_split(_items(spark, d), "l_extendedprice", "c", 3)
    return out.select(rounded(F.col("bound")).alias("bound"), rounded(F.col("weighted_ce")).alias("weighted_ce"))


_BINS = "lim AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), binned AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, least(floor((l_extendedprice - lo) / (hi - lo) * 10)::INT, 9) AS bin FROM lineitem, lim)"
_DOM = f"""{_BINS}, n AS (SELECT bin, c, count(*) AS n FROM binned GROUP BY ALL), t AS (SELECT c, sum(n) AS t FROM n GROUP BY 1),
dom AS (SELECT i::INT AS bin, coalesce(arg_max(c, (n / t, -c)), 0)::INT AS dominant FROM range(10) r(i) LEFT JOIN (SELECT * FROM n JOIN t USING (c)) z ON z.bin = i GROUP BY i)"""


@query(f"WITH {_BINS} SELECT bin, count(*) AS n FROM binned GROUP BY bin")
def equal_width_bin(spark, d):
    return separability.binned(_items(spark, d), "l_extendedprice", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_DOM} SELECT bin, dominant FROM dom")
def dominant_bins(spark, d):
    return separability.dominant_bins(_items(spark, d), "l_extendedprice", "c", 10)


@query(f"WITH {_DOM}, p AS (SELECT dominant AS c, count(*) / 10.0::DOUBLE AS p FROM dom GROUP BY 1), k AS (SELECT c, count(*) AS n FROM binned GROUP BY 1) SELECT {r('sum(n * (-log10(coalesce(p, 0) + 1e-5) / log10(3))) / sum(n) / 3')} AS bin_ce FROM k LEFT JOIN p USING (c)")
def bin_cross_entropy(spark, d):
    return separability.bin_cross_entropy(_items(spark, d), "l_extendedprice", "c", 3, 10).select(rounded(F.col("bin_ce")).alias("bin_ce"))


@query(f"""WITH {_WCE}, best AS (SELECT bound AS bb FROM w ORDER BY weighted_ce, bound LIMIT 1),
n2 AS (SELECT l_extendedprice >= bb AS rgt, l_returnflag AS c, count(*)::DOUBLE AS n FROM lineitem, best GROUP BY ALL),
s2 AS (SELECT *, n / (sum(n) OVER (PARTITION BY c) + 1e-5) AS s FROM n2), p2 AS (SELECT *, s / (sum(s) OVER (PARTITION BY rgt) + 1e-5) AS p FROM s2)
SELECT {r('sum(-ln(least(greatest(p, 1e-12), 1 - 1e-12) + 1e-9) * n) / sum(n) / ln(3)')} AS bin_ce2 FROM p2""")
def bin_cross_entropy2(spark, d):
    return separability.bin_cross_entropy2(_items(spark, d), "l_extendedprice", "c", 3).select(rounded(F.col("bin_ce2")).alias("bin_ce2"))


def _w_sql(a: str, b: str) -> str:
    return f"""(WITH v AS (SELECT l_extendedprice AS x, count(*) FILTER ({a})::DOUBLE AS a, count(*) FILTER ({b})::DOUBLE AS b FROM lineitem GROUP BY 1),
c AS (SELECT x, sum(a) OVER (ORDER BY x) / sum(a) OVER () AS fa, sum(b) OVER (ORDER BY x) / sum(b) OVER () AS fb, lead(x) OVER (ORDER BY x) AS nx FROM v) SELECT sum(abs(fa - fb) * (nx - x)) FROM c)"""


def _flag(x: str) -> str:
    return f"l_returnflag = '{x}'"


@query(f"SELECT {r(_w_sql(_flag('R'), 'l_returnflag <> ' + chr(39) + 'R' + chr(39)))} AS distance")
def wasserstein(spark, d):
    return separability.wasserstein(_items(spark, d), "l_extendedprice", F.col("y") == 1).select(rounded(F.col("distance")).alias("distance"))


@query(f"SELECT {r('(' + ' + '.join(_w_sql(_flag(a), _flag(b)) for a, b in (('A', 'N'), ('A', 'R'), ('N', 'R'))) + ') / 3')} AS distance")
def wasserstein_multi(spark, d):
    return separability.wasserstein_multi(_items(spark, d), "l_extendedprice", "c", (0, 1, 2)).select(rounded(F.col("distance")).alias("distance"))


@query()
def kmeans_bin_entropy(spark, d):
    return separability.kmeans_bin_entropy(_items(spark, d), "l_extendedprice", "c", 3, 8)


@query()
def lloyd_max_bounds(spark, d):
    edges = separability.lloyd_max(_items(spark, d), "l_extendedprice", 8)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(edges)], "i int, bound double")


def _bin2_sql(source: str, classes: int) -> str:
    """Scores of rows (feature, x, c) in a table ``source``."""
    clip = "least(greatest(p, 1e-12), 1 - 1e-12) + 1e-9"
    return f"""lim2 AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM {source} GROUP BY 1),
cuts2 AS (SELECT feature, i, lo + i * ((hi - lo) / 8) AS bound FROM lim2, range(1, 7) r(i) WHERE hi > lo),
side AS (SELECT s.feature, i, x >= bound AS rgt, c, count(*)::DOUBLE AS n FROM {source} s JOIN cuts2 USING (feature) GROUP BY ALL),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY feature, i, c) AS s, n / (sum(n) OVER (PARTITION BY feature, i, c) + 1e-5) AS s2 FROM side),
pr AS (SELECT *, s / sum(s) OVER (PARTITION BY feature, i, rgt) AS p FROM sh),
wce AS (SELECT feature, i, sum(-ln({clip}) * n) / sum(n) AS w FROM pr GROUP BY ALL),
best2 AS (SELECT feature, arg_min(i, (w, i)) AS i FROM wce GROUP BY 1),
p2 AS (SELECT feature, n, s2 / (sum(s2) OVER (PARTITION BY feature, rgt) + 1e-5) AS p FROM sh JOIN best2 USING (feature, i)),
scores AS (SELECT feature, sum(-ln({clip}) * n) / sum(n) / ln({classes}) AS score FROM p2 GROUP BY 1)"""


@query(f"WITH {LONG}, src AS (SELECT feature, x, l_returnflag AS c FROM long), {_bin2_sql('src', 3)} SELECT feature, {r('score')} AS score FROM scores")
def all_feature_scores(spark, d):
    return separability.all_feature_scores(_items(spark, d), FEATURES, "c", 3, 10, "bin2").withColumn("score", rounded(F.col("score")))


_ALL_BINS = f"""{LONG}, lim AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM long GROUP BY 1), b AS (SELECT feature, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS c, least(floor((x - lo) / (hi - lo) * 10)::INT, 9) AS bin FROM long JOIN lim USING (feature)),
n AS (SELECT feature, bin, c, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT feature, c, sum(n) AS t FROM n GROUP BY ALL), f AS (SELECT DISTINCT feature FROM n),
dom AS (SELECT f.feature, i, coalesce(arg_max(c, (n / t, -c)), 0) AS c FROM f, range(10) r(i) LEFT JOIN (SELECT * FROM n JOIN t USING (feature, c)) z ON z.bin = i AND z.feature = f.feature GROUP BY ALL),
p AS (SELECT feature, c, count(*) / 10.0::DOUBLE AS p FROM dom GROUP BY ALL)"""


@query(f"WITH {_ALL_BINS} SELECT t.feature, {r('sum(t * (-log10(coalesce(p, 0) + 1e-5) / log10(3))) / sum(t) / 3')} AS score FROM t LEFT JOIN p ON p.feature = t.feature AND p.c = t.c GROUP BY t.feature")
def all_feature_bin_scores(spark, d):
    return separability.all_feature_scores(_items(spark, d), FEATURES, "c", 3, 10, "bin").withColumn("score", rounded(F.col("score")))


@query()
def all_feature_kmeans_scores(spark, d):
    return separability.all_feature_scores(_items(spark, d), FEATURES, "c", 3, 8, "kmeans")


# ------------------------------------------------------------------ evaluation


@query(f"""WITH s AS (SELECT l_quantity * l_discount AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM s)
SELECT {r('(sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1)::DOUBLE * count(*) FILTER (y = 0))')} AS auroc FROM k""")
def auroc(spark, d):
    scored = _items(spark, d).select((F.col("l_quantity") * F.col("l_discount")).alias("s"), "y")
    return evaluate.auroc(scored, "s", "y").select(rounded(F.col("auroc")).alias("auroc"))


_ORDERED = f"{PROBS}, o AS (SELECT vec_id, label, c, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS k FROM long_p)"


@query(f"WITH {_ORDERED} SELECT {r('count(*) FILTER (c = label AND k <= 2) / count(DISTINCT vec_id)')} AS accuracy FROM o")
def topk_accuracy(spark, d):
    return evaluate.topk_accuracy(probabilities(spark, d), F.col("p"), F.col("label"), 2).select(rounded(F.col("accuracy")).alias("accuracy"))


@query(f"""WITH {_ORDERED}, top AS (SELECT vec_id, max(c) FILTER (k = 1) AS a, max(c) FILTER (k = 2) AS b FROM o GROUP BY 1)
SELECT x.i::INT AS a, y.j::INT AS b, count(top.vec_id) AS n FROM range(10) x(i) JOIN range(10) y(j) ON i < j LEFT JOIN top ON a = i AND b = j GROUP BY ALL""")
def top_pair_counts(spark, d):
    return evaluate.top_pair_counts(probabilities(spark, d), F.col("p"), 10)


@query("SELECT vec_id, CASE label WHEN 3 THEN 0 ELSE 1 END AS group_label FROM embeddings WHERE label IN (3, 5)")
def class_pair_filter(spark, d):
    return evaluate.class_group(images(spark, d), "label", (3, 5)).select("vec_id", "group_label")


@query(f"WITH {_ORDERED}, top AS (SELECT vec_id, any_value(label) AS label, max(c) FILTER (k = 1) AS a, max(c) FILTER (k = 2) AS b FROM o GROUP BY 1) SELECT vec_id, label FROM top WHERE a = 0 AND b = 1 AND label IN (0, 1)")
def class_pair_test(spark, d):
    return evaluate.class_group(probabilities(spark, d), "label", (0, 1), F.col("p")).select("vec_id", "label")


@query(f"WITH m AS (SELECT l_orderkey, l_linenumber % 3 AS c, l_discount * 10 AS p FROM lineitem) SELECT l_orderkey, c, {r('avg(p)')} AS p FROM m GROUP BY ALL")
def prob_ensemble(spark, d):
    models = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("c"), (F.col("l_discount") * 10).alias("p"))
    return evaluate.prob_ensemble(models, "l_orderkey", "c").withColumn("p", rounded(F.col("p")))


@query(f"WITH {PROBS}, b AS (SELECT vec_id, list_sort(p, 'DESC')[3] AS bar FROM probs) SELECT vec_id, c, CASE WHEN p > bar THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS mark FROM long_p JOIN b USING (vec_id)")
def merge_topk(spark, d):
    return probabilities(spark, d).select("vec_id", F.posexplode(A.mark_top(F.col("p"), 2)).alias("c", "mark"))


@query(f"""WITH {_ORDERED}, srt AS (SELECT vec_id, list_sort(p) AS s FROM probs),
u AS (SELECT vec_id, s[10] < 0.9 AND (s[10] - list_sum(s[1:9]) < -0.01 OR s[9] - list_sum(s[1:8]) < -0.01) AS three FROM srt),
l AS (SELECT vec_id, c FROM o JOIN u USING (vec_id) WHERE k <= CASE WHEN three THEN 3 ELSE 2 END UNION ALL SELECT vec_id, 10 FROM u WHERE NOT three)
SELECT vec_id, string_agg(c::VARCHAR, ',' ORDER BY c) AS classes FROM l GROUP BY vec_id""")
def adaptive_topk(spark, d):
    return probabilities(spark, d).select("vec_id", F.concat_ws(",", F.transform(A.adaptive_top(F.col("p")), lambda x: x.cast("string"))).alias("classes"))


# ------------------------------------------------------------------ sampling


@query("WITH h AS (SELECT o_orderkey, ((o_orderkey % 2147483648) * 2654435761) % 4294967296 / 4294967296.0::DOUBLE AS u FROM orders) SELECT o_orderkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8::DOUBLE + 0.1::DOUBLE THEN 'valid' ELSE 'test' END AS split FROM h")
def hash_split(spark, d):
    return sampling.hash_split(table(spark, d, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY ((vec_id % 2147483648) * 2654435761) % 4294967296, vec_id) <= 7")
def balanced_sample(spark, d):
    return sampling.balanced_sample(table(spark, d, "embeddings").select("vec_id", "label"), "label", "vec_id", 7)


# ------------------------------------------------------------------ images


def _image_rows(df: DataFrame, array: str, width: int, value=lambda v: v) -> DataFrame:
    rows = grid.as_rows(df, array, width, "vec_id")
    return rows.select("vec_id", "h", "w", rounded(value(F.col("v"))).alias("v"))


def _pool_sql(agg: str, step: int = 2) -> str:
    return f"WITH {PIXELS} SELECT vec_id, (h // {step})::INT AS h, (w // {step})::INT AS w, {r(agg)} AS v FROM pix GROUP BY ALL"


@query(_pool_sql("max(v)").replace("GROUP BY ALL", "GROUP BY vec_id, pix.h // 2, pix.w // 2"))
def pool_max(spark, d):
    return _image_rows(grid.pool(images(spark, d), "image", SIDE, SIDE, 2, "max"), "pooled", SIDE // 2)


@query(_pool_sql("avg(v)").replace("GROUP BY ALL", "GROUP BY vec_id, pix.h // 2, pix.w // 2"))
def pool_avg(spark, d):
    return _image_rows(grid.pool(images(spark, d), "image", SIDE, SIDE, 2, "avg"), "pooled", SIDE // 2)


@query(_pool_sql("median(v)", 4).replace("GROUP BY ALL", "GROUP BY vec_id, pix.h // 4, pix.w // 4"))
def pool_median(spark, d):
    return _image_rows(grid.pool(images(spark, d), "image", SIDE, SIDE, 4, "median"), "pooled", SIDE // 4)


@query(f"WITH {PIXELS} SELECT vec_id, (h // 2)::INT AS h, (w // 2)::INT AS w, {r('v')} AS v FROM pix WHERE pix.h % 2 = 0 AND pix.w % 2 = 0")
def pool_direct(spark, d):
    return _image_rows(grid.pool(images(spark, d), "image", SIDE, SIDE, 2, "direct"), "pooled", SIDE // 2)


def _arg_sql(key: str) -> str:
    o = f"ORDER BY {key} DESC, pix.h, pix.w"
    return f"WITH {PIXELS} SELECT vec_id, (h // 2)::INT AS h, (w // 2)::INT AS w, {r('v')} AS v, (2 * (h % 2) + w % 2)::INT AS i FROM pix QUALIFY row_number() OVER (PARTITION BY vec_id, pix.h // 2, pix.w // 2 {o}) = 1"


def _arg_rows(df: DataFrame) -> DataFrame:
    return grid.as_rows(df, "pooled", SIDE // 2, "vec_id").select("vec_id", "h", "w", rounded(F.col("v.v")).alias("v"), F.col("v.i").alias("i"))


@query(_arg_sql("abs(v)"))
def pool_maxabs(spark, d):
    return _arg_rows(grid.pool_arg(images(spark, d), "image", SIDE, SIDE, 2))


@query(_arg_sql("v"))
def pool_maxraw(spark, d):
    return _arg_rows(grid.pool_arg(images(spark, d), "image", SIDE, SIDE, 2, absolute=False))


@query(f"""WITH {PIXELS}, offs AS (SELECT i, j FROM range(3) a(i), range(3) b(j)), wnd AS (SELECT y, x FROM range(3) c(y), range(3) e(x))
SELECT vec_id, y::INT AS h, x::INT AS w, {r('sum(v)')} AS total, {r('max(v) FILTER (i = 0 AND j = 0)')} AS corner FROM pix JOIN wnd ON true JOIN offs ON pix.h = 2 * y + i AND pix.w = 2 * x + j GROUP BY vec_id, y, x""")
def grid_patches(spark, d):
    p = grid.patch_rows(images(spark, d), "image", SIDE, SIDE, 3, 2, "vec_id")
    return p.select("vec_id", "h", "w", rounded(A.total(F.col("patch"))).alias("total"), rounded(F.element_at("patch", 1)).alias("corner"))


@query(f"WITH {PIXELS} SELECT vec_id, h, 7 - w AS w, {r('v')} AS v FROM pix")
def grid_mirror(spark, d):
    return _image_rows(images(spark, d).withColumn("m", A.mirrored(F.col("image"), SIDE, SIDE)), "m", SIDE)


@query(f"WITH {PIXELS} SELECT vec_id, h - 1 AS h, w - 1 AS w, {r('v')} AS v FROM pix WHERE pix.h BETWEEN 1 AND 6 AND pix.w BETWEEN 1 AND 6")
def grid_crop(spark, d):
    return _image_rows(images(spark, d).withColumn("m", A.cropped(F.col("image"), SIDE, SIDE, 1, 1, 6, 6)), "m", 6)


@query(f"""WITH {PIXELS}, g AS (SELECT y, x, CASE WHEN y = 0 THEN 1 WHEN y = 9 THEN 6 ELSE y - 1 END AS sy, CASE WHEN x = 0 THEN 1 WHEN x = 9 THEN 6 ELSE x - 1 END AS sx FROM range(10) a(y), range(10) b(x))
SELECT vec_id, y::INT AS h, x::INT AS w, {r('v')} AS v FROM g JOIN pix ON pix.h = sy AND pix.w = sx""")
def grid_reflect_pad(spark, d):
    return _image_rows(images(spark, d).withColumn("m", A.padded(F.col("image"), SIDE, SIDE, 1, "reflect")), "m", SIDE + 2)


@query(f"WITH {PIXELS} SELECT vec_id, pix.h AS h, pix.w AS w, {r('v * n / (n + 1e-5)')} AS v FROM pix JOIN (SELECT y, x, (CASE WHEN y IN (0, 1, 6, 7) THEN 1 ELSE 2 END) * (CASE WHEN x IN (0, 1, 6, 7) THEN 1 ELSE 2 END) AS n FROM range(8) a(y), range(8) b(x)) c ON c.y = pix.h AND c.x = pix.w")
def overlap_average(spark, d):
    wins = F.transform(A.windows(F.col("image"), SIDE, SIDE, 4, 2), lambda p: F.struct((p["h"] * 2).alias("h0"), (p["w"] * 2).alias("w0"), F.lit(4).alias("size"), p["patch"].alias("patch")))
    return _image_rows(images(spark, d).withColumn("wins", wins).withColumn("m", A.overlap_average(F.col("wins"), SIDE, SIDE)), "m", SIDE)


@query(f"WITH {PIXELS}, p AS (SELECT vec_id, h // 2 AS ph, w // 2 AS pw, max(v) AS m FROM pix GROUP BY vec_id, pix.h // 2, pix.w // 2) SELECT pix.vec_id, pix.h, pix.w, {r('v + m')} AS v FROM pix JOIN p ON p.vec_id = pix.vec_id AND ph = pix.h // 2 AND pw = pix.w // 2")
def hop_concat(spark, d):
    both = grid.hop_concat(grid.pool(images(spark, d), "image", SIDE, SIDE, 2, "max"), (("image", SIDE), ("pooled", SIDE // 2)), SIDE, SIDE)
    return _image_rows(both, "features", SIDE, lambda v: v[0] + v[1])


@query(f"WITH {PIXELS}, s AS (SELECT h, w, avg(abs(v)) AS score FROM pix GROUP BY ALL) SELECT 0 AS channel, (8 * h + w)::INT AS pos FROM s QUALIFY row_number() OVER (ORDER BY score, pos) <= 32")
def select_positions(spark, d):
    scores = grid.as_rows(images(spark, d), "image", SIDE, "vec_id").groupBy((F.col("h") * SIDE + F.col("w")).alias("pos")).agg(F.avg(F.abs("v")).alias("score"))
    return subspace.select_positions(scores.withColumn("channel", F.lit(0)), share=0.5)


@query(f"""WITH {PIXELS}, src AS (SELECT 8 * h + w AS feature, abs(v) AS x, label AS c FROM pix), {_bin2_sql('src', 10)},
pick AS (SELECT h, w FROM (SELECT (feature // 8)::INT AS h, (feature % 8)::INT AS w, score FROM scores) QUALIFY row_number() OVER (PARTITION BY h // 2, w // 2 ORDER BY score, h, w) = 1)
SELECT vec_id, (pix.h // 2)::INT AS h, (pix.w // 2)::INT AS w, {r('v')} AS v FROM pix JOIN pick ON pick.h = pix.h AND pick.w = pix.w""")
def pool_min_ce(spark, d):
    return _image_rows(grid.pool_min_ce(images(spark, d), "image", "label", SIDE, SIDE, 2, 10), "pooled", SIDE // 2)


@query()
def grid_augment(spark, d):
    return grid.augment(images(spark, d), "image", SIDE, SIDE, tuple(grid.AUGMENTS), "vec_id").groupBy("mode").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(A.mean(F.col("image")))).alias("mean"))


@query()
def grid_resize(spark, d):
    return _image_rows(grid.resize(images(spark, d), "image", SIDE, SIDE, 4, 4), "image", 4)


# ------------------------------------------------------------------ subspaces


@query()
def pca_features(spark, d):
    img = images(spark, d)
    out = subspace.transform(img, subspace.fit_pca(img, "image", 8), "image")
    return out.select("vec_id", F.transform("features", rounded).alias("features"))


@query()
def saab_tree(spark, d):
    tree = subspace.HopTree((subspace.Hop(2), subspace.Hop(2)), (SIDE, SIDE, 1), 0.02, 0.005).fit(images(spark, d), "image")
    return tree.table(spark)


@query(f"WITH c AS (SELECT l_quantity AS x, (l_returnflag = 'R')::INT AS y FROM lineitem) SELECT {r('regr_slope(y, x)')} AS theta FROM c")
def lnt_single(spark, d):
    theta = subspace.least_squares_direction(_items(spark, d), ("l_quantity",), "y")
    return spark.createDataFrame([(float(theta[0]),)], "theta double").select(rounded(F.col("theta")).alias("theta"))


@query()
def lnt_projection(spark, d):
    items = _items(spark, d)
    theta = subspace.least_squares_direction(items, FEATURES, "y")
    return subspace.projected(items, FEATURES, theta).select("l_orderkey", "l_linenumber", rounded(F.col("projection")).alias("projection"))


@query(f"WITH {PIXELS} SELECT k::INT AS k, {r('var_pop(v)')} AS variance FROM px GROUP BY px.k")
def coefficient_variance(spark, d):
    return layers.coefficient_variance(images(spark, d), "image").withColumn("variance", rounded(F.col("variance")))


# Codes of coma scale answers, over made-up answers.
@query("WITH a AS (SELECT event_id, ['4 Spontaneously', 'To Speech', 'to pain', 'No Response', 'other'][(event_id % 5) + 1] AS x FROM events) SELECT event_id, CASE WHEN lower(x) LIKE '%respon%' THEN 0 WHEN lower(x) LIKE '%pain%' THEN 1 WHEN lower(x) LIKE '%speech%' THEN 2 WHEN lower(x) LIKE '%spont%' THEN 3 END AS code FROM a")
def coma_scale_codes(spark, d):
    answers = F.array(*[F.lit(x) for x in ("4 Spontaneously", "To Speech", "to pain", "No Response", "other")])
    return table(spark, d, "events").select("event_id", C.encode_ordered(F.element_at(answers, (F.col("event_id") % 5 + 1).cast("int")), EYE_OPENING).alias("code"))
