"""Queries of learned subspaces, images and learners. Windows of two and three entries have closed forms, which the SQL states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import arrays as A
from lacuna.operators import classify, evaluate, grid, joins, layers, ranking, sampling, separability, stats, subspace
from lacuna.plans.registered import query
from lacuna.plans.tables import PIXELS, SIDE, VARIABLES, episode_labels, images, observations, r, rounded, table
from lacuna.sources import sinks
from lacuna.storage import durable, shared_dir

# ------------------------------------------------------------------ closed forms


def _triples(spark, d, absolute: bool = False) -> DataFrame:
    """(vec_id, w, x): windows of three neighbouring pixels, 21 an image."""
    x = F.col("image") if not absolute else F.transform("image", F.abs)
    wins = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.struct(i.alias("w"), F.slice(x, 3 * i + 1, 3).alias("x")))
    return images(spark, d).select("vec_id", F.explode(wins).alias("p")).select("vec_id", "p.w", "p.x")


def _triple_sql(value: str = "embedding[3 * w + {i}]::DOUBLE") -> str:
    """Windows x1..x3; their mean-free part in the plane with axes u and v; covariances a, c, b of these; eigenvalues l1 >= l2; the first eigenvector (px, py); signs s1, s2 of the kernels' largest entries."""
    x = ", ".join(f"{value.format(i=i)} AS x{i}" for i in (1, 2, 3))
    k1 = ["px / sqrt(2) + py / sqrt(6)", "-px / sqrt(2) + py / sqrt(6)", "-2 * py / sqrt(6)"]
    k2 = ["-py / sqrt(2) + px / sqrt(6)", "py / sqrt(2) + px / sqrt(6)", "-2 * px / sqrt(6)"]

    def sign(k: list[str]) -> str:
        big = "greatest(" + ", ".join(f"abs({e})" for e in k) + ")"
        return f"CASE WHEN abs({k[0]}) = {big} THEN sign({k[0]}) WHEN abs({k[1]}) = {big} THEN sign({k[1]}) ELSE sign({k[2]}) END"

    return f"""win AS (SELECT vec_id, w::INT AS w, {x} FROM embeddings, range(21) t(w)),
pl AS (SELECT *, (x1 - x2) / sqrt(2) AS u, (x1 + x2 - 2 * x3) / sqrt(6) AS v FROM win),
st AS (SELECT var_samp(u) AS a, var_samp(v) AS c, covar_samp(u, v) AS b, avg(u) AS mu, avg(v) AS mv, 3 * var_pop((x1 + x2 + x3) / 3) AS e0, max(sqrt(x1 * x1 + x2 * x2 + x3 * x3)) AS norm FROM pl),
ev AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM st),
ax AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS px, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS py FROM ev),
sg AS (SELECT *, {sign(k1)} AS s1, {sign(k2)} AS s2 FROM ax),
ft AS (SELECT vec_id, w, (x1 + x2 + x3) / sqrt(3) AS f0, s1 * (px * (u - mu) + py * (v - mv)) AS f1, s2 * (px * (v - mv) - py * (u - mu)) AS f2 FROM pl, sg)"""


def _three(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key, *[rounded(F.element_at("features", i + 1)).alias(f"f{i}") for i in range(3)])


_F3 = ", ".join(f"{r(f'f{i}')} AS f{i}" for i in range(3))


@query(f"WITH {_triple_sql()} SELECT vec_id, w, {_F3} FROM ft")
def saab_features(spark, d):
    x = _triples(spark, d)
    return _three(subspace.transform(x, subspace.fit_saab(x, "x"), "x"), "vec_id", "w")


@query(f"WITH {_triple_sql()} SELECT k::INT AS k, {r('CASE k WHEN 0 THEN e0 WHEN 1 THEN l1 ELSE l2 END / (e0 + l1 + l2)')} AS energy FROM ev, range(3) t(k)")
def saab_energy(spark, d):
    m = subspace.fit_saab(_triples(spark, d), "x")
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(m.energy)], "k int, energy double").withColumn("energy", rounded(F.col("energy")))


@query(f"WITH {PIXELS}, per AS (SELECT var_samp(v) AS s FROM px GROUP BY px.k) SELECT {r('sum(s)')} AS variance FROM per")
def saab_variance(spark, d):
    """The variances of all features of whole images add up to those of the pixels: the transform is a rotation."""
    img = images(spark, d)
    out = subspace.transform(img, subspace.fit_saab(img, "image"), "image")
    per = out.select(F.posexplode("features").alias("k", "x")).groupBy("k").agg(F.var_samp("x").alias("s"))
    return per.agg(rounded(F.sum("s")).alias("variance"))


@query(f"WITH s AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS t FROM embeddings) SELECT vec_id, {r('t / 64 * 8')} AS dc FROM s")
def saab_dc(spark, d):
    img = images(spark, d)
    out = subspace.transform(img, subspace.fit_saab(img, "image"), "image")
    return out.select("vec_id", rounded(F.element_at("features", 1)).alias("dc"))


@query(f"""WITH {_triple_sql()}, iv AS (SELECT vec_id, w, (f0 * sqrt(3) + sqrt(3) * norm) / sqrt(3) / sqrt(e0) - norm / sqrt(3) AS f0, f1, f2 FROM ft, sg)
SELECT vec_id, w, {_F3} FROM iv""")
def saab_invertible(spark, d):
    x = _triples(spark, d)
    return _three(subspace.transform(x, subspace.fit_dc_saab(x, "x"), "x"), "vec_id", "w")


@query(f"""WITH {_triple_sql()}, e AS (SELECT k, CASE k WHEN 0 THEN e0 WHEN 1 THEN l1 ELSE l2 END / (e0 + l1 + l2) AS energy FROM ev, range(3) t(k)),
c AS (SELECT *, coalesce(sum(energy) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e) SELECT k::INT AS k, {r('energy')} AS energy FROM c WHERE before <= 0.5""")
def saab_energy_share(spark, d):
    """Kernels up to the one with which the energies exceed a half."""
    m = subspace.fit_dc_saab(_triples(spark, d), "x", 0.5)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(m.energy)], "k int, energy double").withColumn("energy", rounded(F.col("energy")))


@query(f"WITH {PIXELS} SELECT vec_id, k::INT AS k, {r('v')} AS v FROM px")
def saab_roundtrip(spark, d):
    img = images(spark, d)
    model = subspace.fit_dc_saab(img, "image", use_dc=False)
    back = subspace.transform(subspace.transform(img, model, "image", "f"), model, "f", "b", inverse=True)
    return back.select("vec_id", F.posexplode("b").alias("k", "v")).withColumn("v", rounded(F.col("v")))


_PAIR = """pr AS (SELECT vec_id, w::INT AS w, embedding[2 * w + 1]::DOUBLE AS x1, embedding[2 * w + 2]::DOUBLE AS x2 FROM embeddings, range(32) t(w)),
st AS (SELECT var_samp(x1) AS a, var_samp(x2) AS c, covar_samp(x1, x2) AS b FROM pr),
ev AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ** 2 + b * b) AS l2 FROM st),
ax AS (SELECT *, b / sqrt(b * b + (l1 - a) ** 2) AS px, (l1 - a) / sqrt(b * b + (l1 - a) ** 2) AS py FROM ev),
sg AS (SELECT *, CASE WHEN abs(px) >= abs(py) THEN sign(px) ELSE sign(py) END AS s1, CASE WHEN abs(py) >= abs(px) THEN sign(-py) ELSE sign(px) END AS s2 FROM ax)"""


def _pairs(spark, d) -> DataFrame:
    wins = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.alias("w"), F.slice("image", 2 * i + 1, 2).alias("x")))
    return images(spark, d).select("vec_id", F.explode(wins).alias("p")).select("vec_id", "p.w", "p.x")


@query(f"WITH {_PAIR} SELECT vec_id, w, {r('s1 * (px * x1 + py * x2)')} AS f0, {r('s2 * (px * x2 - py * x1)')} AS f1 FROM pr, sg")
def pca_pairs(spark, d):
    x = _pairs(spark, d)
    out = subspace.transform(x, subspace.fit_pca(x, "x"), "x")
    return out.select("vec_id", "w", *[rounded(F.element_at("features", i + 1)).alias(f"f{i}") for i in range(2)])


@query(f"WITH {_PAIR} SELECT k::INT AS k, {r('CASE k WHEN 0 THEN l1 ELSE l2 END / (l1 + l2)')} AS energy FROM ev, range(2) t(k) WHERE k = 0 OR l1 / (l1 + l2) < 0.9")
def pca_energy(spark, d):
    """Directions up to nine tenths of the energy."""
    m = subspace.fit_pca(_pairs(spark, d), "x", 0.9)
    return spark.createDataFrame([(i, float(e)) for i, e in enumerate(m.energy)], "k int, energy double").withColumn("energy", rounded(F.col("energy")))


# ------------------------------------------------------------------ stacks and trees of windows of two

_STACK = f"""{PIXELS}, a0 AS (SELECT p.vec_id, p.h, p.w // 2 AS w, p.v AS a, q.v AS b FROM pix p JOIN pix q ON q.vec_id = p.vec_id AND q.h = p.h AND q.w = p.w + 1 WHERE p.w % 2 = 0),
s0 AS (SELECT avg(a - b) AS m, max(abs(a - b)) / sqrt(2) AS bias FROM a0),
o1 AS (SELECT vec_id, h, w, 0 AS c, (a + b) / sqrt(2) AS f FROM a0 UNION ALL SELECT vec_id, h, w, 1, (a - b - m) / sqrt(2) FROM a0, s0),
a1 AS (SELECT p.vec_id, p.h, p.w // 2 AS w, p.c, p.f AS a, q.f AS b FROM o1 p JOIN o1 q ON q.vec_id = p.vec_id AND q.h = p.h AND q.c = p.c AND q.w = p.w + 1 WHERE p.w % 2 = 0)"""


@query(f"""WITH {_STACK}, s1 AS (SELECT c, avg(a - b) AS m FROM a1 GROUP BY c),
o2 AS (SELECT vec_id, h, w, c, 0 AS k, (a + b) / sqrt(2) + sqrt(2) * bias AS f FROM a1, s0 UNION ALL SELECT vec_id, h, w, c, 1, (a - b - s1.m) / sqrt(2) FROM a1 JOIN s1 USING (c))
SELECT vec_id, ((h * 2 + w) * 4 + 2 * c + k)::INT AS pos, {r('f')} AS v FROM o2""")
def layer_features(spark, d):
    """Two layers of windows of one row and two columns, the second one per channel."""
    hop = lambda c: subspace.Hop((1, 2), channelwise=c)
    stack = layers.LayerStack((hop(False), hop(True)), (SIDE, SIDE, 1)).fit(images(spark, d), "image")
    return stack.apply(images(spark, d), "image", "f").select("vec_id", F.posexplode("f").alias("pos", "v")).withColumn("v", rounded(F.col("v")))


@query(f"WITH {PIXELS} SELECT vec_id, k::INT AS k, {r('v')} AS v, (1 + 4) * (4 * 4 + 4 + 1) AS parameters FROM px")
def layer_roundtrip(spark, d):
    stack = layers.LayerStack((subspace.Hop(2, channelwise=False), subspace.Hop(2)), (SIDE, SIDE, 1)).fit(images(spark, d), "image")
    back = stack.apply(stack.apply(images(spark, d), "image", "f"), "f", "b", inverse=True)
    return back.select("vec_id", F.posexplode("b").alias("k", "v")).withColumn("v", rounded(F.col("v"))).withColumn("parameters", F.lit(stack.parameters))


@query(f"""WITH {_STACK}, e1 AS (SELECT 2 * var_pop((a + b) / 2) AS e0, 2 * var_samp((a - b) / 2) AS e1 FROM a0),
t1 AS (SELECT 0 AS layer, 0 AS node, c::INT AS channel, CASE c WHEN 0 THEN e0 ELSE e1 END / (e0 + e1) AS energy FROM e1, range(2) t(c)),
e2 AS (SELECT c, 2 * var_pop((a + b) / 2) AS e0, 2 * var_samp((a - b) / 2) AS e1 FROM a1 GROUP BY c),
t2 AS (SELECT 1 AS layer, e2.c::INT AS node, k::INT AS channel, t1.energy * CASE k WHEN 0 THEN e0 ELSE e1 END / (e0 + e1) AS energy FROM e2 JOIN t1 ON t1.channel = e2.c, range(2) t(k))
SELECT layer, node, channel, {r('energy')} AS energy FROM t1 UNION ALL SELECT layer, node, channel, {r('energy')} FROM t2""")
def tree_energies(spark, d):
    hops = (subspace.Hop((1, 2)), subspace.Hop((1, 2)))
    tree = subspace.HopTree(hops, (SIDE, SIDE, 1), 0.02, 0.005).fit(images(spark, d), "image")
    return tree.table(spark).select("layer", "node", "channel", rounded(F.col("energy")).alias("energy"))


@query(f"""WITH {_triple_sql()} SELECT {r('0.5 / (l1 / (l1 + l2))')} AS ratio, {r('(SELECT avg((abs(x1) + abs(x2) + abs(x3)) / 3 / abs(x1)) FROM win WHERE x1 <> 0) / 1000')} AS mean_abs FROM ev""")
def split_scores(spark, d):
    """What the split modes compare with their threshold; magnitudes in thousands, as first entries may be next to 0."""
    x = _triples(spark, d)
    rows = [(layers.split_score(x, "x", 0.5, "ratio"), layers.split_score(x, "x", 0.5, "mean_abs") / 1000)]
    return spark.createDataFrame(rows, "ratio double, mean_abs double").select(rounded(F.col("ratio")).alias("ratio"), rounded(F.col("mean_abs")).alias("mean_abs"))


@query(f"WITH {_triple_sql('abs(embedding[3 * w + {i}]::DOUBLE)')} SELECT vec_id, w, {_F3} FROM ft")
def global_saab(spark, d):
    """One channel's magnitudes at three positions."""
    _, out = layers.global_transform(_triples(spark, d), "x", (1, 3, 1), absolute=True)
    return _three(out, "vec_id", "w")


@query(f"""WITH g AS (SELECT unnest(['01', '02', '0']) AS grp), c AS (SELECT l_quantity AS x, CASE l_returnflag WHEN 'A' THEN '0' WHEN 'N' THEN '1' ELSE '2' END AS c FROM lineitem)
SELECT grp, {r('regr_slope(contains(grp, c)::INT, x) * 1000')} AS theta FROM c, g GROUP BY grp""")
def lnt_groupings(spark, d):
    """Least-squares slopes for every way to cut three classes in two."""
    c = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    got = subspace.grouped_directions(table(spark, d, "lineitem").select("l_quantity", c.alias("c")), ("l_quantity",), "c", (0, 1, 2))
    return spark.createDataFrame([("".join(map(str, g)), float(t[0]) * 1000) for g, t in got], "grp string, theta double").withColumn("theta", rounded(F.col("theta")))


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount * 100 AS z, (l_returnflag = 'R')::INT AS y FROM lineitem),
s AS (SELECT var_pop(x) AS a, var_pop(z) AS b, covar_pop(x, z) AS m, covar_pop(x, y) AS p, covar_pop(z, y) AS q, avg(x) AS ax, avg(z) AS az FROM c)
SELECT l_orderkey, l_linenumber, {r('((x - ax) * (p * b - q * m) + (z - az) * (q * a - p * m)) / (a * b - m * m) * 1000')} AS projection FROM c, s""")
def lnt_projection_pair(spark, d):
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 100).alias("z"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    theta = subspace.least_squares_direction(items, ("l_quantity", "z"), "y")
    return subspace.projected(items, ("l_quantity", "z"), theta).select("l_orderkey", "l_linenumber", rounded(F.col("projection") * 1000).alias("projection"))


@query(f"WITH {_triple_sql()} SELECT vec_id, w, {_F3} FROM ft")
def model_roundtrip(spark, d):
    """Features of a model that was saved and loaded again."""
    x, path = _triples(spark, d), f"{shared_dir(spark).rstrip('/')}/model_roundtrip"
    sinks.save_model(spark, subspace.fit_saab(x, "x"), path)
    return _three(subspace.transform(x, sinks.load_model(spark, path), "x"), "vec_id", "w")


# ------------------------------------------------------------------ images

#: Weights of a Lanczos window of four lobes at half the size: pixel q of 4 reads from 8, edges held.
_LANCZOS = """lz AS (SELECT q, greatest(least(k, 7), 0) AS p, sum(CASE WHEN x = 0 THEN 1 WHEN abs(x) >= 4 THEN 0 ELSE sin(pi() * x) / (pi() * x) * sin(pi() * x / 4) / (pi() * x / 4) END) AS g
  FROM (SELECT q, k, (2 * q + 0.5::DOUBLE) - k AS x FROM range(4) a(q), range(-8, 16) b(k) WHERE k > floor(2 * q + 0.5) - 4 AND k <= floor(2 * q + 0.5) + 4) GROUP BY ALL),
wt AS (SELECT q, p, g / sum(g) OVER (PARTITION BY q) AS g FROM lz)"""


@query(f"WITH {PIXELS}, {_LANCZOS} SELECT vec_id, a.q::INT AS h, b.q::INT AS w, {r('sum(a.g * b.g * v)')} AS v FROM pix JOIN wt a ON a.p = pix.h JOIN wt b ON b.p = pix.w GROUP BY vec_id, a.q, b.q")
def grid_resize_half(spark, d):
    return grid.as_rows(grid.resize(images(spark, d), "image", SIDE, SIDE, 4, 4), "image", 4, "vec_id").withColumn("v", rounded(F.col("v")))


def _rotated_sql(degrees: int) -> str:
    a = f"radians({degrees}.0)"
    return f"""SELECT vec_id, y, x, (1 - (sy - y0)) * (1 - (sx - x0)) * p00.v + (1 - (sy - y0)) * (sx - x0) * p01.v + (sy - y0) * (1 - (sx - x0)) * p10.v + (sy - y0) * (sx - x0) * p11.v AS v FROM (
  SELECT *, least(floor(sy), 6)::INT AS y0, least(floor(sx), 6)::INT AS x0 FROM (SELECT y, x, greatest(least(cos({a}) * (y - 3.5) - sin({a}) * (x - 3.5) + 3.5, 7), 0) AS sy, greatest(least(sin({a}) * (y - 3.5) + cos({a}) * (x - 3.5) + 3.5, 7), 0) AS sx FROM range(8) a(y), range(8) b(x))) g
  JOIN pix p00 ON p00.h = y0 AND p00.w = x0 JOIN pix p01 USING (vec_id) JOIN pix p10 USING (vec_id) JOIN pix p11 USING (vec_id)
  WHERE p01.h = y0 AND p01.w = x0 + 1 AND p10.h = y0 + 1 AND p10.w = x0 AND p11.h = y0 + 1 AND p11.w = x0 + 1"""


@query(f"""WITH {PIXELS}, rng AS (SELECT vec_id, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1), st AS (SELECT vec_id, h, w, (v - lo) / (hi - lo + 1e-5) AS v FROM pix JOIN rng USING (vec_id)),
eq AS (SELECT vec_id, h, w, sqrt((rank() OVER (PARTITION BY vec_id ORDER BY v) + count(*) OVER (PARTITION BY vec_id, v) - 1) / 64.0::DOUBLE) AS v FROM pix),
every AS (SELECT 'mirror' AS mode, vec_id, h, 7 - w AS w, v FROM pix UNION ALL SELECT 'gamma_dark', vec_id, h, w, v ** 1.5 FROM st UNION ALL SELECT 'gamma_light', vec_id, h, w, v ** 0.75 FROM st
  UNION ALL SELECT 'contrast', vec_id, h, w, v FROM eq UNION ALL SELECT 'rotate_left', * FROM ({_rotated_sql(10)}) UNION ALL SELECT 'rotate_right', * FROM ({_rotated_sql(-10)}))
SELECT mode, vec_id, h::INT AS h, w::INT AS w, {r('v')} AS v FROM every""")
def grid_augment_fixed(spark, d):
    """The augmentations that draw no random numbers."""
    got = grid.augment(images(spark, d), "image", SIDE, SIDE, ("mirror", "gamma_dark", "gamma_light", "contrast", "rotate_left", "rotate_right"), "vec_id")
    return grid.as_rows(got, "image", SIDE, "mode", "vec_id").withColumn("v", rounded(F.col("v")))


@query(f"""WITH {PIXELS} SELECT vec_id, hh::INT AS h, w::INT AS w, {r('v')} AS v FROM (SELECT vec_id, h + (h > 3)::INT AS hh, w, v FROM pix WHERE pix.h < 7 UNION ALL SELECT vec_id, 4, w, v FROM pix WHERE pix.h = 3)""")
def grid_evened(spark, d):
    """Seven rows become eight: the middle one twice."""
    odd = images(spark, d).withColumn("m", A.evened(F.slice("image", 1, 7 * SIDE), 7, SIDE))
    return grid.as_rows(odd, "m", SIDE, "vec_id").withColumn("v", rounded(F.col("v")))


# ------------------------------------------------------------------ quantisers

_LLOYD = """WITH RECURSIVE vals AS (SELECT l_quantity::DOUBLE * l_discount AS x, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1), lim AS (SELECT min(x) AS lo, max(x) AS hi FROM vals),
it(i, c) AS (
  SELECT 0, list_transform(range(8), lambda k: lo + (hi - lo) * k / 7) FROM lim
  UNION ALL
  SELECT i + 1, list_sort(list_transform(range(1, 9), lambda k: coalesce(m[k], c[k]))) FROM (
    SELECT i, c, list_transform(range(8), lambda k: list_sum(list_transform(list_filter(all_v, lambda z: len(list_filter(c[2:], lambda e, j: z.x >= (e + c[j]) / 2)) = k), lambda z: z.x * z.n)) / list_sum(list_transform(list_filter(all_v, lambda z: len(list_filter(c[2:], lambda e, j: z.x >= (e + c[j]) / 2)) = k), lambda z: z.n))) AS m
    FROM it, (SELECT list({'x': x, 'n': n}) AS all_v FROM vals) WHERE i < 20)
),
best AS (SELECT c FROM it WHERE i = 20)"""


def _lloyd_values(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_quantity").cast("double") * F.col("l_discount")).alias("x"), F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("c"))


@query(f"{_LLOYD} SELECT k::INT AS i, round((c[k] + c[k + 1]) / 2, 5) AS bound FROM best, range(1, 8) t(k)")
def lloyd_bounds(spark, d):
    edges = separability.lloyd_max(_lloyd_values(spark, d), "x", 8)[1:-1]
    return spark.createDataFrame([(i + 1, float(e)) for i, e in enumerate(edges)], "i int, bound double").withColumn("bound", F.round("bound", 5))


@query(f"""{_LLOYD}, b AS (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cls, len(list_filter(range(1, 8), lambda k: l_quantity::DOUBLE * l_discount >= (c[k] + c[k + 1]) / 2)) AS bin FROM lineitem, best),
k AS (SELECT bin, cls, count(*)::DOUBLE AS n FROM b GROUP BY ALL), p AS (SELECT n, n / sum(n) OVER (PARTITION BY bin) AS p FROM k) SELECT round(sum(-n * ln(p)) / sum(n) / ln(3), 5) AS entropy FROM p""")
def lloyd_bin_entropy(spark, d):
    got = separability.kmeans_bin_entropy(_lloyd_values(spark, d), "x", "c", 3, 8)
    return got.select(F.round("entropy", 5).alias("entropy"))


# ------------------------------------------------------------------ learners


def _learn(spark, d):
    feats = stats.features_wide(stats.simple_features(observations(spark, d), VARIABLES), VARIABLES)
    rows = sampling.hash_split(joins.label_join(feats, episode_labels(spark, d)), "episode_id")
    names = [f"{v}_{s}" for v in VARIABLES for s in ("mean", "std", "diff_mean", "diff_std")]
    return durable(rows.where("split = 'train'")), durable(rows.where("split <> 'train'")), names


def _ordered(train, names):
    return [x["feature"] for x in ranking.ranked(ranking.split_losses(train, names, "y", 16)).orderBy("rank").collect()]


@query()
def gbt_auroc(spark, d):
    train, test, names = _learn(spark, d)
    return classify.fit_and_test(train, test, names, "y", "gbt")


@query()
def logistic_auroc(spark, d):
    train, test, names = _learn(spark, d)
    return classify.fit_and_test(train, test, names, "y", "logistic", maxIter=50)


@query()
def gbt_gains(spark, d):
    train, _, names = _learn(spark, d)
    return classify.gains(classify.fit(train, names, "y", "gbt"), names, spark)


@query()
def feature_sweep(spark, d):
    """Every k from 1 to all 20 features, best first."""
    train, test, names = _learn(spark, d)
    return classify.logistic_sweep(train, test, _ordered(train, names), "y")


@query()
def feature_sweep_worst(spark, d):
    """Every k from 1 to all 20 features, worst first."""
    train, test, names = _learn(spark, d)
    return classify.logistic_sweep(train, test, _ordered(train, names)[::-1], "y")


@query(f"""WITH s AS (SELECT l_quantity * l_discount AS s, (l_returnflag = 'R')::INT AS y FROM lineitem), g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM s GROUP BY 1)
SELECT {r('s')} AS score, {r('sum(n) OVER (ORDER BY s DESC) / sum(n) OVER ()')} AS fpr, {r('sum(p) OVER (ORDER BY s DESC) / sum(p) OVER ()')} AS tpr FROM g""")
def roc_points(spark, d):
    scored = table(spark, d, "lineitem").select((F.col("l_quantity") * F.col("l_discount")).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return evaluate.roc_points(scored, "s", "y").select(*[rounded(F.col(c)).alias(c) for c in ("score", "fpr", "tpr")])
