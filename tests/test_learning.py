import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import arrays as A
from lacuna.operators import evaluate, grid, ranking, sampling, separability, subspace


def table(spark, rng, n=300, k=3):
    x = rng.normal(size=(n, k))
    y = (x[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    c = rng.integers(0, 3, n)
    rows = [(*map(float, x[i]), int(y[i]), int(c[i]), float(x[i, 1] * 2 + rng.normal())) for i in range(n)]
    return spark.createDataFrame(rows, "x0 double, x1 double, x2 double, y int, c int, t double"), x, y, c, np.array([r[-1] for r in rows])


def bits(y):
    p = np.bincount(y, minlength=3) / max(len(y), 1)
    return -(p[p > 0] * np.log2(p[p > 0])).sum() * len(y)


@pytest.mark.parametrize("loss", ["bce", "ce", "rmse"])
def test_split_losses_equal_brute_force(spark, loss):
    df, x, y, c, t = table(spark, np.random.default_rng(0))
    target = {"bce": y, "ce": c, "rmse": t}[loss]
    got = {r["feature"]: r["loss"] for r in ranking.split_losses(df, ["x0", "x1", "x2"], {"bce": "y", "ce": "c", "rmse": "t"}[loss], 8, loss).collect()}
    for j in range(3):
        lo, w = x[:, j].min(), (x[:, j].max() - x[:, j].min()) / 8
        best = np.inf
        for i in range(1, 8):
            left = x[:, j] <= lo + i * w
            if loss == "rmse":
                v = np.sqrt(sum(((s - s.mean()) ** 2).sum() for s in (target[left], target[~left]) if len(s)) / len(target))
            else:
                v = (bits(target[left]) + bits(target[~left])) / len(target)
            best = min(best, v)
        assert got[f"x{j}"] == pytest.approx(best)


def test_constant_and_missing_features(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0), (1.0, None, 1), (1.0, 3.0, 1), (1.0, 4.0, 0)], "k double, m double, y int")
    for loss in ("bce", "ce"):
        got = {r["feature"]: r["loss"] for r in ranking.split_losses(df, ["k", "m"], "y", 4, loss).collect()}
        assert got["k"] == pytest.approx(1.0)
    assert {r["feature"]: r["loss"] for r in ranking.split_losses(df, ["k", "m"], "y", 4).collect()}["m"] == float("inf")
    assert [r["feature"] for r in ranking.top_features(ranking.split_losses(df, ["k", "m"], "y", 4), 1).collect()] == ["k"]


def test_auroc_and_wasserstein(spark):
    rng = np.random.default_rng(1)
    s, y = np.round(rng.normal(size=200), 1), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert evaluate.auroc(df, "s", "y").first()[0] == pytest.approx(want)
    assert evaluate.auroc(df.withColumn("s", -F.col("s")), "s", "y").first()[0] == pytest.approx(1 - want)
    grid_ = np.unique(s)
    cdf = lambda v: np.searchsorted(np.sort(v), grid_, side="right") / len(v)
    want = (np.abs(cdf(p) - cdf(n))[:-1] * np.diff(grid_)).sum()
    assert separability.wasserstein(df, "s", F.col("y") == 1).first()[0] == pytest.approx(want)
    assert separability.wasserstein_multi(df, "s", "y", (0, 1)).first()[0] == pytest.approx(want)


def test_lloyd(spark):
    x = np.concatenate([np.full(20, 1.0), np.full(20, 5.0), np.full(20, 9.0)]) + np.linspace(0, 0.1, 60)
    df = spark.createDataFrame([(float(v), i // 20) for i, v in enumerate(x)], "x double, c int")
    edges = separability.lloyd_max(df, "x", 3)
    assert edges[0] == -np.inf and edges[-1] == np.inf and 1.1 < edges[1] < 5 and 5.1 < edges[2] < 9
    assert np.allclose((separability.lloyd_1d(x, 3)[1:] + separability.lloyd_1d(x, 3)[:-1]) / 2, edges[1:-1])
    assert tuple(separability.kmeans_bin_entropy(df, "x", "c", 3, 3).first()) == pytest.approx((0.0, 0.0))


def vectors(spark, rng, n=120, d=6):
    x = rng.normal(size=(n, d)) @ rng.normal(size=(d, d))
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>"), x


def test_subspace_invariants(spark):
    df, x = vectors(spark, np.random.default_rng(2))
    m = subspace.fit_saab(df, "v")
    assert np.allclose(m.kernels @ m.kernels.T, np.eye(6), atol=1e-8) and m.energy.sum() == pytest.approx(1)
    ac = x - x.mean(axis=1, keepdims=True)
    assert m.bias_out == pytest.approx(np.linalg.norm(ac, axis=1).max())
    want = np.linalg.eigvalsh(np.cov(ac.T))[::-1][:5]
    assert np.allclose(m.energy[1:] / m.energy[1:].sum(), want / want.sum())
    y = np.array([r["features"] for r in subspace.transform(df, m, "v").orderBy("id").collect()])
    assert np.allclose(y[:, 0], x.mean(axis=1) * np.sqrt(6))
    p = subspace.fit_pca(df, "v", 0.9)
    assert p.energy.sum() >= 0.9 and p.energy[:-1].sum() < 0.9
    exact = subspace.fit_dc_saab(df, "v", use_dc=False)
    assert subspace.round_trip_error(df, exact, "v").first()[0] < 1e-5
    assert np.allclose(exact.apply(x), subspace.Subspace.from_json(exact.to_json()).apply(x))


def test_tree(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 64))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    tree = subspace.HopTree((subspace.Hop(2), subspace.Hop(2)), (8, 8, 1), keep=0.05, discard=0.0).fit(df, "v")
    assert len(tree.layers) == 2 and sum(n.energy.sum() for n in tree.layers[0]) == pytest.approx(1)
    kept = sum(e for n in tree.layers[0] for e in n.energy if e >= 0.05)
    assert sum(n.energy.sum() for n in tree.layers[1]) == pytest.approx(kept)
    out = tree.transform(df, "v").collect()
    assert all(len(r["features"]) == 4 * sum(len(n.energy) for n in tree.layers[1]) for r in out)
    p = subspace.patches(x.reshape(-1, 8, 8, 1), subspace.Hop(2))
    assert np.allclose(subspace.folded(p, subspace.Hop(2), 8, 8).ravel(), x.ravel())
    assert tree.table(spark).count() == sum(len(n.energy) for layer in tree.layers for n in layer)


def test_images(spark):
    img = [float(i) for i in range(25)]
    df = spark.createDataFrame([(0, img)], "id long, a array<double>")
    a = np.array(img).reshape(5, 5)
    pad = np.pad(a, ((0, 1), (0, 1)))
    blocks = pad.reshape(3, 2, 3, 2).transpose(0, 2, 1, 3).reshape(9, 4)
    for how, f in (("max", blocks.max(axis=1)), ("avg", blocks.mean(axis=1)), ("median", np.median(blocks, axis=1))):
        assert grid.pool(df, "a", 5, 5, 2, how).first()["pooled"] == pytest.approx(f.tolist())
    got = df.select(A.padded(F.col("a"), 5, 5, 1, "reflect")).first()[0]
    assert got == np.pad(a, 1, mode="reflect").ravel().tolist()
    assert df.select(A.padded(F.col("a"), 5, 5, 1)).first()[0] == np.pad(a, 1).ravel().tolist()
    assert df.select(A.evened(F.col("a"), 5, 5)).first()[0] == np.concatenate((a[:3], a[2:])).ravel().tolist()
    assert np.allclose(grid.rotated(a[None], 0.0)[0], a) and np.allclose(grid.resized(a[None], 5, 5)[0], a)


def test_samples(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(300)], "id long, c int")
    assert [r["n"] for r in sampling.balanced_sample(df, "c", "id", 7).groupBy("c").agg(F.count("*").alias("n")).collect()] == [7, 7, 7]
    n = {r["split"]: r["count"] for r in sampling.hash_split(df, "id").groupBy("split").count().collect()}
    assert sum(n.values()) == 300 and 200 < n["train"] < 280


def test_small_helpers(spark):
    from lacuna.functions import scalar as C
    from lacuna.operators import classify, joins, series, stats

    df = spark.createDataFrame([(1, 0.0, 1.0, None), (1, 1.0, None, 4.0), (1, 2.0, 3.0, None), (2, 0.0, None, 2.0)], "episode_id long, row double, a double, b double")
    got = {(r["episode_id"], r["row"]): (r["a"], r["b"]) for r in series.interpolate_by_row(df, ["a", "b"], "row").collect()}
    assert got == {(1, 0.0): (1, 4), (1, 1.0): (2, 4), (1, 2.0): (3, 4), (2, 0.0): (None, 2)}
    assert [r["a"] for r in classify.column_means(df, ["a"]).orderBy("episode_id", "row").collect()] == [1, 2, 3, 2]
    flagged, names = classify.with_missing_flags(df, ["a"])
    assert names == ["a", "a__gap"] and flagged.where("a__gap = 1").count() == 2
    p = spark.createDataFrame([([0.1, 0.7, 0.2], 2), ([0.5, 0.4, 0.1], 0)], "p array<double>, y int")
    assert evaluate.topk_accuracy(p, F.col("p"), F.col("y"), 1).first()[0] == 0.5
    assert [r[0] for r in p.select(A.mark_top(F.col("p"), 1)).collect()] == [[-1, 1, -1], [1, -1, -1]]
    assert [r[0] for r in p.select(C.one_hot(F.col("y"), 3)).collect()] == [[0, 0, 1], [1, 0, 0]]
    assert p.where(C.all_of(F.col("y") == 2, F.lit(True))).count() == 1 and p.where(C.any_of(F.col("y") == 2, F.col("y") == 0)).count() == 2
    assert joins.without_listed(df, [1]).count() == 1
    scores = spark.createDataFrame([(0, i, float(i)) for i in range(8)] + [(1, 0, 0.0)], "channel int, pos int, score double")
    assert [r[0] for r in subspace.gated_channels(scores, 7.0).collect()] == [0] and subspace.select_positions(scores, below=2.0).count() == 3
    assert stats.drop_const_patch(spark.createDataFrame([([0.0, 0.0],), ([1.0, 0.0],)], "v array<double>"), "v").count() == 1


def test_multiclass_models(spark):
    rng = np.random.default_rng(7)
    rows = [(float(rng.normal() + 4 * (i % 3)), float(rng.normal()), i % 3) for i in range(150)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    from lacuna.operators import classify

    for kind, how in (("forest", {"numTrees": 10}), ("logistic", {}), ("gbt_multi", {"maxIter": 2})):
        out = classify.fit(df, ["a", "b"], "y", kind, **how).transform(df)
        assert out.where("prediction = y").count() > 120


def test_augmentation(spark):
    rng = np.random.default_rng(3)
    x = rng.random((6, 8, 8))
    df = spark.createDataFrame([(i, [float(v) for v in r.ravel()]) for i, r in enumerate(x)], "id long, a array<double>")
    modes = [str(m) for m in range(12)] + ["gamma_dark"]
    out = grid.augment(df, "a", 8, 8, modes, "id").collect()
    assert len(out) == 6 * 13 and all(len(r["a"]) == 64 for r in out)
    got = {(r["id"], r["mode"]): np.array(r["a"]).reshape(8, 8) for r in out}
    assert (got[2, "1"] == x[2][:, ::-1]).all() and (got[2, "0"] == x[2]).all()
    assert all(np.isclose(got[i, "6"].max(), 1) and got[i, "6"].min() > 0 for i in range(6))
    c = rng.random((5, 4 * 4 * 3))
    colour = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "id long, a array<double>")
    once = [r["a"] for r in grid.colour_jitter(colour, "a", 4, 4).orderBy("id").collect()]
    again = [r["a"] for r in grid.colour_jitter(colour.repartition(3), "a", 4, 4).orderBy("id").collect()]
    assert once == again and all(0 <= v <= 1 for r in once for v in r) and once[0] != c[0].tolist()
