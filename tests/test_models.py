"""Split modes, retained kernels, groupings, sweeps, curves and series that span batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna import storage
from lacuna.operators import classify, evaluate, modelled, ranking, separability, series, subspace
from lacuna.operators.subspace import Hop, HopTree


@pytest.fixture(scope="module")
def images(spark):
    x = np.random.default_rng(0).normal(size=(80, 8, 8, 1)) * np.linspace(0.2, 2, 8)[None, None, :, None]
    return spark.createDataFrame([(i, [float(v) for v in r.ravel()]) for i, r in enumerate(x)], "id long, image array<double>"), x


def plain_scores(tree, x, mode):
    """The score of each channel of the first layer, by plain numpy."""
    maps = tree._maps(x, 1)[0][0]
    out = {}
    for c, energy in enumerate(tree.layers[0][0].energy):
        p = subspace.patches(maps[..., [c]], tree.hops[1])
        p = p.reshape(-1, p.shape[-1])
        if mode == "mean_abs":
            out[c] = np.mean(np.abs(p).mean(axis=1) / np.abs(p[:, 0]))
        else:
            q = p - p.mean(axis=1, keepdims=True)
            values = np.linalg.eigvalsh(np.cov(q, rowvar=False))
            out[c] = energy / (values[-1] / values.sum())
    return out


@pytest.mark.parametrize("mode", ["ratio", "mean_abs"])
def test_split_modes_choose_the_inputs(images, mode):
    df, x = images
    first = HopTree((Hop(2), Hop(2)), (8, 8, 1), 0.0, 0.0).fit(df, "image")
    scores = plain_scores(first, x, mode)
    bar = float(np.median(list(scores.values())))
    tree = HopTree((Hop(2), Hop(2)), (8, 8, 1), bar, 0.0, split=mode).fit(df, "image")
    want = {c for c, s in scores.items() if (s >= bar if mode == "ratio" else s > bar)}
    assert {n.parent[1] for n in tree.layers[1]} == want and 0 < len(want) < len(scores)
    with pytest.raises(ValueError):
        HopTree((Hop(2), Hop(2)), (8, 8, 1), split="odd").fit(df, "image")


def test_retained_kernels(images):
    df, _ = images
    tree = HopTree((Hop(2), Hop(2)), (8, 8, 1), 0.0, 0.0, retain=(2, 3)).fit(df, "image")
    assert [[len(n.energy) for n in layer] for layer in tree.layers] == [[2], [3, 3]]


def test_moments_keep_digits_beside_large_means(spark):
    x = np.random.default_rng(1).normal(size=(500, 4))
    df = spark.createDataFrame([([float(v) + 1e8 for v in r],) for r in x], "v array<double>").repartition(7)
    got = subspace.fit_pca(df, "v").energy
    values = np.linalg.eigvalsh(np.cov(x, rowvar=False))[::-1]
    assert np.allclose(got, values / values.sum(), atol=1e-6)


def test_energy_share():
    energy = np.array([0.5, 0.3, 0.15, 0.05])
    assert [subspace._enough(energy, s) for s in (None, 0.2, 0.5, 0.79, 0.99, 1.5)] == [4, 1, 2, 2, 4, 4]


def test_two_way_groupings():
    assert subspace.two_way_groupings([0, 1, 2]) == [(0, 1), (0, 2), (0,)]
    assert len(subspace.two_way_groupings(range(5))) == 2**4 - 1


def test_grouped_directions(spark):
    rng = np.random.default_rng(2)
    x, c = rng.normal(size=(200, 2)), rng.integers(0, 4, 200)
    df = spark.createDataFrame([(float(a), float(b), int(k)) for (a, b), k in zip(x, c, strict=True)], "a double, b double, c int")
    for group, theta in subspace.grouped_directions(df, ("a", "b"), "c", (0, 1, 2, 3)):
        y = np.isin(c, group).astype(float)
        want = np.linalg.lstsq(x - x.mean(axis=0), y - y.mean(), rcond=None)[0]
        assert np.allclose(theta, want)


def test_logistic_sweep_equals_single_models(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3)) * [1, 5, 0.1] + [0, 3, 1]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=400) > 0.5).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y int")
    train, test = df.limit(300), df
    got = {r["k"]: r["auroc"] for r in classify.logistic_sweep(train, test, ["a", "b", "c"], "y").collect()}
    for k, names in ((1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "c"])):
        one = classify.fit_and_test(train, test, names, "y", "logistic").first()[0]
        assert got[k] == pytest.approx(one, abs=2e-3)
    assert got[3] > got[1] and classify.logistic_sweep(train.limit(0), test, ["a"], "y").count() == 0


def test_roc_points_and_worst_features(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, y int")
    got = {r["score"]: (r["fpr"], r["tpr"]) for r in evaluate.roc_points(df, "s", "y").collect()}
    assert got == {0.9: (0.0, 0.5), 0.8: (0.5, 1.0), 0.1: (1.0, 1.0)}
    losses = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.2)], "feature string, loss double")
    assert [(r["feature"], r["rank"]) for r in ranking.bottom_features(losses, 2).orderBy("rank").collect()] == [("c", 2), ("b", 3)]


def test_spline_streams_across_batches(spark):
    """Series that end and begin within and between batches come out as one by one."""
    rng = np.random.default_rng(4)
    rows = [(e, i, float(i), v, None if rng.random() < 0.4 else float(rng.normal())) for e in range(40) for v in "ab" for i in range(int(rng.integers(1, 30)))]
    df = spark.createDataFrame(rows, "episode_id long, seq long, t double, var string, v double")
    means = spark.createDataFrame([("a", 7.0), ("b", 8.0)], "var string, mean double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        got = {(r["episode_id"], r["var"], r["t"]): r["imputed"] for r in modelled.impute_spline(df, means).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for e in range(40):
        for v in "ab":
            s = [r for r in rows if r[0] == e and r[3] == v]
            want = modelled.spline_series(np.array([r[2] for r in s]), np.array([np.nan if r[4] is None else r[4] for r in s]), 7.0 if v == "a" else 8.0)
            assert [got[e, v, r[2]] for r in s] == pytest.approx(list(want))


def test_interpolation_by_row(spark):
    df = spark.createDataFrame([(1, 0, None, 1.0), (1, 5, 2.0, None), (1, 6, None, None), (1, 9, 4.0, 4.0), (2, 1, None, None)], "episode_id long, t int, a double, b double")
    got = {(r["episode_id"], r["t"]): (r["a"], r["b"]) for r in series.interpolate_by_row(df, ["a", "b"], "t").collect()}
    assert got == {(1, 0): (2.0, 1.0), (1, 5): (2.0, 2.0), (1, 6): (3.0, 3.0), (1, 9): (4.0, 4.0), (2, 1): (None, None)}


def test_shared_folder_is_needed_off_one_machine():
    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session())


def test_quantisers_of_all_features_equal_single_ones(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(float(a), float(b), 1.0, int(c)) for a, b, c in zip(rng.normal(size=300), rng.exponential(size=300), rng.integers(0, 3, 300), strict=True)], "a double, b double, k double, c int")
    together = {r["feature"]: r["score"] for r in separability.all_feature_scores(df, ["a", "b", "k"], "c", 3, 5, "kmeans").collect()}
    for f in ("a", "b"):
        assert together[f] == pytest.approx(separability.kmeans_bin_entropy(df, f, "c", 3, 5).first()["cross_entropy"])
        x = np.array([r[f] for r in df.collect()])
        want = separability.lloyd_1d(x, 5, 20)
        assert separability.lloyd_max(df, f, 5)[1:-1] == pytest.approx(list((want[1:] + want[:-1]) / 2))
    shares = np.bincount([r["c"] for r in df.collect()]) / 300
    assert together["k"] == pytest.approx(-(shares * np.log(shares)).sum() / np.log(3))
    bins = {r["feature"]: r["score"] for r in separability.all_feature_scores(df, ["a", "b"], "c", 3, 5, "bin").collect()}
    for f in ("a", "b"):
        assert bins[f] == pytest.approx(separability.bin_cross_entropy(df, f, "c", 3, 5).first()["bin_ce"])
    with pytest.raises(ValueError):
        separability.all_feature_scores(df, ["a"], "c", 3, 5, "odd")
