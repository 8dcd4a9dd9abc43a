import numpy as np
import pytest

from lacuna.operators import modelled, ordering, series, stats

SCHEMA = "episode_id long, seq long, t double, var string, v double"


def frame(spark, *series_):
    """Each series: (episode, var, times, values)."""
    rows = [(e, i, float(t), var, v) for e, var, ts, vs in series_ for i, (t, v) in enumerate(zip(ts, vs))]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, column, episode=1, var="a"):
    rows = [r for r in df.collect() if r["episode_id"] == episode and r["var"] == var]
    return [r[column] for r in sorted(rows, key=lambda r: (r["t"], r["seq"]))]


@pytest.mark.parametrize(
    "times, given, linear, extrap",
    [
        ((0, 1, 3), (1.0, None, 7.0), [1, 3, 7], [1, 3, 7]),
        ((0, 1, 2), (None, 4.0, 6.0), [0, 4, 6], [2, 4, 6]),
        ((0, 1, 2), (4.0, 6.0, None), [4, 6, 6], [4, 6, 8]),
        ((0, 1, 2), (None, 5.0, None), [0, 5, 5], [5, 5, 5]),
    ],
)
def test_linear(spark, times, given, linear, extrap):
    df = frame(spark, (1, "a", times, given))
    assert values(series.impute_linear(df), "imputed") == linear
    assert values(series.impute_linear_extrap(df), "imputed") == extrap


def test_never_observed(spark):
    df = frame(spark, (1, "a", (0, 1), (None, None)), (2, "a", (0, 1), (2.0, 4.0)), (1, "b", (0,), (None,)))
    assert values(series.impute_linear_extrap(df), "imputed") == [3, 3]
    assert values(series.impute_linear(df), "imputed") == [0, 0]
    assert values(series.impute_mean(df), "imputed", 1, "b") == [0]
    assert values(modelled.impute_spline(df), "imputed") == [3, 3]


def test_interval(spark):
    df = frame(spark, (1, "a", (1, 2, 4), (9.0, None, 8.0)))
    assert values(series.obs_interval(df), "interval") == [1, 1, 3]
    assert values(series.with_mask(df), "mask") == [True, False, True]
    assert values(series.with_mask(df, inverted=True), "mask") == [False, True, False]


def test_confidence(spark):
    df = frame(spark, (1, "a", (0, 1, 2), (1.0, None, 1.0)))
    assert values(series.window_confidence(df, 1), "conf") == pytest.approx([1, 2 / 3, 1])


def test_four_stats(spark):
    f = stats.simple_features(frame(spark, (1, "a", (0, 1, 2, 3), (2.0, None, 4.0, 9.0))), ["a", "z"]).collect()
    a = next(r for r in f if r["var"] == "a")
    assert (a["mean"], a["std"], a["diff_mean"], a["diff_std"]) == pytest.approx((5, np.sqrt(26 / 3), 3.5, 1.5))
    z = next(r for r in f if r["var"] == "z")
    assert (z["mean"], z["std"]) == (0, 0)


def test_equal_bins(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "i long")
    got = sorted((r["bin_id"], r["i"]) for r in ordering.equal_bins(df, [df["i"]], 4).collect())
    assert [b for b, _ in got] == [0, 0, 1, 1, 2, 2, 3, 3, 3, 3]


@pytest.mark.parametrize("name", ["impute_zero", "impute_mean", "impute_ffill", "impute_ffill_zero", "impute_linear", "impute_linear_extrap"])
def test_observed_cells_stay(spark, name):
    rng = np.random.default_rng(3)
    given = [float(x) if rng.random() < 0.6 else None for x in rng.normal(size=30)]
    df = frame(spark, (1, "a", range(30), given), (2, "a", range(5), [None] * 5))
    got = values(getattr(series, name)(df), "imputed")
    assert all(g is None or g == x for g, x in zip(given, got)) and None not in got


def test_not_a_knot_is_exact_for_cubics():
    x = np.array([0.0, 1, 2.5, 4, 7])
    f = lambda t: 2 - t + 0.5 * t**2 - 0.3 * t**3
    at = np.linspace(-2, 9, 23)
    assert np.allclose(modelled.not_a_knot(x, f(x), at), f(at))
    assert np.allclose(modelled.not_a_knot(x[:3], x[:3] ** 2, at), at**2)
    assert np.allclose(modelled.not_a_knot(x[:2], 3 * x[:2] + 1, at), 3 * at + 1)


def test_kmeans_and_trees_fill_everything(spark):
    rng = np.random.default_rng(5)
    make = lambda n: [float(x) if rng.random() < 0.7 else None for x in rng.normal(size=n)]
    df = frame(spark, *[(e, v, range(20), make(20)) for e in range(4) for v in "ab"], (9, "a", range(3), [1.0, None, 2.0]), (9, "b", range(3), [None] * 3))
    for how in ({"strategy": "kmeans", "half": 2, "bins": 2, "kernels": 4, "clusters": 3}, {"strategy": "trees", "variables": ["a", "b"], "trees": 2}):
        out = modelled.impute(df, **how)
        rows = out.collect()
        assert len(rows) == df.count() and all(r["imputed"] is not None for r in rows)
        assert all(r["v"] is None or r["v"] == pytest.approx(r["imputed"]) for r in rows)


def test_padding(spark):
    df = frame(spark, (1, "a", (0, 1), (1.0, 2.0)), (2, "a", (0, 1, 2), (3.0, None, 5.0)))
    got = {r["episode_id"]: r["series"] for r in series.padded_series(df, 3).collect()}
    assert got == {1: [None, 1, 2], 2: [3, None, 5]}
    got = {r["episode_id"]: r["series"] for r in series.padded_series(df, 4, "right", 0.0).collect()}
    assert got == {1: [1, 2, 0, 0], 2: [3, None, 5, 0]}


@pytest.mark.parametrize("side", ["left", "right"])
def test_padding_to_the_longest_cuts_nothing(spark, side):
    df = frame(spark, (1, "a", range(30), [float(i) for i in range(30)]), (2, "a", (0, 1), (5.0, 6.0)), (2, "b", (3,), (7.0,)))
    got = {(r["episode_id"], r["var"]): r["series"] for r in series.padded_series(df, side=side, fill=0.0).collect()}
    pad = lambda x: [0.0] * (30 - len(x)) + x if side == "left" else x + [0.0] * (30 - len(x))
    assert got == {(1, "a"): [float(i) for i in range(30)], (2, "a"): pad([5.0, 6.0]), (2, "b"): pad([7.0])}
    assert series.padded_series(df.limit(0)).count() == 0
