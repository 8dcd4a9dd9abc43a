import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import layers, subspace
from lacuna.plans import flows
from lacuna.sources import sinks

HEAD = "Time,Parameter,Value\n00:00,RecordID,{i}\n00:00,Age,54\n00:00,Gender,0\n00:00,Height,-1\n00:00,ICUType,4\n00:00,Weight,70\n"


def test_icu_to_imputed(spark, tmp_path):
    rng = np.random.default_rng(0)
    (tmp_path / "set").mkdir()
    for i in range(30):
        rows = "".join(f"{h:02d}:00,{v},{rng.normal():.3f}\n" for h in range(8) for v in ("HR", "Temp", "GCS") if rng.random() < 0.6)
        (tmp_path / f"set/{1000 + i}.txt").write_text(HEAD.format(i=1000 + i) + rows)
    (tmp_path / "o.csv").write_text("RecordID,SAPS-I,SOFA,Length_of_stay,Survival,In-hospital_death\n" + "".join(f"{1000 + i},6,1,5,-1,{i % 2}\n" for i in range(28)))
    data = flows.clean_icu(spark, f"{tmp_path}/set/*.txt", [f"{tmp_path}/o.csv"], f"{tmp_path}/clean")
    assert data.select("episode_id").distinct().count() == 28 and set(data.columns) == {"episode_id", "seq", "t", "var", "v", "mask", "interval", "split"}
    meta = {r["var"]: r["missing_rate"] for r in flows.report(spark, f"{tmp_path}/clean").collect()}
    assert len(meta) == 37 and meta["Lactate"] == 1.0 and meta["HR"] < 1.0
    for strategy in ("linear", "forward", "spline", "kmeans"):
        how = {"half": 1, "bins": 2, "clusters": 2} if strategy == "kmeans" else {}
        filled = flows.impute_dataset(spark, f"{tmp_path}/clean", strategy, f"{tmp_path}/filled", 0.99, **how)
        assert filled.where("imputed IS NULL").count() == 0
        again = sinks.load_dataset(spark, f"{tmp_path}/filled_{strategy}")
        assert again.select("var").distinct().count() == sum(m <= 0.99 for m in meta.values())


def test_hourly_and_episode_flows(spark, tmp_path):
    (tmp_path / "p1.psv").write_text("HR|Age|Gender|Unit1|Unit2|HospAdmTime|ICULOS|SepsisLabel\n80|60|1|1|0|-1|1|0\nNaN|60|1|1|0|-1|2|1\n")
    data = flows.clean_hourly(spark, f"{tmp_path}/p*.psv", ["HR"], f"{tmp_path}/h")
    assert sorted((r["t"], r["mask"], r["interval"]) for r in data.collect()) == [(1.0, True, 1.0), (2.0, False, 1.0)]
    (tmp_path / "7_episode1_timeseries.csv").write_text("Hours,Weight\n0.5,80\n")
    (tmp_path / "list.csv").write_text("stay,y_true\n7_episode1_timeseries.csv,1\n")
    assert flows.clean_episodes(spark, f"{tmp_path}/*_episode*.csv", f"{tmp_path}/list.csv", f"{tmp_path}/e").first()["y_true"] == 1


def test_experiment_finds_the_signal(spark):
    rng = np.random.default_rng(1)
    rows = [(e, i, float(i), v, float(rng.normal() + (3 if v == "a" and e % 2 else 0))) for e in range(120) for v in "abc" for i in range(6)]
    obs = spark.createDataFrame(rows, "episode_id long, seq long, t double, var string, v double")
    labels = spark.range(120).select(F.col("id").alias("episode_id"), (F.col("id") % 2).cast("int").alias("y"))
    out = flows.ranked_experiment(obs, labels, list("abc"), 16, 2, "logistic")
    assert out["losses"].orderBy("loss").first()["feature"] == "a_mean"
    assert out["auroc_selected"].first()[0] > 0.95 and out["auroc_all"].first()[0] > 0.9
    assert out["ranks"].count() == 12


def test_layers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 8 * 8 * 2))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    stack = layers.LayerStack((subspace.Hop((4, 2), channelwise=False), subspace.Hop(2)), (8, 8, 2)).fit(df, "v")
    y = stack.forward(x.reshape(-1, 8, 8, 2))
    assert y.shape == (50, 1, 2, 64) and np.allclose(stack.inverse(y).reshape(50, -1), x)
    models, out = layers.global_transform(df, "v", (8, 8, 2), spark.createDataFrame([(1, p) for p in (0, 5, 9)], "channel int, pos int"))
    assert set(models) == {1} and all(len(r["features"]) == 3 for r in out.collect())
    for mode, low, high in (("energy", 0.1, 0.9), ("ratio", 0.1, 1e9), ("mean_abs", 0.0, 1e9)):
        assert layers.should_split(df, "v", 0.5, low, mode) and not layers.should_split(df, "v", 0.5, high, mode)
    with pytest.raises(ValueError):
        layers.should_split(df, "v", 0.5, 0.1, "odd")
