import pytest
from pyspark.sql import functions as F

from lacuna.functions import scalar as C
from lacuna.operators import stats
from lacuna.sources import episodes, sinks, synthetic
from lacuna.operators.subspace import fit_saab
from lacuna.streaming import windowed_var_stats


def test_icu_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    head = "Time,Parameter,Value\n00:00,RecordID,1\n00:00,Age,54\n00:00,Gender,0\n00:00,Height,-1\n00:00,ICUType,4\n"
    (tmp_path / "a/1.txt").write_text(head + "00:00,Weight,-1\n00:07,GCS,15\n26:30,HR,73\n26:30,HR,75\n01:00,Nope,3\n")
    (tmp_path / "a/2.txt").write_text(head + "00:00,Weight,80\n")
    got, static = episodes.read_icu_records(spark, f"{tmp_path}/a/*.txt")
    rows = sorted((r["episode_id"], r["var"], r["t"], r["v"]) for r in got.collect())
    assert rows == [("1", "GCS", pytest.approx(7 / 60), 15), ("1", "HR", 26.5, 73), ("1", "HR", 26.5, 75), ("2", "Weight", 0, 80)]
    assert {(r["episode_id"], r["var"], r["v"]) for r in static.collect()} >= {("1", "Weight", -1.0), ("2", "Weight", 80.0), ("1", "Height", -1.0)}
    (tmp_path / "o1.csv").write_text("RecordID,SAPS-I,SOFA,Length_of_stay,Survival,In-hospital_death\n1,6,1,5,-1,0\n")
    (tmp_path / "o2.csv").write_text("RecordID,SAPS-I,SOFA,Length_of_stay,Survival,In-hospital_death\n1,7,1,5,-1,1\n")
    out = episodes.read_outcomes(spark, [f"{tmp_path}/o1.csv", f"{tmp_path}/o2.csv"]).collect()
    assert [(r["episode_id"], r["SAPS-I"], r["In-hospital_death"]) for r in out] == [("1", 7.0, 1.0)]


def test_hourly_records(spark, tmp_path):
    head = "HR|O2Sat|Age|Gender|Unit1|Unit2|HospAdmTime|ICULOS|SepsisLabel\n"
    (tmp_path / "p1.psv").write_text(head + "NaN|95|60|1|NaN|NaN|-1.5|1|0\n80|NaN|60|1|NaN|NaN|-1.5|2|1\n")
    (tmp_path / "p2.psv").write_text(head + "70|95|50|0|1|1|-2|1|0\n")
    (tmp_path / "p3.psv").write_text(head + "71|96|51|0|0|1|-3|1|0\n")
    series, static = episodes.read_hourly_records(spark, f"{tmp_path}/p*.psv", ["HR", "O2Sat"])
    rows = {r["episode_id"]: r for r in static.collect()}
    assert set(rows) == {"p1", "p3"} and rows["p1"]["unit_id"] == -1 and rows["p3"]["unit_id"] == 1 and rows["p1"]["label"] == 1 and rows["p1"]["icu_los"] == 2
    cells = {(r["episode_id"], r["t"], r["var"]): r["v"] for r in series.collect()}
    assert cells["p1", 1.0, "HR"] is None and cells["p1", 2.0, "HR"] == 80 and len(cells) == 6


def test_episode_files(spark, tmp_path):
    (tmp_path / "7_episode02_timeseries.csv").write_text("Hours,Weight,Glascow coma scale eye opening,Glascow coma scale total,Heart Rate\n0.5,400,4 Spontaneously,15,80\n1.5,70,No Response,,x\n")
    (tmp_path / "other.csv").write_text("Hours,Weight\n1,2\n")
    got = {(r["t"], r["var"]): r["v"] for r in episodes.read_episode_files(spark, f"{tmp_path}/*_episode*_timeseries.csv").collect()}
    assert got[0.5, "weight"] is None and got[1.5, "weight"] == 70 and got[0.5, "glascow_coma_scale_eye_opening"] == 3 and got[1.5, "glascow_coma_scale_eye_opening"] == 0
    assert got[0.5, "glascow_coma_scale_total"] == 12 and got[1.5, "glascow_coma_scale_total"] is None and got[1.5, "heart_rate"] is None
    (tmp_path / "listfile.csv").write_text("stay,y_true\n7_episode2_timeseries.csv,1\nbad,0\n")
    assert [tuple(r) for r in episodes.read_listfile(spark, f"{tmp_path}/listfile.csv").collect()] == [("7_episode2", 1)]


def test_scalars(spark):
    df = spark.createDataFrame([("26:30", 1.0, float("nan")), ("x", None, 2.0), (None, 3.0, None)], "h string, a double, b double")
    assert [r[0] for r in df.select(C.hhmm_to_hours(F.col("h"))).collect()] == [26.5, None, None]
    assert [r["b"] for r in C.nan_to_null(df).collect()] == [None, 2.0, None]
    assert C.normalise_names(df.withColumnRenamed("a", "Heart Rate")).columns == ["h", "heart_rate", "b"]
    edges = spark.createDataFrame([(0.0,), (0.1,), (0.3,), (0.30000000000000004,), (1.0,)], "x double")
    width = 0.1
    want = [sum(x > 0 + i * width for i in range(1, 10)) for x in (0.0, 0.1, 0.3, 0.30000000000000004, 1.0)]
    assert [r[0] for r in edges.select(C.steps_below(F.col("x"), F.lit(0.0), F.lit(width), 10)).collect()] == want


def test_synthetic_and_sinks(spark, tmp_path):
    df = synthetic.missing_by_label(spark, 60, 20, 4, seed=3)
    rate = {(r["last"], r["y"]): r["m"] for r in df.groupBy((F.col("var") == 3).alias("last"), "y").agg(F.avg(F.col("v").isNull().cast("double")).alias("m")).collect()}
    assert rate[True, 1] > 0.14 and rate[True, 0] < 0.16 and rate[False, 1] < 0.16
    assert synthetic.oscillating_missing(spark, 5, 10, 2).count() == 100
    m = synthetic.labelled_matrix(spark, 50, 5, 0)
    assert m.agg(F.min("y")).first()[0] >= 1
    long = df.select(F.col("sample").alias("episode_id"), F.lit(0).cast("long").alias("seq"), F.col("pos").cast("double").alias("t"), F.col("var").cast("string").alias("var"), "v")
    sinks.save_dataset(long.withColumn("split", F.lit("train")), f"{tmp_path}/d", stats.metadata(long), "split")
    assert sinks.load_dataset(spark, f"{tmp_path}/d").count() == df.count() and sinks.load_metadata(spark, f"{tmp_path}/d").count() == 4
    v = m.select(F.array(*[f"x{i}" for i in range(5)]).alias("v"))
    model = fit_saab(v, "v")
    sinks.save_model(spark, model, f"{tmp_path}/m")
    assert (sinks.load_model(spark, f"{tmp_path}/m").kernels == model.kernels).all()


def test_stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    import shutil, tempfile

    src = tempfile.mkdtemp()
    shutil.copy(f"{sf}/events.parquet", src)
    stream = spark.readStream.schema(schema).parquet(src).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("var"), F.col("value").alias("v"))
    q = windowed_var_stats(stream).writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()
