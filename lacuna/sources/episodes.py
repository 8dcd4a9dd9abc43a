"""Readers of the three episode layouts. Each gives the long form (episode_id, seq, t, var, v) and its side tables; malformed rows are left out, never whole scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.functions.scalar import encode_ordered, hhmm_to_hours, nan_to_null, normalise_names, truncated_int, unit_id, units_agree, within

# Variable and descriptor names of the first layout's files.
ICU_DESCRIPTORS = ("RecordID", "Age", "Gender", "Height", "ICUType", "Weight")
ICU_VARIABLES = (
    "Albumin", "ALP", "ALT", "AST", "Bilirubin", "BUN", "Cholesterol", "Creatinine",
    "DiasABP", "FiO2", "GCS", "Glucose", "HCO3", "HCT", "HR", "K", "Lactate", "Mg",
    "MAP", "MechVent", "Na", "NIDiasABP", "NIMAP", "NISysABP", "PaCO2", "PaO2", "pH",
    "Platelets", "RespRate", "SaO2", "SysABP", "Temp", "TroponinI", "TroponinT", "Urine",
    "WBC", "Weight",
)
ICU_LABELS = ("SAPS-I", "SOFA", "Length_of_stay", "Survival", "In-hospital_death")
# Records that hold no usable series.
ICU_BLACKLIST = ("140501", "150649", "140936", "143656", "141264", "145611", "142998", "147514", "142731", "150309", "155655", "156254")
# Features of the third layout's files: name, kind.
EPISODE_FEATURES = (
    ("capillary_refill_rate", "categorical"),
    ("diastolic_blood_pressure", "continuous"),
    ("fraction_inspired_oxygen", "continuous"),
    ("glascow_coma_scale_eye_opening", "categorical"),
    ("glascow_coma_scale_motor_response", "categorical"),
    ("glascow_coma_scale_total", "categorical"),
    ("glascow_coma_scale_verbal_response", "categorical"),
    ("glucose", "continuous"),
    ("heart_rate", "continuous"),
    ("height", "continuous"),
    ("mean_blood_pressure", "continuous"),
    ("oxygen_saturation", "continuous"),
    ("respiratory_rate", "continuous"),
    ("systolic_blood_pressure", "continuous"),
    ("temperature", "continuous"),
    ("weight", "continuous"),
    ("ph", "continuous"),
)
# Substrings of coma scale answers and their codes, tried in this order.
EYE_OPENING = (("respon", 0), ("pain", 1), ("speech", 2), ("spont", 3))
MOTOR_RESPONSE = (("respon", 0), ("extens", 1), ("flex", 2), ("withd", 3), ("pain", 4), ("obey", 5))
VERBAL_RESPONSE = (("respon", 0), ("trach", 0), ("incomp", 1), ("inap", 2), ("conf", 3), ("orient", 4))
WEIGHT_BOUNDS = (0.0, 300.0)
# Columns after the measurements of the second layout's files.
HOURLY_REST = ("Age", "Gender", "Unit1", "Unit2", "HospAdmTime", "ICULOS", "SepsisLabel")


def _file_stem() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)


def read_icu_records(spark: SparkSession, paths: str | Sequence[str], variables: Sequence[str] = ICU_VARIABLES, descriptors: int = 5) -> tuple[DataFrame, DataFrame]:
    """(series, static) of record files: a header, the record's id, ``descriptors`` descriptor rows (the last one also begins the series), then time,param,value.

    A first series row with a negative weight is dropped. Values of -1 stay in ``static`` as they are.
    """
    text = spark.read.text(list(paths) if not isinstance(paths, str) else paths, wholetext=True).select(_file_stem().alias("episode_id"), "value")
    return icu_rows(text, variables, descriptors)


def icu_rows(text: DataFrame, variables: Sequence[str] = ICU_VARIABLES, descriptors: int = 5) -> tuple[DataFrame, DataFrame]:
    """(series, static) of whole record files (episode_id, value)."""
    lines = text.select("episode_id", F.posexplode(F.split("value", r"\r?\n")).alias("line", "row")).where((F.col("line") >= 2) & (F.trim("row") != ""))
    part = F.split("row", ",")
    rows = lines.select("episode_id", (F.col("line") - 2).cast("long").alias("seq"), F.try_element_at(part, F.lit(1)).alias("time"), F.try_element_at(part, F.lit(2)).alias("var"), F.nanvl(F.try_element_at(part, F.lit(3)).try_cast("double"), F.lit(None)).alias("v"))
    static = rows.where(F.col("seq") < descriptors).select("episode_id", "var", "v")
    series = rows.where((F.col("seq") >= descriptors - 1) & ~((F.col("seq") == descriptors - 1) & (F.col("var") == "Weight") & (F.col("v") < 0)))
    series = series.where(F.col("var").isin(list(variables))).select("episode_id", "seq", hhmm_to_hours(F.col("time")).alias("t"), "var", "v").where(F.col("t").isNotNull())
    return series, static


def read_outcomes(spark: SparkSession, paths: Sequence[str], labels: Sequence[str] = ICU_LABELS) -> DataFrame:
    """(episode_id, one column per label); of a repeated id the row of the last listed file counts."""
    schema = T.StructType([T.StructField("RecordID", T.StringType()), *[T.StructField(n, T.DoubleType()) for n in labels]])
    parts = [spark.read.csv(p, schema=schema, header=True).withColumn("__file", F.lit(i)) for i, p in enumerate(paths)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(F.col("RecordID").alias("episode_id")).agg(*[F.max_by(F.struct(F.col(f"`{n}`").alias("x")), "__file")["x"].alias(n) for n in labels])


def read_hourly_records(spark: SparkSession, paths: str | Sequence[str], measurements: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(series, static) of '|'-separated files with a row per hour: ``measurements``, then demographics, time (ICULOS) and label (SepsisLabel).

    ``static`` has a row per episode: age, gender, unit_id, hosp_adm_time of its first row, icu_los and label of its last. Episodes whose unit flags contradict each other are left
    out of both.
    """
    schema = T.StructType([T.StructField(c, T.DoubleType()) for c in (*measurements, *HOURLY_REST)])
    raw = spark.read.csv(list(paths) if not isinstance(paths, str) else paths, schema=schema, sep="|", header=True, nanValue="NaN", mode="PERMISSIVE")
    return hourly_rows(raw.select(_file_stem().alias("episode_id"), "*"), measurements)


def hourly_rows(raw: DataFrame, measurements: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(series, static) of the rows of hourly files, with their ``episode_id``."""
    rows = nan_to_null(raw).where(F.col("ICULOS").isNotNull())
    first = lambda c: F.min_by(F.struct(F.col(c).alias("x")), "ICULOS")["x"]
    last = lambda c: F.max_by(F.struct(F.col(c).alias("x")), "ICULOS")["x"]
    static = rows.groupBy("episode_id").agg(first("Age").cast("int").alias("age"), first("Gender").cast("int").alias("gender"), first("Unit1").alias("u1"), first("Unit2").alias("u2"), first("HospAdmTime").alias("hosp_adm_time"), F.max("ICULOS").alias("icu_los"), last("SepsisLabel").cast("int").alias("label"))
    static = static.where(units_agree(F.col("u1"), F.col("u2"))).select("episode_id", "age", "gender", unit_id(F.col("u1"), F.col("u2")).alias("unit_id"), "hosp_adm_time", "icu_los", "label")
    long = rows.unpivot(["episode_id", "ICULOS"], [f"`{m}`" for m in measurements], "var", "v")
    series = long.select("episode_id", F.lit(0).cast("long").alias("seq"), F.col("ICULOS").alias("t"), "var", "v").join(static.select("episode_id"), "episode_id", "left_semi")
    return series, static


def encode_episode_feature(name: str, c: Column) -> Column:
    """A feature's text as a number: categories by their codes, weights out of bounds missing."""
    if name == "capillary_refill_rate":
        return truncated_int(c).cast("double")
    if name == "glascow_coma_scale_total":
        return truncated_int(c, 3).cast("double")
    codes = {"glascow_coma_scale_eye_opening": EYE_OPENING, "glascow_coma_scale_motor_response": MOTOR_RESPONSE, "glascow_coma_scale_verbal_response": VERBAL_RESPONSE}.get(name)
    if codes:
        return encode_ordered(c, codes).cast("double")
    value = F.nanvl(c.try_cast("double"), F.lit(None))
    return within(value, *WEIGHT_BOUNDS) if name == "weight" else value


def read_episode_files(spark: SparkSession, paths: str | Sequence[str], features: Sequence[str] = tuple(n for n, _ in EPISODE_FEATURES)) -> DataFrame:
    """Series of ``<subject>_episode<n>_timeseries.csv`` files; columns are taken by name, in any order; files of other names are left out."""
    return episode_rows(spark.read.csv(list(paths) if not isinstance(paths, str) else paths, header=True, inferSchema=False).select("*", F.col("_metadata.file_name").alias("file_name")), features)


def episode_rows(raw: DataFrame, features: Sequence[str] = tuple(n for n, _ in EPISODE_FEATURES)) -> DataFrame:
    """Series of the text columns of episode files, with their ``file_name``."""
    raw = normalise_names(raw)
    subject, episode = (F.regexp_extract("file_name", r"(\d+)_episode(\d+)_timeseries\.csv", i) for i in (1, 2))
    rows = raw.where(subject != "").select(F.concat_ws("_", subject.cast("long").cast("string"), F.concat(F.lit("episode"), episode.cast("int").cast("string"))).alias("episode_id"), F.col("hours").try_cast("double").alias("t"), *[encode_episode_feature(f, F.col(f)).alias(f) for f in features if f in raw.columns])
    long = rows.unpivot(["episode_id", "t"], [f for f in features if f in raw.columns], "var", "v")
    return long.select("episode_id", F.lit(0).cast("long").alias("seq"), "t", "var", "v")


def read_listfile(spark: SparkSession, path: str) -> DataFrame:
    """(episode_id, y_true) of a list file whose first column is a file name."""
    raw = spark.read.csv(path, header=True, inferSchema=False)
    key = raw.columns[0]
    subject, episode = (F.regexp_extract(F.col(key), r"(\d+)_episode(\d+)_timeseries\.csv", i) for i in (1, 2))
    return raw.where(subject != "").select(F.concat_ws("_", subject.cast("long").cast("string"), F.concat(F.lit("episode"), episode.cast("int").cast("string"))).alias("episode_id"), F.col("y_true").try_cast("double").cast("int").alias("y_true"))
