"""Datasets, metadata and models as Parquet or JSON below one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.subspace import Subspace


def save_dataset(series: DataFrame, path: str, meta: DataFrame | None = None, split: str | None = None, mode: str = "overwrite") -> None:
    """``<path>/data`` (by split, if there is such a column) and ``<path>/meta``."""
    writer = series.write.mode(mode)
    (writer.partitionBy(split) if split else writer).parquet(f"{path}/data")
    if meta is not None:
        meta.write.mode(mode).parquet(f"{path}/meta")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/data")


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """The metadata alone: the data are not touched."""
    return spark.read.parquet(f"{path}/meta")


def save_model(spark: SparkSession, model: Subspace, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> Subspace:
    return Subspace.from_json(spark.read.parquet(path).first()["model"])


def vectors_from(df: DataFrame, column: str, drop_leading: int = 0, keep: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Stored vectors without their leading entries, and only the rows whose key is in ``keep``."""
    out = df if keep is None else df.join(keep.select(key), key, "left_semi")
    return out if not drop_leading else out.withColumn(column, F.slice(column, drop_leading + 1, F.size(column)))
