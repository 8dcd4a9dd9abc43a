"""Reproducible splits and samples, by arithmetic hashes of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MULTIPLIER, MODULUS = 2654435761, 1 << 32


def id_hash(c: Column) -> Column:
    """A scattered number in [0, 2^32) of an integer id."""
    return F.pmod(F.pmod(c.cast("long"), F.lit(1 << 31)) * F.lit(MULTIPLIER), F.lit(MODULUS))


def hash_split(df: DataFrame, key: str, train: float = 0.8, valid: float = 0.1, name: str = "split") -> DataFrame:
    """train, valid or test by the key's hash: no order of all rows is needed, and a row's split never changes."""
    u = id_hash(F.col(key)) / F.lit(float(MODULUS))
    return df.withColumn(name, F.when(u < train, "train").when(u < train + valid, "valid").otherwise("test"))


def balanced_sample(df: DataFrame, label: str, key: str, per_class: int) -> DataFrame:
    """``per_class`` rows of each class, those of smallest (hash, key). The window limit is applied before the shuffle as well, so a hot class stays cheap."""
    w = Window.partitionBy(label).orderBy(id_hash(F.col(key)), key)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_class).drop("__rn")
