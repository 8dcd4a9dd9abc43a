"""Cleaning and encoding expressions. A missing value is NULL everywhere; NaN is turned into NULL at the scan."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in any float or double column becomes NULL."""
    return df.select(*[F.nanvl(F.col(f"`{f.name}`"), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def hhmm_to_hours(c: Column) -> Column:
    """'hh:mm' to hours; hours may pass 24, malformed text is NULL."""
    h, m = F.try_element_at(F.split(c, ":"), F.lit(1)), F.try_element_at(F.split(c, ":"), F.lit(2))
    return h.try_cast("double") + m.try_cast("double") / F.lit(60.0)


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case column names, blanks as underscores."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def within(c: Column, low: float, high: float) -> Column:
    """The value, or NULL outside [low, high]."""
    return F.when(c.between(low, high), c)


def encode_ordered(c: Column, codes: Sequence[tuple[str, int]]) -> Column:
    """Code of the first substring found, whatever its case; NULL without any."""
    low = F.lower(c)
    return F.coalesce(*[F.when(F.contains(low, F.lit(s)), F.lit(n)) for s, n in codes])


def truncated_int(c: Column, minus: int = 0) -> Column:
    """Text of a number as an integer, cut toward zero, less an offset."""
    return c.try_cast("double").cast("int") - minus


def unit_id(first: Column, second: Column) -> Column:
    """-1 if either flag is missing, else the second flag."""
    return F.when(first.isNull() | second.isNull(), F.lit(-1)).otherwise(second.cast("int"))


def units_agree(first: Column, second: Column) -> Column:
    """True if a flag is missing or exactly one of both is set."""
    return first.isNull() | second.isNull() | (first.cast("int") + second.cast("int") == 1)


def all_of(first: Column, *more: Column) -> Column:
    return reduce(lambda a, b: a & b, more, first)


def any_of(first: Column, *more: Column) -> Column:
    return reduce(lambda a, b: a | b, more, first)


def one_hot(c: Column, classes: int) -> Column:
    """array<double> of 0 and 1; all 0 for NULL."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.coalesce((c == k).cast("double"), F.lit(0.0)))


def steps_below(x: Column, low: Column, width: Column, bins: int) -> Column:
    """How many of the cuts low + i x width (i = 1 .. bins-1) lie strictly below x.

    The quotient finds the bin but for rounding; comparing with the two cuts around it makes the count exact, so no per-cut loop is needed.
    """
    guess = F.when(width > 0, F.least(F.greatest(F.ceil((x - low) / width).cast("int") - 1, F.lit(0)), F.lit(bins - 1))).otherwise(F.lit(0))
    up = ((guess + 1 <= bins - 1) & (x > low + (guess + 1) * width)).cast("int")
    down = ((guess >= 1) & ~(x > low + guess * width)).cast("int")
    return guess + up - down


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """floor of the scaled value; the top edge belongs to the last bin."""
    return F.least(F.floor((x - low) / (high - low) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
