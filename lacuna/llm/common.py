"""What the training-data operators share: table access, durable intermediate results, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.storage import durable as cut
from lacuna.storage import shared_dir

__all__ = ["arrow_map", "cut", "held_out", "maybe_listed", "read_table", "scratch", "shared_dir", "spread"]

#: Bytes of an Arrow batch for the Python workers.
BATCH = "8m"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (the folder may be in any Hadoop store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table scan dealt over all cores where it has fewer splits than these, as a small table in one file; larger ones stay as they are read."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded size: a batch of long texts would otherwise take its default of 64 MB several times over, in the JVM and in Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return df.mapInArrow(f, schema)


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model may learn from: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


#: Bits of the filter of :func:`maybe_listed`: 8 MB at most, whatever the number of ids.
FILTER_BITS = 1 << 26


def maybe_listed(df: DataFrame, columns: str | Sequence[str], ids: DataFrame) -> DataFrame:
    """``df`` with ``__listed``: true where the values of ``columns`` are a row of ``ids`` (columns of the same types, in this order), and for few other rows.

    A bitmap of hashes that is built on the executors and broadcast. It spares a join rows that cannot match; a join must follow, and with more ids than bits it only loses its use.
    """
    columns = [columns] if isinstance(columns, str) else columns
    # One row for each 32768 bits of the map.
    place = F.pmod(F.xxhash64(*ids.columns), F.lit(FILTER_BITS))
    maps = ids.select(F.bitmap_bucket_number(place).alias("__map"), F.bitmap_bit_position(place).alias("__bit")).groupBy("__map").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    own = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    joined = df.withColumn("__bit", F.bitmap_bit_position(own)).join(F.broadcast(maps), F.bitmap_bucket_number(own) == F.col("__map"), "left")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    listed = F.coalesce(F.getbit(byte, F.pmod("__bit", F.lit(8)).cast("int")) == 1, F.lit(False))
    return joined.withColumn("__listed", listed).drop("__bit", "__bits", "__map")
