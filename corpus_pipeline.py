"""A training-corpus pipeline: toxicity, quality, near duplicates, benchmark leaks, then token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but the last keep the columns of
``documents``. Each works on all that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import bpe, decontaminate, quality, simhash, toxicity
from lacuna.llm.common import read_table, scratch


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def reject_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_poor(docs, read_table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def remove_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_documents(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(docs, bpe.default_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("quality", reject_poor),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", remove_benchmark_leaks),
    ("bpe", encode),
]

#: Classifiers and fingerprints have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table in the shared folder."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(path := scratch(spark, name))
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
