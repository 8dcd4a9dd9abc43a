"""What the plans must look like: columns pruned, filters pushed, few exchanges, no Python and no cross product where expressions do."""

import re

import pytest
from pyspark.sql import functions as F

from lacuna.plans.catalogue import QUERIES
from lacuna.plans.tables import VARIABLES, observations
from lacuna.operators import ranking, series, stats


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_scan_reads_only_what_is_used(spark, sf):
    text = plan(QUERIES["obs_scan"](spark, sf))
    assert "props" not in re.search(r"ReadSchema: (.*)", text)[1]
    assert "l_quantity" not in plan(QUERIES["class_balance"](spark, sf))


def test_filters_reach_the_scan(spark, sf):
    df = observations(spark, sf).where((F.col("episode_id") == 3) & (F.col("var") == "view"))
    assert re.search(r"PushedFilters: \[.*EqualTo\(user_id,3\).*\]", plan(df)) and "EqualTo(event_type,view)" in plan(df)


def test_chained_series_operators_share_one_exchange(spark, sf):
    obs = observations(spark, sf)
    once = series.obs_interval(obs)
    assert exchanges(once) == 1
    assert exchanges(series.impute_linear(series.impute_ffill_zero(once).drop("imputed"))) == 1


def test_features_take_a_shuffle_per_key(spark, sf):
    df = stats.simple_features(observations(spark, sf), VARIABLES)
    assert exchanges(df) <= 3 and "CartesianProduct" not in plan(df)


def test_ranking_is_one_pass_over_the_rows(spark, sf):
    items = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    few, many = (plan(ranking.split_losses(items, f, "y", 16)).count("Scan parquet") for f in (["l_tax"], ["l_tax", "l_discount", "l_quantity"]))
    assert few == many


@pytest.mark.parametrize("name", ["obs_interval", "impute_linear_extrap", "simple_features_wide", "dft_bce", "dft_ce", "pool_maxabs", "grid_patches", "auroc", "bin_cross_entropy2", "hash_split", "topk_accuracy"])
def test_no_python_and_no_product(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct", text)
