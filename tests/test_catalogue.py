"""Every query runs, and those with SQL give the rows of their SQL."""

import pytest
from oracle import rows_of, rows_of_sql

import __spark_entry__ as entry
from lacuna.plans.catalogue import ORACLE_SQL, QUERIES

def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "y" in df.columns


def test_registered():
    assert set(ORACLE_SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, name):
    assert rows_of(QUERIES[name](spark, sf)) == rows_of_sql(ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
