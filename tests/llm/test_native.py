"""The operators that must stay native: no Python, pandas, Arrow or RDD step in their plans."""

import re

import pytest

from lacuna.llm.registry import QUERIES


@pytest.mark.parametrize("name", ["op3_sharding", "op10_chat_formatting"])
def test_plan_is_native(spark, sf, name):
    df = QUERIES[name](spark, sf)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|MapInArrow|ArrowEval|CartesianProduct|BroadcastNestedLoop", text)
