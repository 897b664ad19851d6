"""Answers grow when they are read: no side of their joins is sent whole to every task."""

import pytest

from tessera.plans import registry


@pytest.mark.parametrize("name", ["cn02_search", "cn03_release"])
def test_no_side_is_broadcast(spark, small, name):
    plan = registry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan
