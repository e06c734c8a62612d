"""Plan-shape guards: column pruning at the scans, map-side partial aggregation."""

import os

import pytest

from orderlab.plans import load_all

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_demand_groups_plan(spark):
    df = load_all()["demand_groups"].build(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # lineitem is read with the three columns the adapter needs, nothing else
    assert "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
    # partial aggregate below the exchange, final above it
    assert "partial_sum" in plan and "Exchange hashpartitioning" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_backtest_has_no_join_after_aggregation(spark):
    df = load_all()["quantile_backtest"].build(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # the three joins of the adapter, none after the two aggregates
    assert plan.count("Join Inner") == 3
    assert "percentile" in plan
