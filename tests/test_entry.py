"""Contract, plan and whole-query checks on the smallest tables."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registered_names_match():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["day", "n_rows", "n_events", "rate_pct"] and df.count() > 0


@pytest.mark.parametrize("name", ["q_forward_label", "q_pit_link", "q_metric_table", "q_winsor_fit", "q_semi_asof", "q_trailing_excess", "q_delong"])
def test_plans_stay_in_the_jvm(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["q_filter_pushdown"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_extendedprice,0.0)" in plan and "l_tax" not in plan
