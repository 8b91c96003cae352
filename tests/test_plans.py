"""Physical-plan properties that matter at scale."""

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL


def plan(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def test_queue_is_top_k_not_full_sort(spark):
    p = plan(spark, "q03_action_queue")
    assert "TakeOrderedAndProject" in p


def test_executive_summary_scans_once(spark):
    p = plan(spark, "k08_executive_summary")
    assert p.count("orders.parquet") == 1
    assert p.count("lineitem.parquet") == 1
    assert "Expand" in p


def test_lineitem_scan_is_pruned(spark):
    p = plan(spark, "g10_dept_stats")
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in p
    assert "partial_sum" in p


@pytest.mark.parametrize("name", ["s09_tickets", "k08_executive_summary", "g10_dept_stats", "e15_dept_quota_sample",
                                  "m07_auc_risk_score", "i02_i05_roi_grid", "q05_build_payload",
                                  "f12_apply_filters"])
def test_no_python_evaluation(spark, name):
    p = plan(spark, name)
    assert "EvalPython" not in p and "PythonUDF" not in p


@pytest.mark.parametrize("name", ["m04_stratified_split", "e15_dept_quota_sample"])
def test_exact_selection_scans_its_table_once_more(spark, name):
    """The keys' job scans the table once; the plan that returns the rows scans
    it once and neither ranks rows nor unions."""
    p = plan(spark, name)
    assert p.count("orders.parquet") == 1
    assert "Window" not in p and "Union" not in p
