"""Plan shape: what must (not) appear in the physical plans at any scale."""

import pytest

import __spark_entry__ as E
from conftest import SF001
from storelens.plans import registry as REG


def plan(df):
    df.collect()  # let AQE finalise
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(REG.QUERIES))
def test_no_cartesian_products(spark, name):
    p = plan(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


@pytest.mark.parametrize("name", ["process_reviews", "clean_text", "anonymize_pii", "validate_reviews",
                                  "validate_prices", "validate_apps", "quarantine_counts", "keyword_faults",
                                  "review_merge", "pii_rates", "weekly_report", "price_trends", "asof_price",
                                  "running_avg", "offers", "churn", "sync_errors", "metadata_json_query"])
def test_no_python_in_native_jobs(spark, name):
    p = plan(E.queries()[name](spark, SF001))
    assert "EvalPython" not in p and "PythonUDF" not in p and "MapInArrow" not in p


@pytest.mark.parametrize("name", ["price_changes", "offers", "running_avg", "sync_errors", "asof_price", "churn"])
def test_series_windows_split_hot_keys(spark, name):
    """Per-row windows over a series run on (key, time bucket)."""
    df = E.queries()[name](spark, SF001)
    p = df._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in p


def test_scans_are_pruned(spark):
    df = E.queries()["latest_price"](spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in p
    df = E.queries()["reviews_page"](spark, SF001)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in p and "PushedFilters: [IsNotNull(source), EqualTo(source,src3)]" in p


def test_series_summary_join_reuses_partitioning(spark):
    """With no broadcast allowed, the rows are still shuffled only once: the
    sort-merge join with the per-bucket summary reuses the window's partitioning."""
    from storelens.operators import prices as P
    from storelens.sources import fixtures as FX
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = P.price_changes(FX.fx_prices(spark, SF001), width_us=7 * 24 * 3_600_000_000)
        p = df._jdf.queryExecution().executedPlan().toString()
        lines = p.splitlines()
        start = next(i for i, ln in enumerate(lines) if "SortMergeJoin" in ln)
        scan = next(i for i in range(start, len(lines)) if "FileScan" in lines[i])
        left = lines[start + 1:scan]  # the row side, down to its scan
        assert sum("Exchange" in ln for ln in left) == 1, p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
