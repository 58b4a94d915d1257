"""Tier (f): plan properties that matter at scale."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry_mod
from conftest import SF001, SF01
from rows_read import fact_records

from lifetrail import Params
from lifetrail.operators import cohort, lifecycle, rfm, value
from lifetrail.operators.facts import facts
from lifetrail.operators.prepare import clean
from lifetrail.sources.adapter import raw_transactions
from lifetrail.sources.files import ingest_transactions

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF")


def plan_of(df) -> str:
    """Executed plan; for an adaptive plan, only its final section."""
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("name", sorted(set(entry_mod.queries()) - set(entry_mod.LLM_QUERIES)))
def test_no_python_in_query_plans(spark, name):
    plan = plan_of(entry_mod.queries()[name](spark, SF001))
    assert not any(n in plan for n in PY_NODES)


def test_facts_plan_prunes_and_shuffles_twice(spark, tmpdir_path):
    ingest_transactions(raw_transactions(spark, SF001), f"{tmpdir_path}/tx")
    f = facts(clean(spark.read.parquet(f"{tmpdir_path}/tx"), Params()), Params())
    f.collect()
    plan = plan_of(f)
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "PartitionFilters: [isnotnull(tx_year" in scan and "(tx_year#" in scan and "< 2001" in scan
    read_schema = scan.split("ReadSchema: ")[1]
    assert "merchant_name" not in read_schema and "amount" in read_schema
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SinglePartition" not in plan


#: Rows that one pass over the fact and its two joined tables reads.
def one_pass(spark) -> int:
    return sum(spark.read.parquet(f"{SF01}/{t}.parquet").count() for t in ("lineitem", "orders", "part"))


@pytest.mark.parametrize("name", ["rfm_scored_ntile", "rfm_scored_qcut", "rfm_segments", "rfm_segment_summary", "segment_transactions", "segment_category_mix", "segment_category_matrix",
                                  "segment_top_categories", "segment_seasonality", "outcome_comparison", "two_proportion_ztest", "experiment_by_segment", "impact_estimate",
                                  "funnel_sequential", "ltv_summary", "ltv_describe"])
def test_composite_queries_read_the_fact_once(spark, name):
    """Beyond one pass over the given tables only narrow written tables are
    read: the users' frame a few times, and the activity table."""
    scanned = fact_records(spark, lambda: entry_mod.queries()[name](spark, SF01).collect())
    assert scanned <= 1.05 * one_pass(spark), (name, scanned)


def test_no_global_window_over_users(spark):
    df = entry_mod.queries()["rfm_scored_ntile"](spark, SF001)
    df.collect()
    assert "Window" not in plan_of(df) and "Exchange" not in plan_of(df)  # bins are comparisons with cut keys


def hash_exchanges(df) -> list[str]:
    df.collect()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(df))


@pytest.fixture()
def ingested(spark, tmpdir_path):
    ingest_transactions(raw_transactions(spark, SF001), f"{tmpdir_path}/tx")
    return clean(spark.read.parquet(f"{tmpdir_path}/tx"), Params())


def test_user_grain_needs_one_exchange(ingested):
    from lifetrail.operators.facts import user_totals
    p = Params()
    totals = user_totals(ingested, p)
    for df in (value.annual_ltv(totals, p), rfm.rfm_raw(totals, p)):
        keys = hash_exchanges(df)
        assert len(keys) == 1 and keys[0].startswith("user_id"), keys
    keys = hash_exchanges(lifecycle.revenue_summary(totals, p))
    assert len(keys) == 1, keys


def test_cohort_queries_never_exchange_days(ingested):
    from lifetrail.operators.facts import user_returns, user_years
    p = Params()
    uy = user_years(ingested, p)
    for df in (cohort.cohort_retention(uy, p), cohort.cohort_behavior(uy, p), lifecycle.retention_next_year(user_returns(uy), p)):
        assert not any("date_int" in k for k in hash_exchanges(df))
        df.collect()
        assert "date_int" not in plan_of(df)


def test_raw_scan_is_not_reshuffled(spark):
    assert "RoundRobinPartitioning" not in plan_of(raw_transactions(spark, SF001))
