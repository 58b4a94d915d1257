"""Tier (e) and skew: results do not depend on the number of shuffle
partitions, and a user holding a third of all rows is handled exactly."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_mod
from conftest import SF01
from contract_check import compare, duck
from fixtures import raw_frame, tx
from lifetrail import Params
from lifetrail.operators.facts import facts
from lifetrail.operators.prepare import clean

KEYS = ["funnel_sequential", "cohort_behavior", "rfm_segments", "segment_category_mix",
        "outcome_comparison", "ltv_summary"]


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partition_count_independence(spark, con, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        for name in KEYS:
            problems, _, _ = compare(spark, con, name, entry_mod.queries()[name], entry_mod.oracle_sql()[name], SF01)
            assert not problems, (name, parts, problems)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_hot_user_facts_match_brute_force(spark):
    rows = []
    for i in range(1200):                       # user 0: a third of all rows, many days and years
        y, m, d = 1995 + i % 6, 1 + (i // 6) % 12, 1 + i % 28
        rows.append(tx(0, y, m, d, f"${(i % 97) - 10}.25"))
    for u in range(1, 241):                     # 240 other users, 10 rows each
        for j in range(10):
            rows.append(tx(u, 1996 + (u + j) % 5, 1 + j, 1 + (u * j) % 28, f"${u + j}.00"))
    p = Params()
    got = facts(clean(raw_frame(spark, rows, partitions=16), p), p).toPandas().set_index("user_id").sort_index()

    pdf = pd.DataFrame(rows, columns=["user_id", "card", "y", "m", "d", "t", "amount_raw", "c1", "c2", "c3",
                                      "c4", "c5", "mcc", "errors", "fraud"])
    pdf["date_int"] = pdf.y * 10000 + pdf.m * 100 + pdf.d
    pdf["cents"] = (pdf.amount_raw.str.replace("$", "", regex=False).astype(float) * 100).round().astype(int)
    exp = {}
    for uid, g in pdf.groupby("user_id"):
        days = sorted(set(g.date_int))
        first_year, last_year = g.y.min(), g.y.max()
        exp[uid] = dict(first_date=days[0], second_date=days[1] if len(days) > 1 else None,
                        first_year=first_year, last_year=last_year,
                        active_next_year=int((g.y == first_year + 1).any()), n_tx=len(g),
                        pos_cents=int(g.cents[g.cents > 0].sum()), n_days=len(days))
    exp = pd.DataFrame.from_dict(exp, orient="index").sort_index()
    for col in ("first_date", "first_year", "last_year", "active_next_year", "n_tx", "pos_cents", "n_days"):
        assert (got[col].astype("int64").values == exp[col].astype("int64").values).all(), col
    assert got.loc[0, "n_tx"] == 1200


def test_parquet_stream_ingest_of_event_days(spark, tmpdir_path):
    from lifetrail.streaming import ingest_parquet_stream
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    day = F.to_date("ts")
    days = [r[0] for r in ev.select(day.alias("d")).distinct().orderBy("d").collect()]
    half = days[len(days) // 2]
    ev.filter(day < half).coalesce(2).write.parquet(f"{tmpdir_path}/landing/batch1")
    n1 = ingest_parquet_stream(spark, f"{tmpdir_path}/landing/*", ev.schema, f"{tmpdir_path}/out",
                               f"{tmpdir_path}/ck", max_files_per_trigger=1)
    assert n1 == ev.filter(day < half).count()
    ev.filter(day >= half).coalesce(2).write.parquet(f"{tmpdir_path}/landing/batch2")
    n2 = ingest_parquet_stream(spark, f"{tmpdir_path}/landing/*", ev.schema, f"{tmpdir_path}/out", f"{tmpdir_path}/ck")
    assert n1 + n2 == ev.count() == spark.read.parquet(f"{tmpdir_path}/out").count()
