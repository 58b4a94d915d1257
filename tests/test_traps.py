"""Tier (a): micro fixtures for the semantic traps and column helpers."""

from __future__ import annotations

import hashlib
import math
from statistics import NormalDist

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixtures import raw_frame, tx
from lifetrail import Params
from lifetrail.functions import normal_cdf, pct, round_ratio, round_ratio_int
from lifetrail.operators import cohort, experiment, lifecycle, profile, rfm, value
from lifetrail.operators.facts import facts
from lifetrail.operators.prepare import clean, monetary

P = Params()


def by_user(df, col):
    return {r["user_id"]: r[col] for r in df.select("user_id", col).collect()}


def test_t1_activation_window_modes(spark):
    rows = [tx(1, 2000, 1, 31), tx(1, 2000, 2, 1),          # month edge
            tx(2, 2000, 2, 28), tx(2, 2000, 3, 1),          # leap-year month edge
            tx(3, 2000, 3, 1), tx(3, 2000, 3, 31),          # 30 days inside a month
            tx(4, 2000, 4, 5), tx(4, 2000, 4, 5),           # same-day repeat only
            tx(5, 1999, 12, 31), tx(5, 2000, 1, 1),         # year edge
            tx(6, 2000, 5, 1), tx(6, 2000, 6, 15)]          # beyond both windows
    c = clean(raw_frame(spark, rows), P)
    d = by_user(facts(c, P), "activated")
    assert d == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}
    cal = by_user(facts(c, P.with_(window_mode="calendar")), "activated")
    assert cal == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 0}
    assert by_user(facts(c, P), "has_second") == {1: 1, 2: 1, 3: 1, 4: 0, 5: 1, 6: 1}


def test_t2_t18_spans_and_retention(spark):
    rows = [tx(1, 1997, 3, 1),                                   # single transaction
            tx(2, 1997, 3, 1), tx(2, 1997, 9, 1),                # single year
            tx(3, 1996, 1, 1), tx(3, 1998, 1, 1),                # skips the next year
            tx(4, 2000, 6, 1), tx(4, 2000, 7, 1),                # first seen in the last kept year
            tx(5, 1996, 1, 1, "$300.00"), tx(5, 1997, 1, 1, "$300.00"), tx(5, 1999, 1, 1, "$301.00")]
    f = facts(clean(raw_frame(spark, rows), P), P)
    assert by_user(f, "active_next_year") == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}
    a = value.annual_ltv(f, P)
    assert by_user(a, "active_years") == {1: 1, 2: 1, 3: 2, 4: 1, 5: 3}
    # 901 dollars over 3 years = 300.33 -> 300; 3 rows / 3 years = 1
    assert by_user(a, "annual_ltv")[5] == 300 and by_user(a, "annual_tx")[5] == 1
    r = rfm.rfm_raw(f, P)
    assert by_user(r, "recency_years") == {1: 3, 2: 3, 3: 2, 4: 0, 5: 1}


def test_t3_int_division_flag(spark):
    rows = [tx(1, 1996, 1, 1), tx(1, 1996, 2, 1), tx(1, 1996, 3, 1), tx(1, 1996, 4, 1), tx(1, 1996, 5, 1),
            tx(1, 1998, 1, 1)]  # 6 rows over a 2-year span -> 3 either way; make it 7 / 2
    rows.append(tx(1, 1998, 2, 1))
    f = facts(clean(raw_frame(spark, rows), P), P)
    assert by_user(value.annual_ltv(f, P), "annual_tx") == {1: 4}          # round(3.5) half up
    assert by_user(value.annual_ltv(f, P, int_division=True), "annual_tx") == {1: 3}


def test_t8_cohort_filter_after_minimum(spark):
    rows = [tx(1, 1994, 1, 1), tx(1, 1997, 1, 1),   # true cohort 1994 (excluded), truncated 1997
            tx(2, 1997, 5, 1), tx(3, 1996, 2, 2)]
    f = facts(clean(raw_frame(spark, rows), P), P)
    t = {r["cohort_year"]: (r["users_full_history"], r["users_truncated_history"])
         for r in cohort.cohort_truncation_check(f, P).collect()}
    assert t == {1996: (1, 1), 1997: (1, 2)}


def test_b1_amount_parsing_and_monetary_view(spark):
    rows = [tx(1, 1999, 1, 1, "$-5.00"), tx(1, 1999, 1, 2, "$0.00"), tx(1, 1999, 1, 3, "$100000.00"),
            tx(1, 1999, 1, 4, "$100000.01"), tx(1, 1999, 1, 5, "$abc"), tx(1, 1999, 1, 6, "$12.50", errors=""),
            tx(1, 1999, 1, 7, "$7.25"), tx(1, 1999, 1, 8, "$7.25", fraud="Yes"), tx(1, 2001, 1, 1, "$1.00")]
    c = clean(raw_frame(spark, rows), P)
    amounts = sorted((r["amount"] is None, r["amount"]) for r in c.select("amount").collect())
    assert len(amounts) == 7 and amounts[-1][0]            # fraud and 2001 rows dropped, '$abc' -> NULL
    m = monetary(c, P).select(F.col("amount").cast("string").alias("a")).collect()
    assert sorted(r["a"] for r in m) == ["100000.00", "7.25"]   # cap inclusive, '' error excluded


def test_t16_integer_rounding(spark):
    row = spark.range(1).select(pct(F.lit(201), F.lit(20000), 2).alias("a"),
                                round_ratio(F.lit(-5), F.lit(2), 0).alias("b"),
                                round_ratio_int(F.lit(5), F.lit(2)).alias("c")).first()
    assert row["a"] == 1.01 and row["b"] == -3.0 and row["c"] == 3


def test_t13_mapping_last_wins(spark):
    m = profile.mapping_frame(spark, [("5813", "restaurant"), ("5411", "grocery"), ("5813", "liquor")])
    d = {r["code"]: r["label"] for r in m.collect()}
    assert d == {"5813": "liquor", "5411": "grocery"}


def test_t14_population_counts_keys_not_names(spark):
    users = spark.createDataFrame([(0, "Ann"), (1, "Ann"), (2, "Bo")], "user_id long, person string")
    raw = raw_frame(spark, [tx(0, 1999, 1, 1), tx(1, 1999, 1, 1, fraud="Yes"), tx(2, 2001, 1, 1)])
    rec = {r["stage"]: r["users"] for r in profile.population_reconciliation(raw, users, P).collect()}
    assert rec == {"raw": 3, "non_fraud": 2, "clean": 1, "dimension": 3}


def test_k5_segment_branches(spark):
    from lifetrail.functions import rfm_segment
    rows = [(13, 5, 4, 4), (10, 4, 3, 3), (7, 3, 2, 2), (6, 2, 3, 1), (5, 1, 2, 2), (6, 2, 2, 2)]
    df = spark.createDataFrame(rows, "s int, r int, f int, m int")
    got = [r["seg"] for r in df.select(rfm_segment("s", "r", "f", "m").alias("seg")).collect()]
    assert got == ["VIP", "Loyal", "Potential", "At Risk", "Dormant", "Dormant"]


def test_normal_cdf_accuracy(spark):
    xs = [i / 4 for i in range(-40, 41)] + [-8.0, 7.5, 9.0, -38.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    nd = NormalDist()
    for r in df.select("x", normal_cdf("x").alias("p")).collect():
        assert abs(r["p"] - nd.cdf(r["x"])) < 1e-14


@pytest.mark.parametrize("xt,z,pv", [(250, 3.2415, 0.0006), (239, 2.2071, 0.0137)])
def test_l7_ztest_goldens(spark, xt, z, pv):
    df = spark.createDataFrame([(xt, 316, 214, 316)], "x_treated long, n_treated long, x_control long, n_control long")
    r = df.select(experiment.z_test_columns("x_treated", "n_treated", "x_control", "n_control").alias("z")) \
          .select("z", (1 - normal_cdf("z")).alias("p")).first()
    assert round(r["z"], 4) == z and round(r["p"], 4) == pv


def test_l8_wald_interval_zero_variance(spark):
    rows = [("s", "control", 0), ("s", "control", 0), ("s", "treatment", 1), ("s", "treatment", 1)]
    o = spark.createDataFrame(rows, "outcome string, arm string, converted long")
    ci = {r["arm"]: (r["ci_low"], r["ci_high"]) for r in experiment.proportion_ci(o, P).collect()}
    assert ci == {"control": (0.0, 0.0), "treatment": (1.0, 1.0)}


def test_l9_sample_size_goldens(spark):
    za, zb = experiment.z_quantile(0.95), experiment.z_quantile(0.8)
    h = 2 * math.asin(math.sqrt(0.75)) - 2 * math.asin(math.sqrt(0.66))
    assert round(h, 4) == 0.1979
    grid = [math.ceil(2 * ((za + zb) / (2 * math.asin(math.sqrt(0.66 + m)) - 2 * math.asin(math.sqrt(0.66)))) ** 2)
            for m in (0.05, 0.07, 0.09, 0.11, 0.13, 0.15)]
    assert grid == [1066, 534, 316, 207, 145, 106]
    # the same through the operator, with a baseline of exactly 66 %
    units = spark.createDataFrame([(i, 1 if i < 66 else 0, "VIP") for i in range(100)],
                                  "user_id long, activated int, segment string")
    plan = experiment.sample_size_plan(units, P)
    got = [r["n_per_group"] for r in plan.filter(F.col("baseline") == "all").orderBy("mde").collect()]
    assert got == grid


def test_l12_impact_golden(spark):
    rows = ([("benchmark", "control", 1)] * 214 + [("benchmark", "control", 0)] * 102
            + [("benchmark", "treatment", 1)] * 239 + [("benchmark", "treatment", 0)] * 77)
    o = spark.createDataFrame(rows, "outcome string, arm string, converted long")
    population = spark.createDataFrame([(1657, 50507)], "eligible_users long, avg_annual_ltv long")
    r = experiment.impact_estimate(o, population).first()
    assert r["additional_activated"] == 131 and r["additional_revenue"] == 6616417


def test_l2_activation_by_segment(spark):
    u = spark.createDataFrame([(1, 1, "VIP"), (2, 0, "Potential"), (3, 1, "Potential")], "user_id long, activated int, segment string")
    s = {r["segment"]: (r["user_count"], r["activated"]) for r in experiment.activation_by_segment(u).collect()}
    assert s == {"VIP": (1, 1), "Potential": (2, 1)}


def test_l3_draw_of_n_per_group(spark):
    u = spark.range(101).select(F.col("id").alias("user_id"), F.lit(1).alias("activated"), F.lit("VIP").alias("segment"))
    half = experiment.experiment_assignment(u, P).groupBy("arm").count().collect()
    assert {r.arm: r["count"] for r in half} == {"control": 50, "treatment": 50}
    some = experiment.experiment_assignment(u, P.with_(n_per_group=7)).collect()
    want = sorted(range(101), key=lambda i: (hashlib.md5(f"{i}:42".encode()).hexdigest(), i))[:14]
    assert [r.user_id for r in sorted(some, key=lambda r: r.draw_order)] == want
    assert [r.arm for r in sorted(some, key=lambda r: r.draw_order)] == ["control"] * 7 + ["treatment"] * 7


def test_rounding_beyond_long(spark):
    row = spark.range(1).select(round_ratio(F.lit(10**17 + 1), F.lit(10**12), 2).alias("a"), pct(F.lit(10**17), F.lit(3 * 10**17), 4).alias("b"),
                                round_ratio_int(F.lit(-(10**18) - 1), F.lit(2)).alias("c"), round_ratio(F.lit(46_200_000_000_000_000), F.lit(1_300_000_000_000), 2).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (100000.0, 33.3333, -(5 * 10**17) - 1, 35538.46)


def test_half_even_rounding(spark):
    from lifetrail.functions import round_half_even
    xs = [0.5, 1.5, 2.5, -0.5, 2.25, 2.35]
    got = [r.v for r in spark.createDataFrame([(x,) for x in xs], "x double").select(round_half_even("x", 0).alias("v")).collect()]
    assert got == [round(x) for x in xs]


def test_clean_view_keeps_only_known_no(spark):
    rows = [tx(k, 1999, 1, 1, fraud=f) for k, f in enumerate(["No", "", "unknown", "YES", None, "Yes"])]
    assert [r.user_id for r in clean(raw_frame(spark, rows), P).collect()] == [0]
    flags = spark.createDataFrame([(0, False), (1, True), (2, None)], "user_id long, is_fraud boolean")
    from lifetrail.operators.prepare import not_fraud
    assert [r.user_id for r in flags.where(not_fraud(flags)).collect()] == [0]


def test_retention_without_censored_users(spark):
    r = spark.createDataFrame([(1, 1998, 1), (2, 1999, 0), (3, 2000, 0)], "user_id long, first_year int, active_next_year int")
    assert tuple(lifecycle.retention_next_year(r, P).first())[:2] == (3, 1)
    assert tuple(lifecycle.retention_next_year(r, P, exclude_censored=True).first())[:2] == (2, 1)


def test_pivot_stops_at_an_age_without_a_column(spark):
    long = spark.createDataFrame([(1996, 0, 1.0), (1996, 99, 2.0)], "cohort_year long, years_since_first long, v double")
    with pytest.raises(Exception, match="no column for age 99"):
        cohort.pivot_by_age(long, "v", P).collect()


def test_funnel_invariants(spark):
    from lifetrail.sources.adapter import raw_transactions
    f = facts(clean(raw_transactions(spark, "/root/testdata/sf0.01"), P), P)
    s = lifecycle.funnel_sequential(f).first()
    assert s["acquisition"] >= s["activation"] >= s["retention"]
    t = lifecycle.activation_x_retention(f).toPandas()
    assert t["user_count"].sum() == s["acquisition"] and abs(t["ratio"].sum() - 100) < 0.05
    r = cohort.cohort_retention(__import__("lifetrail.operators.facts", fromlist=["x"]).user_years(
        clean(raw_transactions(spark, "/root/testdata/sf0.01"), P), P), P).toPandas()
    assert (r[r.years_since_first == 0].retention_rate == 100.0).all()


def test_cluster_settings_sizes_partitions():
    from lifetrail import cluster_settings
    s = cluster_settings(100 * 2**40, 8000)          # 100 TB on 8000 cores
    assert 16_000 <= int(s["spark.sql.shuffle.partitions"]) <= 20_000
    splits = 100 * 2**40 / (int(s["spark.sql.files.maxPartitionBytes"][:-1]) << 20)
    assert splits <= 110_000
    assert cluster_settings(1 << 20, 8)["spark.sql.shuffle.partitions"] == "16"
    assert s["spark.sql.adaptive.skewJoin.enabled"] == "true"
