"""Distributed selection and equal-count bins against sorting."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lifetrail.functions import ntile_from_rank, qcut_from_rank
from lifetrail.operators.rank import exact_rank
from lifetrail.operators.select import bin_cuts, bin_of, keys_at, ntile_ends, qcut_ends, quantiles


def frame(spark, n, spread, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.integers(0, spread, n)
    v[: n // 3] = spread // 2  # a value that a third of all rows share
    return spark.createDataFrame(pd.DataFrame({"user_id": rng.permutation(n).astype("int64"), "v": v.astype("int64"), "s": [f"{x:08x}" for x in rng.integers(0, 1 << 31, n)]})).repartition(7)


@pytest.mark.parametrize("n,spread,most", [(5000, 3, 50), (5000, 10**9, 50), (5000, 10**9, 4096), (1, 5, 10), (7, 2, 1)])
def test_keys_at_equal_sorting(spark, n, spread, most):
    df = frame(spark, n, spread).cache()
    rows = sorted((r.v, r.user_id) for r in df.collect())
    texts = sorted((r.s, r.user_id) for r in df.collect())
    ranks = sorted({1, 2, n // 5, n // 3, n // 2, n - 1, n} & set(range(1, n + 1)))
    found = keys_at(df, [(("v", "user_id"), r, n) for r in ranks] + [(("s", "user_id"), r, n) for r in ranks] + [(("v",), n + 1, n), (("v",), 0, n)], most=most, accuracy=200)
    assert found == [rows[r - 1] for r in ranks] + [texts[r - 1] for r in ranks] + [None, None]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 7, 8, 9, 103])
def test_bin_ends_equal_the_rank_formulas(spark, n):
    ranks = spark.range(1, n + 1).select("id", ntile_from_rank("id", F.lit(n), 5).alias("nt"), qcut_from_rank("id", F.lit(n), 5).alias("qc")).collect()
    for r in ranks:
        assert r.nt == 1 + sum(r.id > e for e in ntile_ends(n, 5))
        assert r.qc == 1 + sum(r.id > e for e in qcut_ends(n, 5))


@pytest.mark.parametrize("method,formula", [("ntile", ntile_from_rank), ("qcut", qcut_from_rank)])
def test_bins_equal_those_from_ranks(spark, method, formula):
    df = frame(spark, 3001, 40).cache()
    cuts, = bin_cuts(df, [("v", "user_id")], 5, method)
    got = {r.user_id: r.b for r in df.select("user_id", bin_of(("v", "user_id"), cuts).alias("b")).collect()}
    want = {r.user_id: r.b for r in exact_rank(df, "v").select("user_id", formula("rank", "n", 5).alias("b")).collect()}
    assert got == want
    empty, = bin_cuts(df.limit(0), [("v", "user_id")], 5, method)
    assert empty == []


def test_quantiles_with_nulls_and_ties(spark):
    df = frame(spark, 4000, 7).withColumn("w", F.when(F.col("user_id") % 3 == 0, F.col("user_id") * 17 % 1009)).cache()
    pdf = df.toPandas()
    sizes = {"v": 4000, "w": int(pdf.w.notna().sum())}
    got = quantiles(df, ["v", "w"], [0.0, 0.25, 0.5, 0.9, 1.0], sizes)
    for m in ("v", "w"):
        assert np.allclose(got[m], np.nanpercentile(pdf[m].astype(float), [0, 25, 50, 90, 100]))
    assert quantiles(df.limit(0), ["v"], [0.5], {"v": 0}) == {"v": [None]}


def test_few_rows_are_sorted(spark):
    """Of 200,000 different values, those counted by value for a median are under 5 %."""
    from rows_read import shuffled_records
    df = spark.range(200_000).select(F.col("id").alias("user_id"), (F.xxhash64("id") % 10**12).alias("v")).cache()
    df.count()
    records = shuffled_records(spark, lambda: keys_at(df, [(("v",), 100_000, 200_000)]))
    assert records < 10_000, records
