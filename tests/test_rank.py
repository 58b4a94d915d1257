"""Distributed exact rank: equal to a single-process rank, independent of
partitioning, robust to a hot value holding a third of the rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lifetrail.functions import ntile_from_rank, qcut_from_rank
from lifetrail.operators.rank import exact_quantiles, exact_rank, multi_rank, rank_keys


def data(spark, n=3000, parts=None):
    rng = np.random.default_rng(7)
    v = rng.integers(0, 50, n)
    v[: n // 3] = 17                      # one value holds a third of all rows
    pdf = pd.DataFrame({"user_id": rng.permutation(n).astype("int64"), "v": v.astype("int64"),
                        "w": rng.integers(0, 5, n).astype("int64")})
    df = spark.createDataFrame(pdf)
    return (df.repartition(parts) if parts else df), pdf


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_rank_matches_single_process(spark, parts):
    df, pdf = data(spark)
    got = exact_rank(df, "v", "user_id", partitions=parts).toPandas().set_index("user_id")
    exp = pdf.sort_values(["v", "user_id"]).reset_index(drop=True)
    exp["rank"] = np.arange(1, len(exp) + 1)
    exp = exp.set_index("user_id")
    assert (got.loc[exp.index, "rank"].values == exp["rank"].values).all()
    assert set(got["n"]) == {len(pdf)}


def test_multi_rank_equals_separate(spark):
    df, pdf = data(spark, 1000, 5)
    m = multi_rank(df, ["v", "w"], ["user_id"], partitions=9).toPandas().set_index("user_id").sort_index()
    for col in ("v", "w"):
        e = pdf.sort_values([col, "user_id"]).reset_index(drop=True)
        e["r"] = np.arange(1, len(e) + 1)
        e = e.set_index("user_id").sort_index()
        assert (m[f"rank_{col}"].values == e["r"].values).all()


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 13, 1337])
def test_bins_match_sql_ntile_and_pandas_qcut(spark, n):
    import duckdb
    pdf = pd.DataFrame({"user_id": np.arange(n, dtype="int64"), "v": (np.arange(n) % 3).astype("int64")})
    df = spark.createDataFrame(pdf)
    r = exact_rank(df, "v", "user_id").select("user_id", ntile_from_rank("rank", "n", 5).alias("nt"),
                                              qcut_from_rank("rank", "n", 5).alias("qc")).toPandas()
    r = r.set_index("user_id").sort_index()
    nt = duckdb.sql("SELECT user_id, NTILE(5) OVER (ORDER BY v, user_id) AS nt FROM pdf").df().set_index("user_id").sort_index()
    assert (r["nt"].values == nt["nt"].values).all()
    if n > 1:
        ranks = pdf.sort_values(["v", "user_id"]).assign(rk=np.arange(1, n + 1)).set_index("user_id").sort_index()["rk"]
        qc = pd.qcut(ranks, 5, labels=False) + 1
        assert (r["qc"].values == qc.values).all()
    sizes = r["nt"].value_counts()
    assert sizes.max() - sizes.min() <= 1


def test_exact_quantiles_match_numpy(spark):
    df, pdf = data(spark, 2001, 6)
    q = exact_quantiles(df, "v", {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.9}).first()
    for k, p in {"a": 0.25, "b": 0.5, "c": 0.75, "d": 0.9}.items():
        assert abs(q[k] - np.quantile(pdf["v"], p)) < 1e-9


def test_rank_needs_no_exchange_reuse(spark):
    """600,000 rows in 16 buckets: ranks are 1..n with and without reused exchanges."""
    n = 600_000
    df = spark.range(n).select(F.col("id").alias("user_id"), F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.xxhash64("id") % 1000).cast("long").alias("v"))
    old = spark.conf.get("spark.sql.exchange.reuse")
    try:
        for reuse in ("true", "false"):
            spark.conf.set("spark.sql.exchange.reuse", reuse)
            r = rank_keys(df, ["v"], ["user_id"], partitions=16)
            w = r.agg(F.count_distinct("rank").alias("d"), F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.max("n").alias("n")).first()
            assert (w.d, w.lo, w.hi, w.n) == (n, 1, n, n)
            below = df.where("v < 7").count()
            assert r.where("v = 7").agg(F.min("rank")).first()[0] == below + 1
    finally:
        spark.conf.set("spark.sql.exchange.reuse", old)


def test_rank_of_nulls_few_rows_and_none(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 1)], "user_id long, v long")
    got = {r.user_id: r["rank"] for r in rank_keys(df, ["v"], ["user_id"], partitions=8).collect()}
    assert got == {1: 1, 3: 2, 4: 3, 2: 4}
    assert rank_keys(df.limit(0), ["v"], ["user_id"], partitions=8).count() == 0


def test_stacked_summary_matches_pandas(spark):
    from lifetrail.operators.rank import stacked_summary
    df, pdf = data(spark, 1500, 6)
    st = {r["metric"]: r for r in stacked_summary(df, ["v", "w"], {"q1": 0.25, "med": 0.5}, partitions=5).collect()}
    for m in ("v", "w"):
        x = pdf[m]
        assert st[m]["count"] == len(x) and int(st[m]["sum"]) == int(x.sum())
        assert int(st[m]["sum_sq"]) == int((x.astype(object) ** 2).sum())
        assert st[m]["min"] == x.min() and st[m]["max"] == x.max()
        assert abs(st[m]["q1"] - np.quantile(x, 0.25)) < 1e-9 and abs(st[m]["med"] - np.quantile(x, 0.5)) < 1e-9
