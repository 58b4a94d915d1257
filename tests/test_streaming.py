"""Incremental ingest (A2): each run appends exactly the newly arrived files."""

from __future__ import annotations

from pyspark.sql import functions as F

from conftest import SF001
from lifetrail.sources.adapter import raw_transactions
from lifetrail.sources.files import TRANSACTION_RENAMES
from lifetrail.streaming import ingest_csv_stream


def drop_csv(df, path):
    back = {v: k for k, v in TRANSACTION_RENAMES.items()}
    df.select(*[F.col(c).alias(back[c]) for c in back]).coalesce(1) \
      .write.mode("overwrite").option("header", True).csv(path)


def test_incremental_ingest_exactly_once(spark, tmpdir_path):
    raw = raw_transactions(spark, SF001)
    src, out, ck = f"{tmpdir_path}/landing", f"{tmpdir_path}/table", f"{tmpdir_path}/ckpt"
    y = [r["tx_year"] for r in raw.select("tx_year").distinct().orderBy("tx_year").collect()]
    drop_csv(raw.filter(F.col("tx_year") == y[0]), f"{src}/part1")
    drop_csv(raw.filter(F.col("tx_year") == y[1]), f"{src}/part2")
    n1 = ingest_csv_stream(spark, f"{src}/*", out, ck, max_files_per_trigger=1)
    expect1 = raw.filter(F.col("tx_year").isin(y[0], y[1])).count()
    assert n1 == expect1 and spark.read.parquet(out).count() == expect1
    assert ingest_csv_stream(spark, f"{src}/*", out, ck) == 0           # nothing new
    drop_csv(raw.filter(F.col("tx_year") == y[2]), f"{src}/part3")
    n3 = ingest_csv_stream(spark, f"{src}/*", out, ck)
    assert n3 == raw.filter(F.col("tx_year") == y[2]).count()
    assert spark.read.parquet(out).count() == expect1 + n3


def test_row_count_over_more_batches_than_progress_keeps(spark, tmpdir_path):
    raw = raw_transactions(spark, SF001).limit(60).repartition(6)
    drop = f"{tmpdir_path}/landing"
    back = {v: k for k, v in TRANSACTION_RENAMES.items()}
    raw.select(*[F.col(c).alias(back[c]) for c in back]).write.option("header", True).csv(drop)
    old = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates", "100")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        n = ingest_csv_stream(spark, drop, f"{tmpdir_path}/out", f"{tmpdir_path}/ck", max_files_per_trigger=1)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", old)
    assert n == 60 == spark.read.parquet(f"{tmpdir_path}/out").count()
