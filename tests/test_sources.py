"""Sources and sinks: round trips in private scratch folders."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from lifetrail import Params
from lifetrail.sources.adapter import category_map, raw_transactions, raw_users
from lifetrail.sources.files import (TRANSACTION_RENAMES, audit_row_counts, entity_subset, export_csv,
                                     ingest_transactions, read_jdbc, read_transactions_csv, sample_rows,
                                     sanitise_columns, with_positional_key, write_jdbc, write_table)

P = Params()


def as_original_csv(spark, path, df):
    back = {v: k for k, v in TRANSACTION_RENAMES.items()}
    df.select(*[F.col(c).alias(back[c]) for c in back]).write.mode("overwrite").option("header", True).csv(path)


def test_csv_round_trip_with_original_headers(spark, tmpdir_path):
    raw = raw_transactions(spark, SF001)
    as_original_csv(spark, f"{tmpdir_path}/csv", raw)
    back = read_transactions_csv(spark, f"{tmpdir_path}/csv")
    assert back.columns == list(TRANSACTION_RENAMES.values())
    assert back.count() == raw.count()
    assert back.exceptAll(raw.select(*back.columns)).count() == 0


def test_write_modes(spark, tmpdir_path):
    df = spark.range(10)
    path = f"{tmpdir_path}/t"
    write_table(df, path, mode="replace")
    write_table(df, path, mode="append")
    assert spark.read.parquet(path).count() == 20
    write_table(df, path, mode="replace")
    assert spark.read.parquet(path).count() == 10
    with pytest.raises(Exception):
        write_table(df, path, mode="fail")


def test_jdbc_batched_sink_in_memory_derby(spark):
    url = "jdbc:derby:memory:lifetrail_test;create=true"
    props = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    df = raw_transactions(spark, SF001).select("user_id", "tx_year", "amount_raw").limit(500)
    write_jdbc(df, url, "TX", mode="replace", batchsize=100, properties=props)
    assert read_jdbc(spark, url, "TX", props).count() == 500


def test_positional_key_is_gap_free(spark):
    df = spark.createDataFrame([(f"p{i}",) for i in range(25)], "person string").repartition(4)
    order = [r["person"] for r in df.collect()]
    keyed = with_positional_key(df, "user_id")
    got = {r["person"]: r["user_id"] for r in keyed.collect()}
    assert sorted(got.values()) == list(range(25))
    assert [got[p] for p in order] == list(range(25))


def test_entity_subset_is_consistent(spark):
    raw, users = raw_transactions(spark, SF001), raw_users(spark, SF001)
    a = entity_subset(raw, users, 20, 42, P)
    b = entity_subset(raw.repartition(5), users.repartition(3), 20, 42, P)
    ua = {r["user_id"] for r in a.select("user_id").distinct().collect()}
    assert len(ua) <= 20 and ua == {r["user_id"] for r in b.select("user_id").distinct().collect()}
    assert a.filter((F.col("is_fraud") == "Yes") | (F.col("tx_year") >= P.last_year_excl)).count() == 0


def test_ingest_layout_and_audit(spark, tmpdir_path):
    raw = raw_transactions(spark, SF001)
    ingest_transactions(raw, f"{tmpdir_path}/tx")
    years = sorted(d for d in os.listdir(f"{tmpdir_path}/tx") if d.startswith("tx_year="))
    assert years and all(d.split("=")[1].isdigit() for d in years)
    t = spark.read.parquet(f"{tmpdir_path}/tx")
    assert dict(t.dtypes)["amount"].startswith("decimal") and dict(t.dtypes)["is_fraud"] == "boolean"
    counts = {r["table_name"]: r["row_count"] for r in audit_row_counts({"raw": raw, "ingested": t}).collect()}
    assert counts["raw"] == counts["ingested"]


def test_sanitise_sample_and_export(spark, tmpdir_path):
    df = spark.createDataFrame([(1, 2)], "`Is Fraud?` int, `Use Chip` int")
    assert sanitise_columns(df).columns == ["Is_Fraud_", "Use_Chip"]
    assert sample_rows(raw_transactions(spark, SF001), 5).count() == 5
    export_csv(category_map(spark), f"{tmpdir_path}/m", single_file=True)
    files = [f for f in os.listdir(f"{tmpdir_path}/m") if f.endswith(".csv")]
    assert len(files) == 1


MART_KEYS = {"aarrr_funnel": "funnel_stages", "yearly_trend": "yearly_trend", "cohort_behavior": "cohort_behavior_complete_years",
             "rfm_segments": "rfm_segments_qcut", "ab_test_result": "outcome_comparison"}


def test_marts_equal_their_queries_and_load(spark, tmpdir_path):
    from lifetrail.plans.contract import QUERIES
    from lifetrail.plans.marts import build_marts, load_marts, run_folder, run_marts, write_marts
    raw = raw_transactions(spark, SF001)
    marts = build_marts(raw, category_map(spark), run_folder(tmpdir_path), P)
    paths = write_marts(marts, f"{tmpdir_path}/marts", fmt="csv")
    assert len(paths) == 6 and all(os.path.isdir(p) for p in paths)
    for mart, key in MART_KEYS.items():
        a, b = marts[mart], QUERIES[key](spark, SF001)
        assert sorted(map(repr, (tuple(r) for r in a.select(*sorted(a.columns)).collect()))) == \
            sorted(map(repr, (tuple(r) for r in b.select(*sorted(b.columns)).collect()))), mart
    top = {r.mcc: r.tx_count for r in marts["mcc_category"].collect()}
    assert top == {r.mcc: r.tx_count for r in QUERIES["category_top20_purchases"](spark, SF001).collect()}
    names = load_marts(marts, prefix="t_")
    assert load_marts(marts, prefix="t_") == names            # replaced, not appended
    for name, mart in zip(names, marts):
        assert spark.table(name).count() == marts[mart].count()
        spark.sql(f"DROP TABLE {name}")
    os.makedirs(f"{tmpdir_path}/shared")
    run_marts(raw, category_map(spark), f"{tmpdir_path}/again", f"{tmpdir_path}/shared", P)
    assert os.listdir(f"{tmpdir_path}/shared") == []           # intermediates are gone
    with pytest.raises(ValueError):
        run_folder("")


def test_per_user_mart_is_written_by_all_tasks(spark, tmpdir_path):
    from lifetrail.plans.marts import write_marts
    many = spark.range(1000, numPartitions=6).withColumnRenamed("id", "user_id")
    write_marts({"rfm_segments": many, "yearly_trend": many}, tmpdir_path)
    files = {m: len([f for f in os.listdir(f"{tmpdir_path}/{m}") if f.endswith(".parquet")]) for m in ("rfm_segments", "yearly_trend")}
    assert files == {"rfm_segments": 6, "yearly_trend": 1}


def test_card_category_map_last_wins(spark):
    from lifetrail.sources.mcc import MCC_EXPORT, card_category_map
    m = {r["code"]: (r["detail"], r["large_group"]) for r in card_category_map(spark).collect()}
    assert m["5813"] == ("주류", "주류")                 # repeated code: the later entry wins
    assert m["5261"][1] is None and len(MCC_EXPORT) == 20
    assert len(m) == len({str(c) for c, _ in __import__("lifetrail.sources.mcc", fromlist=["x"]).MCC_DETAIL}
                         | {str(c) for c, _ in __import__("lifetrail.sources.mcc", fromlist=["x"]).MCC_GROUP})


def test_views_and_sql(spark):
    from lifetrail.operators.prepare import drop_views, register_views
    register_views(spark, raw_transactions(spark, SF001), P, prefix="t_")
    n = spark.sql("SELECT COUNT(*) AS n FROM t_ltv_transactions").first()["n"]
    assert n == spark.table("t_clean_transactions").filter("amount > 0 AND errors IS NULL AND amount <= 100000").count()
    drop_views(spark, prefix="t_")
    assert not spark.catalog.tableExists("t_clean_transactions")


def test_bulk_load_and_catalog_table(spark, tmpdir_path):
    from lifetrail.sources.files import bulk_load_csv, save_table
    raw = raw_transactions(spark, SF001)
    as_original_csv(spark, f"{tmpdir_path}/csv", raw)
    bulk_load_csv(spark, f"{tmpdir_path}/csv", f"{tmpdir_path}/typed")
    assert spark.read.parquet(f"{tmpdir_path}/typed").count() == raw.count()
    bulk_load_csv(spark, f"{tmpdir_path}/csv", f"{tmpdir_path}/sanitised", sanitise=True)
    assert "Is_Fraud_" in spark.read.parquet(f"{tmpdir_path}/sanitised").columns
    save_table(spark.range(3), "lifetrail_test_tbl", path=f"{tmpdir_path}/tbl")
    save_table(spark.range(3), "lifetrail_test_tbl", mode="append", path=f"{tmpdir_path}/tbl")
    assert spark.table("lifetrail_test_tbl").count() == 6
    spark.sql("DROP TABLE lifetrail_test_tbl")


def test_positional_key_follows_files_of_unequal_size(spark, tmpdir_path):
    os.makedirs(f"{tmpdir_path}/users")
    for name, lo, hi in (("part-0.csv", 0, 3), ("part-1.csv", 3, 303), ("part-2.csv", 303, 310)):
        with open(f"{tmpdir_path}/users/{name}", "w") as f:
            f.write("Person\n" + "".join(f"p{i}\n" for i in range(lo, hi)))
    df = spark.read.option("header", True).csv(f"{tmpdir_path}/users")
    assert {r.Person: r.user_id for r in with_positional_key(df).collect()} == {f"p{i}": i for i in range(310)}


def test_declared_users_and_cards(spark, tmpdir_path):
    from lifetrail.sources.files import CARD_HEADER, USER_HEADER, read_cards_csv, read_users_csv
    for name, header in (("users", USER_HEADER), ("cards", CARD_HEADER)):
        with open(f"{tmpdir_path}/{name}.csv", "w") as f:
            f.write(",".join(f'"{h}"' for h, _, _ in header) + "\n")
            for k in range(3):
                f.write(",".join(str(k) for _ in header) + "\n")
    users = read_users_csv(spark, f"{tmpdir_path}/users.csv").orderBy("user_id").collect()
    assert [(u.user_id, u.person, u.age, u.latitude) for u in users] == [(k, str(k), k, float(k)) for k in range(3)]
    cards = read_cards_csv(spark, f"{tmpdir_path}/cards.csv")
    assert dict(cards.dtypes)["user_id"] == "bigint" and cards.count() == 3


def test_ingest_files_follow_size_not_tasks(spark, tmpdir_path):
    raw = raw_transactions(spark, SF001).repartition(32)
    ingest_transactions(raw, f"{tmpdir_path}/tx")
    files = [f for d, _, names in os.walk(f"{tmpdir_path}/tx") for f in names if f.endswith(".parquet")]
    years = len([d for d in os.listdir(f"{tmpdir_path}/tx") if d.startswith("tx_year=")])
    assert len(files) <= 2 * years


def test_jdbc_read_in_parts(spark):
    url, props = "jdbc:derby:memory:lifetrail_parts;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    write_jdbc(spark.range(100), url, "PARTS", properties=props)
    df = read_jdbc(spark, url, "PARTS", props, partition_column="id", bounds=(0, 100), partitions=4)
    assert df.count() == 100 and df.rdd.getNumPartitions() == 4


def test_labelled_purchases_of_a_hot_user(spark):
    from lifetrail.operators.mix import labelled_purchases
    rows = [(0 if i % 3 == 0 else i, float(i % 5 - 1)) for i in range(3000)]
    tx = spark.createDataFrame(rows, "user_id long, amount double")
    segments = spark.createDataFrame([(u, "VIP" if u == 0 else "Loyal") for u in sorted({u for u, _ in rows})], "user_id long, segment string")
    got = {r.segment: r["count"] for r in labelled_purchases(tx, segments).groupBy("segment").count().collect()}
    assert got == {"VIP": sum(u == 0 and a > 0 for u, a in rows), "Loyal": sum(u != 0 and a > 0 for u, a in rows)}
