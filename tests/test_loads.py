"""Checked bulk loads, loads of a stream, atomic marts and the bucketed layout."""

from __future__ import annotations

import os

import pytest
from conftest import SF001
from fixtures import raw_frame, tx
from pyspark.sql import functions as F

from lifetrail import Params
from lifetrail.operators.facts import user_totals
from lifetrail.operators.prepare import clean
from lifetrail.plans import marts
from lifetrail.sources import batches
from lifetrail.sources.adapter import raw_transactions
from lifetrail.sources.files import TRANSACTION_HEADER
from lifetrail.sources.layout import bucket_sizes, bucket_transactions, buckets_for
from lifetrail.sources.load import detect_types, load_csv, load_table, load_transactions
from lifetrail.streaming.ingest import ingest_csv_loads

P = Params()


def write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as f:
        f.write(text)
    return f"{folder}/{name}"


# ---------------------------------------------------------------- checked loads
def test_types_are_detected_and_every_row_checked(spark, tmpdir_path):
    rows = ['id,When,Price ($),Rate,Ok?,Note,Nothing'] + [f'{i},2001-02-{i % 28 + 1:02d},"${i}.50",{i}.25,{"Yes" if i % 2 else "No"},"a, b",' for i in range(1, 40)]
    rows += ["x1,2001-01-01,$1.00,1,Yes,number,", "50,2001-02-30,$1.00,1,No,date,", "51,2001-01-01,1.0.0,2,No,money,", "52,2001-01-01,$1.00,3,maybe,flag,",
             "53,2001-01-01,$1.00", "54,2001-01-01,$1.00,3,No,many,,,", ",2001-01-01,$-3.10,,yes,empty,"]
    path = write(tmpdir_path, "a.csv", "\n".join(rows) + "\n")
    types = detect_types(spark, path, sample_rows=30)
    assert types == {"id": "long", "When": "date", "Price ($)": "money", "Rate": "double", "Ok?": "flag", "Note": "string", "Nothing": "string"}
    got = load_csv(spark, path, types)
    assert got.counts == {"read": 46, "kept": 40, "rejected": 6}
    assert got.rows.columns == ["id", "When", "Price____", "Rate", "Ok_", "Note", "Nothing"]
    kept = {r.id: r for r in got.rows.collect()}
    assert str(kept[3]["Price____"]) == "3.50" and kept[3].Rate == 3.25 and kept[3].Ok_ is True and kept[3].Note == "a, b" and str(kept[None]["Price____"]) == "-3.10"
    reasons = sorted(tuple(r.reasons) for r in got.rejects.collect())
    assert reasons == [("Ok_: maybe",), ("Price____: 1.0.0",), ("When: 2001-02-30",), ("columns",), ("columns",), ("id: x1",)]
    lines = {r.line for r in got.rejects.collect()}
    assert "53,2001-01-01,$1.00" in lines and any('"id":"x1"' in x for x in lines)
    assert load_csv(spark, path, types, required=("id",), checks={"cheap": "Rate < 20"}).counts == {"read": 46, "kept": 19, "rejected": 27}


def test_a_load_with_too_many_rejects_writes_nothing(spark, tmpdir_path):
    path = write(tmpdir_path, "b.csv", "a,b\n1,2\nx,3\n4,5\n")
    types = {"a": "long", "b": "long"}
    with pytest.raises(ValueError):
        load_table(spark, path, f"{tmpdir_path}/out", f"{tmpdir_path}/rejects", types=types)
    assert not os.path.exists(f"{tmpdir_path}/out")
    assert load_table(spark, path, f"{tmpdir_path}/out", f"{tmpdir_path}/rejects", most_rejected=0.5, types=types) == {"read": 3, "kept": 2, "rejected": 1}
    assert spark.read.parquet(f"{tmpdir_path}/out").count() == 2 and spark.read.parquet(f"{tmpdir_path}/rejects").first().reasons == ["a: x"]
    empty = write(tmpdir_path, "c.csv", "a,b\n")
    assert load_csv(spark, empty).counts == {"read": 0, "kept": 0, "rejected": 0}


def test_transactions_five_kinds_of_broken_rows(spark, tmpdir_path):
    header = ",".join(h for h, _, _ in TRANSACTION_HEADER)
    line = "1,0,1999,{m},{d},10:00,{amount},Chip,M,City,ST,1,{mcc},,{fraud}"
    good = [line.format(m=i % 12 + 1, d=i % 28 + 1, amount=f"$-{i}.25" if i % 5 == 0 else f"${i}.25", mcc=i, fraud="No" if i % 3 else "Yes") for i in range(20)]
    bad = [line.format(m=2, d=30, amount="$1.00", mcc=1, fraud="No"), line.format(m=1, d=1, amount="one", mcc=1, fraud="No"), line.format(m=1, d=1, amount="$1.00", mcc=1, fraud="Perhaps"),
           "1,0,1999,1,1", line.format(m="Jan", d=1, amount="$1.00", mcc=1, fraud="No"), line.format(m=1, d=1, amount="", mcc=1, fraud="No")]
    got = load_transactions(spark, write(tmpdir_path, "tx.csv", "\n".join([header, *good, *bad]) + "\n"))
    assert got.counts == {"read": 26, "kept": 20, "rejected": 6}
    assert sorted(r.reasons[0].split(":")[0] for r in got.rejects.collect()) == ["amount", "amount is missing", "columns", "is_fraud", "no such day", "tx_month"]
    assert got.rows.schema["amount"].dataType.simpleString() == "decimal(12,2)" and got.rows.schema["is_fraud"].dataType.simpleString() == "boolean"
    assert clean(got.rows, P).count() == 13 and clean(got.rows, P).filter("amount is null").count() == 0


def test_rows_are_parsed_and_checked_once(spark, tmpdir_path):
    """Counts, rows and rejects come from one staged check: after the load no row is parsed or typed again."""
    path = write(tmpdir_path, "once.csv", "a,b,c\n1,2,x\nx,3,\n4,,y\ny,z,w\n5\n")
    got = load_csv(spark, path, {"a": "long", "b": "long", "c": "string"}, required=("c",), checks={"small": "a < 3"})
    assert got.counts == {"read": 5, "kept": 1, "rejected": 4}
    plan = got.rows._jdf.queryExecution().optimizedPlan().toString()
    assert "try_cast" not in plan and "trim" not in plan and "lambda" not in plan
    assert "csv" not in got.rejects._jdf.queryExecution().executedPlan().toString().lower()
    assert [tuple(r) for r in got.rows.collect()] == [(1, 2, "x")]
    assert sorted((r.reasons, r.line) for r in got.rejects.collect()) == [
        (["a: x", "c is missing"], '{"a":"x","b":"3"}'), (["a: y", "b: z"], '{"a":"y","b":"z","c":"w"}'), (["columns"], "5"), (["small"], '{"a":"4","c":"y"}')]
    assert {r.file.rsplit("/", 1)[-1] for r in got.rejects.collect()} == {"once.csv"}


# ---------------------------------------------------------------- loads of a stream
def csv_batch(folder, i, rows):
    header = ",".join(h for h, _, _ in TRANSACTION_HEADER)
    write(folder, f"part-{i:03d}.csv", "\n".join([header, *rows]) + "\n")


def test_stream_loads_files_by_bytes_and_twice_adds_nothing(spark, tmpdir_path):
    src, root, ckpt = f"{tmpdir_path}/src", f"{tmpdir_path}/root", f"{tmpdir_path}/ckpt"
    for i in range(12):
        csv_batch(src, i, [f"{u},0,{1995 + u % 6},{i + 1},1,10:00,${u}.50,Chip,M,C,S,1,5,,No" for u in range(30)])
    assert ingest_csv_loads(spark, src, root, ckpt, max_files=1) == 360
    live = batches.counting(batches.log(spark, root))
    assert len(live) == 1 and live[0][1].endswith("merged")
    files = [f for _, _, names in os.walk(f"{root}/data/load={live[0][1]}") for f in names if f.endswith(".parquet")]
    assert len(files) <= 6 * 2  # by year and bytes, not 12 batches x 6 years
    table = batches.read_loads(spark, root)
    assert table.count() == 360 and table.groupBy("tx_year").count().count() == 6
    assert ingest_csv_loads(spark, src, root, ckpt, max_files=1) == 0
    # the checkpoint is lost: the same batches run again and add nothing
    assert ingest_csv_loads(spark, src, root, f"{tmpdir_path}/ckpt2", max_files=1) == 0
    assert batches.read_loads(spark, root).count() == 360
    assert len(batches.vacuum(spark, root, ("data",))) == 12 and batches.read_loads(spark, root).count() == 360


def test_arriving_files_grow_with_the_input_files(spark, tmpdir_path, monkeypatch):
    from lifetrail.plans import contract
    from lifetrail.sources.files import input_bytes
    want = sorted(contract.q_stream_loads(spark, SF001).collect())
    monkeypatch.setattr(contract, "_scratch", lambda _, name: f"{tmpdir_path}/{name}")
    monkeypatch.setattr(contract, "ARRIVAL_BYTES", input_bytes(raw_transactions(spark, SF001)) // 9)
    assert sorted(contract.q_stream_loads(spark, SF001).collect()) == want and want
    assert len([f for f in os.listdir(f"{tmpdir_path}/arrivals") if f.endswith(".csv")]) == 10
    assert [r["batch"] for r in batches.log(spark, f"{tmpdir_path}/loads")] == [*(f"stream-{i}" for i in range(4)), "merged"]


def test_a_load_that_stops_does_not_count(spark, tmpdir_path, monkeypatch):
    root = f"{tmpdir_path}/root"
    df = raw_frame(spark, [tx(1, 1999, 1, 1), tx(2, 2000, 1, 1)])
    with monkeypatch.context() as m:
        m.setattr(batches, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            batches.add_load(df, root, "a", ("tx_year",))
    assert batches.read_loads(spark, root) is None
    assert batches.add_load(df, root, "a", ("tx_year",)) == 2 and batches.add_load(df, root, "a", ("tx_year",)) == 0
    assert batches.read_loads(spark, root).count() == 2


# ---------------------------------------------------------------- marts: all or none
def small_marts(spark, v):
    return {"yearly_trend": spark.createDataFrame([(v,)], "a long"), "rfm_segments": spark.range(v)}


def test_a_failing_mart_leaves_the_old_files(spark, tmpdir_path, monkeypatch):
    out = f"{tmpdir_path}/marts"
    marts.write_marts(small_marts(spark, 3), out)
    bad = small_marts(spark, 5) | {"rfm_segments": spark.range(0)}
    with pytest.raises(ValueError):
        marts.write_marts(bad, out)
    broken = small_marts(spark, 5) | {"rfm_segments": spark.range(5).select(F.raise_error(F.lit("lost")).alias("x"))}
    with pytest.raises(Exception):
        marts.write_marts(broken, out)
    assert spark.read.parquet(f"{out}/yearly_trend").first().a == 3 and spark.read.parquet(f"{out}/rfm_segments").count() == 3
    assert sorted(os.listdir(out)) == ["rfm_segments", "yearly_trend"]
    marts.write_marts(small_marts(spark, 4), out)
    marts.write_marts(small_marts(spark, 4) | {"rfm_segments": spark.range(0)}, out, may_be_empty=("rfm_segments",))
    assert spark.read.parquet(f"{out}/yearly_trend").first().a == 4 and spark.read.parquet(f"{out}/rfm_segments").count() == 0


def test_a_failing_rename_puts_the_old_files_back(spark, tmpdir_path):
    out = f"{tmpdir_path}/marts"
    marts.write_marts(small_marts(spark, 3), out)
    new = f"{out}/.new"
    spark.range(9).write.parquet(f"{new}/yearly_trend")  # the other mart's folder is missing
    with pytest.raises(Exception):
        marts._switch(spark, ["yearly_trend", "rfm_segments"], new, out, f"{out}/.old")
    assert spark.read.parquet(f"{out}/yearly_trend").first().a == 3 and spark.read.parquet(f"{out}/rfm_segments").count() == 3


def test_a_failing_mart_leaves_the_old_tables(spark):
    names = marts.load_marts(small_marts(spark, 3), prefix="atomic_")
    with pytest.raises(ValueError):
        marts.load_marts(small_marts(spark, 5) | {"rfm_segments": spark.range(0)}, prefix="atomic_")
    assert spark.table("default.atomic_yearly_trend").first().a == 3 and spark.table("default.atomic_rfm_segments").count() == 3
    marts.load_marts(small_marts(spark, 6), prefix="atomic_")
    assert spark.table("default.atomic_rfm_segments").count() == 6
    assert not [t.name for t in spark.catalog.listTables("default") if t.name.startswith("atomic_") and "__" in t.name]
    for t in names:
        spark.sql(f"DROP TABLE {t}")


# ---------------------------------------------------------------- layout
def test_bucketed_fact_needs_no_exchange_by_user(spark, tmpdir_path):
    raw = raw_transactions(spark, SF001)
    bucket_transactions(raw, "bucketed_tx", 4, path=f"{tmpdir_path}/bucketed")
    try:
        totals = user_totals(clean(spark.table("bucketed_tx"), P), P)
        totals.collect()
        plan = totals._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        key = lambda r: r.user_id
        assert sorted(totals.collect(), key=key) == sorted(user_totals(clean(raw, P), P).collect(), key=key)
        sizes = bucket_sizes(spark, "bucketed_tx").collect()
        assert len(sizes) == 4 and sum(r.rows for r in sizes) == raw.count()
    finally:
        spark.sql("DROP TABLE bucketed_tx")
    assert [buckets_for(n) for n in (0, 1, 512 << 20, (512 << 20) + 1, 10 << 30)] == [1, 1, 1, 2, 32]


def test_buckets_grow_with_the_input_files(spark, tmpdir_path, monkeypatch):
    from lifetrail.plans import contract
    from lifetrail.sources import layout
    from lifetrail.sources.files import input_bytes
    raw = raw_transactions(spark, SF001)
    size = sum(os.path.getsize(f"{SF001}/{t}.parquet") for t in ("lineitem", "orders", "part"))
    assert input_bytes(raw) == size and layout.buckets_of(raw) == 8
    assert input_bytes(raw_frame(spark, [tx(1, 1999, 1, 1)])) == 0
    monkeypatch.setattr(contract, "_scratch", lambda _, name: f"{tmpdir_path}/{name}")
    monkeypatch.setattr(layout, "BUCKET_BYTES", size // 20)
    got = contract.q_rfm_raw_from_buckets(spark, SF001)
    assert len([f for f in os.listdir(f"{tmpdir_path}/bucketed") if f.endswith(".parquet")]) == 32
    rows = sorted(got.collect())
    assert rows == sorted(contract.q_rfm_raw(spark, SF001).collect()) and rows
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- normal quantile
def test_normal_quantile_density_and_cdf_agree_with_the_library(spark):
    from statistics import NormalDist

    from lifetrail.functions import normal_cdf, normal_pdf, normal_quantile
    n = NormalDist()
    ps = [1e-12, 1e-6, 0.001, 0.02425, 0.1, 0.3, 0.5, 0.7, 0.975, 0.999999]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -1.0, None]], "p double")
    rows = {r.p: r for r in df.select("p", normal_quantile("p").alias("q")).select("*", normal_pdf("q").alias("d"), normal_cdf("q").alias("c")).collect()}
    for p in ps:
        assert abs(rows[p].q - n.inv_cdf(p)) < 1e-8 * max(1, abs(n.inv_cdf(p))) and abs(rows[p].d - n.pdf(rows[p].q)) < 1e-12 and abs(rows[p].c / p - 1) < 1e-8
    assert all(rows[p].q is None for p in (0.0, 1.0, -1.0, None))
