"""Marts kept up to date by batches against a full build from the whole fact."""

from __future__ import annotations

import random

import pytest
from conftest import SF001
from fixtures import raw_frame, tx
from pyspark.sql import functions as F
from rows_read import fact_records

from lifetrail import Params
from lifetrail.operators.facts import facts, user_days, user_years_from_days
from lifetrail.operators.prepare import clean
from lifetrail.operators.state import DAYS, merge_state, user_year_state, user_years_from_state
from lifetrail.plans import refresh
from lifetrail.plans.contract import marts_long
from lifetrail.plans.marts import build_marts
from lifetrail.sources.adapter import category_map, raw_transactions

P = Params()


def random_rows(seed, users, n):
    rng = random.Random(seed)
    rows = [tx(rng.choice(users), rng.randint(1995, 2001), rng.randint(1, 12), rng.randint(1, 31), f"${rng.randint(-50, 900)}.{rng.randint(0, 99):02d}",
               f"Brand#{rng.randint(1, 25)}", rng.choice([None, None, "Bad PIN"]), rng.choice(["No", "No", "No", "Yes"])) for _ in range(n)]
    return rows + [tx(1, 1997, 5, 5)] * (n // 3)  # a hot user and day


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def same_marts(spark, root, raw, tmp):
    got = rows_of(marts_long(refresh.marts(spark, root, category_map(spark), P)))
    want = rows_of(marts_long(build_marts(raw, category_map(spark), tmp, P)))
    assert got == want and got
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_states_merge_to_the_per_year_table(spark, seed):
    raw = raw_frame(spark, random_rows(seed, range(1, 30), 900), 4)
    c = clean(raw, P)
    parts = [c.filter(F.pmod(F.xxhash64("tx_day", "user_id", "amount"), F.lit(3)) == i) for i in range(3)]
    state = merge_state(user_year_state(parts[0], P).unionByName(user_year_state(parts[1], P)).unionByName(user_year_state(parts[2], P)))
    want = user_years_from_days(user_days(c, P))
    assert rows_of(user_years_from_state(state).select(*want.columns)) == rows_of(want)
    again = merge_state(state.unionByName(state.select("user_id", "tx_year", *DAYS, *(F.lit(0).cast("long").alias(s) for s in ("n_tx", "n_pos", "pos_cents", "ltv_n", "ltv_cents")))))
    assert rows_of(again.select(*state.columns)) == rows_of(state)  # days that repeat count once


def test_batches_equal_a_full_build(spark, tmpdir_path):
    """Late rows move users to earlier cohorts; users come and return; one batch comes twice; one has no clean row."""
    root = f"{tmpdir_path}/root"
    batches = [random_rows(3, range(1, 40), 500), random_rows(4, range(20, 60), 300), [tx(45, 1995, 1, 1), tx(2, 1995, 1, 2), tx(70, 2000, 12, 31)], [tx(5, 2005, 1, 1)]]
    every = []
    for i, rows in enumerate(batches):
        raw = raw_frame(spark, rows, 3)
        added = refresh.add_batch(raw, root, f"b{i}", P)
        every += rows
        assert added == clean(raw, P).count() and refresh.add_batch(raw, root, f"b{i}", P) == 0
    before = same_marts(spark, root, raw_frame(spark, every, 3), f"{tmpdir_path}/full")
    refresh.compact(spark, root, P)
    assert len(refresh.counting(refresh.log(spark, root))) == 1
    assert len(refresh.vacuum(spark, root)) == 16 and refresh.vacuum(spark, root) == []
    assert rows_of(marts_long(refresh.marts(spark, root, category_map(spark), P))) == before
    assert refresh.add_batch(raw_frame(spark, batches[0]), root, "b0", P) == 0  # its name outlives the compaction
    extra = [tx(3, 1995, 1, 1), tx(91, 1998, 4, 4), *random_rows(9, range(1, 90), 60)]
    refresh.add_batch(raw_frame(spark, extra), root, "late", P)
    same_marts(spark, root, raw_frame(spark, every + extra, 3), f"{tmpdir_path}/full-late")


def test_a_run_that_stops_changes_nothing(spark, tmpdir_path, monkeypatch):
    root, first, second = f"{tmpdir_path}/root", random_rows(5, range(1, 20), 200), random_rows(6, range(1, 25), 200)
    refresh.add_batch(raw_frame(spark, first), root, "a", P)
    before = rows_of(marts_long(refresh.marts(spark, root, category_map(spark), P)))

    def stop(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(refresh, "commit", stop)
        with pytest.raises(RuntimeError):
            refresh.add_batch(raw_frame(spark, second), root, "b", P)
    assert rows_of(marts_long(refresh.marts(spark, root, category_map(spark), P))) == before
    refresh.add_batch(raw_frame(spark, second), root, "b", P)
    same_marts(spark, root, raw_frame(spark, first + second), f"{tmpdir_path}/full")
    with pytest.raises(ValueError):
        refresh.add_batch(raw_frame(spark, second), root, "c", P.with_(outlier_cap=5))
    with pytest.raises(ValueError):
        refresh.marts(spark, f"{tmpdir_path}/nothing", category_map(spark), P)


def test_a_refresh_does_not_read_the_old_fact(spark, tmpdir_path):
    raw, root = raw_transactions(spark, SF001), f"{tmpdir_path}/root"
    refresh.add_batch(raw, root, "all", P)
    small = raw_frame(spark, [tx(7, 1999, 3, 3)])

    def again():
        refresh.add_batch(small, root, "one", P)
        marts_long(refresh.marts(spark, root, category_map(spark), P)).collect()
    assert fact_records(spark, again) == 0
    touched = spark.read.parquet(f"{root}/facts/{refresh.counting(refresh.log(spark, root))[-1][1]}")
    assert [r.user_id for r in touched.collect()] == [7]
    whole = facts(clean(raw.unionByName(small), P), P)
    assert rows_of(refresh.current_facts(spark, root, refresh.counting(refresh.log(spark, root))).select(*whole.columns)) == rows_of(whole)


def test_the_registered_refresh_reads_the_fact_once(spark):
    """Three batches of one fact: its tables are read and joined once, not for every step of every batch."""
    from lifetrail.plans.contract import q_marts_refreshed
    raw = raw_transactions(spark, SF001)
    once = fact_records(spark, lambda: raw.write.format("noop").mode("overwrite").save())
    assert 0 < fact_records(spark, lambda: q_marts_refreshed(spark, SF001).collect()) <= once
