"""Marts kept up to date: a batch of new transactions refreshes them without
reading the old fact (A2, A16).

Below a root folder (shared by the executors) lie four tables, each with one
sub-folder per batch, and a log of the batches that count:

    state/       a batch's (user, year) states, partial: merged when read
    categories/  a batch's category sums, partial
    facts/       the facts of the users that a batch touched, complete: the
                 latest batch holds for a user
    cube/        the change that a batch makes to the (cohort, year) cube
    log/         one JSON row per batch, written last

``add_batch`` aggregates the batch, reads the states of the users it touches
(a semi-join; nothing of the other users is recomputed) and writes the four
parts; the log row makes them count.  A run that stops before has changed
nothing, and its folders are overwritten by the next attempt; a batch that
is in the log adds nothing when it comes again.  Two writers cannot log the
same number: the second one's write fails.

``compact`` merges all batches into one, so the number of folders stays
small; ``marts`` builds the six result marts from what counts.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.operators import cohort, experiment, lifecycle, profile, rfm
from lifetrail.operators.facts import facts_from_years
from lifetrail.operators.prepare import clean
from lifetrail.operators.select import held
from lifetrail.operators.state import category_state, cube, merge_categories, merge_cube, merge_state, user_year_state, user_years_from_state
from lifetrail.sources import batches
from lifetrail.sources.batches import commit, counting, folder_of, log, next_number

TABLES = ("state", "categories", "facts", "cube")
#: The parameters that the stored states depend on.
STORED = ("last_year_excl", "outlier_cap", "activation_window", "window_mode", "min_cohort")


def _stored(p: Params) -> str:
    return json.dumps({name: getattr(p, name) for name in STORED})


def _read(spark: SparkSession, root: str, name: str, live: list[tuple[int, str]]) -> DataFrame:
    """A table's rows in the batches that count, with ``number``."""
    out = None
    for number, folder in live:
        part = spark.read.parquet(f"{root}/{name}/{folder}").withColumn("number", F.lit(number))
        out = part if out is None else out.unionByName(part)
    return out


def _check(rows: list, p: Params) -> None:
    if rows and rows[-1]["note"] != _stored(p):
        raise ValueError(f"the stored states were built with {rows[-1]['params']}, not {_stored(p)}")


def add_batch(raw: DataFrame, root: str, batch: str, p: Params = Params()) -> int:
    """Add a batch of raw transactions; returns the clean rows added (0: the batch is already there)."""
    spark = raw.sparkSession
    done = log(spark, root)
    _check(done, p)
    if any(r["batch"] == batch for r in done):
        return 0
    number = next_number(done)
    live, folder = counting(done), folder_of(number, batch)

    def write(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}/{folder}")
        return spark.read.parquet(f"{root}/{name}/{folder}")

    c = clean(raw, p)
    delta = write(user_year_state(c, p), "state")
    write(category_state(c), "categories")
    if live:
        touched = delta.select("user_id").distinct()
        before = held(merge_state(_read(spark, root, "state", live).join(touched, "user_id", "left_semi")), "touched-states")
        old, new = user_years_from_state(before), user_years_from_state(merge_state(before.unionByName(delta).repartition("user_id")))
        change = merge_changes(cube(old, -1).unionByName(cube(new)))
    else:
        new = user_years_from_state(delta)
        change = cube(new)
    write(facts_from_years(new, p), "facts")
    write(change, "cube")
    rows = delta.agg(F.coalesce(F.sum("n_tx"), F.lit(0)).alias("n")).first()["n"]
    commit(spark, root, number, batch, [], _stored(p), rows)
    return rows


def merge_changes(rows: DataFrame) -> DataFrame:
    """Changes of the cube added up; cells may be negative or zero."""
    counts = [c for c in rows.columns if c not in ("cohort_year", "tx_year")]
    return rows.groupBy("cohort_year", "tx_year").agg(*(F.sum(c).cast("long").alias(c) for c in counts))


def current_facts(spark: SparkSession, root: str, live: list[tuple[int, str]]) -> DataFrame:
    """One row per user: the one that the latest batch wrote."""
    rows = _read(spark, root, "facts", live)
    columns = [c for c in rows.columns if c != "number"]
    return rows.groupBy("user_id").agg(F.max_by(F.struct(*columns), "number").alias("f")).select("f.*")


def compact(spark: SparkSession, root: str, p: Params = Params()) -> None:
    """Merge all batches that count into one.  Readers of the old folders are
    not disturbed; ``vacuum`` removes them later."""
    done = log(spark, root)
    _check(done, p)
    live = counting(done)
    if len(live) < 2:
        return
    number = next_number(done)
    folder = folder_of(number, "compact")
    tables = {"state": merge_state(_read(spark, root, "state", live)), "categories": merge_categories(_read(spark, root, "categories", live)),
              "facts": current_facts(spark, root, live), "cube": merge_cube(_read(spark, root, "cube", live))}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}/{folder}")
    commit(spark, root, number, "compact", [f for _, f in live], _stored(p), 0)


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders that do not count."""
    return batches.vacuum(spark, root, TABLES)


def marts(spark: SparkSession, root: str, mapping: DataFrame, p: Params = Params()) -> dict[str, DataFrame]:
    """The six marts of ``plans.marts.build_marts`` from the stored tables."""
    done = log(spark, root)
    _check(done, p)
    live = counting(done)
    if not live:
        raise ValueError(f"no batch has been added below {root}")
    facts = held(current_facts(spark, root, live), "facts")
    cells = merge_cube(_read(spark, root, "cube", live))
    categories = profile.category_top_from_sums(merge_categories(_read(spark, root, "categories", live)), p)
    scored, units = rfm.scored_users(facts, p, "qcut")
    segments = rfm.rfm_segments(scored, p)
    outcomes = experiment.observed_outcomes(experiment.experiment_arms(units, p))
    return {
        "aarrr_funnel": lifecycle.funnel_stages(facts),
        "yearly_trend": profile.yearly_trend_from_cube(cells),
        "cohort_behavior": cohort.complete_years(cohort.behavior_from_cube(cells, p), p),
        "rfm_segments": segments.select("user_id", "recency_years", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score", "segment"),
        "ab_test_result": experiment.outcome_comparison(outcomes, p),
        "mcc_category": profile.with_category_label(categories, mapping),
    }
