"""Result marts (A16/A13): the six dashboard tables built in one run.

The yearly per-user table is written once to the shared folder that the
caller names, the per-user ``facts`` table is derived from it (and written
too), and every mart reads them; the transaction fact itself is scanned
once for them plus once for the category mart.  The written tables cut the
lineage, so a lost executor recomputes from them rather than from the raw
scan; they go when the marts are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from lifetrail.config import Params
from lifetrail.operators import cohort, experiment, lifecycle, profile, rfm
from lifetrail.operators.facts import facts_from_years, user_days, user_years_from_days
from lifetrail.operators.prepare import clean
from lifetrail.sources.files import save_table, write_table

#: Marts whose number of rows is bounded by years, stages or categories.
SMALL_MARTS = ("aarrr_funnel", "yearly_trend", "cohort_behavior", "ab_test_result", "mcc_category")


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table below ``folder``."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def run_folder(shared_folder: str) -> str:
    """A name for one run's intermediate tables below the shared folder."""
    if not shared_folder:
        raise ValueError("a folder that all executors share is needed for intermediate tables")
    return f"{shared_folder.rstrip('/')}/lifetrail-marts-{uuid.uuid4().hex}"


def remove_folder(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def build_marts(raw: DataFrame, mapping: DataFrame, folder: str, p: Params = Params()) -> dict[str, DataFrame]:
    """Return the six marts as DataFrames (lazy except the bases, which are
    written below ``folder``; see ``run_folder`` and ``remove_folder``)."""
    c = clean(raw, p)
    uy = materialise(user_years_from_days(user_days(c, p)), folder, "user_years")
    f = materialise(facts_from_years(uy, p), folder, "facts")

    scored, units = rfm.scored_users(f, p, "qcut")
    segs = rfm.rfm_segments(scored, p)
    outcomes = experiment.observed_outcomes(experiment.experiment_arms(units, p))
    top = profile.category_top(c, p, purchases_only=True)
    return {
        "aarrr_funnel": lifecycle.funnel_stages(f),
        "yearly_trend": profile.yearly_trend_from_years(uy),
        "cohort_behavior": cohort.cohort_behavior_complete_years(uy, p),
        "rfm_segments": segs.select("user_id", "recency_years", "frequency", "monetary",
                                    "r_score", "f_score", "m_score", "rfm_score", "segment"),
        "ab_test_result": experiment.outcome_comparison(outcomes, p),
        "mcc_category": profile.with_category_label(top, mapping),
    }


def write_marts(marts: dict[str, DataFrame], out_dir: str, fmt: str = "parquet", may_be_empty: tuple = ()) -> list[str]:
    """Replace every mart's files, all or none.  Returns the written paths.

    The marts are written to a staging folder first and read back: a mart
    without rows fails the load (but for those that ``may_be_empty``).  Only
    then do renames switch them; a load that fails before leaves the old
    marts as they were, and a failing rename puts them back.  Marts bounded
    by years, stages or categories become a single file for dashboard tools;
    the per-user mart is written by all tasks."""
    spark = next(iter(marts.values())).sparkSession
    out = out_dir.rstrip("/")
    run = uuid.uuid4().hex
    new, old = f"{out}/.staging-{run}", f"{out}/.replaced-{run}"
    options = {"header": True} if fmt == "csv" else {}
    try:
        for name, df in marts.items():
            write_table(df.coalesce(1) if name in SMALL_MARTS else df, f"{new}/{name}", mode="fail", fmt=fmt, **options)
            _audit(spark.read.format(fmt).options(**options).load(f"{new}/{name}").count(), name, may_be_empty)
        _switch(spark, list(marts), new, out, old)
    finally:
        for folder in (new, old):
            remove_folder(spark, folder)
    return [f"{out}/{name}" for name in marts]


def _audit(rows: int, name: str, may_be_empty: tuple) -> None:
    if not rows and name not in may_be_empty:
        raise ValueError(f"mart {name} has no rows; the old one stays")


def _switch(spark, names: list[str], new: str, out: str, old: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(out).getFileSystem(conf)
    fs.mkdirs(path(old))
    moved: list[tuple[str, str]] = []
    try:
        for name in names:
            for a, b in ((f"{out}/{name}", f"{old}/{name}"), (f"{new}/{name}", f"{out}/{name}")):
                if a.startswith(new) or fs.exists(path(a)):
                    if not fs.rename(path(a), path(b)):
                        raise OSError(f"cannot move {a} to {b}")
                    moved.append((a, b))
    except Exception:
        for a, b in reversed(moved):
            fs.rename(path(b), path(a))
        raise


def load_marts(marts: dict[str, DataFrame], database: str = "default", prefix: str = "", may_be_empty: tuple = ()) -> list[str]:
    """Replace the marts' catalog tables, all or none (A13): staging tables
    are written and counted, then renamed in place of the old ones."""
    spark = next(iter(marts.values())).sparkSession
    full = {name: f"{database}.{prefix}{name}" for name in marts}
    staging = {name: f"{t}__staging" for name, t in full.items()}
    moved: list[tuple[str, str]] = []
    try:
        for name, df in marts.items():
            save_table(df.coalesce(1) if name in SMALL_MARTS else df, staging[name], mode="replace")
            _audit(spark.table(staging[name]).count(), name, may_be_empty)
        for name, t in full.items():
            spark.sql(f"DROP TABLE IF EXISTS {t}__replaced")
            for a, b in ((t, f"{t}__replaced"), (staging[name], t)):
                if spark.catalog.tableExists(a):
                    spark.sql(f"ALTER TABLE {a} RENAME TO {b}")
                    moved.append((a, b))
    except Exception:
        for a, b in reversed(moved):
            spark.sql(f"ALTER TABLE {b} RENAME TO {a}")
        raise
    finally:
        for t in staging.values():
            spark.sql(f"DROP TABLE IF EXISTS {t}")
    for t in full.values():
        spark.sql(f"DROP TABLE IF EXISTS {t}__replaced")
    return list(full.values())


def run_marts(raw: DataFrame, mapping: DataFrame, out_dir: str, shared_folder: str, p: Params = Params(), fmt: str = "parquet") -> list[str]:
    """Build and write the six marts, then drop the run's intermediate tables."""
    folder = run_folder(shared_folder)
    try:
        return write_marts(build_marts(raw, mapping, folder, p), out_dir, fmt)
    finally:
        remove_folder(raw.sparkSession, folder)
