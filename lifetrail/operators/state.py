"""Mergeable states: what the marts need of the fact, kept up to date by adding.

``user_year_state`` has one row per user and year: the user's active days as
twelve bit masks (one per month), and counts and cent sums.  Masks are
merged by OR and sums by addition, so the state of a union of rows is the
merged state of its parts, whatever their order and whether days repeat in
several parts.  ``user_years_from_state`` gives the table that
``user_years_from_days`` gives from the fact.

``cube`` adds users up by (cohort year, year).  It is additive over users,
so when a few users change, the difference of their old and new rows brings
it up to date.

Months are 1 to 12 and days 1 to 31; a row with another month or day counts
in the sums and has no active day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import cents

DAYS = [f"d{m}" for m in range(1, 13)]
SUMS = ["n_tx", "n_pos", "pos_cents", "ltv_n", "ltv_cents"]
CUBE = ["users", "n_tx", "buyers", "n_pos", "pos_cents"]


def user_year_state(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """(user, year) -> day masks and sums, in one exchange with partial aggregation before it."""
    c = F.col("c")
    pos = c > 0
    ltv = pos & F.col("errors").isNull() & (c <= p.outlier_cap * 100)
    bit = F.when(F.col("tx_day").between(1, 31), F.expr("shiftleft(1, tx_day - 1)"))
    rows = clean_df.select("user_id", "tx_year", "tx_month", bit.alias("bit"), cents("amount").alias("c"), "errors")
    return rows.groupBy("user_id", "tx_year").agg(
        *(F.coalesce(F.bit_or(F.when(F.col("tx_month") == m, F.col("bit"))), F.lit(0)).alias(d) for m, d in enumerate(DAYS, 1)),
        F.count(F.lit(1)).alias("n_tx"), F.count_if(pos).alias("n_pos"), F.sum(F.when(pos, c).otherwise(F.lit(0))).alias("pos_cents"),
        F.count_if(ltv).alias("ltv_n"), F.sum(F.when(ltv, c).otherwise(F.lit(0))).alias("ltv_cents"))


def merge_state(state: DataFrame) -> DataFrame:
    """One row per (user, year) from several."""
    return state.groupBy("user_id", "tx_year").agg(*(F.bit_or(d).alias(d) for d in DAYS), *(F.sum(s).alias(s) for s in SUMS))


def _date(month: int, mask):
    """The first day of a month's mask as YYYYMMDD (null: none)."""
    low = F.bit_count(mask.bitwiseAND(-mask) - 1) + 1
    return F.when(mask != 0, F.col("tx_year") * 10000 + month * 100 + low)


def user_years_from_state(state: DataFrame) -> DataFrame:
    """(user, year) rows with cohort year, first active day, first active day
    after it within the year, active days and sums.  ``state`` has one row
    per (user, year); users without any active day are left out."""
    masks = [(m, F.col(d)) for m, d in enumerate(DAYS, 1)]
    firsts = [_date(m, mask) for m, mask in masks]
    y = state.select("*", F.least(*firsts).alias("low"), sum(F.bit_count(mask) for _, mask in masks).cast("long").alias("n_days"))
    later = [F.when(_date(m, mask) > F.col("low"), _date(m, mask)).otherwise(_date(m, mask.bitwiseAND(mask - 1))) for m, mask in masks]
    y = y.withColumn("second", F.least(*later)).withColumn("first_date", F.min("low").over(Window.partitionBy("user_id"))).where("low is not null")
    return y.select("user_id", "tx_year", F.expr("first_date div 10000").cast("int").alias("cohort_year"), F.col("first_date").cast("int").alias("first_date"),
                    F.when(F.col("low") > F.col("first_date"), F.col("low")).otherwise(F.col("second")).cast("int").alias("next_date"), "n_days", *SUMS)


def cube(user_years: DataFrame, sign: int = 1) -> DataFrame:
    """(cohort year, year) -> active users, rows, buyers, purchases and their cents; ``sign`` -1 takes them off."""
    return user_years.groupBy("cohort_year", "tx_year").agg(
        F.count(F.lit(1)).alias("users"), F.sum("n_tx").alias("n_tx"), F.count_if(F.col("n_pos") > 0).alias("buyers"), F.sum("n_pos").alias("n_pos"), F.sum("pos_cents").alias("pos_cents")
    ).select("cohort_year", "tx_year", *((F.col(c) * sign).cast("long").alias(c) for c in CUBE))


def merge_cube(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cohort_year", "tx_year").agg(*(F.sum(c).cast("long").alias(c) for c in CUBE)).where("users > 0")


def category_state(clean_df: DataFrame) -> DataFrame:
    """Category -> rows, purchases and their cents."""
    c = F.col("c")
    return clean_df.select("mcc", cents("amount").alias("c")).groupBy("mcc").agg(
        F.count(F.lit(1)).alias("n_tx"), F.count_if(c > 0).alias("n_pos"), F.sum(F.when(c > 0, c).otherwise(F.lit(0))).alias("pos_cents"))


def merge_categories(rows: DataFrame) -> DataFrame:
    return rows.groupBy("mcc").agg(*(F.sum(c).cast("long").alias(c) for c in ("n_tx", "n_pos", "pos_cents")))
