"""The shared per-user fact table.

The original analyses join the transaction fact to its own per-user
minimum again and again (first date, first year, second date, next-year
activity).  Here that work is done once:

1. ``daily``: the clean fact reduced to (user_id, date_int) with counts and
   cent sums.  Partial aggregation runs before the shuffle, so a user who
   owns a third of all rows still ships at most one row per day per map task.
2. ``user_days``: ``daily`` clustered by user with the user's first date as
   a window value (the number of distinct days per user is bounded by the
   calendar, so the window partition is small).
3. ``user_years_from_days`` (one row per user and year) aggregates
   ``user_days`` and ``facts`` (one row per user) aggregates that, both
   without another exchange: they need clustering by ``user_id``, which the
   window already provides.  Materialising the yearly table therefore gives
   every per-user and per-year analysis from one pass over the fact.

The day grain serves questions about the second active day.  Others start
from ``user_totals`` (user grain) or ``user_years`` (year grain), which
shuffle one row per user, or per user and year, and task.

Money is summed as long cents: exact, order independent, cheaper than
decimal sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import cents, date_from_int, year_of_int


def daily(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """(user_id, date_int) -> rows, purchases, purchase cents, monetary-view
    rows and cents.  Conditions run on long cents, not decimals."""
    c = F.col("c")
    pos = c > 0
    ltv = pos & F.col("errors").isNull() & (c <= p.outlier_cap * 100)
    return (clean_df.select("user_id", "date_int", cents("amount").alias("c"), "errors")
            .groupBy("user_id", "date_int")
            .agg(F.count(F.lit(1)).alias("n_tx"),
                 F.count_if(pos).alias("n_pos"),
                 F.sum(F.when(pos, c).otherwise(F.lit(0))).alias("pos_cents"),
                 F.count_if(ltv).alias("ltv_n"),
                 F.sum(F.when(ltv, c).otherwise(F.lit(0))).alias("ltv_cents")))


def user_days(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    w = Window.partitionBy("user_id")
    return daily(clean_df, p).select("*", F.min("date_int").over(w).alias("first_date"),
                                     year_of_int("date_int").cast("int").alias("tx_year"))


def activated_expr(first, second, p: Params = Params()):
    first, second = F.col(first), F.col(second)
    if p.window_mode == "date_int":
        within = (second - first) <= p.activation_window
    elif p.window_mode == "calendar":
        within = F.datediff(date_from_int(second), date_from_int(first)) <= p.activation_window
    else:
        raise ValueError(f"unknown window_mode {p.window_mode!r}")
    return F.when(second.isNotNull() & within, 1).otherwise(0)


def user_years_from_days(ud: DataFrame) -> DataFrame:
    """(user, year) rows carrying the user's first active day and cohort
    year, the first active day after the user's first day within that year,
    the number of active days, and the counts and cent sums."""
    return ud.groupBy("user_id", "tx_year").agg(
        F.min(year_of_int("first_date")).cast("int").alias("cohort_year"),
        F.min("first_date").alias("first_date"),
        F.min(F.when(F.col("date_int") > F.col("first_date"), F.col("date_int"))).alias("next_date"),
        F.count(F.lit(1)).alias("n_days"),
        F.sum("n_tx").alias("n_tx"),
        F.sum("n_pos").alias("n_pos"),
        F.sum("pos_cents").alias("pos_cents"),
        F.sum("ltv_n").alias("ltv_n"),
        F.sum("ltv_cents").alias("ltv_cents"),
    )


def facts_from_years(uy: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per user from ``user_years`` (clustered by user, so no
    exchange): the second active day is the earliest day after the first
    day over all years."""
    f = uy.groupBy("user_id").agg(
        F.min("first_date").alias("first_date"),
        F.min("next_date").alias("second_date"),
        F.min("tx_year").alias("first_year"),
        F.max("tx_year").alias("last_year"),
        F.max(F.when(F.col("tx_year") == F.col("cohort_year") + 1, 1).otherwise(0)).alias("active_next_year"),
        F.sum("n_tx").alias("n_tx"),
        F.sum("n_pos").alias("n_pos"),
        F.sum("pos_cents").alias("pos_cents"),
        F.sum("ltv_n").alias("ltv_n"),
        F.sum("ltv_cents").alias("ltv_cents"),
        F.sum("n_days").alias("n_days"),
        F.min(F.when(F.col("tx_year") >= p.min_cohort, F.col("tx_year"))).alias("first_year_truncated"),
    )
    return f.select("*", F.col("second_date").isNotNull().cast("int").alias("has_second"),
                    activated_expr("first_date", "second_date", p).alias("activated"))


def _sums(clean_df: DataFrame, p: Params, keys: tuple, *more) -> DataFrame:
    c = F.col("c")
    pos = c > 0
    ltv = pos & F.col("errors").isNull() & (c <= p.outlier_cap * 100)
    rows = clean_df.select("user_id", "tx_year", cents("amount").alias("c"), "errors")
    return rows.groupBy(*keys).agg(
        *more, F.count(F.lit(1)).alias("n_tx"), F.count_if(pos).alias("n_pos"),
        F.sum(F.when(pos, c).otherwise(F.lit(0))).alias("pos_cents"), F.count_if(ltv).alias("ltv_n"),
        F.sum(F.when(ltv, c).otherwise(F.lit(0))).alias("ltv_cents"))


def user_totals(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per user with first and last active year, counts and cent
    sums: one exchange, with partial aggregation before it, so a hot user
    ships one row per task.  Enough for every question without a second
    active day or a next year."""
    year = F.col("tx_year")
    return _sums(clean_df, p, ("user_id",), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
                 F.min(F.when(year >= p.min_cohort, year)).alias("first_year_truncated"))


def user_years(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per (user, active year) carrying the user's cohort year
    (taken over all history, before any cohort filter).  The fact is
    reduced to (user, year) before the exchange by user."""
    years = _sums(clean_df, p, ("user_id", "tx_year"))
    return years.withColumn("cohort_year", F.min("tx_year").over(Window.partitionBy("user_id")))


def user_returns(user_years: DataFrame) -> DataFrame:
    """One row per user from ``user_years``: first year, and whether the user was active in the year after it."""
    back = F.max(F.when(F.col("tx_year") == F.col("cohort_year") + 1, 1).otherwise(0))
    return user_years.groupBy("user_id").agg(F.min("tx_year").alias("first_year"), F.max("tx_year").alias("last_year"), back.alias("active_next_year"))


def facts(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per user: first/second active day, first/last year,
    next-year activity, activation flag, counts and cent sums."""
    return facts_from_years(user_years_from_days(user_days(clean_df, p)), p)
