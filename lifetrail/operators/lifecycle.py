"""Lifecycle funnel (acquisition, activation, retention, revenue).

Every operator reads the per-user ``facts`` table, so the fact itself is
scanned and shuffled once; the results are single-row or per-year
aggregates over users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import money, pct, round_ratio, round_ratio_int


def acquisition_by_year(facts: DataFrame) -> DataFrame:
    """New users per first active year."""
    return (facts.groupBy("first_year").agg(F.count(F.lit(1)).alias("new_users"))
                 .select(F.col("first_year").cast("long").alias("first_year"), "new_users")
                 .orderBy("first_year"))


def acquisition_summary(facts: DataFrame) -> DataFrame:
    """All acquired users, number of first-activity years, mean new users
    per year (0 dp)."""
    g = facts.groupBy("first_year").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.sum("n").cast("long").alias("total_users"), F.count(F.lit(1)).alias("years"),
                 round_ratio_int(F.sum("n"), F.count(F.lit(1))).alias("mean_new_users_per_year"))


def activation(facts: DataFrame) -> DataFrame:
    """Acquired users, users with a second active day, activated users, rate."""
    g = facts.agg(F.count(F.lit(1)).alias("acquired_users"),
                  F.sum("has_second").cast("long").alias("had_second_tx"),
                  F.sum("activated").cast("long").alias("activated_users"))
    return g.withColumn("activation_rate", pct("activated_users", "acquired_users", 2))


def retention_next_year(returns: DataFrame, p: Params = Params(), exclude_censored: bool = False) -> DataFrame:
    """Users active again in the year after their first year, from a table
    with one row per user (``user_returns`` or ``facts``).

    ``exclude_censored`` leaves out users first seen in the last kept year,
    whose next year is not observed."""
    if exclude_censored:
        returns = returns.filter(F.col("first_year") < p.last_kept_year)
    g = returns.agg(F.count(F.lit(1)).alias("acquired_users"),
                  F.sum("active_next_year").cast("long").alias("retained_users"))
    return g.withColumn("retention_rate", pct("retained_users", "acquired_users", 2))


def revenue_summary(facts: DataFrame, p: Params = Params()) -> DataFrame:
    """Per-user purchase totals (monetary view) summarised over users."""
    payers = facts.filter(F.col("ltv_n") > 0)
    g = payers.agg(F.count(F.lit(1)).alias("total_users"),
                   F.sum("ltv_cents").alias("_sum"),
                   F.min("ltv_cents").alias("_min"),
                   F.max("ltv_cents").alias("_max"),
                   F.count_if(F.col("ltv_cents") > p.high_value * 100).alias("high_value_users"))
    return g.select("total_users",
                    round_ratio("_sum", F.col("total_users") * 100, 2).alias("avg_ltv"),
                    money("_min").alias("min_ltv"), money("_max").alias("max_ltv"),
                    "high_value_users")


def _funnel_counts(facts: DataFrame) -> DataFrame:
    return facts.agg(
        F.count(F.lit(1)).alias("acquisition"),
        F.sum("activated").cast("long").alias("activation"),
        F.sum(F.col("activated") * F.col("active_next_year")).cast("long").alias("retention"))


def funnel_sequential(facts: DataFrame) -> DataFrame:
    """Acquisition -> activation -> retention among the activated."""
    return _funnel_counts(facts)


def funnel_stages(facts: DataFrame) -> DataFrame:
    """Long form (stage, users, order_num) of the sequential funnel."""
    def row(stage, col, order):
        return F.struct(F.lit(stage).alias("stage"), F.col(col).alias("users"),
                        F.lit(order).cast("long").alias("order_num"))

    return _funnel_counts(facts).select(F.inline(F.array(
        row("Acquisition", "acquisition", 1), row("Activation", "activation", 2),
        row("Retention", "retention", 3))))


def funnel_conversion(facts: DataFrame) -> DataFrame:
    """Step-to-step conversion percentages (1 decimal) of the sequential funnel."""
    c = _funnel_counts(facts)

    def step(name, a, b):
        return F.struct(F.lit(name).alias("step"), F.col(a).alias("from_users"),
                        F.col(b).alias("to_users"),
                        F.when(F.col(a) > 0, pct(b, a, 1)).alias("conversion_rate"))

    return c.select(F.inline(F.array(step("acquisition_to_activation", "acquisition", "activation"),
                                     step("activation_to_retention", "activation", "retention"),
                                     step("acquisition_to_retention", "acquisition", "retention"))))


def funnel_independent(facts: DataFrame) -> DataFrame:
    """Each stage measured on all acquired users (stages independent)."""
    g = facts.agg(F.count(F.lit(1)).alias("acq"),
                  F.sum("activated").cast("long").alias("act"),
                  F.sum("active_next_year").cast("long").alias("ret"),
                  F.count_if(F.col("n_tx") > 0).alias("rev"))

    def row(stage, col, order):
        return F.struct(F.lit(stage).alias("stage"), F.col(col).alias("users"),
                        pct(col, "acq", 1).alias("pct_of_acquired"),
                        F.lit(order).cast("long").alias("order_num"))

    return g.select(F.inline(F.array(row("Acquisition", "acq", 1), row("Activation", "act", 2),
                                     row("Retention", "ret", 3), row("Revenue", "rev", 4))))


USER_TYPES = {(1, 1): "core", (1, 0): "early_flash", (0, 1): "slow_settler", (0, 0): "churned"}


def activation_x_retention(facts: DataFrame) -> DataFrame:
    """2x2 typing of users by activation and next-year retention."""
    a, r = F.col("activated"), F.col("active_next_year")
    label = (F.when((a == 1) & (r == 1), USER_TYPES[(1, 1)])
              .when((a == 1) & (r == 0), USER_TYPES[(1, 0)])
              .when((a == 0) & (r == 1), USER_TYPES[(0, 1)])
              .otherwise(USER_TYPES[(0, 0)]))
    g = facts.groupBy(label.alias("user_type")).agg(F.count(F.lit(1)).alias("user_count"))
    total = F.sum("user_count").over(Window.partitionBy())
    return (g.withColumn("ratio", pct("user_count", total, 2))
             .orderBy(F.desc("user_count"), "user_type"))


def activation_extract(facts: DataFrame) -> DataFrame:
    """Per user: first active day, second active day, activated flag."""
    return facts.select("user_id", F.col("first_date").cast("long").alias("first_date"),
                        F.col("second_date").cast("long").alias("second_date"),
                        F.col("activated").cast("long").alias("activated"))


def funnel_sequential_joins(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """The sequential funnel in its literal join form (the original's
    formulation): the fact joined to its per-user first day with a range
    residual (C1, C2), distinct users as semi-joins (C4), left joins and
    null tests for the stages (C3, C5).  ``funnel_sequential`` computes the
    same counts from ``facts`` in one pass.  Here the fact is reduced to
    distinct user days before the joins, so a hot user has one row per day."""
    c = clean_df.select("user_id", "date_int", "tx_year").distinct()
    first = c.groupBy("user_id").agg(F.min("date_int").alias("first_date"), F.min("tx_year").alias("first_year"))
    cf = c.join(first, "user_id")
    act = cf.filter((F.col("date_int") > F.col("first_date"))
                    & (F.col("date_int") - F.col("first_date") <= p.activation_window)) \
            .select("user_id").distinct()
    ret = cf.filter(F.col("tx_year") == F.col("first_year") + 1).select("user_id") \
            .join(act, "user_id", "left_semi").distinct()
    j = (first.join(act.withColumn("_a", F.lit(1)), "user_id", "left")
              .join(ret.withColumn("_r", F.lit(1)), "user_id", "left"))
    return j.agg(F.count(F.lit(1)).alias("acquisition"),
                 F.count_if(F.col("_a").isNotNull()).alias("activation"),
                 F.count_if(F.col("_r").isNotNull()).alias("retention"))
