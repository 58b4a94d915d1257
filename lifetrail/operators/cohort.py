"""Yearly cohorts: sizes, retention, behaviour, demographics, lifespan.

Cohort year = the user's first active year over the whole history; the
cohort filter is applied after that minimum (a filter before it would
fold earlier users into the first kept year, see
``cohort_truncation_check``).  All per-(cohort, age) metrics come from
``user_years`` — one row per user and active year, already carrying the
cohort — so no join back to the fact is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import cents, parse_amount, pct, round_ratio, round_ratio_int


def cohort_sizes(facts: DataFrame) -> DataFrame:
    """Users per cohort year (all cohorts)."""
    return (facts.groupBy(F.col("first_year").cast("long").alias("cohort_year"))
                 .agg(F.count(F.lit(1)).alias("users")).orderBy("cohort_year"))


def cohort_truncation_check(facts: DataFrame, p: Params = Params()) -> DataFrame:
    """Cohort sizes from the full history vs from history cut at ``min_cohort``.

    The truncated minimum lumps every earlier user into the first kept
    year; the difference is the left-truncation bias."""
    rows = facts.select(F.inline(F.array(
        F.struct(F.col("first_year").alias("cohort_year"), F.lit(1).alias("t"), F.lit(0).alias("c")),
        F.struct(F.col("first_year_truncated").alias("cohort_year"), F.lit(0).alias("t"), F.lit(1).alias("c")))))
    return (rows.filter(F.col("cohort_year") >= p.min_cohort)
                .groupBy(F.col("cohort_year").cast("long").alias("cohort_year"))
                .agg(F.sum("t").cast("long").alias("users_full_history"),
                     F.sum("c").cast("long").alias("users_truncated_history"))
                .orderBy("cohort_year"))


def truncated_years(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    """``user_years`` as if history began at ``min_cohort``: the cohort year
    is the first kept year, so earlier users are folded into it."""
    kept = user_years.filter(F.col("tx_year") >= p.min_cohort).drop("cohort_year")
    return kept.withColumn("cohort_year", F.min("tx_year").over(Window.partitionBy("user_id")))


def _eligible_years(user_years: DataFrame, p: Params) -> DataFrame:
    return (user_years.filter(F.col("cohort_year") >= p.min_cohort)
                      .withColumn("years_since_first", (F.col("tx_year") - F.col("cohort_year")).cast("long")))


def cohort_retention(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    """(cohort, age) -> retained users, cohort size, retention % (1 dp)."""
    g = (_eligible_years(user_years, p)
         .groupBy(F.col("cohort_year").cast("long").alias("cohort_year"), "years_since_first")
         .agg(F.count(F.lit(1)).alias("retained_users")))
    size = F.max(F.when(F.col("years_since_first") == 0, F.col("retained_users"))) \
            .over(Window.partitionBy("cohort_year"))
    return (g.withColumn("cohort_users", size)
             .withColumn("retention_rate", pct("retained_users", "cohort_users", 1))
             .orderBy("cohort_year", "years_since_first"))


def ages(p: Params = Params(), lo: int = 0) -> list[int]:
    """Pivot columns: every age a kept cohort can reach (from parameters,
    so the pivot needs no extra pass to discover its values)."""
    return list(range(lo, p.last_kept_year - p.min_cohort + 1))


def pivot_by_age(long: DataFrame, value: str, p: Params = Params(), lo: int = 0) -> DataFrame:
    """Long (cohort, age, value) -> wide cohort x age_k; missing cells NULL.
    An age without a column stops the job instead of vanishing."""
    vals = ages(p, lo)
    age = F.col("years_since_first")
    known = F.when(age.isin(vals), age).otherwise(F.raise_error(F.concat(F.lit("no column for age "), age.cast("string"))))
    w = long.withColumn("years_since_first", known).groupBy("cohort_year").pivot("years_since_first", vals).agg(F.first(value))
    return w.select("cohort_year", *[F.col(str(a)).alias(f"age_{a}") for a in vals]).orderBy("cohort_year")


def cohort_retention_matrix(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    return pivot_by_age(cohort_retention(user_years, p), "retention_rate", p)


def cohort_retention_by_age(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    """Unweighted mean over cohorts of the (1 dp) retention rate per age."""
    r = cohort_retention(user_years, p).withColumn(
        "_t", round_ratio_int(F.col("retained_users") * 1000, "cohort_users"))
    return (r.groupBy("years_since_first")
             .agg(F.count(F.lit(1)).alias("cohorts"), F.sum("_t").alias("_s"))
             .select("years_since_first", "cohorts",
                     (F.col("_s").cast("double") / (F.col("cohorts") * 10).cast("double")).alias("avg_retention_rate"))
             .orderBy("years_since_first"))


def cohort_behavior(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    """(cohort, age) -> transactions, active users, cohort size,
    transactions per user (1 dp), purchase revenue per user (0 dp)."""
    return _behavior(_eligible_years(user_years, p)
                     .groupBy(F.col("cohort_year").cast("long").alias("cohort_year"), "years_since_first")
                     .agg(F.sum("n_tx").cast("long").alias("total_tx"),
                          F.count(F.lit(1)).alias("active_users"),
                          F.sum("pos_cents").alias("_rev")))


def behavior_from_cube(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """``cohort_behavior`` from the (cohort year, year) cube."""
    return _behavior(_eligible_years(cells, p).select(
        F.col("cohort_year").cast("long").alias("cohort_year"), "years_since_first", F.col("n_tx").alias("total_tx"), F.col("users").alias("active_users"), F.col("pos_cents").alias("_rev")))


def _behavior(g: DataFrame) -> DataFrame:
    size = F.max(F.when(F.col("years_since_first") == 0, F.col("active_users"))) \
            .over(Window.partitionBy("cohort_year"))
    return (g.withColumn("cohort_users", size)
             .withColumn("avg_tx_per_user", round_ratio("total_tx", "active_users", 1))
             .withColumn("avg_revenue_per_user", round_ratio_int("_rev", F.col("active_users") * 100))
             .drop("_rev").orderBy("cohort_year", "years_since_first"))


def complete_years(behavior: DataFrame, p: Params = Params()) -> DataFrame:
    return behavior.filter(F.col("years_since_first").between(p.age_min, p.age_max)).select(
        "cohort_year", "years_since_first", "active_users", "avg_tx_per_user", "avg_revenue_per_user")


def cohort_behavior_complete_years(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    """Cohort behaviour for complete follow-up years ``age_min..age_max``."""
    return complete_years(cohort_behavior(user_years, p), p)


def cohort_behavior_from_first_age(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    """Cohort behaviour of every age from ``age_min`` on (the first, partial year left out)."""
    b = cohort_behavior(user_years, p)
    return b.filter(F.col("years_since_first") >= p.age_min)


def cohort_frequency_matrix(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    return pivot_by_age(cohort_behavior_from_first_age(user_years, p), "avg_tx_per_user", p, lo=p.age_min)


def cohort_revenue_matrix(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    return pivot_by_age(cohort_behavior_from_first_age(user_years, p), "avg_revenue_per_user", p, lo=p.age_min)


def cohort_behavior_by_age(user_years: DataFrame, p: Params = Params()) -> DataFrame:
    """Unweighted mean over cohorts of transactions and revenue per user, per age."""
    b = cohort_behavior_from_first_age(user_years, p).withColumn(
        "_t", F.round(F.col("avg_tx_per_user") * 10).cast("long"))
    return (b.groupBy("years_since_first")
             .agg(F.count(F.lit(1)).alias("cohorts"), F.sum("_t").alias("_ts"),
                  F.sum("avg_revenue_per_user").alias("_rs"))
             .select("years_since_first", "cohorts",
                     (F.col("_ts").cast("double") / (F.col("cohorts") * 10).cast("double")).alias("avg_tx_per_user"),
                     (F.col("_rs").cast("double") / F.col("cohorts").cast("double")).alias("avg_revenue_per_user"))
             .orderBy("years_since_first"))


def cohort_demographics(facts: DataFrame, users: DataFrame, p: Params = Params()) -> DataFrame:
    """Cohorts in ``[profile_cohort_lo, profile_cohort_hi]`` joined to the users
    dimension: users, mean score, mean income and mean age (0 dp each)."""
    f = facts.filter(F.col("first_year").between(p.profile_cohort_lo, p.profile_cohort_hi)) \
             .select("user_id", F.col("first_year").cast("long").alias("cohort_year"))
    u = users.select("user_id", "score", "age", cents(parse_amount("income_raw")).alias("_inc"))
    j = f.join(u, "user_id", "inner")
    g = j.groupBy("cohort_year").agg(F.count(F.lit(1)).alias("user_count"),
                                     F.sum("score").alias("_ss"), F.count("score").alias("_sn"),
                                     F.sum("_inc").alias("_is"), F.count("_inc").alias("_in"),
                                     F.sum("age").alias("_as"), F.count("age").alias("_an"))
    return g.select("cohort_year", "user_count",
                    round_ratio_int("_ss", "_sn").alias("avg_score"),
                    round_ratio_int("_is", F.col("_in") * 100).alias("avg_income"),
                    round_ratio_int("_as", "_an").alias("avg_age")).orderBy("cohort_year")


def observed_lifespan(facts: DataFrame, p: Params = Params()) -> DataFrame:
    """Cohort -> users and mean / min / max of (last - first active year)."""
    f = facts.filter(F.col("first_year").between(p.min_cohort, p.lifespan_cohort_hi)) \
             .withColumn("_y", (F.col("last_year") - F.col("first_year")).cast("long"))
    g = f.groupBy(F.col("first_year").cast("long").alias("cohort_year")).agg(
        F.count(F.lit(1)).alias("user_count"), F.sum("_y").alias("_s"),
        F.min("_y").alias("min_years"), F.max("_y").alias("max_years"))
    return g.select("cohort_year", "user_count", round_ratio("_s", "user_count", 1).alias("avg_observed_years"),
                    "min_years", "max_years").orderBy("cohort_year")
