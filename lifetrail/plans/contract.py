"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Each query reads the provided parquet tables through the adapter, runs
the operator over the whole data and returns a DataFrame with aliased,
engine-neutral columns (long counts, double ratios, string labels).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.operators import lifecycle, profile
from lifetrail.operators.facts import facts, user_returns, user_totals
from lifetrail.operators.prepare import clean, monetary
from lifetrail.sources.adapter import category_map, raw_transactions, raw_users

PARAMS = Params()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------- inputs
def _raw(spark, sf_dir):
    return raw_transactions(spark, sf_dir)


def _clean(spark, sf_dir, p=PARAMS):
    return clean(_raw(spark, sf_dir), p)


def _facts(spark, sf_dir, p=PARAMS):
    return facts(_clean(spark, sf_dir, p), p)


def _totals(spark, sf_dir, p=PARAMS):
    return user_totals(_clean(spark, sf_dir, p), p)


# ---------------------------------------------------------------- A: preparation
@register("clean_transactions")
def q_clean_transactions(spark, sf_dir):
    c = _clean(spark, sf_dir)
    return c.withColumn("amount", F.col("amount").cast("double")) \
            .withColumn("user_id", F.col("user_id").cast("long"))


@register("ltv_transactions")
def q_ltv_transactions(spark, sf_dir):
    m = monetary(_clean(spark, sf_dir), PARAMS)
    return m.withColumn("amount", F.col("amount").cast("double"))


@register("audit_row_counts")
def q_audit_row_counts(spark, sf_dir):
    """Row counts of the raw fact, the clean and monetary views (one pass
    with conditional counts) and the users dimension."""
    from lifetrail.functions import parse_amount
    from lifetrail.operators.prepare import not_fraud
    raw = _raw(spark, sf_dir)
    keep = not_fraud(raw) & (F.col("tx_year") < PARAMS.last_year_excl)
    amt = parse_amount("amount_raw")
    ltv = keep & (amt > 0) & F.col("errors").isNull() & (amt <= PARAMS.outlier_cap)
    g = raw.agg(F.count(F.lit(1)).alias("transactions"), F.count_if(keep).alias("clean_transactions"),
                F.count_if(ltv).alias("ltv_transactions"))
    fact_rows = g.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("table_name"), F.col(n).alias("row_count"))
        for n in ("transactions", "clean_transactions", "ltv_transactions")])))
    users = raw_users(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count")) \
                                    .select(F.lit("users").alias("table_name"), "row_count")
    return fact_rows.unionByName(users)


# ---------------------------------------------------------------- H: profiling
@register("profile_range")
def q_profile_range(spark, sf_dir):
    return profile.profile_range(_clean(spark, sf_dir))


@register("profile_amount")
def q_profile_amount(spark, sf_dir):
    return profile.profile_amount(_clean(spark, sf_dir))


@register("refund_detail_top20")
def q_refund_detail_top20(spark, sf_dir):
    return profile.refund_detail_top(_clean(spark, sf_dir), PARAMS)


@register("refund_error_share")
def q_refund_error_share(spark, sf_dir):
    return profile.refund_error_share(_clean(spark, sf_dir))


@register("fraud_share")
def q_fraud_share(spark, sf_dir):
    return profile.fraud_share(_raw(spark, sf_dir))


@register("error_share")
def q_error_share(spark, sf_dir):
    return profile.error_share(_clean(spark, sf_dir))


@register("null_profile")
def q_null_profile(spark, sf_dir):
    return profile.null_profile(_clean(spark, sf_dir))


@register("amount_outliers")
def q_amount_outliers(spark, sf_dir):
    return profile.amount_outliers(_clean(spark, sf_dir), PARAMS)


@register("category_top20")
def q_category_top20(spark, sf_dir):
    return profile.category_top(_clean(spark, sf_dir), PARAMS)


@register("category_top20_purchases")
def q_category_top20_purchases(spark, sf_dir):
    return profile.category_top(_clean(spark, sf_dir), PARAMS, purchases_only=True)


@register("category_rollup")
def q_category_rollup(spark, sf_dir):
    return profile.category_rollup(_clean(spark, sf_dir), category_map(spark), PARAMS)


@register("category_rollup_of_top20")
def q_category_rollup_of_top20(spark, sf_dir):
    return profile.category_rollup(_clean(spark, sf_dir), category_map(spark), PARAMS, top_k=PARAMS.top_k)


@register("yearly_trend")
def q_yearly_trend(spark, sf_dir):
    return profile.yearly_trend(_clean(spark, sf_dir))


@register("yearly_trend_from_user_years")
def q_yearly_trend_from_user_years(spark, sf_dir):
    return profile.yearly_trend_from_years(_user_years(spark, sf_dir))


@register("partial_period_check")
def q_partial_period_check(spark, sf_dir):
    return profile.partial_period_check(_raw(spark, sf_dir), PARAMS)


@register("population_reconciliation")
def q_population_reconciliation(spark, sf_dir):
    return profile.population_reconciliation(_raw(spark, sf_dir), raw_users(spark, sf_dir), PARAMS)


# ---------------------------------------------------------------- I: funnel
@register("acquisition_by_year")
def q_acquisition_by_year(spark, sf_dir):
    return lifecycle.acquisition_by_year(_totals(spark, sf_dir))


@register("acquisition_summary")
def q_acquisition_summary(spark, sf_dir):
    return lifecycle.acquisition_summary(_totals(spark, sf_dir))


@register("activation")
def q_activation(spark, sf_dir):
    return lifecycle.activation(_facts(spark, sf_dir))


@register("activation_calendar")
def q_activation_calendar(spark, sf_dir):
    p = PARAMS.with_(window_mode="calendar")
    return lifecycle.activation(_facts(spark, sf_dir, p))


@register("retention_next_year")
def q_retention_next_year(spark, sf_dir):
    return lifecycle.retention_next_year(user_returns(_user_years(spark, sf_dir)), PARAMS)


@register("retention_next_year_uncensored")
def q_retention_next_year_uncensored(spark, sf_dir):
    return lifecycle.retention_next_year(user_returns(_user_years(spark, sf_dir)), PARAMS, exclude_censored=True)


@register("revenue_summary")
def q_revenue_summary(spark, sf_dir):
    return lifecycle.revenue_summary(_totals(spark, sf_dir), PARAMS)


@register("funnel_sequential")
def q_funnel_sequential(spark, sf_dir):
    return lifecycle.funnel_sequential(_facts(spark, sf_dir))


@register("funnel_sequential_joins")
def q_funnel_sequential_joins(spark, sf_dir):
    return lifecycle.funnel_sequential_joins(_clean(spark, sf_dir), PARAMS)


@register("funnel_stages")
def q_funnel_stages(spark, sf_dir):
    return lifecycle.funnel_stages(_facts(spark, sf_dir))


@register("funnel_conversion")
def q_funnel_conversion(spark, sf_dir):
    return lifecycle.funnel_conversion(_facts(spark, sf_dir))


@register("funnel_independent")
def q_funnel_independent(spark, sf_dir):
    return lifecycle.funnel_independent(_facts(spark, sf_dir))


@register("activation_x_retention")
def q_activation_x_retention(spark, sf_dir):
    return lifecycle.activation_x_retention(_facts(spark, sf_dir))


@register("activation_extract")
def q_activation_extract(spark, sf_dir):
    return lifecycle.activation_extract(_facts(spark, sf_dir))


# ---------------------------------------------------------------- A15: subset
@register("user_subset")
def q_user_subset(spark, sf_dir):
    from lifetrail.sources.files import entity_subset
    raw = _raw(spark, sf_dir)
    users = raw_users(spark, sf_dir)
    sub = entity_subset(raw, users, n_users=200, seed=PARAMS.seed, p=PARAMS)
    return sub.select("user_id", "tx_year", "tx_month", "tx_day", "amount_raw", "mcc", "errors", "is_fraud")


@register("user_subset_tables")
def q_user_subset_tables(spark, sf_dir):
    """Rows of each table that stay when all are cut to the same users."""
    from lifetrail.sources.adapter import raw_cards
    from lifetrail.sources.files import consistent_subset
    tables = {"transactions": _raw(spark, sf_dir), "users": raw_users(spark, sf_dir), "cards": raw_cards(spark, sf_dir)}
    cut = consistent_subset(tables, n_users=200, seed=PARAMS.seed, p=PARAMS)
    out = None
    for name, df in cut.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("user_id").alias("users")).select(F.lit(name).alias("table_name"), "row_count", "users")
        out = row if out is None else out.unionByName(row)
    return out


@register("cohort_demographics_by_position")
def q_cohort_demographics_by_position(spark, sf_dir):
    """Cohort demographics with users joined on their row position (the
    users file has no key of its own): the position among the users in key
    order, shifted to the keys' start."""
    from lifetrail.sources.files import positional_key
    users = positional_key(raw_users(spark, sf_dir).withColumn("customer", F.col("user_id")).drop("user_id"), ["customer"], "user_id", start=1)
    return cohort.cohort_demographics(_totals(spark, sf_dir), users, PARAMS)


# ---------------------------------------------------------------- J: cohorts and value
from lifetrail.operators import cohort, value, rfm, mix, experiment  # noqa: E402
from lifetrail.operators.facts import user_years  # noqa: E402
from lifetrail.operators.select import held  # noqa: E402


def _user_years(spark, sf_dir, p=PARAMS):
    return user_years(_clean(spark, sf_dir, p), p)


def _annual(spark, sf_dir, p=PARAMS):
    return value.annual_ltv(_totals(spark, sf_dir, p), p)


@register("cohort_sizes")
def q_cohort_sizes(spark, sf_dir):
    return cohort.cohort_sizes(_totals(spark, sf_dir))


@register("cohort_truncation_check")
def q_cohort_truncation_check(spark, sf_dir):
    return cohort.cohort_truncation_check(_totals(spark, sf_dir), PARAMS)


@register("cohort_retention")
def q_cohort_retention(spark, sf_dir):
    return cohort.cohort_retention(_user_years(spark, sf_dir), PARAMS)


@register("cohort_retention_matrix_truncated")
def q_cohort_retention_matrix_truncated(spark, sf_dir):
    """The biased matrix: cohorts of a history that begins at the first kept year."""
    return cohort.cohort_retention_matrix(cohort.truncated_years(_user_years(spark, sf_dir), PARAMS), PARAMS)


@register("cohort_retention_matrix")
def q_cohort_retention_matrix(spark, sf_dir):
    return cohort.cohort_retention_matrix(_user_years(spark, sf_dir), PARAMS)


@register("cohort_retention_by_age")
def q_cohort_retention_by_age(spark, sf_dir):
    return cohort.cohort_retention_by_age(_user_years(spark, sf_dir), PARAMS)


@register("cohort_behavior")
def q_cohort_behavior(spark, sf_dir):
    return cohort.cohort_behavior(_user_years(spark, sf_dir), PARAMS)


@register("cohort_behavior_complete_years")
def q_cohort_behavior_complete_years(spark, sf_dir):
    return cohort.cohort_behavior_complete_years(_user_years(spark, sf_dir), PARAMS)


@register("cohort_frequency_matrix")
def q_cohort_frequency_matrix(spark, sf_dir):
    return cohort.cohort_frequency_matrix(_user_years(spark, sf_dir), PARAMS)


@register("cohort_revenue_matrix")
def q_cohort_revenue_matrix(spark, sf_dir):
    return cohort.cohort_revenue_matrix(_user_years(spark, sf_dir), PARAMS)


@register("cohort_behavior_by_age")
def q_cohort_behavior_by_age(spark, sf_dir):
    return cohort.cohort_behavior_by_age(_user_years(spark, sf_dir), PARAMS)


@register("cohort_demographics")
def q_cohort_demographics(spark, sf_dir):
    return cohort.cohort_demographics(_totals(spark, sf_dir), raw_users(spark, sf_dir), PARAMS)


@register("observed_lifespan")
def q_observed_lifespan(spark, sf_dir):
    return cohort.observed_lifespan(_totals(spark, sf_dir), PARAMS)


@register("annual_ltv")
def q_annual_ltv(spark, sf_dir):
    return _annual(spark, sf_dir)


@register("ltv_summary")
def q_ltv_summary(spark, sf_dir):
    return value.ltv_summary(_annual(spark, sf_dir))


@register("ltv_distribution")
def q_ltv_distribution(spark, sf_dir):
    return value.ltv_distribution(_annual(spark, sf_dir), bins=PARAMS.hist_bins)


@register("ltv_describe")
def q_ltv_describe(spark, sf_dir):
    return value.ltv_describe(_annual(spark, sf_dir))


# ---------------------------------------------------------------- K: RFM and segment mix
def _rfm_raw(spark, sf_dir, p=PARAMS):
    return rfm.rfm_raw(_totals(spark, sf_dir, p), p)


def _segments(spark, sf_dir, method, p=PARAMS):
    return rfm.rfm_segments(rfm.rfm_scored(_rfm_raw(spark, sf_dir, p), p, method), p)


RFM_COLS = ("user_id", "recency_years", "frequency", "monetary", "r_score", "f_score", "m_score")


@register("rfm_raw")
def q_rfm_raw(spark, sf_dir):
    return _rfm_raw(spark, sf_dir).select("user_id", "recency_years", "frequency", "monetary")


@register("rfm_scored_ntile")
def q_rfm_scored_ntile(spark, sf_dir):
    return rfm.rfm_scored(_rfm_raw(spark, sf_dir), PARAMS, "ntile").select(*RFM_COLS)


@register("rfm_scored_qcut")
def q_rfm_scored_qcut(spark, sf_dir):
    return rfm.rfm_scored(_rfm_raw(spark, sf_dir), PARAMS, "qcut").select(*RFM_COLS)


@register("rfm_quantile_recency")
def q_rfm_quantile_recency(spark, sf_dir):
    return rfm.rfm_quantile_recency(_rfm_raw(spark, sf_dir), PARAMS)


@register("rfm_segments")
def q_rfm_segments(spark, sf_dir):
    return _segments(spark, sf_dir, "ntile").select(*RFM_COLS, "rfm_score", "segment")


@register("rfm_segments_qcut")
def q_rfm_segments_qcut(spark, sf_dir):
    return _segments(spark, sf_dir, "qcut").select(*RFM_COLS, "rfm_score", "segment")


@register("rfm_segment_summary")
def q_rfm_segment_summary(spark, sf_dir):
    return rfm.rfm_segment_summary(_segments(spark, sf_dir, "ntile"))


@register("segment_transactions")
def q_segment_transactions(spark, sf_dir):
    return mix.segment_transactions(_segments(spark, sf_dir, "qcut"))


def _activity(spark, sf_dir, p=PARAMS):
    """One aggregate of the fact, written once, and the segments from it."""
    activity = held(mix.user_activity(_clean(spark, sf_dir, p), p), "activity")
    raw = rfm.rfm_raw(mix.totals_from_activity(activity, p), p)
    return activity, rfm.rfm_segments(rfm.rfm_scored(raw, p, "qcut"), p)


def _mix(spark, sf_dir):
    return mix.segment_category_mix(*_activity(spark, sf_dir), category_map(spark))


@register("segment_category_mix")
def q_segment_category_mix(spark, sf_dir):
    return _mix(spark, sf_dir)


@register("segment_category_matrix")
def q_segment_category_matrix(spark, sf_dir):
    return mix.segment_category_matrix(_mix(spark, sf_dir))


@register("segment_top_categories")
def q_segment_top_categories(spark, sf_dir):
    return mix.segment_top_categories(_mix(spark, sf_dir), PARAMS)


@register("segment_seasonality")
def q_segment_seasonality(spark, sf_dir):
    return mix.segment_seasonality(*_activity(spark, sf_dir))


# ---------------------------------------------------------------- L: experiment
def _units(spark, sf_dir, p=PARAMS):
    return rfm.segments_all_users(_facts(spark, sf_dir, p), p, "qcut")


def _outcomes(spark, sf_dir, p=PARAMS):
    return experiment.observed_outcomes(experiment.experiment_arms(_units(spark, sf_dir, p), p))


@register("activation_by_segment")
def q_activation_by_segment(spark, sf_dir):
    return experiment.activation_by_segment(_units(spark, sf_dir))


@register("experiment_assignment")
def q_experiment_assignment(spark, sf_dir):
    a = experiment.experiment_assignment(_units(spark, sf_dir), PARAMS)
    return a.select("user_id", F.col("activated").cast("long").alias("activated"), "segment", "draw_order", "arm")


@register("observed_outcomes")
def q_observed_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir)


@register("experiment_groups")
def q_experiment_groups(spark, sf_dir):
    return experiment.experiment_groups(_outcomes(spark, sf_dir))


@register("experiment_by_segment")
def q_experiment_by_segment(spark, sf_dir):
    return experiment.experiment_by_segment(_outcomes(spark, sf_dir))


@register("two_proportion_ztest")
def q_two_proportion_ztest(spark, sf_dir):
    return experiment.two_proportion_ztest(_outcomes(spark, sf_dir), PARAMS)


@register("proportion_ci")
def q_proportion_ci(spark, sf_dir):
    return experiment.proportion_ci(_outcomes(spark, sf_dir), PARAMS)


@register("sample_size_plan")
def q_sample_size_plan(spark, sf_dir):
    return experiment.sample_size_plan(_units(spark, sf_dir), PARAMS)


@register("power_curve")
def q_power_curve(spark, sf_dir):
    return experiment.power_curve(_units(spark, sf_dir), PARAMS)


@register("outcome_comparison")
def q_outcome_comparison(spark, sf_dir):
    return experiment.outcome_comparison(_outcomes(spark, sf_dir), PARAMS)


@register("impact_estimate")
def q_impact_estimate(spark, sf_dir):
    f = held(_facts(spark, sf_dir), "facts")
    arms = experiment.experiment_arms(rfm.segments_all_users(f, PARAMS, "qcut"), PARAMS)
    return experiment.impact_estimate(experiment.observed_outcomes(arms), experiment.impact_population(f, PARAMS))


# ---------------------------------------------------------------- A16: marts after appends
#: Mart -> (two key columns, value columns) of the long form.
MART_VALUES = {
    "aarrr_funnel": (("stage", None), ("users", "order_num")),
    "yearly_trend": (("tx_year", None), ("tx_count", "active_users", "avg_amount", "total_revenue")),
    "cohort_behavior": (("cohort_year", "years_since_first"), ("active_users", "avg_tx_per_user", "avg_revenue_per_user")),
    "rfm_segments": (("user_id", "segment"), ("recency_years", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score")),
    "ab_test_result": (("outcome", "arm"), ("conversion_rate", "lift_pp", "n", "p_value")),
    "mcc_category": (("mcc", "category"), ("tx_count", "avg_amount", "ratio")),
}


def marts_long(marts: dict[str, DataFrame]) -> DataFrame:
    """Every mart's values as rows (mart, key1, key2, metric, value)."""
    out = None
    for mart, (keys, values) in MART_VALUES.items():
        each = F.inline(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values)))
        key1, key2 = (F.col(k).cast("string") if k else F.lit(None).cast("string") for k in keys)
        rows = marts[mart].select(F.lit(mart).alias("mart"), key1.alias("key1"), key2.alias("key2"), each)
        out = rows if out is None else out.unionByName(rows)
    return out


@register("marts_refreshed")
def q_marts_refreshed(spark, sf_dir):
    """The six marts after the fact arrived in three batches (and one of them
    twice), with a compaction in between.  The fact that the batches are parts
    of is written once, so its joins are not done again for every batch."""
    from lifetrail.plans import refresh
    root = _scratch(spark, "refresh")
    raw = held(_raw(spark, sf_dir), "arrivals")
    part = F.pmod(F.xxhash64("user_id", "tx_year", "tx_month", "card"), F.lit(3))
    refresh.add_batch(raw.filter(part == 0), root, "first", PARAMS)
    refresh.add_batch(raw.filter(part == 1), root, "second", PARAMS)
    refresh.compact(spark, root, PARAMS)
    refresh.add_batch(raw.filter(part == 2), root, "third", PARAMS)
    refresh.add_batch(raw.filter(part == 1), root, "second", PARAMS)
    return marts_long(refresh.marts(spark, root, category_map(spark), PARAMS))


# ---------------------------------------------------------------- sources and sinks, written and read back
def _scratch(spark, name: str) -> str:
    import uuid

    from lifetrail.config import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _original_headers(raw: DataFrame) -> DataFrame:
    from lifetrail.sources.files import TRANSACTION_HEADER
    return raw.select(*(F.col(c).alias(h) for h, c, _ in TRANSACTION_HEADER))


@register("bulk_load_with_rejects")
def q_bulk_load_with_rejects(spark, sf_dir):
    """The fact exported as CSV (A10), with unreadable amounts on the rows of
    card 5 and impossible days on those of card 6 that are of month 2, and
    loaded again (A1, A12): per year and reason, rows and the cents of what was kept."""
    from lifetrail.sources.files import export_csv
    from lifetrail.sources.load import load_transactions
    raw = _raw(spark, sf_dir)
    broken = raw.withColumn("amount_raw", F.when(F.col("card") == 5, F.lit("n/a")).otherwise(F.col("amount_raw"))) \
                .withColumn("tx_day", F.when((F.col("card") == 6) & (F.col("tx_month") == 2), 30).otherwise(F.col("tx_day")))
    path = _scratch(spark, "csv")
    export_csv(_original_headers(broken), path)
    loaded = load_transactions(spark, path)
    kept = loaded.rows.groupBy(F.col("tx_year").cast("long").alias("tx_year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum((F.col("amount") * 100).cast("long")).alias("cents"), F.count_if("is_fraud").alias("fraud_rows"), F.count("errors").alias("error_rows"))
    reason = F.element_at("reasons", 1)
    rejects = loaded.rejects.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("row_count"))
    return kept.select(F.lit("kept").alias("reason"), "tx_year", "row_count", "cents", "fraud_rows", "error_rows").unionByName(
        rejects.select("reason", F.lit(None).cast("long").alias("tx_year"), "row_count", F.lit(None).cast("long").alias("cents"),
                       F.lit(None).cast("long").alias("fraud_rows"), F.lit(None).cast("long").alias("error_rows")))


#: Input files per arriving CSV file, the fewest files, and the fewest and most files of a micro-batch (eight make a load that is not a small one).
ARRIVAL_BYTES, LEAST_ARRIVALS, BATCH_FILES = 32 << 20, 6, (2, 8)


@register("stream_loads")
def q_stream_loads(spark, sf_dir):
    """The fact as CSV files taken in by a stream in bounded batches (A2), small
    loads merged, and the whole stream run a second time: rows and cents per
    year.  One task writes a file, so their number grows with the fact, and
    with it the number of batches, not what a task or a batch holds."""
    from lifetrail.sources.batches import read_loads
    from lifetrail.sources.files import input_bytes
    from lifetrail.streaming.ingest import ingest_csv_loads
    src, root = _scratch(spark, "arrivals"), _scratch(spark, "loads")
    raw = _raw(spark, sf_dir)
    files = max(LEAST_ARRIVALS, -(-input_bytes(raw) // ARRIVAL_BYTES))
    per_batch = max(BATCH_FILES[0], min(BATCH_FILES[1], files // 3))
    _original_headers(raw).repartition(files, "User").write.option("header", True).csv(src)
    ingest_csv_loads(spark, src, root, f"{root}-checkpoint", max_files=per_batch, most_loads=2)
    ingest_csv_loads(spark, src, root, f"{root}-checkpoint-again", max_files=per_batch, most_loads=2)
    return read_loads(spark, root).groupBy(F.col("tx_year").cast("long").alias("tx_year")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum((F.col("amount") * 100).cast("long")).alias("cents"), F.count_distinct("user_id").alias("users"))


@register("rfm_raw_from_buckets")
def q_rfm_raw_from_buckets(spark, sf_dir):
    """``rfm_raw`` from the fact bucketed and sorted by user (A7), without an exchange by user."""
    import uuid

    from lifetrail.sources.layout import bucket_transactions, buckets_of
    name, raw = f"bucketed_{uuid.uuid4().hex}", _raw(spark, sf_dir)
    bucket_transactions(raw, name, buckets_of(raw), path=_scratch(spark, "bucketed"))
    fact = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay until the query has run
    return rfm.rfm_raw(user_totals(clean(fact, PARAMS), PARAMS), PARAMS).select("user_id", "recency_years", "frequency", "monetary")


@register("marts_written")
def q_marts_written(spark, sf_dir):
    """The six marts built from the whole fact, written over older ones (A13, A16) and read back."""
    from lifetrail.plans import marts as m
    out = _scratch(spark, "marts")
    built = m.build_marts(_raw(spark, sf_dir), category_map(spark), m.run_folder(_scratch(spark, "marts-run")), PARAMS)
    m.write_marts({name: df.limit(1) for name, df in built.items()}, out)
    m.write_marts(built, out)
    return marts_long({name: spark.read.parquet(f"{out}/{name}") for name in built})


# ---------------------------------------------------------------- B18: the normal distribution as expressions
@register("refund_normal_scores")
def q_refund_normal_scores(spark, sf_dir):
    """Per category the share of refunds (with one more row of each kind) as a
    normal score: quantile, density there, and the CDF back again (6 dp)."""
    from lifetrail.functions import floor_round, normal_cdf, normal_pdf, normal_quantile
    c = _clean(spark, sf_dir).groupBy("mcc").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("amount") < 0).alias("refunds"))
    p = (F.col("refunds") + 1).cast("double") / (F.col("row_count") + 2).cast("double")
    q = c.withColumn("_q", normal_quantile(p)).withColumn("_m", normal_quantile(1 - p))
    return q.select("mcc", "row_count", "refunds", floor_round("_q", 6).alias("score"), floor_round("_m", 6).alias("mirrored"),
                    floor_round(normal_pdf("_q"), 6).alias("density"), floor_round(normal_cdf("_q"), 6).alias("share"))
