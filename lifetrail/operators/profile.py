"""Profiling analyses over a transaction frame (raw or clean; the caller
chooses the base)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import cents, money, pct, round_ratio
from lifetrail.operators.prepare import not_fraud


def _distinct(col: str, approx: bool):
    return F.approx_count_distinct(col) if approx else F.count_distinct(col)


def profile_range(tx: DataFrame, approx: bool = False) -> DataFrame:
    """Year range and distinct years, months, users, merchants, categories."""
    return tx.agg(
        F.min("tx_year").cast("long").alias("min_year"),
        F.max("tx_year").cast("long").alias("max_year"),
        _distinct("tx_year", approx).alias("year_count"),
        _distinct("tx_month", approx).alias("month_count"),
        _distinct("user_id", approx).alias("user_count"),
        _distinct("merchant_name", approx).alias("merchant_count"),
        _distinct("mcc", approx).alias("mcc_count"))


def profile_amount(tx: DataFrame) -> DataFrame:
    """Amount min / max / mean (2 dp), refund count, row count."""
    g = tx.agg(F.min("amount").alias("_min"), F.max("amount").alias("_max"),
               F.sum(cents("amount")).alias("_sum"), F.count("amount").alias("_n"),
               F.count_if(F.col("amount") < 0).alias("negative_count"),
               F.count(F.lit(1)).alias("total_count"))
    return g.select(F.col("_min").cast("double").alias("min_amount"),
                    F.col("_max").cast("double").alias("max_amount"),
                    round_ratio("_sum", F.col("_n") * 100, 2).alias("avg_amount"),
                    "negative_count", "total_count")


def refund_detail_top(tx: DataFrame, p: Params = Params()) -> DataFrame:
    """Refund rows grouped by (chip, city, category, error, amount), top-k by count.

    Strict grouping (every selected column is a key); ties are broken by
    the keys so the cut is deterministic."""
    keys = ["use_chip", "merchant_city", "mcc", "errors", "amount"]
    g = tx.filter(F.col("amount") < 0).groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))
    return (g.orderBy(F.desc("cnt"), *[F.col(k).asc_nulls_first() for k in keys])
             .limit(p.top_k)
             .withColumn("amount", F.col("amount").cast("double")))


def _share(g: DataFrame, k: int) -> DataFrame:
    total = F.sum("cnt").over(Window.partitionBy())
    return g.withColumn("ratio", pct("cnt", total, k))


def refund_error_share(tx: DataFrame) -> DataFrame:
    """Refunds by error value with percentage (2 dp)."""
    g = tx.filter(F.col("amount") < 0).groupBy("errors").agg(F.count(F.lit(1)).alias("cnt"))
    return _share(g, 2).orderBy(F.desc("cnt"), F.col("errors").asc_nulls_first())


def fraud_share(raw: DataFrame) -> DataFrame:
    """Rows by fraud flag with percentage (4 dp), on the raw table."""
    g = raw.groupBy(F.col("is_fraud").cast("string").alias("is_fraud")) \
           .agg(F.count(F.lit(1)).alias("cnt"))
    return _share(g, 4)


def error_share(tx: DataFrame) -> DataFrame:
    """Rows by error type with percentage (4 dp)."""
    g = tx.groupBy(F.col("errors").alias("error_type")).agg(F.count(F.lit(1)).alias("cnt"))
    return _share(g, 4).orderBy(F.desc("cnt"), F.col("error_type").asc_nulls_first())


NULL_PROFILE = (("user_null", "user_id"), ("amount_null", "amount"), ("year_null", "tx_year"),
                ("mcc_null", "mcc"), ("city_null", "merchant_city"),
                ("state_null", "merchant_state"), ("zip_null", "zip"))


def null_profile(tx: DataFrame, columns=NULL_PROFILE) -> DataFrame:
    """Null count per column, one aggregate pass."""
    return tx.agg(*[F.count_if(F.col(c).isNull()).alias(name) for name, c in columns])


def amount_outliers(tx: DataFrame, p: Params = Params()) -> DataFrame:
    """Purchases: rows, rows above the two report bands, mean, min, max."""
    g = tx.filter(F.col("amount") > 0).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("amount") > p.outlier_band_low).alias("over_low"),
        F.count_if(F.col("amount") > p.outlier_band_high).alias("over_high"),
        F.sum(cents("amount")).alias("_sum"),
        F.min(cents("amount")).alias("_min"), F.max(cents("amount")).alias("_max"))
    return g.select("total", "over_low", "over_high",
                    round_ratio("_sum", F.col("total") * 100, 2).alias("avg_amount"),
                    money("_min").alias("min_amount"), money("_max").alias("max_amount"))


def category_stats(tx: DataFrame, purchases_only: bool = False) -> DataFrame:
    """Per category: rows, distinct users, mean amount (2 dp), share of all rows.

    With ``purchases_only`` the numerator counts purchases while the
    denominator stays all rows (the export variant of the original).  The
    denominator is a window sum over the aggregated categories, not a
    second scan."""
    keep = (F.col("amount") > 0) if purchases_only else F.lit(True)
    g = tx.groupBy("mcc").agg(
        F.count_if(keep).alias("tx_count"),
        F.count_distinct(F.when(keep, F.col("user_id"))).alias("user_count"),
        F.sum(F.when(keep, cents("amount"))).alias("_sum"),
        F.count(F.when(keep, F.col("amount"))).alias("_n"),
        F.count(F.lit(1)).alias("_all"))
    total = F.sum("_all").over(Window.partitionBy())
    out = g.select("mcc", "tx_count", "user_count",
                   F.when(F.col("_n") > 0, round_ratio("_sum", F.col("_n") * 100, 2)).alias("avg_amount"),
                   pct("tx_count", total, 2).alias("ratio"))
    return out.filter(F.col("tx_count") > 0) if purchases_only else out


def category_top(tx: DataFrame, p: Params = Params(), purchases_only: bool = False) -> DataFrame:
    """Top-k categories by rows (ties by category code)."""
    return (category_stats(tx, purchases_only)
            .orderBy(F.desc("tx_count"), F.col("mcc").asc_nulls_first()).limit(p.top_k))


def category_top_from_sums(sums: DataFrame, p: Params = Params()) -> DataFrame:
    """Top-k categories by purchases from category sums (``state.category_state``):
    purchases, mean amount, share of all rows."""
    total = F.sum("n_tx").over(Window.partitionBy())
    stats = sums.select("mcc", F.col("n_pos").alias("tx_count"), F.when(F.col("n_pos") > 0, round_ratio("pos_cents", F.col("n_pos") * 100, 2)).alias("avg_amount"),
                        pct("n_pos", total, 2).alias("ratio")).filter(F.col("tx_count") > 0)
    return stats.orderBy(F.desc("tx_count"), F.col("mcc").asc_nulls_first()).limit(p.top_k)


def with_category_label(stats: DataFrame, mapping: DataFrame, default: str = "other") -> DataFrame:
    """Category rows with the mapping's detail label."""
    m = mapping.select(F.col("code").alias("mcc"), F.col("detail").alias("category"))
    return stats.join(m, "mcc", "left").select("mcc", "tx_count", "avg_amount", "ratio", F.coalesce("category", F.lit(default)).alias("category"))


def mapping_frame(spark, pairs, key="code", value="label") -> DataFrame:
    """Code -> label table from (code, label) pairs; a repeated code keeps
    its last label, as a Python dict literal would."""
    last = {}
    for k, v in pairs:
        last[k] = v
    return spark.createDataFrame(list(last.items()), f"{key} string, {value} string")


def category_rollup(tx: DataFrame, mapping: DataFrame, p: Params = Params(),
                    top_k: int | None = None, default: str = "other") -> DataFrame:
    """Category counts rolled up to the mapping's detail label and large group.

    ``mapping`` has columns (code, detail, large_group).  ``top_k=None`` rolls
    up every category instead of the top-k rows only."""
    stats = category_stats(tx).select("mcc", "tx_count")
    if top_k is not None:
        stats = stats.orderBy(F.desc("tx_count"), F.col("mcc").asc_nulls_first()).limit(top_k)
    m = mapping.select(F.col("code").alias("mcc"), "detail", "large_group")
    j = stats.join(m, "mcc", "left")
    large = j.groupBy(F.coalesce("large_group", F.lit(default)).alias("label")) \
             .agg(F.sum("tx_count").cast("long").alias("tx_count")) \
             .withColumn("level", F.lit("large"))
    detail = j.groupBy(F.coalesce("detail", F.lit(default)).alias("label")) \
              .agg(F.sum("tx_count").cast("long").alias("tx_count")) \
              .withColumn("level", F.lit("detail"))
    return large.unionByName(detail).select("level", "label", "tx_count") \
                .orderBy("level", F.desc("tx_count"), "label")


def yearly_trend(tx: DataFrame) -> DataFrame:
    """Purchases per year: rows, active users, mean amount, revenue."""
    g = tx.filter(F.col("amount") > 0).groupBy("tx_year").agg(
        F.count(F.lit(1)).alias("tx_count"),
        F.count_distinct("user_id").alias("active_users"),
        F.sum(cents("amount")).alias("_sum"))
    return g.select(F.col("tx_year").cast("long").alias("tx_year"), "tx_count", "active_users",
                    round_ratio("_sum", F.col("tx_count") * 100, 2).alias("avg_amount"),
                    money("_sum").alias("total_revenue")).orderBy("tx_year")


def yearly_trend_from_years(user_years: DataFrame) -> DataFrame:
    """``yearly_trend`` from the per-(user, year) table: purchase rows,
    purchasing users and purchase cents per year are sums over it."""
    return _trend(user_years.filter(F.col("n_pos") > 0).groupBy("tx_year").agg(
        F.sum("n_pos").cast("long").alias("tx_count"), F.count(F.lit(1)).alias("active_users"), F.sum("pos_cents").alias("_sum")))


def yearly_trend_from_cube(cells: DataFrame) -> DataFrame:
    """``yearly_trend`` from the (cohort year, year) cube."""
    return _trend(cells.groupBy("tx_year").agg(
        F.sum("n_pos").cast("long").alias("tx_count"), F.sum("buyers").cast("long").alias("active_users"), F.sum("pos_cents").alias("_sum")).filter(F.col("active_users") > 0))


def _trend(g: DataFrame) -> DataFrame:
    return g.select(F.col("tx_year").cast("long").alias("tx_year"), "tx_count", "active_users",
                    round_ratio("_sum", F.col("tx_count") * 100, 2).alias("avg_amount"),
                    money("_sum").alias("total_revenue")).orderBy("tx_year")


def partial_period_check(raw: DataFrame, p: Params = Params()) -> DataFrame:
    """Months present in the excluded (partial) last year, non-fraud rows."""
    y = raw.filter(not_fraud(raw) & (F.col("tx_year") == p.last_year_excl))
    return (y.groupBy((F.col("tx_year") * 100 + F.col("tx_month")).cast("long").alias("year_month"))
             .agg(F.count(F.lit(1)).alias("tx_count")).orderBy("year_month"))


def population_reconciliation(raw: DataFrame, users: DataFrame, p: Params = Params()) -> DataFrame:
    """Distinct users: raw -> non-fraud -> clean window -> dimension keys.

    One pass over the fact: per-user flags (partial aggregation before the
    shuffle), then conditional counts over users."""
    nf = not_fraud(raw)
    per_user = raw.groupBy("user_id").agg(
        F.max(nf.cast("int")).alias("nf"),
        F.max((nf & (F.col("tx_year") < p.last_year_excl)).cast("int")).alias("cl"))
    c = per_user.agg(F.count(F.lit(1)).alias("raw"), F.count_if(F.col("nf") == 1).alias("non_fraud"),
                     F.count_if(F.col("cl") == 1).alias("clean"))
    d = users.agg(F.count_distinct("user_id").alias("users"))

    def row(stage, col, order):
        return F.struct(F.lit(stage).alias("stage"), F.col(col).alias("users"),
                        F.lit(order).cast("long").alias("order_num"))

    fact_rows = c.select(F.inline(F.array(row("raw", "raw", 1), row("non_fraud", "non_fraud", 2),
                                          row("clean", "clean", 3))))
    dim_row = d.select(F.lit("dimension").alias("stage"), "users", F.lit(4).cast("long").alias("order_num"))
    return fact_rows.unionByName(dim_row)
