"""Segment behaviour: what and when each RFM segment buys.

The original pulls the multi-million-row purchase fact into one process
and merges the segment label onto every row.  Here the fact is reduced
once to (user, year, month, category) with map-side partial aggregation;
the users' totals (and with them their segments), categories and months
are all aggregates of that table, so the fact is scanned once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import cents, money, pct

VIEW_SEGMENTS = ("VIP", "Potential", "Loyal")


def segment_transactions(segments: DataFrame) -> DataFrame:
    """Purchase rows of cohort-eligible users per segment (value counts).

    ``segments`` carries each user's purchase count (``n_pos``), so no
    join with the fact is needed."""
    return (segments.groupBy("segment").agg(F.sum("n_pos").cast("long").alias("tx_count"))
                    .orderBy(F.desc("tx_count"), "segment"))


def user_activity(clean_df: DataFrame, p: Params = Params()) -> DataFrame:
    """(user, year, month, category) -> rows, purchases and their cents."""
    c = F.col("c")
    pos = c > 0
    ltv = pos & F.col("errors").isNull() & (c <= p.outlier_cap * 100)
    rows = clean_df.select("user_id", "tx_year", "tx_month", "mcc", "errors", cents("amount").alias("c"))
    return rows.groupBy("user_id", "tx_year", "tx_month", "mcc").agg(
        F.count(F.lit(1)).alias("n_tx"), F.count_if(pos).alias("n_pos"), F.sum(F.when(pos, c).otherwise(F.lit(0))).alias("pos_cents"),
        F.count_if(ltv).alias("ltv_n"), F.sum(F.when(ltv, c).otherwise(F.lit(0))).alias("ltv_cents"))


def totals_from_activity(activity: DataFrame, p: Params = Params()) -> DataFrame:
    """``user_totals`` as an aggregate of ``user_activity``."""
    year = F.col("tx_year")
    return activity.groupBy("user_id").agg(
        F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.min(F.when(year >= p.min_cohort, year)).alias("first_year_truncated"),
        *(F.sum(x).alias(x) for x in ("n_tx", "n_pos", "pos_cents", "ltv_n", "ltv_cents")))


def labelled_purchases(clean_df: DataFrame, segments: DataFrame) -> DataFrame:
    """The purchase fact with its segment label, for callers who want rows.

    The labels (one row per user) meet the fact in an equi-join whose hot
    partitions Spark splits (adaptive skew join); a broadcast is not forced."""
    return clean_df.filter(F.col("amount") > 0).join(segments.select("user_id", "segment"), "user_id", "inner")


def segment_category_mix(activity: DataFrame, segments: DataFrame, mapping: DataFrame,
                         default: str = "other") -> DataFrame:
    """(segment, category group) -> purchases, amount, share within segment (1 dp).

    ``mapping`` has columns (code, detail, large_group)."""
    m = mapping.select(F.col("code").alias("mcc"), "large_group")
    per_user = activity.filter(F.col("n_pos") > 0).groupBy("user_id", "mcc").agg(F.sum("n_pos").alias("n"), F.sum("pos_cents").alias("c"))
    j = per_user.join(segments.select("user_id", "segment"), "user_id", "inner") \
                .groupBy("segment", "mcc").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).join(m, "mcc", "left")
    g = j.groupBy("segment", F.coalesce("large_group", F.lit(default)).alias("category")).agg(
        F.sum("n").cast("long").alias("tx_count"), F.sum("c").alias("_c"))
    seg_total = F.sum("tx_count").over(Window.partitionBy("segment"))
    return (g.select("segment", "category", "tx_count", money("_c").alias("total_amount"),
                     pct("tx_count", seg_total, 1).alias("ratio"))
             .orderBy("segment", F.desc("tx_count"), "category"))


def segment_category_matrix(mix: DataFrame, segments=VIEW_SEGMENTS) -> DataFrame:
    """Category x segment share matrix, missing cells 0, sorted by the first segment."""
    cols = [s.lower().replace(" ", "_") for s in segments]
    w = mix.filter(F.col("segment").isin(*segments)).groupBy("category") \
           .pivot("segment", list(segments)).agg(F.first("ratio"))
    w = w.select("category", *[F.coalesce(F.col(s), F.lit(0.0)).alias(c) for s, c in zip(segments, cols)])
    return w.orderBy(F.desc(cols[0]), "category")


def segment_top_categories(mix: DataFrame, p: Params = Params()) -> DataFrame:
    """Top ``top_per_segment`` categories of each segment by share."""
    w = Window.partitionBy("segment").orderBy(F.desc("ratio"), F.desc("tx_count"), "category")
    return (mix.withColumn("rank", F.row_number().over(w).cast("long"))
               .filter(F.col("rank") <= p.top_per_segment)
               .select("segment", "rank", "category", "tx_count", "ratio")
               .orderBy("segment", "rank"))


def segment_seasonality(activity: DataFrame, segments: DataFrame) -> DataFrame:
    """(segment, calendar month) -> purchases and share within segment (1 dp)."""
    per_user = activity.filter(F.col("n_pos") > 0).groupBy("user_id", "tx_month").agg(F.sum("n_pos").alias("n"))
    j = per_user.join(segments.select("user_id", "segment"), "user_id", "inner")
    g = j.groupBy("segment", F.col("tx_month").cast("long").alias("tx_month")) \
         .agg(F.sum("n").cast("long").alias("tx_count"))
    seg_total = F.sum("tx_count").over(Window.partitionBy("segment"))
    return g.withColumn("ratio", pct("tx_count", seg_total, 1)).orderBy("segment", "tx_month")
