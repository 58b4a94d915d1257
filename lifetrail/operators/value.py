"""Period-adjusted lifetime value per user and its distribution.

``annual_ltv`` = purchase total (monetary view) / active span in years,
where the span is ``last - first`` with 0 replaced by 1.  Summary
quantiles come from distributed selection: no user is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import idiv, money, round_ratio_int, span_years
from lifetrail.operators.select import held, quantiles


def annual_ltv(facts: DataFrame, p: Params = Params(), int_division: bool = False) -> DataFrame:
    """Per cohort-eligible user with purchases: span, totals, annual LTV and tx.

    ``int_division=True`` truncates the annual transaction count (the
    SQLite variant); the default rounds it."""
    f = facts.filter((F.col("first_year") >= p.min_cohort) & (F.col("ltv_n") > 0))
    yrs = span_years("first_year", "last_year").cast("long")
    annual_tx = idiv("total_tx", "active_years") if int_division else round_ratio_int("total_tx", "active_years")
    return (f.select("user_id", F.col("first_year").cast("long").alias("cohort_year"),
                     F.col("last_year").cast("long").alias("last_year"), yrs.alias("active_years"),
                     "ltv_cents", F.col("ltv_n").alias("total_tx"))
             .withColumn("total_revenue", money("ltv_cents"))
             .withColumn("annual_ltv", round_ratio_int("ltv_cents", F.col("active_years") * 100))
             .withColumn("annual_tx", annual_tx.cast("long"))
             .drop("ltv_cents"))


def _half_up(c):
    return F.floor(c + 0.5).cast("long")


def metric_summary(df: DataFrame, metrics, probs: dict) -> DataFrame:
    """One row per metric: count, exact integer sum and sum of squares, min,
    max and interpolated quantiles.  The metrics (integral) are written
    once; one aggregate gives the moments, selection the quantiles."""
    metrics = list(metrics)
    frame = held(df.select(*(F.col(m).cast("long").alias(m) for m in metrics)), "metrics")
    x = {m: F.col(m).cast("decimal(38,0)") for m in metrics}
    sums = frame.agg(*(F.struct(F.count(m).alias("count"), F.sum(x[m]).alias("sum"), F.sum(x[m] * x[m]).alias("sum_sq"), F.min(m).alias("min"), F.max(m).alias("max")).alias(m) for m in metrics)).first()
    found = quantiles(frame, metrics, list(probs.values()), {m: sums[m]["count"] for m in metrics})
    rows = [(m, *sums[m], *found[m]) for m in metrics if sums[m]["count"]]
    schema = "metric string, count long, sum decimal(38,0), sum_sq decimal(38,0), min long, max long, " + ", ".join(f"{name} double" for name in probs)
    return df.sparkSession.createDataFrame(rows, schema)


def ltv_summary(annual: DataFrame) -> DataFrame:
    """Users, mean / min / max / median / 75th percentile of annual LTV (0 dp)."""
    st = metric_summary(annual, ["annual_ltv"], {"median": 0.5, "p75": 0.75})
    return st.select(F.col("count").alias("total_users"),
                     round_ratio_int(F.col("sum").cast("long"), "count").alias("avg_annual_ltv"),
                     F.col("min").alias("min_annual_ltv"), F.col("max").alias("max_annual_ltv"),
                     _half_up(F.col("median")).alias("median_annual_ltv"),
                     _half_up(F.col("p75")).alias("p75_annual_ltv"))


def ltv_distribution(annual: DataFrame, metrics=("annual_ltv", "annual_tx"), bins: int = 50) -> DataFrame:
    """Equal-width histogram (``bins`` bins over [min, max]) of each metric.

    Bin index is computed in integers: ``(x - min) * bins div (max - min) + 1``,
    the maximum falls in the last bin.  Only non-empty bins are returned.
    All minima and maxima come from one scalar subquery (one pass), the
    counts from a second pass over the stacked metrics."""
    metrics = list(metrics)
    ranges = annual.select(F.struct(*[x for m in metrics for x in (F.min(m).alias(f"{m}_mn"),
                                                                      F.max(m).alias(f"{m}_mx"))])).scalar()
    rows = annual.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("v"),
                 ranges.getField(f"{m}_mn").cast("long").alias("mn"),
                 ranges.getField(f"{m}_mx").cast("long").alias("mx")) for m in metrics])))
    width = F.col("mx") - F.col("mn")
    b = F.when(width == 0, F.lit(1)).otherwise(
        F.least(F.lit(bins), idiv((F.col("v") - F.col("mn")) * bins, width) + 1)).cast("long")
    g = rows.filter(F.col("v").isNotNull()).groupBy("metric", b.alias("bin"), "mn", "mx") \
            .agg(F.count(F.lit(1)).alias("users"))
    w = F.col("mx") - F.col("mn")
    return g.select("metric", "bin",
                    (F.col("mn") + (F.col("bin") - 1).cast("double") * w / bins).cast("double").alias("bin_low"),
                    (F.col("mn") + F.col("bin").cast("double") * w / bins).cast("double").alias("bin_high"),
                    "users").orderBy("metric", "bin")


def ltv_describe(annual: DataFrame, metrics=("annual_ltv", "annual_tx")) -> DataFrame:
    """count / mean / std / min / quartiles / max per metric (pandas describe).

    Mean and sample variance come from exact integer sums, so they do not
    depend on summation order."""
    st = metric_summary(annual, metrics, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    n = F.col("count").cast("decimal(38,0)")
    num = n * F.col("sum_sq") - F.col("sum") * F.col("sum")
    den = n * (F.col("count") - 1).cast("decimal(38,0)")
    return st.select("metric", "count",
                     (F.col("sum").cast("double") / F.col("count").cast("double")).alias("mean"),
                     F.when(F.col("count") > 1, F.sqrt(num.cast("double") / den.cast("double"))).alias("std"),
                     F.col("min").cast("double").alias("min"), "q25", "q50", "q75",
                     F.col("max").cast("double").alias("max"))
