"""Distributed exact ranking, NTILE / qcut bins and exact quantiles.

A window ``ORDER BY x`` without ``PARTITION BY`` moves every row into a
single task.  Here the rows are dealt into buckets of the total order
(x, tie key): the bucket edges are values, taken once from a sample of
the rows with the smallest key hashes, and a row's bucket is a plain
column computed by binary search in them.  Rows are numbered within their
bucket, and a count per bucket (one row per bucket) gives the offsets;
``offset + local number`` is the exact global rank whatever the edges
are.  Nothing depends on two branches sharing an exchange, or on how rows
were partitioned.  Ties are broken by the tie key, so a value shared by a
third of all rows is still split across buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Sampled rows per bucket, and the most buckets (both bound the sample).
SAMPLE_PER_BUCKET, MOST_BUCKETS = 32, 2048


def _buckets(df: DataFrame, partitions: int | None) -> int:
    wanted = int(partitions or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(MOST_BUCKETS, wanted))


def _dealt(narrow: DataFrame, key, tie_cols, buckets: int) -> DataFrame:
    """``narrow`` with ``_b``, the number of sampled edges below a row's key:
    binary search in an array of at most ``buckets - 1`` values, which comes
    from a scalar subquery."""
    steps = max(1, (buckets - 1).bit_length())
    size = buckets * SAMPLE_PER_BUCKET
    picked = narrow.orderBy(F.xxhash64(*tie_cols), *tie_cols).limit(size).select(key.alias("k"))
    held = F.sort_array(F.collect_list("k"))
    every = F.greatest(F.floor(F.size(held) / buckets).cast("int"), F.lit(1))
    edges = picked.agg(F.filter(held, lambda k, i: (i % every == 0) & (i > 0) & (i < every * buckets)).alias("e")).scalar()

    def step(at, p):
        edge = F.get(F.col("_e"), at + p - 1)
        return at + F.when(edge < key, p).otherwise(0)

    halves = F.array(*(F.lit(1 << s) for s in reversed(range(steps + 1))))
    return narrow.withColumn("_e", edges).withColumn("_b", F.aggregate(halves, F.lit(0), step)).drop("_e")


def rank_keys(df: DataFrame, order_cols, tie_cols=("user_id",), *, rank_col: str = "rank",
              n_col: str = "n", partitions: int | None = None) -> DataFrame:
    """Exact 1-based rank of every row of the narrow projection
    (order_cols..., tie_cols...) under that total order (nulls first);
    returns those columns plus ``rank_col`` and ``n_col``."""
    order_cols, tie_cols = list(order_cols), list(tie_cols)
    names = order_cols + tie_cols
    narrow = df.select(*names)
    key = F.struct(*(F.col(c) for c in names))
    buckets = _buckets(df, partitions)
    dealt = _dealt(narrow, key, tie_cols, buckets) if buckets > 1 else narrow.withColumn("_b", F.lit(0))
    inside = Window.partitionBy("_b").orderBy(*(F.col(c).asc_nulls_first() for c in names))
    numbered = dealt.withColumn("_lrn", F.row_number().over(inside))
    counts = dealt.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_b",
        F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"),
        F.sum("_cnt").over(Window.partitionBy()).alias(n_col),
    )
    # one row per bucket, MOST_BUCKETS at most
    return (numbered.join(F.broadcast(offsets), "_b")
                    .select(*names, (F.col("_off") + F.col("_lrn")).cast("long").alias(rank_col),
                            F.col(n_col).cast("long").alias(n_col)))


def exact_rank(df: DataFrame, order_col: str, tie_col: str = "user_id", *,
               rank_col: str = "rank", n_col: str = "n", partitions: int | None = None) -> DataFrame:
    """Add ``rank_col`` (1..n over (order_col, tie_col)) and ``n_col``.

    ``tie_col`` must be unique per row (it makes the order total); the
    rank computed on the narrow projection is joined back on it."""
    keys = rank_keys(df, [order_col], [tie_col], rank_col=rank_col, n_col=n_col, partitions=partitions)
    return df.join(keys.drop(order_col), tie_col, "inner")


def multi_rank(df: DataFrame, metrics, tie_cols=("user_id",), *, partitions: int | None = None) -> DataFrame:
    """Exact ranks of several metrics with one range exchange.

    The metrics are stacked as rows (metric index, value, tie...), ranked
    once under (metric index, value, tie), and pivoted back: one row per
    tie key with ``rank_<metric>`` columns and ``n``.  Every row carries
    each metric once, so the rank within metric ``i`` is the stacked rank
    minus ``i * n``.  The metric values are returned too, so callers can
    join the ranks back on the full key they were computed for (which also
    keeps both sides of that join reading the same upstream columns, so
    Spark can reuse one exchange for them).  The metrics must share one
    type."""
    metrics, tie_cols = list(metrics), list(tie_cols)
    stacked = df.select(*tie_cols, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_m"), F.col(m).alias("_v")) for i, m in enumerate(metrics)])))
    r = rank_keys(stacked, ["_m", "_v"], tie_cols, rank_col="_r", n_col="_nn", partitions=partitions)
    n = (F.col("_nn") / len(metrics)).cast("long")
    within = F.col("_r") - F.col("_m") * n
    return r.groupBy(*tie_cols).agg(
        *[F.max(F.when(F.col("_m") == i, F.col("_v"))).alias(m) for i, m in enumerate(metrics)],
        *[F.max(F.when(F.col("_m") == i, within)).alias(f"rank_{m}") for i, m in enumerate(metrics)],
        F.max(n).alias("n"))


def exact_quantiles(df: DataFrame, value_col: str, probs: dict, tie_col: str = "user_id",
                    partitions: int | None = None) -> DataFrame:
    """Interpolated quantiles (``percentile_cont``) as one row.

    ``probs`` maps output column -> probability.  Only the rows at the
    needed ranks survive the filter, so the final aggregate is tiny.
    """
    r = rank_keys(df, [value_col], [tie_col], rank_col="_r", n_col="_n", partitions=partitions)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        lo = F.floor(pos).cast("long") + 1
        hi = F.ceil(pos).cast("long") + 1
        aggs += [F.max(F.when(F.col("_r") == lo, F.col(value_col))).alias(f"_{name}_lo"),
                 F.max(F.when(F.col("_r") == hi, F.col(value_col))).alias(f"_{name}_hi"),
                 F.max(pos - F.floor(pos)).alias(f"_{name}_fr")]
    wanted = None
    for p in probs.values():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        cond = (F.col("_r") == F.floor(pos) + 1) | (F.col("_r") == F.ceil(pos) + 1)
        wanted = cond if wanted is None else (wanted | cond)
    g = r.filter(wanted).agg(*aggs)
    outs = []
    for name in probs:
        lo, hi, fr = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double"), F.col(f"_{name}_fr")
        outs.append((lo + fr * (hi - lo)).alias(name))
    return g.select(*outs)


def stacked_summary(df: DataFrame, metrics, probs: dict, tie_col: str = "user_id",
                    partitions: int | None = None) -> DataFrame:
    """One row per metric: count, exact integer sum and sum of squares,
    min, max and interpolated quantiles (``percentile_cont``), from a single
    pass: the metrics are stacked as rows and ranked in one exchange.
    Metric values must be integral (they are summed as DECIMAL(38,0))."""
    metrics = list(metrics)
    stacked = df.select(tie_col, F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("long").alias("_v")) for m in metrics])))
    stacked = stacked.filter(F.col("_v").isNotNull())
    r = rank_keys(stacked, ["metric", "_v"], [tie_col], rank_col="_r", n_col="_nn", partitions=partitions)
    # start and size of each metric's block in the stacked order: a partial
    # aggregate per metric (one row per metric, broadcast back), never a
    # window over all rows of a metric
    blocks = r.groupBy("metric").agg(F.min("_r").alias("_first"), F.count(F.lit(1)).alias("_n"))
    r = r.join(F.broadcast(blocks), "metric")
    rr = F.col("_r") - F.col("_first") + 1
    x = F.col("_v").cast("decimal(38,0)")
    aggs = [F.count(F.lit(1)).alias("count"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_sq"),
            F.min("_v").alias("min"), F.max("_v").alias("max")]
    for name, p in probs.items():
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        aggs += [F.max(F.when(rr == F.floor(pos) + 1, F.col("_v"))).alias(f"_{name}_lo"),
                 F.max(F.when(rr == F.ceil(pos) + 1, F.col("_v"))).alias(f"_{name}_hi"),
                 F.max(pos - F.floor(pos)).alias(f"_{name}_fr")]
    g = r.groupBy("metric").agg(*aggs)
    outs = []
    for name in probs:
        lo, hi = F.col(f"_{name}_lo").cast("double"), F.col(f"_{name}_hi").cast("double")
        outs.append((lo + F.col(f"_{name}_fr") * (hi - lo)).alias(name))
    return g.select("metric", "count", "sum", "sum_sq", "min", "max", *outs)
