"""RFM scoring and segmentation.

R comes from recency bands; F and M are equal-count bins over users,
either SQL ``NTILE(5)`` or pandas ``qcut(rank(method='first'), 5)`` (they
differ when n mod 5 is 2, 3 or 4).  No user is numbered: the cut keys
(value, user_id) of the bins are selected, and a bin is a comparison with
them.  The users' frame is written once and read by both steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import pct, recency_score, rfm_segment, round_ratio, round_ratio_int, span_years
from lifetrail.operators.select import bin_cuts, bin_of, held

#: The orders of the F and M scores.
ORDERS = (("frequency", "user_id"), ("monetary", "user_id"))


def rfm_frame(facts: DataFrame, p: Params = Params()) -> DataFrame:
    """Every user with the RFM inputs and a cohort-eligibility flag."""
    yrs = span_years("first_year", "last_year").cast("long")
    more = [c for c in ("activated", "active_next_year") if c in facts.columns]
    return facts.select("user_id",
                        (F.lit(p.as_of_year) - F.col("last_year")).cast("long").alias("recency_years"),
                        round_ratio_int("n_tx", yrs).alias("frequency"),
                        round_ratio_int("pos_cents", yrs * 100).alias("monetary"),
                        "n_pos", *more, (F.col("first_year") >= p.min_cohort).alias("eligible"))


def rfm_raw(facts: DataFrame, p: Params = Params()) -> DataFrame:
    """Per cohort-eligible user: recency (years before the as-of year),
    transactions per year (refunds included), purchase spend per year."""
    return rfm_frame(facts, p).filter("eligible").drop("eligible")


def _scores(frame: DataFrame, p: Params, method: str):
    """R, F and M score columns for the rows of ``frame`` (a written table); the
    cuts are those of its eligible rows."""
    if method not in ("ntile", "qcut"):
        raise ValueError(method)
    counted = frame.filter("eligible") if "eligible" in frame.columns else frame
    f, m = (bin_of(order, cuts) for order, cuts in zip(ORDERS, bin_cuts(counted, list(ORDERS), p.n_bins, method)))
    return recency_score("recency_years", p.recency_bands), f, m


def scored_users(facts: DataFrame, p: Params = Params(), method: str = "qcut") -> tuple[DataFrame, DataFrame]:
    """The eligible users with their scores (``rfm_scored``), and every user
    with activation flag and segment (``segments_all_users``), from one
    written frame and one selection of cut keys."""
    frame = held(rfm_frame(facts, p), "rfm-users")
    r, f, m = _scores(frame, p, method)
    own = [c for c in frame.columns if c != "eligible"]
    scored = frame.filter("eligible").select(*own, r.alias("r_score"), f.alias("f_score"), m.alias("m_score"))
    seg = F.when(F.col("eligible"), rfm_segment(r + f + m, r, f, m, p.segment_cuts)).otherwise(F.lit(p.default_segment))
    return scored, frame.select("user_id", *(c for c in ("activated", "active_next_year") if c in own), seg.alias("segment"))


def segments_all_users(facts: DataFrame, p: Params = Params(), method: str = "qcut") -> DataFrame:
    """Every user with activation flag and segment: eligible users are
    scored (bins over the eligible users only), the others get
    ``default_segment``."""
    return scored_users(facts, p, method)[1]


def rfm_scored(raw: DataFrame, p: Params = Params(), method: str = "ntile") -> DataFrame:
    """Add r_score (bands), f_score and m_score (equal-count bins)."""
    frame = held(raw, "rfm-users")
    r, f, m = _scores(frame, p, method)
    return frame.select(*raw.columns, r.alias("r_score"), f.alias("f_score"), m.alias("m_score"))


def rfm_quantile_recency(raw: DataFrame, p: Params = Params()) -> DataFrame:
    """R by quantile cut of recency with duplicate edges dropped, inverted
    so the most recent bin scores highest (the abandoned variant)."""
    probs = [i / p.n_bins for i in range(p.n_bins + 1)]
    edges = F.array_distinct(raw.select(F.percentile("recency_years", probs)).scalar())
    m = F.size(edges) - 1
    x = F.col("recency_years")
    label = sum(F.when(F.try_element_at(edges, F.lit(j)) < x, 1).otherwise(0) for j in range(2, p.n_bins + 2))
    return raw.select("user_id", "recency_years",
                      F.greatest(F.lit(1), m - label).cast("int").alias("r_score"))


def rfm_segments(scored: DataFrame, p: Params = Params()) -> DataFrame:
    """Total score and segment label (VIP / Loyal / Potential / At Risk / Dormant)."""
    score = (F.col("r_score") + F.col("f_score") + F.col("m_score")).cast("int")
    return scored.select("*", score.alias("rfm_score"),
                         rfm_segment(score, "r_score", "f_score", "m_score", p.segment_cuts).alias("segment"))


def rfm_segment_summary(segments: DataFrame) -> DataFrame:
    """Segment -> users, share (2 dp), mean recency (1 dp), frequency (0 dp),
    monetary (0 dp) and score (1 dp)."""
    g = segments.groupBy("segment").agg(
        F.count(F.lit(1)).alias("user_count"),
        F.sum("recency_years").alias("_r"), F.sum("frequency").alias("_f"),
        F.sum("monetary").alias("_m"), F.sum("rfm_score").alias("_s"))
    total = F.sum("user_count").over(Window.partitionBy())
    return g.select("segment", segment_order("segment").alias("segment_order"),
                    "user_count", pct("user_count", total, 2).alias("ratio"),
                    round_ratio("_r", "user_count", 1).alias("avg_recency"),
                    round_ratio_int("_f", "user_count").alias("avg_frequency"),
                    round_ratio_int("_m", "user_count").alias("avg_monetary"),
                    round_ratio("_s", "user_count", 1).alias("avg_rfm_score")) \
            .orderBy(F.desc("avg_rfm_score"), "segment")


SEGMENT_ORDER = ("VIP", "Loyal", "Potential", "At Risk", "Dormant")


def segment_order(col, order=SEGMENT_ORDER):
    """Position of a segment label in the declared order (unknown labels last)."""
    c = F.col(col) if isinstance(col, str) else col
    e = F.when(c == order[0], 1)
    for i, label in enumerate(order[1:], start=2):
        e = e.when(c == label, i)
    return e.otherwise(len(order) + 1).cast("long")
