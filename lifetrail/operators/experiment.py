"""Experiment evaluation: assignment, observed outcomes, tests, planning.

Users are drawn into two arms by an md5 order of (user, seed), which
depends on values only and can be reproduced in any SQL engine.  The
outcomes are what the tables show (activation, return in the next year),
so without a treatment the two arms differ by chance alone.  The normal
CDF is a pure Column expression; quantiles of the normal depend on
parameters only and are computed once on the driver.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lifetrail.config import Params
from lifetrail.functions import floor_round, md5_key, normal_cdf, pct, round_ratio, whole
from lifetrail.operators.rank import rank_keys
from lifetrail.operators.select import held, keys_at

#: Observed outcomes: name -> per-user 0/1 column.
OUTCOMES = {"activation": "activated", "next_year_return": "active_next_year"}


def z_quantile(q: float) -> float:
    return NormalDist().inv_cdf(q)


def activation_by_segment(units: DataFrame) -> DataFrame:
    """Segment -> users, activated users, activation rate (3 dp)."""
    g = units.groupBy("segment").agg(F.count(F.lit(1)).alias("user_count"),
                                     F.sum("activated").cast("long").alias("activated"))
    return g.withColumn("activation_rate", round_ratio("activated", "user_count", 3)).orderBy("segment")


def experiment_assignment(units: DataFrame, p: Params = Params()) -> DataFrame:
    """Draw users without replacement (md5 order) into two arms: the first n
    are control, the next n treatment.  ``n_per_group`` None takes half of
    all users each.

    The order is a distributed rank, so any n works without sorting the
    drawn users in one task; the other columns ride along as tie keys, so
    nothing is joined back."""
    keyed = units.withColumn("_k", md5_key("user_id", F.lit(p.seed)))
    ties = ["user_id", *(c for c in units.columns if c != "user_id")]
    ranked = rank_keys(keyed, ["_k"], ties, rank_col="draw_order", n_col="_n")
    n = F.lit(p.n_per_group).cast("long") if p.n_per_group else F.floor(F.col("_n") / 2).cast("long")
    arm = F.when(F.col("draw_order") <= n, "control").otherwise("treatment")
    return ranked.filter(F.col("draw_order") <= 2 * n).select(*units.columns, "draw_order", arm.alias("arm"))


def experiment_arms(units: DataFrame, p: Params = Params()) -> DataFrame:
    """The arms of ``experiment_assignment`` without the draw order: the keys
    of the n-th and the 2n-th drawn user are selected, and an arm is a
    comparison with them.  The md5 text is compared by its first 60 bits as
    a number, then as text."""
    key = md5_key("user_id", F.lit(p.seed))
    drawn = held(units.withColumn("_h", F.conv(F.substring(key, 1, 15), 16, 10).cast("long")).withColumn("_k", key), "units")
    n_all = drawn.count()
    n = p.n_per_group or n_all // 2
    order = ("_h", "_k", "user_id")
    first, last = keys_at(drawn, [(order, r, n_all) for r in (n, 2 * n)])
    place = F.struct(*order)

    def upto(key):
        return place <= F.struct(*(F.lit(v).alias(c) for v, c in zip(key, order)))
    if first is None:  # nobody to draw, or all in the control arm
        return drawn.filter(F.lit(bool(n))).select(*units.columns, F.lit("control").alias("arm"))
    kept = drawn if last is None else drawn.filter(upto(last))
    return kept.select(*units.columns, F.when(upto(first), "control").otherwise("treatment").alias("arm"))


def observed_outcomes(assigned: DataFrame, outcomes=OUTCOMES) -> DataFrame:
    """(outcome, user): arm, segment and whether the user shows the outcome."""
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("outcome"), F.col(c).cast("long").alias("converted")) for name, c in outcomes.items()]))
    return assigned.select("user_id", "arm", "segment", rows).select("outcome", "user_id", "arm", "segment", "converted")


def experiment_groups(outcomes: DataFrame) -> DataFrame:
    """(outcome, group) -> n, conversions, rate (4 dp); treatment rows carry
    the lift over control in percentage points (1 dp)."""
    g = outcomes.groupBy("outcome", "arm").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum("converted").cast("long").alias("conversions"))
    w = Window.partitionBy("outcome")
    cx = F.max(F.when(F.col("arm") == "control", F.col("conversions"))).over(w)
    cn = F.max(F.when(F.col("arm") == "control", F.col("n"))).over(w)
    n, x = whole("n"), whole("conversions")
    lift = round_ratio((x * whole(cn) - whole(cx) * n) * F.lit(100).cast("decimal(10,0)"), n * whole(cn), 1)
    return (g.withColumn("conversion_rate", round_ratio("conversions", "n", 4))
             .withColumn("lift_pp", F.when(F.col("arm") == "treatment", lift))
             .orderBy("outcome", "arm"))


def experiment_by_segment(outcomes: DataFrame) -> DataFrame:
    """(outcome, segment) -> control rate, treated rate (3 dp), difference
    in points (1 dp), treated users."""
    c, t = F.col("arm") == "control", F.col("arm") == "treatment"
    g = outcomes.groupBy("outcome", "segment").agg(
        F.count_if(c).alias("n_control"), F.sum(F.when(c, F.col("converted")).otherwise(0)).alias("x_control"),
        F.count_if(t).alias("n_treated"), F.sum(F.when(t, F.col("converted")).otherwise(0)).alias("x_treated"))
    diff = round_ratio((whole("x_treated") * whole("n_control") - whole("x_control") * whole("n_treated")) * F.lit(100).cast("decimal(10,0)"),
                       whole("n_treated") * whole("n_control"), 1)
    both = (F.col("n_control") > 0) & (F.col("n_treated") > 0)
    return g.select("outcome", "segment", "n_control", "n_treated",
                    F.when(F.col("n_control") > 0, round_ratio("x_control", "n_control", 3)).alias("control_rate"),
                    F.when(F.col("n_treated") > 0, round_ratio("x_treated", "n_treated", 3)).alias("treated_rate"),
                    F.when(both, diff).alias("diff_pp")).orderBy("outcome", "segment")


def _arms(outcomes: DataFrame) -> DataFrame:
    c, t = F.col("arm") == "control", F.col("arm") == "treatment"
    return outcomes.groupBy("outcome").agg(
        F.count_if(t).alias("n_treated"), F.sum(F.when(t, F.col("converted")).otherwise(0)).cast("long").alias("x_treated"),
        F.count_if(c).alias("n_control"), F.sum(F.when(c, F.col("converted")).otherwise(0)).cast("long").alias("x_control"))


def z_test_columns(x1, n1, x2, n2):
    """Pooled one-sided two-proportion z statistic (treated > control)."""
    x1, n1, x2, n2 = [F.col(c).cast("double") for c in (x1, n1, x2, n2)]
    p1, p2 = x1 / n1, x2 / n2
    pp = (x1 + x2) / (n1 + n2)
    se = F.sqrt(pp * (1 - pp) * (F.lit(1.0) / n1 + F.lit(1.0) / n2))
    return F.when((n1 > 0) & (n2 > 0), F.when(se > 0, (p1 - p2) / se))


def two_proportion_ztest(outcomes: DataFrame, p: Params = Params()) -> DataFrame:
    """Per outcome: z, one-sided p-value (6 dp) and the decision at alpha."""
    a = _arms(outcomes)
    z = z_test_columns("x_treated", "n_treated", "x_control", "n_control")
    a = a.select("*", z.alias("_z")).select("*", (1 - normal_cdf("_z")).alias("_p"))
    return a.select("outcome", "x_treated", "n_treated", "x_control", "n_control",
                    floor_round("_z", 4).alias("z_stat"), floor_round("_p", 6).alias("p_value"),
                    F.when(F.col("_p") < p.alpha, 1).otherwise(0).cast("long").alias("reject")).orderBy("outcome")


def proportion_ci(outcomes: DataFrame, p: Params = Params()) -> DataFrame:
    """Wald interval of each arm's rate, clipped to [0, 1] (4 dp)."""
    zq = z_quantile(1 - p.alpha / 2)
    g = outcomes.groupBy("outcome", "arm").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum("converted").cast("long").alias("conversions"))
    rate = F.col("conversions").cast("double") / F.col("n").cast("double")
    half = F.lit(zq) * F.sqrt(rate * (1 - rate) / F.col("n").cast("double"))
    return g.select("outcome", "arm", "n", "conversions",
                    floor_round(F.greatest(F.lit(0.0), rate - half), 4).alias("ci_low"),
                    floor_round(F.least(F.lit(1.0), rate + half), 4).alias("ci_high")).orderBy("outcome", "arm")


def cohens_h(p_treat, p_base):
    return 2 * F.asin(F.sqrt(p_treat)) - 2 * F.asin(F.sqrt(p_base))


def sample_size_plan(units: DataFrame, p: Params = Params()) -> DataFrame:
    """For each baseline (all users and each segment) and each effect in
    the grid: Cohen's h, users needed per group, and whether the baseline
    group has enough users for two groups."""
    za, zb = z_quantile(1 - p.alpha), z_quantile(p.power)
    # per-segment and overall baselines from one rollup (one pass over units)
    base = units.rollup("segment").agg(F.count(F.lit(1)).alias("users"),
                                       F.sum("activated").cast("long").alias("activated"),
                                       F.grouping_id().alias("_g"))
    base = base.select(F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col("segment")).alias("baseline"),
                       "users", "activated")
    rows = base.withColumn("mde", F.explode(F.array(*[F.lit(float(m)) for m in p.mde_grid])))
    p0 = F.col("activated").cast("double") / F.col("users").cast("double")
    pt = p0 + F.col("mde")
    h = cohens_h(pt, p0)
    n = F.ceil(F.lit(2.0) * F.pow(F.lit(za + zb) / h, 2)).cast("long")
    ok = (pt <= 1) & (h > 0)
    return rows.select("baseline", "users", floor_round(p0, 4).alias("baseline_rate"), "mde",
                       F.when(ok, floor_round(h, 4)).alias("cohens_h"),
                       F.when(ok, n).alias("n_per_group"),
                       F.when(ok, (F.col("users") >= 2 * n).cast("long")).alias("enough")) \
               .orderBy("baseline", "mde")


def power_curve(units: DataFrame, p: Params = Params()) -> DataFrame:
    """Power of the one-sided test for n per group in a grid, at the planned
    effect over the observed overall activation rate."""
    za = z_quantile(1 - p.alpha)
    b = units.agg((F.sum("activated").cast("double") / F.count(F.lit(1)).cast("double")).alias("p0"))
    h = cohens_h(F.col("p0") + p.planned_mde, F.col("p0"))
    g = b.select(h.alias("h"), F.explode(F.sequence(F.lit(p.power_n_lo), F.lit(p.power_n_hi),
                                                    F.lit(p.power_n_step))).alias("n_per_group"))
    pw = normal_cdf(F.col("h") * F.sqrt(F.col("n_per_group").cast("double") / 2) - za)
    return g.select(F.col("n_per_group").cast("long").alias("n_per_group"),
                    floor_round(pw, 6).alias("power")).orderBy("n_per_group")


def outcome_comparison(outcomes: DataFrame, p: Params = Params()) -> DataFrame:
    """Result table: for each outcome a control and a treatment row with the
    rate (%, 1 dp); the treatment row has the lift, group size, one-sided
    p-value (4 dp) and the decision."""
    a = _arms(outcomes)
    z = z_test_columns("x_treated", "n_treated", "x_control", "n_control")
    # z and the p-value get their own projections: each is referenced more
    # than once, so they are computed once instead of being inlined.
    a = a.select("*", z.alias("_z")).select("*", (1 - normal_cdf("_z")).alias("_p"))
    pv = F.col("_p")
    nt, nc, xt, xc = (F.col(c) for c in ("n_treated", "n_control", "x_treated", "x_control"))
    lift = round_ratio((whole(xt) * whole(nc) - whole(xc) * whole(nt)) * F.lit(100).cast("decimal(10,0)"), whole(nt) * whole(nc), 1)
    treated = F.struct(
        F.lit("treatment").alias("arm"), F.when(nt > 0, pct(xt, nt, 1)).alias("conversion_rate"),
        F.when((nt > 0) & (nc > 0), lift).alias("lift_pp"), nt.alias("n"), floor_round(pv, 4).alias("p_value"),
        F.when(pv < p.alpha, "reject").otherwise("keep").alias("decision"))
    control = F.struct(
        F.lit("control").alias("arm"), F.when(nc > 0, pct(xc, nc, 1)).alias("conversion_rate"),
        F.lit(None).cast("double").alias("lift_pp"), nc.alias("n"), F.lit(None).cast("double").alias("p_value"), F.lit(None).cast("string").alias("decision"))
    return a.select("outcome", F.inline(F.array(control, treated))).orderBy("outcome", "arm")


def impact_population(facts: DataFrame, p: Params = Params()) -> DataFrame:
    """One row: cohort-eligible users and their mean annual LTV (0 dp), from
    one aggregate over ``facts``."""
    from lifetrail.functions import round_ratio_int, span_years
    f = facts.filter(F.col("first_year") >= p.min_cohort)
    yrs = span_years("first_year", "last_year").cast("long")
    ann = round_ratio_int("ltv_cents", yrs * 100)
    g = f.agg(F.count(F.lit(1)).alias("eligible_users"),
              F.sum(F.when(F.col("ltv_n") > 0, ann)).alias("_s"), F.count_if(F.col("ltv_n") > 0).alias("_k"))
    return g.select("eligible_users", round_ratio_int("_s", "_k").alias("avg_annual_ltv"))


def impact_estimate(outcomes: DataFrame, population: DataFrame) -> DataFrame:
    """Per outcome: int(eligible users x lift) x mean annual LTV.

    ``population`` is the one-row (eligible_users, avg_annual_ltv) frame of
    ``impact_population``; it enters as one scalar subquery."""
    a = _arms(outcomes)
    pop = population.select(F.struct("eligible_users", "avg_annual_ltv")).scalar()
    users, avg_ltv = pop.getField("eligible_users"), pop.getField("avg_annual_ltv")
    lift = F.when((F.col("n_treated") > 0) & (F.col("n_control") > 0),
                  F.col("x_treated").cast("double") / F.col("n_treated").cast("double")
                  - F.col("x_control").cast("double") / F.col("n_control").cast("double"))
    extra = (users.cast("double") * lift).cast("long")
    return a.select("outcome", users.alias("eligible_users"), floor_round(lift, 6).alias("lift"),
                    extra.alias("additional_activated"), avg_ltv.alias("avg_annual_ltv"),
                    (extra * avg_ltv).cast("long").alias("additional_revenue")).orderBy("outcome")
