"""Independent SQL formulations of the registered queries (DuckDB dialect).

These are written the way an analyst would write them directly against
the provided tables: the adapter and the clean views as CTEs, then the
literal self-joins of the fact to its per-user minimum.  They do not
reuse the Spark operators' ``facts`` rewrite, so agreement between the two
is a real check of that rewrite.

Rounding of ratios is done in integers in both engines (half away from
zero), so values agree bit for bit.
"""

from __future__ import annotations

from lifetrail.config import Params

P = Params()


# ---------------------------------------------------------------- helpers
def rr(a: str, b: str, k: int) -> str:
    """round(a / b, k) half away from zero, a and b integral, b > 0."""
    s = 10 ** k
    return (f"(CAST(CASE WHEN ({a}) < 0 THEN -((2 * {s} * ABS({a}) + ({b})) // (2 * ({b}))) "
            f"ELSE (2 * {s} * ({a}) + ({b})) // (2 * ({b})) END AS DOUBLE) / {float(s)})")


def rr_int(a: str, b: str) -> str:
    return (f"CAST(CASE WHEN ({a}) < 0 THEN -((2 * ABS({a}) + ({b})) // (2 * ({b}))) "
            f"ELSE (2 * ({a}) + ({b})) // (2 * ({b})) END AS BIGINT)")


def pct(a: str, b: str, k: int) -> str:
    return rr(f"100 * ({a})", b, k)


def money(c: str) -> str:
    return f"(CAST({c} AS DOUBLE) / 100.0)"


def span(first: str, last: str) -> str:
    return f"(CASE WHEN ({last}) - ({first}) = 0 THEN 1 ELSE ({last}) - ({first}) END)"


def int_to_date(d: str) -> str:
    return f"make_date(CAST(({d}) // 10000 AS BIGINT), CAST((({d}) // 100) % 100 AS BIGINT), CAST(({d}) % 100 AS BIGINT))"


# ---------------------------------------------------------------- base CTEs
def base(p: Params = P) -> str:
    return f"""
raw AS (
  SELECT o.o_custkey AS user_id,
         CAST(l.l_linenumber - 1 AS INTEGER) AS card,
         CAST(year(o.o_orderdate) AS INTEGER) AS tx_year,
         CAST(month(o.o_orderdate) AS INTEGER) AS tx_month,
         CAST(day(o.o_orderdate) AS INTEGER) AS tx_day,
         lpad(CAST(l.l_linenumber AS VARCHAR), 2, '0') || ':00' AS tx_time,
         '$' || (CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber <= 2 THEN '-' ELSE '' END)
             || CAST(CAST(l.l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS amount_raw,
         CASE WHEN l.l_linestatus = 'F' THEN 'Chip Transaction' ELSE 'Swipe Transaction' END AS use_chip,
         'Supplier#' || CAST(l.l_suppkey AS VARCHAR) AS merchant_name,
         CASE WHEN o.o_orderstatus = 'P' THEN 'ONLINE' ELSE 'City-' || CAST(l.l_suppkey AS VARCHAR) END AS merchant_city,
         CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE 'ST-' || substr(o.o_orderpriority, 1, 1) END AS merchant_state,
         CASE WHEN o.o_orderstatus = 'P' THEN NULL
              ELSE lpad(CAST(l.l_partkey % 100000 AS VARCHAR), 5, '0') END AS zip,
         p.p_brand AS mcc,
         CASE WHEN o.o_orderpriority = '1-URGENT' AND l.l_linenumber = 7 THEN 'Insufficient Balance' END AS errors,
         CASE WHEN l.l_quantity = 50 AND l.l_discount >= 0.09 THEN 'Yes' ELSE 'No' END AS is_fraud
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
clean AS (
  SELECT user_id, card, tx_year, tx_month, tx_day, tx_time,
         TRY_CAST(replace(amount_raw, '$', '') AS DECIMAL(12,2)) AS amount,
         use_chip, merchant_name, merchant_city, merchant_state, zip, mcc, errors,
         false AS is_fraud,
         CAST(tx_year * 10000 + tx_month * 100 + tx_day AS INTEGER) AS date_int,
         CAST(tx_year * 100 + tx_month AS INTEGER) AS year_month
  FROM raw
  WHERE is_fraud = 'No' AND tx_year < {p.last_year_excl}
),
clean_c AS (
  SELECT *, CAST(amount * 100 AS BIGINT) AS cents FROM clean
),
ltv AS (
  SELECT * FROM clean_c WHERE amount > 0 AND errors IS NULL AND amount <= {p.outlier_cap}
)"""


def funnel_ctes(p: Params = P, calendar: bool = False) -> str:
    if calendar:
        within = f"date_diff('day', {int_to_date('f.first_date')}, {int_to_date('s.second_date')}) <= {p.activation_window}"
    else:
        within = f"s.second_date - f.first_date <= {p.activation_window}"
    return f"""
first_tx AS (
  SELECT user_id, MIN(date_int) AS first_date, MIN(tx_year) AS first_year, MAX(tx_year) AS last_year
  FROM clean GROUP BY user_id
),
second_tx AS (
  SELECT c.user_id, MIN(c.date_int) AS second_date
  FROM clean c JOIN first_tx f ON c.user_id = f.user_id
  WHERE c.date_int > f.first_date
  GROUP BY c.user_id
),
next_year AS (
  SELECT DISTINCT c.user_id
  FROM clean c JOIN first_tx f ON c.user_id = f.user_id
  WHERE c.tx_year = f.first_year + 1
),
flags AS (
  SELECT f.user_id, f.first_date, f.first_year, f.last_year, s.second_date,
         CASE WHEN s.second_date IS NOT NULL AND {within} THEN 1 ELSE 0 END AS activated,
         CASE WHEN n.user_id IS NOT NULL THEN 1 ELSE 0 END AS retained
  FROM first_tx f
  LEFT JOIN second_tx s ON f.user_id = s.user_id
  LEFT JOIN next_year n ON f.user_id = n.user_id
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


CLEAN_COLS = ("user_id, card, tx_year, tx_month, tx_day, tx_time, CAST(amount AS DOUBLE) AS amount, "
              "use_chip, merchant_name, merchant_city, merchant_state, zip, mcc, errors, is_fraud, "
              "date_int, year_month")


# ---------------------------------------------------------------- queries
def _sql() -> dict[str, str]:
    b = base()
    fb = with_(b, funnel_ctes())
    q: dict[str, str] = {}

    # A
    q["clean_transactions"] = with_(b) + f"SELECT {CLEAN_COLS} FROM clean"
    q["ltv_transactions"] = with_(b) + f"SELECT {CLEAN_COLS} FROM ltv"
    q["audit_row_counts"] = with_(b) + """
SELECT 'transactions' AS table_name, COUNT(*) AS row_count FROM raw
UNION ALL SELECT 'users', COUNT(*) FROM customer
UNION ALL SELECT 'clean_transactions', COUNT(*) FROM clean
UNION ALL SELECT 'ltv_transactions', COUNT(*) FROM ltv"""

    # H
    q["profile_range"] = with_(b) + """
SELECT CAST(MIN(tx_year) AS BIGINT) AS min_year, CAST(MAX(tx_year) AS BIGINT) AS max_year,
       COUNT(DISTINCT tx_year) AS year_count, COUNT(DISTINCT tx_month) AS month_count,
       COUNT(DISTINCT user_id) AS user_count, COUNT(DISTINCT merchant_name) AS merchant_count,
       COUNT(DISTINCT mcc) AS mcc_count
FROM clean"""
    q["profile_amount"] = with_(b) + f"""
SELECT CAST(MIN(amount) AS DOUBLE) AS min_amount, CAST(MAX(amount) AS DOUBLE) AS max_amount,
       {rr('SUM(cents)', 'COUNT(amount) * 100', 2)} AS avg_amount,
       COUNT(*) FILTER (WHERE amount < 0) AS negative_count, COUNT(*) AS total_count
FROM clean_c"""
    q["refund_detail_top20"] = with_(b) + """
SELECT use_chip, merchant_city, mcc, errors, CAST(amount AS DOUBLE) AS amount, COUNT(*) AS cnt
FROM clean WHERE amount < 0
GROUP BY use_chip, merchant_city, mcc, errors, amount
ORDER BY cnt DESC, use_chip ASC NULLS FIRST, merchant_city ASC NULLS FIRST, mcc ASC NULLS FIRST,
         errors ASC NULLS FIRST, amount ASC NULLS FIRST
LIMIT 20"""
    q["refund_error_share"] = with_(b) + f"""
SELECT errors, COUNT(*) AS cnt, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 2)} AS ratio
FROM clean WHERE amount < 0 GROUP BY errors"""
    q["fraud_share"] = with_(b) + f"""
SELECT is_fraud, COUNT(*) AS cnt, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 4)} AS ratio
FROM raw GROUP BY is_fraud"""
    q["error_share"] = with_(b) + f"""
SELECT errors AS error_type, COUNT(*) AS cnt, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 4)} AS ratio
FROM clean GROUP BY errors"""
    q["null_profile"] = with_(b) + """
SELECT COUNT(*) FILTER (WHERE user_id IS NULL) AS user_null,
       COUNT(*) FILTER (WHERE amount IS NULL) AS amount_null,
       COUNT(*) FILTER (WHERE tx_year IS NULL) AS year_null,
       COUNT(*) FILTER (WHERE mcc IS NULL) AS mcc_null,
       COUNT(*) FILTER (WHERE merchant_city IS NULL) AS city_null,
       COUNT(*) FILTER (WHERE merchant_state IS NULL) AS state_null,
       COUNT(*) FILTER (WHERE zip IS NULL) AS zip_null
FROM clean"""
    q["amount_outliers"] = with_(b) + f"""
SELECT COUNT(*) AS total,
       COUNT(*) FILTER (WHERE amount > {P.outlier_band_low}) AS over_low,
       COUNT(*) FILTER (WHERE amount > {P.outlier_band_high}) AS over_high,
       {rr('SUM(cents)', 'COUNT(*) * 100', 2)} AS avg_amount,
       {money('MIN(cents)')} AS min_amount, {money('MAX(cents)')} AS max_amount
FROM clean_c WHERE amount > 0"""
    q["category_top20"] = with_(b) + f"""
SELECT mcc, COUNT(*) AS tx_count, COUNT(DISTINCT user_id) AS user_count,
       {rr('SUM(cents)', 'COUNT(amount) * 100', 2)} AS avg_amount,
       {pct('COUNT(*)', '(SELECT COUNT(*) FROM clean)', 2)} AS ratio
FROM clean_c GROUP BY mcc
ORDER BY tx_count DESC, mcc ASC NULLS FIRST LIMIT {P.top_k}"""
    q["category_top20_purchases"] = with_(b) + f"""
SELECT mcc, COUNT(*) AS tx_count, COUNT(DISTINCT user_id) AS user_count,
       {rr('SUM(cents)', 'COUNT(amount) * 100', 2)} AS avg_amount,
       {pct('COUNT(*)', '(SELECT COUNT(*) FROM clean)', 2)} AS ratio
FROM clean_c WHERE amount > 0 GROUP BY mcc
ORDER BY tx_count DESC, mcc ASC NULLS FIRST LIMIT {P.top_k}"""
    q["category_rollup"] = with_(b) + f"""
, top AS (
  SELECT mcc, COUNT(*) AS tx_count FROM clean GROUP BY mcc
  ), labelled AS (
  SELECT tx_count,
         CASE WHEN mcc LIKE 'Brand#%' AND CAST(substr(mcc, 7) AS INTEGER) BETWEEN 1 AND 20
              THEN 'brand-' || substr(mcc, 7) ELSE 'other' END AS detail,
         CASE WHEN mcc LIKE 'Brand#%' AND CAST(substr(mcc, 7) AS INTEGER) BETWEEN 1 AND 20
              THEN 'group-' || CAST((CAST(substr(mcc, 7) AS INTEGER) - 1) // 5 + 1 AS VARCHAR)
              ELSE 'other' END AS large_group
  FROM top
)
SELECT 'large' AS level, large_group AS label, CAST(SUM(tx_count) AS BIGINT) AS tx_count FROM labelled GROUP BY large_group
UNION ALL
SELECT 'detail', detail, CAST(SUM(tx_count) AS BIGINT) FROM labelled GROUP BY detail"""
    q["category_rollup_of_top20"] = with_(b) + f"""
, top AS (
  SELECT mcc, COUNT(*) AS tx_count FROM clean GROUP BY mcc
  ORDER BY tx_count DESC, mcc ASC NULLS FIRST LIMIT {P.top_k}
), labelled AS (
  SELECT tx_count,
         CASE WHEN mcc LIKE 'Brand#%' AND CAST(substr(mcc, 7) AS INTEGER) BETWEEN 1 AND 20
              THEN 'brand-' || substr(mcc, 7) ELSE 'other' END AS detail,
         CASE WHEN mcc LIKE 'Brand#%' AND CAST(substr(mcc, 7) AS INTEGER) BETWEEN 1 AND 20
              THEN 'group-' || CAST((CAST(substr(mcc, 7) AS INTEGER) - 1) // 5 + 1 AS VARCHAR)
              ELSE 'other' END AS large_group
  FROM top
)
SELECT 'large' AS level, large_group AS label, CAST(SUM(tx_count) AS BIGINT) AS tx_count FROM labelled GROUP BY large_group
UNION ALL
SELECT 'detail', detail, CAST(SUM(tx_count) AS BIGINT) FROM labelled GROUP BY detail"""
    q["yearly_trend"] = with_(b) + f"""
SELECT CAST(tx_year AS BIGINT) AS tx_year, COUNT(*) AS tx_count, COUNT(DISTINCT user_id) AS active_users,
       {rr('SUM(cents)', 'COUNT(*) * 100', 2)} AS avg_amount, {money('SUM(cents)')} AS total_revenue
FROM clean_c WHERE amount > 0 GROUP BY tx_year"""
    q["yearly_trend_from_user_years"] = q["yearly_trend"]
    q["partial_period_check"] = with_(b) + f"""
SELECT CAST(tx_year * 100 + tx_month AS BIGINT) AS year_month, COUNT(*) AS tx_count
FROM raw WHERE is_fraud = 'No' AND tx_year = {P.last_year_excl}
GROUP BY 1"""
    q["population_reconciliation"] = with_(b) + """
SELECT 'raw' AS stage, COUNT(DISTINCT user_id) AS users, CAST(1 AS BIGINT) AS order_num FROM raw
UNION ALL SELECT 'non_fraud', COUNT(DISTINCT user_id), 2 FROM raw WHERE is_fraud = 'No'
UNION ALL SELECT 'clean', COUNT(DISTINCT user_id), 3 FROM clean
UNION ALL SELECT 'dimension', COUNT(DISTINCT c_custkey), 4 FROM customer"""

    # I
    q["acquisition_by_year"] = fb + """
SELECT CAST(first_year AS BIGINT) AS first_year, COUNT(*) AS new_users FROM first_tx GROUP BY first_year"""
    q["acquisition_summary"] = fb + f"""
, y AS (SELECT first_year, COUNT(*) AS n FROM first_tx GROUP BY first_year)
SELECT CAST(SUM(n) AS BIGINT) AS total_users, COUNT(*) AS years,
       {rr_int('SUM(n)', 'COUNT(*)')} AS mean_new_users_per_year
FROM y"""
    act_sql = f"""
SELECT COUNT(*) AS acquired_users, COUNT(second_date) AS had_second_tx,
       CAST(SUM(activated) AS BIGINT) AS activated_users,
       {pct('SUM(activated)', 'COUNT(*)', 2)} AS activation_rate
FROM flags"""
    q["activation"] = fb + act_sql
    q["activation_calendar"] = with_(b, funnel_ctes(calendar=True)) + act_sql
    q["retention_next_year"] = fb + f"""
SELECT COUNT(*) AS acquired_users, CAST(SUM(retained) AS BIGINT) AS retained_users,
       {pct('SUM(retained)', 'COUNT(*)', 2)} AS retention_rate
FROM flags"""
    q["retention_next_year_uncensored"] = fb + f"""
SELECT COUNT(*) AS acquired_users, CAST(SUM(retained) AS BIGINT) AS retained_users,
       {pct('SUM(retained)', 'COUNT(*)', 2)} AS retention_rate
FROM flags WHERE first_year < 2000"""
    q["revenue_summary"] = with_(b) + f"""
, per_user AS (SELECT user_id, SUM(cents) AS tot FROM ltv GROUP BY user_id)
SELECT COUNT(*) AS total_users, {rr('SUM(tot)', 'COUNT(*) * 100', 2)} AS avg_ltv,
       {money('MIN(tot)')} AS min_ltv, {money('MAX(tot)')} AS max_ltv,
       COUNT(*) FILTER (WHERE tot > {P.high_value * 100}) AS high_value_users
FROM per_user"""
    seq = with_(b, funnel_ctes()) + f"""
, act AS (
  SELECT DISTINCT c.user_id FROM clean c JOIN first_tx f ON c.user_id = f.user_id
  WHERE c.date_int > f.first_date AND c.date_int - f.first_date <= {P.activation_window}
), ret AS (
  SELECT DISTINCT c.user_id FROM clean c
  JOIN first_tx f ON c.user_id = f.user_id
  JOIN act a ON c.user_id = a.user_id
  WHERE c.tx_year = f.first_year + 1
), counts AS (
  SELECT COUNT(DISTINCT f.user_id) AS acquisition, COUNT(DISTINCT a.user_id) AS activation,
         COUNT(DISTINCT r.user_id) AS retention
  FROM first_tx f LEFT JOIN act a ON f.user_id = a.user_id LEFT JOIN ret r ON f.user_id = r.user_id
)
"""
    q["funnel_sequential"] = seq + "SELECT acquisition, activation, retention FROM counts"
    q["funnel_sequential_joins"] = q["funnel_sequential"]
    q["funnel_stages"] = seq + """
SELECT 'Acquisition' AS stage, acquisition AS users, CAST(1 AS BIGINT) AS order_num FROM counts
UNION ALL SELECT 'Activation', activation, 2 FROM counts
UNION ALL SELECT 'Retention', retention, 3 FROM counts"""
    q["funnel_conversion"] = seq + f"""
SELECT 'acquisition_to_activation' AS step, acquisition AS from_users, activation AS to_users,
       CASE WHEN acquisition > 0 THEN {pct('activation', 'acquisition', 1)} END AS conversion_rate FROM counts
UNION ALL SELECT 'activation_to_retention', activation, retention,
       CASE WHEN activation > 0 THEN {pct('retention', 'activation', 1)} END FROM counts
UNION ALL SELECT 'acquisition_to_retention', acquisition, retention,
       CASE WHEN acquisition > 0 THEN {pct('retention', 'acquisition', 1)} END FROM counts"""
    q["funnel_independent"] = fb + f"""
, c AS (SELECT COUNT(*) AS acq, CAST(SUM(activated) AS BIGINT) AS act, CAST(SUM(retained) AS BIGINT) AS ret,
               (SELECT COUNT(DISTINCT user_id) FROM clean) AS rev FROM flags)
SELECT 'Acquisition' AS stage, acq AS users, {pct('acq', 'acq', 1)} AS pct_of_acquired, CAST(1 AS BIGINT) AS order_num FROM c
UNION ALL SELECT 'Activation', act, {pct('act', 'acq', 1)}, 2 FROM c
UNION ALL SELECT 'Retention', ret, {pct('ret', 'acq', 1)}, 3 FROM c
UNION ALL SELECT 'Revenue', rev, {pct('rev', 'acq', 1)}, 4 FROM c"""
    q["activation_x_retention"] = fb + f"""
SELECT CASE WHEN activated = 1 AND retained = 1 THEN 'core'
            WHEN activated = 1 AND retained = 0 THEN 'early_flash'
            WHEN activated = 0 AND retained = 1 THEN 'slow_settler'
            ELSE 'churned' END AS user_type,
       COUNT(*) AS user_count,
       {pct('COUNT(*)', '(SELECT COUNT(*) FROM first_tx)', 2)} AS ratio
FROM flags GROUP BY 1"""
    q["activation_extract"] = fb + """
SELECT user_id, CAST(first_date AS BIGINT) AS first_date, CAST(second_date AS BIGINT) AS second_date,
       CAST(activated AS BIGINT) AS activated
FROM flags"""
    _sql_jkl(q)
    return q


# ---------------------------------------------------------------- J / K / L
def sql_normal_cdf(x: str) -> str:
    """The normal CDF of the same publication (Hart 1968, West 2005), in SQL."""
    # fixed values of that publication
    p = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    q = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)

    def lit(v):
        return f"CAST({v!r} AS DOUBLE)"

    ax = f"abs({x})"

    def horner(cs):
        acc = f"({lit(cs[0])} * {ax} + {lit(cs[1])})"
        for c in cs[2:]:
            acc = f"({acc} * {ax} + {lit(c)})"
        return acc

    ex = f"exp(-({ax}) * {ax} / 2)"
    near = f"({ex} * {horner(p)} / {horner(q)})"
    frac = f"({ax} + {lit(0.65)})"
    for k in (4, 3, 2, 1):
        frac = f"({ax} + {lit(float(k))} / {frac})"
    far = f"({ex} / {frac} / {lit(2.506628274631)})"
    tail = f"(CASE WHEN {ax} > 37 THEN 0.0 WHEN {ax} < {lit(7.07106781186547)} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN ({x}) > 0 THEN 1 - {tail} ELSE {tail} END)"


def fround(x: str, k: int) -> str:
    s = float(10 ** k)
    return f"(floor(({x}) * {s} + 0.5) / {s})"


def qcut_sql(order: str, k: int) -> str:
    """pandas qcut(rank(method='first'), k) via float bin edges 1 + i(n-1)/k."""
    rn = f"ROW_NUMBER() OVER (ORDER BY {order}, user_id)"
    n = "COUNT(*) OVER ()"
    terms = " + ".join(f"CASE WHEN {rn} > 1 + CAST({i} * ({n} - 1) AS DOUBLE) / {float(k)} THEN 1 ELSE 0 END"
                       for i in range(1, k))
    return f"CAST(1 + {terms} AS INTEGER)"


def brand_group(col: str) -> str:
    num = f"TRY_CAST(substr({col}, 7) AS INTEGER)"
    return (f"(CASE WHEN {col} LIKE 'Brand#%' AND {num} BETWEEN 1 AND 20 "
            f"THEN 'group-' || CAST(({num} - 1) // 5 + 1 AS VARCHAR) ELSE 'other' END)")


def cohort_ctes(p: Params = P) -> str:
    sp = span("MIN(c.tx_year)", "MAX(c.tx_year)")
    return f"""
cb AS (SELECT user_id, MIN(tx_year) AS cohort_year, MAX(tx_year) AS last_year FROM clean GROUP BY user_id),
fc AS (SELECT * FROM cb WHERE cohort_year >= {p.min_cohort}),
cs AS (SELECT cohort_year, COUNT(*) AS cohort_users FROM fc GROUP BY cohort_year),
ua AS (
  SELECT DISTINCT c.user_id, fc.cohort_year, c.tx_year - fc.cohort_year AS age
  FROM clean c JOIN fc ON c.user_id = fc.user_id WHERE c.tx_year >= fc.cohort_year
),
ret AS (
  SELECT ua.cohort_year, ua.age, COUNT(DISTINCT ua.user_id) AS retained_users, cs.cohort_users
  FROM ua JOIN cs ON ua.cohort_year = cs.cohort_year
  GROUP BY ua.cohort_year, ua.age, cs.cohort_users
),
beh AS (
  SELECT fc.cohort_year, c.tx_year - fc.cohort_year AS age, COUNT(*) AS total_tx,
         COUNT(DISTINCT c.user_id) AS active_users, cs.cohort_users,
         SUM(CASE WHEN c.amount > 0 THEN c.cents ELSE 0 END) AS rev
  FROM clean_c c JOIN fc ON c.user_id = fc.user_id JOIN cs ON fc.cohort_year = cs.cohort_year
  WHERE c.tx_year >= fc.cohort_year
  GROUP BY fc.cohort_year, c.tx_year - fc.cohort_year, cs.cohort_users
),
ur AS (
  SELECT c.user_id, SUM(c.cents) AS rev, COUNT(*) AS total_tx
  FROM ltv c JOIN fc ON c.user_id = fc.user_id GROUP BY c.user_id
),
al AS (
  SELECT fc.user_id, CAST(fc.cohort_year AS BIGINT) AS cohort_year, CAST(fc.last_year AS BIGINT) AS last_year,
         CAST({span('fc.cohort_year', 'fc.last_year')} AS BIGINT) AS active_years,
         {money('ur.rev')} AS total_revenue, ur.total_tx,
         {rr_int('ur.rev', span('fc.cohort_year', 'fc.last_year') + ' * 100')} AS annual_ltv,
         {rr_int('ur.total_tx', span('fc.cohort_year', 'fc.last_year'))} AS annual_tx
  FROM fc JOIN ur ON fc.user_id = ur.user_id
),
rfm AS (
  SELECT c.user_id, CAST({p.as_of_year} - MAX(c.tx_year) AS BIGINT) AS recency_years,
         {rr_int('COUNT(*)', sp)} AS frequency,
         {rr_int('SUM(CASE WHEN c.amount > 0 THEN c.cents ELSE 0 END)', sp + ' * 100')} AS monetary
  FROM clean_c c JOIN fc ON c.user_id = fc.user_id GROUP BY c.user_id
),
rfm_r AS (
  SELECT *, CAST(CASE WHEN recency_years = 0 THEN 5 WHEN recency_years <= 2 THEN 4
                      WHEN recency_years <= 5 THEN 3 WHEN recency_years <= 9 THEN 2 ELSE 1 END AS INTEGER) AS r_score
  FROM rfm
),
sc_n AS (
  SELECT user_id, recency_years, frequency, monetary, r_score,
         CAST(NTILE({p.n_bins}) OVER (ORDER BY frequency, user_id) AS INTEGER) AS f_score,
         CAST(NTILE({p.n_bins}) OVER (ORDER BY monetary, user_id) AS INTEGER) AS m_score
  FROM rfm_r
),
sc_q AS (
  SELECT user_id, recency_years, frequency, monetary, r_score,
         {qcut_sql('frequency', p.n_bins)} AS f_score,
         {qcut_sql('monetary', p.n_bins)} AS m_score
  FROM rfm_r
),
seg_n AS (
  SELECT *, CAST(r_score + f_score + m_score AS INTEGER) AS rfm_score,
         CASE WHEN r_score + f_score + m_score >= 13 THEN 'VIP'
              WHEN r_score + f_score + m_score >= 10 THEN 'Loyal'
              WHEN r_score + f_score + m_score >= 7 THEN 'Potential'
              WHEN r_score <= 2 AND (f_score >= 3 OR m_score >= 3) THEN 'At Risk'
              ELSE 'Dormant' END AS segment
  FROM sc_n
),
seg_q AS (
  SELECT *, CAST(r_score + f_score + m_score AS INTEGER) AS rfm_score,
         CASE WHEN r_score + f_score + m_score >= 13 THEN 'VIP'
              WHEN r_score + f_score + m_score >= 10 THEN 'Loyal'
              WHEN r_score + f_score + m_score >= 7 THEN 'Potential'
              WHEN r_score <= 2 AND (f_score >= 3 OR m_score >= 3) THEN 'At Risk'
              ELSE 'Dormant' END AS segment
  FROM sc_q
)"""


def experiment_ctes(p: Params = P) -> str:
    return f"""
units AS (
  SELECT f.user_id, f.activated, f.retained, COALESCE(s.segment, '{p.default_segment}') AS segment
  FROM flags f LEFT JOIN seg_q s ON f.user_id = s.user_id
),
asg AS (
  SELECT *, ROW_NUMBER() OVER (ORDER BY md5(CAST(user_id AS VARCHAR) || ':42'), user_id) AS draw_order,
         COUNT(*) OVER () // 2 AS half
  FROM units
),
asg2 AS (
  SELECT user_id, activated, retained, segment, draw_order, CASE WHEN draw_order <= half THEN 'control' ELSE 'treatment' END AS arm
  FROM asg WHERE draw_order <= 2 * half
),
outc AS (
  SELECT 'activation' AS outcome, user_id, arm, segment, CAST(activated AS BIGINT) AS converted FROM asg2
  UNION ALL
  SELECT 'next_year_return', user_id, arm, segment, CAST(retained AS BIGINT) FROM asg2
),
arms AS (
  SELECT outcome,
         COUNT(*) FILTER (WHERE arm = 'treatment') AS n_treated,
         CAST(SUM(CASE WHEN arm = 'treatment' THEN converted ELSE 0 END) AS BIGINT) AS x_treated,
         COUNT(*) FILTER (WHERE arm = 'control') AS n_control,
         CAST(SUM(CASE WHEN arm = 'control' THEN converted ELSE 0 END) AS BIGINT) AS x_control
  FROM outc GROUP BY outcome
),
zt AS (
  SELECT *, CASE WHEN n_treated > 0 AND n_control > 0 AND se > 0 THEN (p1 - p2) / se END AS z
  FROM (
    SELECT *, CASE WHEN n_treated > 0 AND n_control > 0
                   THEN sqrt(pp * (1 - pp) * (CAST(1.0 AS DOUBLE) / n1 + CAST(1.0 AS DOUBLE) / n2)) END AS se
    FROM (
      SELECT *, CAST(x_treated AS DOUBLE) AS x1, CAST(n_treated AS DOUBLE) AS n1,
             CAST(x_control AS DOUBLE) AS x2, CAST(n_control AS DOUBLE) AS n2,
             CASE WHEN n_treated > 0 THEN CAST(x_treated AS DOUBLE) / CAST(n_treated AS DOUBLE) END AS p1,
             CASE WHEN n_control > 0 THEN CAST(x_control AS DOUBLE) / CAST(n_control AS DOUBLE) END AS p2,
             CASE WHEN n_treated > 0 AND n_control > 0 THEN (CAST(x_treated AS DOUBLE) + CAST(x_control AS DOUBLE))
               / (CAST(n_treated AS DOUBLE) + CAST(n_control AS DOUBLE)) END AS pp
      FROM arms
    )
  )
)"""


def _sql_jkl(q: dict) -> None:
    from statistics import NormalDist
    z_quantile = NormalDist().inv_cdf
    p = P
    b = base()
    ff = funnel_ctes()
    cj = with_(b, ff, cohort_ctes())
    ex = with_(b, ff, cohort_ctes(), experiment_ctes())
    ages = list(range(0, p.last_kept_year - p.min_cohort + 1))
    ages1 = [a for a in ages if a >= p.age_min]

    q["user_subset"] = with_(b) + f"""
, s AS (SELECT c_custkey AS user_id FROM customer
        ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':{p.seed}'), c_custkey LIMIT 200)
SELECT user_id, tx_year, tx_month, tx_day, amount_raw, mcc, errors, is_fraud
FROM raw WHERE user_id IN (SELECT user_id FROM s) AND is_fraud = 'No' AND tx_year < {p.last_year_excl}"""

    q["user_subset_tables"] = with_(b) + f"""
, s AS (SELECT c_custkey AS user_id FROM customer
        ORDER BY md5(CAST(c_custkey AS VARCHAR) || ':42'), c_custkey LIMIT 200)
SELECT 'transactions' AS table_name, COUNT(*) AS row_count, COUNT(DISTINCT user_id) AS users
FROM raw WHERE user_id IN (SELECT user_id FROM s) AND is_fraud = 'No' AND tx_year < {p.last_year_excl}
UNION ALL SELECT 'users', COUNT(*), COUNT(DISTINCT user_id) FROM s
UNION ALL SELECT 'cards', CAST(SUM(user_id % 7 + 1) AS BIGINT), COUNT(DISTINCT user_id) FROM s"""

    # J
    q["cohort_sizes"] = cj + "SELECT CAST(cohort_year AS BIGINT) AS cohort_year, COUNT(*) AS users FROM cb GROUP BY cohort_year"
    q["cohort_truncation_check"] = cj + f"""
, tr AS (SELECT user_id, MIN(tx_year) AS cohort_year FROM clean WHERE tx_year >= {p.min_cohort} GROUP BY user_id)
, a AS (SELECT cohort_year, COUNT(*) AS n FROM cb WHERE cohort_year >= {p.min_cohort} GROUP BY cohort_year)
, t AS (SELECT cohort_year, COUNT(*) AS n FROM tr GROUP BY cohort_year)
SELECT CAST(COALESCE(a.cohort_year, t.cohort_year) AS BIGINT) AS cohort_year,
       CAST(COALESCE(a.n, 0) AS BIGINT) AS users_full_history, CAST(COALESCE(t.n, 0) AS BIGINT) AS users_truncated_history
FROM a FULL OUTER JOIN t ON a.cohort_year = t.cohort_year"""
    ret_sel = f"""SELECT CAST(cohort_year AS BIGINT) AS cohort_year, CAST(age AS BIGINT) AS years_since_first,
       retained_users, cohort_users, {pct('retained_users', 'cohort_users', 1)} AS retention_rate FROM ret"""
    q["cohort_retention"] = cj + ret_sel
    q["cohort_retention_matrix"] = cj + ", r AS (" + ret_sel + ")\nSELECT cohort_year, " + ", ".join(
        f"MAX(CASE WHEN years_since_first = {a} THEN retention_rate END) AS age_{a}" for a in ages) + \
        " FROM r GROUP BY cohort_year"
    q["cohort_retention_matrix_truncated"] = cj + f"""
, tb AS (SELECT user_id, MIN(tx_year) AS cohort_year FROM clean WHERE tx_year >= {p.min_cohort} GROUP BY user_id)
, ta AS (SELECT DISTINCT c.user_id, tb.cohort_year, c.tx_year - tb.cohort_year AS age FROM clean c JOIN tb ON c.user_id = tb.user_id WHERE c.tx_year >= {p.min_cohort})
, tn AS (SELECT cohort_year, age, COUNT(*) AS n FROM ta GROUP BY 1, 2)
, tr AS (SELECT a.cohort_year, a.age, {pct('a.n', 'z.n', 1)} AS rate FROM tn a JOIN tn z ON a.cohort_year = z.cohort_year AND z.age = 0)
SELECT CAST(cohort_year AS BIGINT) AS cohort_year, """ + ", ".join(f"MAX(CASE WHEN age = {a} THEN rate END) AS age_{a}" for a in ages) + " FROM tr GROUP BY cohort_year"
    q["cohort_retention_by_age"] = cj + f"""
SELECT CAST(age AS BIGINT) AS years_since_first, COUNT(*) AS cohorts,
       CAST(SUM({rr_int('1000 * retained_users', 'cohort_users')}) AS DOUBLE) / CAST(COUNT(*) * 10 AS DOUBLE) AS avg_retention_rate
FROM ret GROUP BY age"""
    beh_sel = f"""SELECT CAST(cohort_year AS BIGINT) AS cohort_year, CAST(age AS BIGINT) AS years_since_first,
       total_tx, active_users, cohort_users, {rr('total_tx', 'active_users', 1)} AS avg_tx_per_user,
       {rr_int('rev', 'active_users * 100')} AS avg_revenue_per_user FROM beh"""
    q["cohort_behavior"] = cj + beh_sel
    cy_sel = f"""SELECT cohort_year, years_since_first, active_users, avg_tx_per_user, avg_revenue_per_user
FROM ({beh_sel}) WHERE years_since_first BETWEEN {p.age_min} AND {p.age_max}"""
    q["cohort_behavior_complete_years"] = cj + cy_sel
    fa_sel = f"SELECT * FROM ({beh_sel}) WHERE years_since_first >= 1"
    q["cohort_frequency_matrix"] = cj + ", r AS (" + fa_sel + ")\nSELECT cohort_year, " + ", ".join(
        f"MAX(CASE WHEN years_since_first = {a} THEN avg_tx_per_user END) AS age_{a}" for a in ages1) + \
        " FROM r GROUP BY cohort_year"
    q["cohort_revenue_matrix"] = cj + ", r AS (" + fa_sel + ")\nSELECT cohort_year, " + ", ".join(
        f"MAX(CASE WHEN years_since_first = {a} THEN avg_revenue_per_user END) AS age_{a}" for a in ages1) + \
        " FROM r GROUP BY cohort_year"
    q["cohort_behavior_by_age"] = cj + f"""
SELECT CAST(age AS BIGINT) AS years_since_first, COUNT(*) AS cohorts,
       CAST(SUM({rr_int('10 * total_tx', 'active_users')}) AS DOUBLE) / CAST(COUNT(*) * 10 AS DOUBLE) AS avg_tx_per_user,
       CAST(SUM({rr_int('rev', 'active_users * 100')}) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS avg_revenue_per_user
FROM beh WHERE age >= 1 GROUP BY age"""
    q["cohort_demographics"] = cj + f"""
SELECT CAST(cb.cohort_year AS BIGINT) AS cohort_year, COUNT(*) AS user_count,
       {rr_int('SUM(u.c_nationkey)', 'COUNT(u.c_nationkey)')} AS avg_score,
       {rr_int('SUM(CAST(CAST(u.c_acctbal AS DECIMAL(12,2)) * 100 AS BIGINT))', 'COUNT(u.c_acctbal) * 100')} AS avg_income,
       {rr_int('SUM(18 + u.c_custkey % 70)', 'COUNT(u.c_custkey)')} AS avg_age
FROM cb JOIN customer u ON cb.user_id = u.c_custkey
WHERE cb.cohort_year BETWEEN {p.profile_cohort_lo} AND {p.profile_cohort_hi}
GROUP BY cb.cohort_year"""
    q["cohort_demographics_by_position"] = cj + f"""
, u AS (SELECT *, ROW_NUMBER() OVER (ORDER BY c_custkey) AS position FROM customer)
SELECT CAST(cb.cohort_year AS BIGINT) AS cohort_year, COUNT(*) AS user_count,
       {rr_int('SUM(u.c_nationkey)', 'COUNT(u.c_nationkey)')} AS avg_score,
       {rr_int('SUM(CAST(CAST(u.c_acctbal AS DECIMAL(12,2)) * 100 AS BIGINT))', 'COUNT(u.c_acctbal) * 100')} AS avg_income,
       {rr_int('SUM(18 + u.c_custkey % 70)', 'COUNT(u.c_custkey)')} AS avg_age
FROM cb JOIN u ON cb.user_id = u.position
WHERE cb.cohort_year BETWEEN 1995 AND 1998
GROUP BY cb.cohort_year"""
    q["observed_lifespan"] = cj + f"""
SELECT CAST(cohort_year AS BIGINT) AS cohort_year, COUNT(*) AS user_count,
       {rr('SUM(last_year - cohort_year)', 'COUNT(*)', 1)} AS avg_observed_years,
       CAST(MIN(last_year - cohort_year) AS BIGINT) AS min_years, CAST(MAX(last_year - cohort_year) AS BIGINT) AS max_years
FROM cb WHERE cohort_year BETWEEN {p.min_cohort} AND {p.lifespan_cohort_hi} GROUP BY cohort_year"""
    q["annual_ltv"] = cj + "SELECT * FROM al"
    q["ltv_summary"] = cj + f"""
SELECT COUNT(*) AS total_users, {rr_int('SUM(annual_ltv)', 'COUNT(*)')} AS avg_annual_ltv,
       MIN(annual_ltv) AS min_annual_ltv, MAX(annual_ltv) AS max_annual_ltv,
       CAST(floor(quantile_cont(annual_ltv, 0.5) + 0.5) AS BIGINT) AS median_annual_ltv,
       CAST(floor(quantile_cont(annual_ltv, 0.75) + 0.5) AS BIGINT) AS p75_annual_ltv
FROM al"""
    parts = []
    for m in ("annual_ltv", "annual_tx"):
        parts.append(f"""
SELECT '{m}' AS metric, bin, mn + CAST(bin - 1 AS DOUBLE) * (mx - mn) / {p.hist_bins} AS bin_low,
       mn + CAST(bin AS DOUBLE) * (mx - mn) / {p.hist_bins} AS bin_high, COUNT(*) AS users
FROM (SELECT CAST(CASE WHEN mx = mn THEN 1 ELSE LEAST({p.hist_bins}, ({m} - mn) * {p.hist_bins} // (mx - mn) + 1) END AS BIGINT) AS bin, mn, mx
      FROM al, (SELECT MIN({m}) AS mn, MAX({m}) AS mx FROM al) st)
GROUP BY bin, mn, mx""")
    q["ltv_distribution"] = cj + " UNION ALL ".join(parts)
    parts = []
    for m in ("annual_ltv", "annual_tx"):
        x = f"CAST({m} AS HUGEINT)"
        parts.append(f"""
SELECT '{m}' AS metric, COUNT({m}) AS count, CAST(SUM({x}) AS DOUBLE) / CAST(COUNT({m}) AS DOUBLE) AS mean,
       CASE WHEN COUNT({m}) > 1 THEN sqrt(CAST(COUNT({m}) * SUM({x} * {x}) - SUM({x}) * SUM({x}) AS DOUBLE)
                                          / CAST(COUNT({m}) * (COUNT({m}) - 1) AS DOUBLE)) END AS std,
       CAST(MIN({m}) AS DOUBLE) AS min, quantile_cont({m}, 0.25) AS q25, quantile_cont({m}, 0.5) AS q50,
       quantile_cont({m}, 0.75) AS q75, CAST(MAX({m}) AS DOUBLE) AS max
FROM al""")
    q["ltv_describe"] = cj + " UNION ALL ".join(parts)

    # K
    q["rfm_raw"] = cj + "SELECT user_id, recency_years, frequency, monetary FROM rfm"
    rcols = "user_id, recency_years, frequency, monetary, r_score, f_score, m_score"
    q["rfm_scored_ntile"] = cj + f"SELECT {rcols} FROM sc_n"
    q["rfm_scored_qcut"] = cj + f"SELECT {rcols} FROM sc_q"
    probs = ", ".join(repr(i / p.n_bins) for i in range(p.n_bins + 1))
    q["rfm_quantile_recency"] = cj + f"""
, e AS (SELECT list_sort(list_distinct(quantile_cont(recency_years, [{probs}]))) AS ue FROM rfm)
SELECT user_id, recency_years,
       CAST(GREATEST(1, (len(ue) - 1) - len(list_filter(ue[2:], lambda v: v < recency_years))) AS INTEGER) AS r_score
FROM rfm, e"""
    q["rfm_segments"] = cj + f"SELECT {rcols}, rfm_score, segment FROM seg_n"
    q["rfm_segments_qcut"] = cj + f"SELECT {rcols}, rfm_score, segment FROM seg_q"
    q["rfm_segment_summary"] = cj + f"""
SELECT segment, CAST(CASE segment WHEN 'VIP' THEN 1 WHEN 'Loyal' THEN 2 WHEN 'Potential' THEN 3
                      WHEN 'At Risk' THEN 4 WHEN 'Dormant' THEN 5 ELSE 6 END AS BIGINT) AS segment_order,
       COUNT(*) AS user_count, {pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 2)} AS ratio,
       {rr('SUM(recency_years)', 'COUNT(*)', 1)} AS avg_recency,
       {rr_int('SUM(frequency)', 'COUNT(*)')} AS avg_frequency,
       {rr_int('SUM(monetary)', 'COUNT(*)')} AS avg_monetary,
       {rr('SUM(rfm_score)', 'COUNT(*)', 1)} AS avg_rfm_score
FROM seg_n GROUP BY segment"""
    q["segment_transactions"] = cj + """
SELECT s.segment, COUNT(*) AS tx_count FROM clean c JOIN seg_q s ON c.user_id = s.user_id
WHERE c.amount > 0 GROUP BY s.segment"""
    mix_cte = f"""
, mix AS (
  SELECT segment, category, tx_count, {money('cs_')} AS total_amount,
         {pct('tx_count', 'SUM(tx_count) OVER (PARTITION BY segment)', 1)} AS ratio
  FROM (SELECT s.segment, {brand_group('c.mcc')} AS category, COUNT(*) AS tx_count, SUM(c.cents) AS cs_
        FROM clean_c c JOIN seg_q s ON c.user_id = s.user_id
        WHERE c.amount > 0 GROUP BY 1, 2)
)"""
    q["segment_category_mix"] = cj + mix_cte + "SELECT * FROM mix"
    q["segment_category_matrix"] = cj + mix_cte + """
SELECT category, COALESCE(MAX(CASE WHEN segment = 'VIP' THEN ratio END), 0.0) AS vip,
       COALESCE(MAX(CASE WHEN segment = 'Potential' THEN ratio END), 0.0) AS potential,
       COALESCE(MAX(CASE WHEN segment = 'Loyal' THEN ratio END), 0.0) AS loyal
FROM mix WHERE segment IN ('VIP', 'Potential', 'Loyal') GROUP BY category"""
    q["segment_top_categories"] = cj + mix_cte + f"""
SELECT segment, rank, category, tx_count, ratio FROM (
  SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY segment ORDER BY ratio DESC, tx_count DESC, category) AS BIGINT) AS rank
  FROM mix) WHERE rank <= {p.top_per_segment}"""
    q["segment_seasonality"] = cj + f"""
SELECT segment, tx_month, tx_count, {pct('tx_count', 'SUM(tx_count) OVER (PARTITION BY segment)', 1)} AS ratio
FROM (SELECT s.segment, CAST(c.tx_month AS BIGINT) AS tx_month, COUNT(*) AS tx_count
      FROM clean c JOIN seg_q s ON c.user_id = s.user_id WHERE c.amount > 0 GROUP BY 1, 2)"""

    # L
    q["activation_by_segment"] = ex + f"""
SELECT segment, COUNT(*) AS user_count, CAST(SUM(activated) AS BIGINT) AS activated,
       {rr('SUM(activated)', 'COUNT(*)', 3)} AS activation_rate
FROM units GROUP BY segment"""
    q["experiment_assignment"] = ex + "SELECT user_id, CAST(activated AS BIGINT) AS activated, segment, draw_order, arm FROM asg2"
    q["observed_outcomes"] = ex + "SELECT * FROM outc"
    q["experiment_groups"] = ex + f"""
, g AS (SELECT outcome, arm, COUNT(*) AS n, CAST(SUM(converted) AS BIGINT) AS conversions FROM outc GROUP BY 1, 2)
SELECT g.outcome, g.arm, g.n, g.conversions, {rr('g.conversions', 'g.n', 4)} AS conversion_rate,
       CASE WHEN g.arm = 'treatment'
            THEN {rr('100 * (g.conversions * c.n - c.conversions * g.n)', 'g.n * c.n', 1)} END AS lift_pp
FROM g JOIN g c ON c.outcome = g.outcome AND c.arm = 'control'"""
    q["experiment_by_segment"] = ex + f"""
, g AS (
  SELECT outcome, segment,
         COUNT(*) FILTER (WHERE arm = 'control') AS n_control,
         SUM(CASE WHEN arm = 'control' THEN converted ELSE 0 END) AS x_control,
         COUNT(*) FILTER (WHERE arm = 'treatment') AS n_treated,
         SUM(CASE WHEN arm = 'treatment' THEN converted ELSE 0 END) AS x_treated
  FROM outc GROUP BY 1, 2
)
SELECT outcome, segment, n_control, n_treated,
       CASE WHEN n_control > 0 THEN {rr('x_control', 'n_control', 3)} END AS control_rate,
       CASE WHEN n_treated > 0 THEN {rr('x_treated', 'n_treated', 3)} END AS treated_rate,
       CASE WHEN n_control > 0 AND n_treated > 0
            THEN {rr('100 * (x_treated * n_control - x_control * n_treated)', 'n_treated * n_control', 1)} END AS diff_pp
FROM g"""
    pv = "1 - " + sql_normal_cdf("z")
    q["two_proportion_ztest"] = ex + f"""
SELECT outcome, x_treated, n_treated, x_control, n_control, {fround('z', 4)} AS z_stat,
       {fround(pv, 6)} AS p_value, CAST(CASE WHEN {pv} < {p.alpha} THEN 1 ELSE 0 END AS BIGINT) AS reject
FROM zt"""
    zq = z_quantile(1 - p.alpha / 2)
    rate = "CAST(conversions AS DOUBLE) / CAST(n AS DOUBLE)"
    half = f"CAST({zq!r} AS DOUBLE) * sqrt(({rate}) * (1 - ({rate})) / CAST(n AS DOUBLE))"
    q["proportion_ci"] = ex + f"""
SELECT outcome, arm, n, conversions,
       {fround(f'GREATEST(0.0, ({rate}) - {half})', 4)} AS ci_low,
       {fround(f'LEAST(1.0, ({rate}) + {half})', 4)} AS ci_high
FROM (SELECT outcome, arm, COUNT(*) AS n, CAST(SUM(converted) AS BIGINT) AS conversions FROM outc GROUP BY 1, 2)"""
    za, zb = z_quantile(1 - p.alpha), z_quantile(p.power)
    grid = ", ".join(f"CAST({m!r} AS DOUBLE)" for m in p.mde_grid)
    p0 = "CAST(activated AS DOUBLE) / CAST(users AS DOUBLE)"
    h = f"(2 * asin(sqrt({p0} + mde)) - 2 * asin(sqrt({p0})))"
    nn = f"CAST(ceil(2.0 * pow(CAST({za + zb!r} AS DOUBLE) / {h}, 2)) AS BIGINT)"
    ok = f"({p0} + mde <= 1 AND {h} > 0)"
    q["sample_size_plan"] = ex + f"""
, base_ AS (
  SELECT 'all' AS baseline, COUNT(*) AS users, CAST(SUM(activated) AS BIGINT) AS activated FROM units
  UNION ALL
  SELECT segment, COUNT(*), CAST(SUM(activated) AS BIGINT) FROM units GROUP BY segment
)
SELECT baseline, users, {fround(p0, 4)} AS baseline_rate, mde,
       CASE WHEN {ok} THEN {fround(h, 4)} END AS cohens_h,
       CASE WHEN {ok} THEN {nn} END AS n_per_group,
       CASE WHEN {ok} THEN CAST(users >= 2 * {nn} AS BIGINT) END AS enough
FROM base_, (SELECT unnest([{grid}]) AS mde) g"""
    h0 = f"(2 * asin(sqrt(p0 + CAST({p.planned_mde!r} AS DOUBLE))) - 2 * asin(sqrt(p0)))"
    q["power_curve"] = ex + f"""
, b AS (SELECT CAST(SUM(activated) AS DOUBLE) / CAST(COUNT(*) AS DOUBLE) AS p0 FROM units)
SELECT CAST(n AS BIGINT) AS n_per_group,
       {fround(sql_normal_cdf(f'{h0} * sqrt(CAST(n AS DOUBLE) / 2) - CAST({za!r} AS DOUBLE)'), 6)} AS power
FROM b, generate_series({p.power_n_lo}, {p.power_n_hi}, {p.power_n_step}) t(n)"""
    q["outcome_comparison"] = ex + f"""
SELECT outcome, 'control' AS arm, CASE WHEN n_control > 0 THEN {rr('100 * x_control', 'n_control', 1)} END AS conversion_rate,
       CAST(NULL AS DOUBLE) AS lift_pp, n_control AS n, CAST(NULL AS DOUBLE) AS p_value, CAST(NULL AS VARCHAR) AS decision
FROM arms
UNION ALL
SELECT outcome, 'treatment', CASE WHEN n_treated > 0 THEN {rr('100 * x_treated', 'n_treated', 1)} END,
       CASE WHEN n_treated > 0 AND n_control > 0
            THEN {rr('100 * (x_treated * n_control - x_control * n_treated)', 'n_treated * n_control', 1)} END,
       n_treated, {fround(pv, 4)}, CASE WHEN {pv} < 0.05 THEN 'reject' ELSE 'keep' END
FROM zt"""
    lift = ("(CASE WHEN n_treated > 0 AND n_control > 0 THEN CAST(x_treated AS DOUBLE) / CAST(n_treated AS DOUBLE)"
            " - CAST(x_control AS DOUBLE) / CAST(n_control AS DOUBLE) END)")
    q["impact_estimate"] = ex + f"""
, u AS (SELECT COUNT(*) AS eligible_users FROM fc)
, l AS (SELECT {rr_int('SUM(annual_ltv)', 'COUNT(*)')} AS avg_annual_ltv FROM al)
SELECT outcome, eligible_users, {fround(lift, 6)} AS lift,
       CAST(trunc(CAST(eligible_users AS DOUBLE) * {lift}) AS BIGINT) AS additional_activated,
       avg_annual_ltv,
       CAST(trunc(CAST(eligible_users AS DOUBLE) * {lift}) AS BIGINT) * avg_annual_ltv AS additional_revenue
FROM arms, u, l"""


def _marts_sql(q: dict) -> str:
    """The six marts in full, as rows (mart, key1, key2, metric, value)."""
    label = "CASE WHEN mcc LIKE 'Brand#%' AND TRY_CAST(substr(mcc, 7) AS INTEGER) BETWEEN 1 AND 20 THEN 'brand-' || substr(mcc, 7) ELSE 'other' END"
    marts = {
        "aarrr_funnel": ("funnel_stages", "stage", "NULL", ("users", "order_num")),
        "yearly_trend": ("yearly_trend", "tx_year", "NULL", ("tx_count", "active_users", "avg_amount", "total_revenue")),
        "cohort_behavior": ("cohort_behavior_complete_years", "cohort_year", "years_since_first", ("active_users", "avg_tx_per_user", "avg_revenue_per_user")),
        "rfm_segments": ("rfm_segments_qcut", "user_id", "segment", ("recency_years", "frequency", "monetary", "r_score", "f_score", "m_score", "rfm_score")),
        "ab_test_result": ("outcome_comparison", "outcome", "arm", ("conversion_rate", "lift_pp", "n", "p_value")),
        "mcc_category": ("category_top20_purchases", "mcc", label, ("tx_count", "avg_amount", "ratio")),
    }
    parts = []
    for mart, (query, key1, key2, values) in marts.items():
        for v in values:
            parts.append(f"SELECT '{mart}' AS mart, CAST({key1} AS VARCHAR) AS key1, CAST({key2} AS VARCHAR) AS key2, '{v}' AS metric, CAST({v} AS DOUBLE) AS value FROM m_{mart}")
    ctes = ", ".join(f"m_{mart} AS MATERIALIZED ({q[query]})" for mart, (query, *_) in marts.items())
    return f"WITH {ctes}\n" + "\nUNION ALL\n".join(parts)


def _normal_scores_sql() -> str:
    """The same published start (Abramowitz and Stegun 26.2.23) and two Halley steps, in SQL."""
    pdf = lambda x: f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()))"
    step = lambda x: f"({x} - u / (1 + {x} * u / 2))"
    steps = "".join(f"""
, u{i} AS (SELECT *, ({sql_normal_cdf(f'x{i}')} - tail) / {pdf(f'x{i}')} AS u FROM x{i})
, x{i + 1} AS (SELECT * EXCLUDE (u), {step(f'x{i}')} AS x{i + 1} FROM u{i})""" for i in range(2))
    return with_(base()) + f"""
, g AS (SELECT mcc, COUNT(*) AS row_count, COUNT(*) FILTER (WHERE amount < 0) AS refunds FROM clean GROUP BY mcc)
, s AS (SELECT *, CAST(refunds + 1 AS DOUBLE) / CAST(row_count + 2 AS DOUBLE) AS p FROM g)
, t AS (SELECT *, least(p, 1 - p) AS tail, sqrt(-2 * ln(least(p, 1 - p))) AS t FROM s)
, x0 AS (SELECT *, (2.515517e0 + 0.802853e0 * t + 0.010328e0 * t * t) / (1e0 + 1.432788e0 * t + 0.189269e0 * t * t + 0.001308e0 * t * t * t) - t AS x0 FROM t){steps}
, z AS (SELECT *, CASE WHEN p > 0.5 THEN -x2 ELSE x2 END AS z FROM x2)
SELECT mcc, row_count, refunds, {fround('z', 6)} AS score, {fround('-z', 6)} AS mirrored, {fround(pdf('z'), 6)} AS density, {fround(sql_normal_cdf('z'), 6)} AS share FROM z"""


def _sources_sql(q: dict) -> None:
    q["bulk_load_with_rejects"] = with_(base()) + """
, b AS (SELECT *, card = 5 AS no_amount, card = 6 AND tx_month = 2 AS no_day FROM raw)
SELECT 'kept' AS reason, CAST(tx_year AS BIGINT) AS tx_year, COUNT(*) AS row_count,
       CAST(SUM(CAST(CAST(replace(amount_raw, '$', '') AS DECIMAL(12,2)) * 100 AS BIGINT)) AS BIGINT) AS cents,
       COUNT(*) FILTER (WHERE is_fraud = 'Yes') AS fraud_rows, COUNT(errors) AS error_rows
FROM b WHERE NOT no_amount AND NOT no_day GROUP BY tx_year
UNION ALL SELECT 'amount: n/a', NULL, COUNT(*), NULL, NULL, NULL FROM b WHERE no_amount HAVING COUNT(*) > 0
UNION ALL SELECT 'no such day', NULL, COUNT(*), NULL, NULL, NULL FROM b WHERE no_day HAVING COUNT(*) > 0"""
    q["stream_loads"] = with_(base()) + """
SELECT CAST(tx_year AS BIGINT) AS tx_year, COUNT(*) AS row_count,
       CAST(SUM(CAST(CAST(replace(amount_raw, '$', '') AS DECIMAL(12,2)) * 100 AS BIGINT)) AS BIGINT) AS cents, COUNT(DISTINCT user_id) AS users
FROM raw GROUP BY tx_year"""
    q["rfm_raw_from_buckets"] = q["rfm_raw"]
    q["marts_refreshed"] = q["marts_written"] = _marts_sql(q)
    q["refund_normal_scores"] = _normal_scores_sql()


ORACLE_SQL: dict[str, str] = _sql()
_sources_sql(ORACLE_SQL)
