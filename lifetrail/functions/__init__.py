from lifetrail.functions.exprs import (  # noqa: F401
    MONEY, parse_amount, date_int, year_month, date_from_int, year_of_int, idiv,
    round_ratio, round_ratio_int, round_half_even, whole, pct, cents, money, floor_round, span_years,
    ntile_from_rank, qcut_from_rank, recency_score, rfm_segment, normal_cdf, normal_pdf, normal_quantile,
    md5_key,
)
