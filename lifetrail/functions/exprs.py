"""Column expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage codegen; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(12, 2)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- parsing
def parse_amount(col) -> Column:
    """Currency text ``'$1234.56'`` / ``'$-1.00'`` -> DECIMAL(12,2).

    ``try_cast`` gives NULL for malformed text instead of failing the
    job (ANSI casts throw).  Numeric input is cast directly.
    """
    c = _c(col)
    return F.replace(c.cast("string"), F.lit("$"), F.lit("")).try_cast(MONEY)


def date_int(y, m, d) -> Column:
    """Integer date key ``YYYYMMDD``."""
    return _c(y) * 10000 + _c(m) * 100 + _c(d)


def year_month(y, m) -> Column:
    return _c(y) * 100 + _c(m)


def date_from_int(di) -> Column:
    di = _c(di)
    return F.make_date(idiv(di, 10000), idiv(di, 100) % 100, di % 100)


def year_of_int(di) -> Column:
    return idiv(_c(di), 10000)


# ---------------------------------------------------------------- arithmetic
def idiv(a, b) -> Column:
    """Integral division (truncates toward zero), exact for longs."""
    return F.call_function("div", _c(a), _c(b) if not isinstance(b, int) else F.lit(b))


def round_ratio(a, b, k: int) -> Column:
    """``round(a / b, k)`` half away from zero, computed in integers.

    ``a`` and ``b`` are integral (counts, cents); ``b > 0``.  Doing the
    rounding with integer arithmetic makes the result independent of the
    engine's decimal/binary rounding and of summation order.  It runs in
    DECIMAL(38,0): scaled sums of a large fact pass the range of a long.
    """
    scale = 10 ** k
    return (_rounded(a, b, scale) / F.lit(float(scale))).cast("double")


def _rounded(a, b, scale: int) -> Column:
    """``round(a * scale / b)`` half away from zero, as a long."""
    a, b = whole(a), whole(b)
    mag = idiv(F.abs(a) * F.lit(2 * scale).cast("decimal(10,0)") + b, b * F.lit(2).cast("decimal(10,0)"))
    return F.when(a < 0, -mag).otherwise(mag)


def whole(x) -> Column:
    """An integral column as DECIMAL(38,0), for products beyond a long."""
    return _c(x).cast("decimal(38,0)")


def round_half_even(x, k: int) -> Column:
    """``round(x, k)`` with ties to the even neighbour (Python, NumPy and
    pandas), of a double or decimal."""
    return F.bround(_c(x), k)


def round_ratio_int(a, b) -> Column:
    """``round(a / b, 0)`` as a long (half away from zero)."""
    return _rounded(a, b, 1).cast("long")


def pct(a, b, k: int) -> Column:
    """Percentage ``a * 100 / b`` rounded to ``k`` decimals."""
    return round_ratio(whole(a) * F.lit(100).cast("decimal(10,0)"), b, k)


def cents(amount) -> Column:
    """DECIMAL(12,2) money -> long cents (exact)."""
    return (_c(amount) * 100).cast("long")


def money(cents_col) -> Column:
    """long cents -> double dollars (single exact-operand division)."""
    return (_c(cents_col) / F.lit(100.0)).cast("double")


def floor_round(x, k: int) -> Column:
    """Half-up rounding of a double via floor; same arithmetic in any engine."""
    s = float(10 ** k)
    return F.floor(_c(x) * s + 0.5) / s


def span_years(first_year, last_year) -> Column:
    """Active span ``last - first`` with 0 replaced by 1 (guarded divisor)."""
    s = _c(last_year) - _c(first_year)
    return F.when(s == 0, F.lit(1)).otherwise(s)


# ---------------------------------------------------------------- binning
def ntile_from_rank(r, n, k: int) -> Column:
    """SQL ``NTILE(k)`` bucket of the 1-based rank ``r`` among ``n`` rows.

    The first ``n mod k`` buckets hold ``n div k + 1`` rows, the rest
    ``n div k``.
    """
    r, n = _c(r).cast("long"), _c(n).cast("long")
    q = idiv(n, k)
    rem = n % k
    big = rem * (q + 1)
    return (F.when(r <= big, idiv(r - 1, q + 1) + 1)
            .otherwise(rem + idiv(r - 1 - big, F.greatest(q, F.lit(1))) + 1)).cast("int")


def qcut_from_rank(r, n, k: int) -> Column:
    """Equal-count bin of ``qcut(rank, k)`` for ranks 1..n (1-based label).

    Bin edges are ``1 + i (n-1) / k``; a rank falls in the first bin whose
    right edge it does not exceed: ``max(1, ceil((r-1) k / (n-1)))``.
    ``n = 1`` puts the single row in bin 1.
    """
    r, n = _c(r).cast("long"), _c(n).cast("long")
    num = (r - 1) * k
    den = n - 1
    ceil_div = idiv(num + den - 1, F.greatest(den, F.lit(1)))
    return F.when(n <= 1, F.lit(1)).otherwise(F.greatest(F.lit(1), ceil_div)).cast("int")


def recency_score(years, bands=(0, 2, 5, 9)) -> Column:
    """R score: 5 at bands[0] (the as-of year), 4 up to bands[1], ... else 1."""
    y = _c(years)
    e = F.when(y == bands[0], 5)
    for score, b in zip((4, 3, 2), bands[1:]):
        e = e.when(y <= b, score)
    return e.otherwise(1).cast("int")


def rfm_segment(score, r, f, m, cuts=(13, 10, 7)) -> Column:
    """Segment label from the RFM score and its parts."""
    score, r, f, m = _c(score), _c(r), _c(f), _c(m)
    return (F.when(score >= cuts[0], "VIP")
            .when(score >= cuts[1], "Loyal")
            .when(score >= cuts[2], "Potential")
            .when((r <= 2) & ((f >= 3) | (m >= 3)), "At Risk")
            .otherwise("Dormant"))


# ---------------------------------------------------------------- statistics
# Coefficients of the double-precision normal CDF of
# Hart (1968) as published by West (2005), "Better approximations to
# cumulative normal functions".
_HART_P = (0.0352624965998911, 0.700383064443688, 6.37396220353165,
           33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_HART_Q = (0.0883883476483184, 1.75566716318264, 16.064177579207,
           86.7807322029461, 296.564248779674, 637.333633378831,
           793.826512519948, 440.413735824752)
_HART_SPLIT = 7.07106781186547
_SQRT_2PI = 2.506628274631


def _horner(x: Column, coeffs) -> Column:
    acc = F.lit(coeffs[0]) * x + coeffs[1]
    for c in coeffs[2:]:
        acc = acc * x + c
    return acc


def normal_cdf(x) -> Column:
    """Standard normal CDF as a pure Column expression (abs error ~1e-15)."""
    x = _c(x).cast("double")
    ax = F.abs(x)
    ex = F.exp(-ax * ax / 2)
    near = ex * _horner(ax, _HART_P) / _horner(ax, _HART_Q)
    frac = ax + 0.65
    for k in (4, 3, 2, 1):
        frac = ax + F.lit(float(k)) / frac
    far = ex / frac / _SQRT_2PI
    tail = F.when(ax > 37, F.lit(0.0)).when(ax < _HART_SPLIT, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_pdf(x) -> Column:
    """Standard normal density."""
    x = _c(x).cast("double")
    return F.exp(-x * x / 2) / F.sqrt(2 * F.pi())


# Coefficients of the rational approximation 26.2.23 of
# Abramowitz and Stegun (1964), absolute error below 4.5e-4.
_START_C = (2.515517, 0.802853, 0.010328)
_START_D = (1.0, 1.432788, 0.189269, 0.001308)


def normal_quantile(p) -> Column:
    """Standard normal quantile of a probability in (0, 1), else null.

    A rational start in the lower tail, then two Halley steps on
    ``normal_cdf`` (each triples the digits); the upper half by symmetry, so
    tails keep their relative accuracy.  The steps run in a ``transform``,
    where a value is computed once however often it is used."""
    p = _c(p).cast("double")
    tail = F.least(p, 1 - p)

    def poly(t, cs):
        return sum((F.lit(c) * F.pow(t, F.lit(float(i))) for i, c in enumerate(cs) if i), F.lit(cs[0]))

    def bind(value, fn):
        return F.element_at(F.transform(F.array(value), fn), 1)

    def halley(x, q):
        # u = (Phi(x) - q) / phi(x);  x - u / (1 + x u / 2)
        return bind((normal_cdf(x) - q) / normal_pdf(x), lambda u: x - u / (1 + x * u / 2))

    def solve(q):
        start = bind(F.sqrt(-2 * F.log(q)), lambda t: poly(t, _START_C) / poly(t, _START_D) - t)
        return bind(start, lambda x: bind(halley(x, q), lambda y: halley(y, q)))

    low = bind(tail, solve)
    return F.when((p > 0) & (p < 1), F.when(p > 0.5, -low).otherwise(low))


def md5_key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *[_c(p).cast("string") for p in parts]))
