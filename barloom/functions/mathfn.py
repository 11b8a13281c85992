"""Scalar functions as Columns: normal distribution, clipping, text helpers."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.shipping import ship

ship(__name__)

# Coefficients of the rational approximation of the normal CDF
# published by G. West, "Better approximations to cumulative normal functions" (2005).
WEST_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
WEST_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
WEST_SWITCH = 7.07106781186547
WEST_TAIL = 2.506628274631

# Coefficients of P. Acklam's inverse normal approximation (2003).
ACKLAM_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
ACKLAM_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00)
ACKLAM_LOW = 0.02425

NORM = 1.0 / math.sqrt(2.0 * math.pi)


def _tail_polynomials():
    """The tail's continued fraction z + 1/(z + 2/(z + 3/(z + 4/(z + 0.65)))) as a ratio."""
    top, bottom = [1.0, 0.65], [1.0]
    for k in (4.0, 3.0, 2.0, 1.0):
        longer = [*top, 0.0]
        shift = len(longer) - len(bottom)
        for i, b in enumerate(bottom):
            longer[shift + i] += k * b
        top, bottom = longer, top
    return top, bottom


FRACTION_TOP, FRACTION_BOTTOM = _tail_polynomials()


def col(x) -> Column:
    """Column name, number or Column -> Column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def horner(coefficients, x):
    total = coefficients[0]
    for c in coefficients[1:]:
        total = total * x + c
    return total


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, for bodies that use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def norm_pdf(x) -> Column:
    x = col(x)
    return F.exp(-x * x / 2.0) * NORM


def known(x: Column, default=0.0) -> Column:
    """``x`` as a value Spark knows to be non-null, which keeps generated code small.

    A long formula over nullable values produces methods beyond the size the JVM compiles.
    """
    return F.coalesce(x, F.lit(default))


def upper_tail(z: Column, e: Column) -> Column:
    """P(X > z) for non-null z >= 0 with e = exp(-z*z/2)."""
    near = known(e * horner(WEST_NUMERATOR, z) / horner(WEST_DENOMINATOR, z))
    far = known(e * horner(FRACTION_BOTTOM, z) / horner(FRACTION_TOP, z)) * (1.0 / WEST_TAIL)
    return F.when(z < WEST_SWITCH, near).otherwise(far)


def norm_cdf(x) -> Column:
    x = col(x)
    safe = known(x)
    z = F.least(F.abs(safe), F.lit(38.0))
    tail = upper_tail(z, F.exp(-z * z / 2.0))
    return F.when(x.isNotNull(), F.when(safe > 0, 1.0 - tail).otherwise(tail))


def norm_ppf(p) -> Column:
    """Inverse normal CDF; 0 and 1 give -inf and inf, outside gives null."""
    if isinstance(p, (int, float)):
        return F.lit(NormalDist().inv_cdf(p))
    p = col(p)
    q = p - 0.5
    middle = q * horner(ACKLAM_A, q * q) / (horner(ACKLAM_B, q * q) * q * q + 1.0)
    tail_p = F.least(p, 1.0 - p)
    s = F.sqrt(-2.0 * F.ln(tail_p))
    tail = horner(ACKLAM_C, s) / (horner(ACKLAM_D, s) * s + 1.0)
    start = F.when(tail_p >= ACKLAM_LOW, middle).when(p < 0.5, tail).otherwise(-tail)
    # One Newton step from the approximation.
    refined = let(start, lambda x: x - (norm_cdf(x) - p) / norm_pdf(x))
    return (
        F.when((p > 0) & (p < 1), refined)
        .when(p == 0, F.lit(float("-inf")))
        .when(p == 1, F.lit(float("inf")))
    )


def clip(x, lo, hi) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, col(lo)), col(hi)))


def nan_to_null(x) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def first_key(*candidates, width: int = 50) -> Column:
    """First non-null candidate; the last one cut to ``width`` characters."""
    *head, last = [F.col(c) if isinstance(c, str) else c for c in candidates]
    return F.coalesce(*head, F.substring(last, 1, width))


def money(x) -> Column:
    return F.format_string("$%.2f", col(x))


def signed_percent(x) -> Column:
    return F.format_string("%+.2f%%", col(x))


def percent(x, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", col(x))


def parse_iso(text) -> Column:
    """ISO timestamp text, with ``Z`` or an offset or none; null if unparsable."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(text)


def age_seconds(ts, as_of) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(ts)) / 1e6


def expiry_text(as_of, days) -> Column:
    return F.date_format(F.date_add(F.to_date(as_of), days), "yyyy-MM-dd")


def arg_max(values) -> Column:
    """0-based index of the first largest element."""
    values = F.col(values) if isinstance(values, str) else values
    return F.array_position(values, F.array_max(values)) - 1
