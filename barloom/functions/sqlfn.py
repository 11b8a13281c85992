"""The option formulas as SQL functions, so ``spark.sql`` text can call them.

They are SQL expressions and run inside the query's generated code; only the
implied volatility is a Python function.
"""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from barloom.functions.mathfn import (
    FRACTION_BOTTOM,
    FRACTION_TOP,
    WEST_DENOMINATOR,
    WEST_NUMERATOR,
    WEST_SWITCH,
    WEST_TAIL,
)
from barloom.functions.options import implied_vol_udf


def _poly(coefficients) -> str:
    return horner([f"{c!r}D" for c in coefficients], "z")


def horner(parts, z) -> str:
    text = parts[0]
    for c in parts[1:]:
        text = f"({text} * {z} + {c})"
    return text


_ROOT = "sqrt(CASE WHEN T > 0D THEN T END)"
_QUOTE = "S DOUBLE, K DOUBLE, T DOUBLE, r DOUBLE, sigma DOUBLE"
_CARRY, _DISCOUNT = "exp(-q * T)", "exp(-r * T)"
_D1, _D2 = "bs_d1(S, K, T, r, sigma, q)", "bs_d2(S, K, T, r, sigma, q)"
_TYPE = "option_type STRING DEFAULT 'call', q DOUBLE DEFAULT 0.0D"
_DECAY = f"-S * {_CARRY} * norm_pdf({_D1}) * sigma / (2D * {_ROOT})"

FUNCTIONS = {
    "norm_pdf": ("x DOUBLE", f"exp(-x * x / 2D) / {math.sqrt(2 * math.pi)!r}D"),
    # Upper tail for z >= 0 with e = exp(-z * z / 2); the caller passes values that are never null.
    "norm_tail": (
        "z DOUBLE, e DOUBLE",
        f"coalesce(CASE WHEN z < {WEST_SWITCH}D THEN e * {_poly(WEST_NUMERATOR)} / {_poly(WEST_DENOMINATOR)} "
        f"ELSE e * {_poly(FRACTION_BOTTOM)} / {_poly(FRACTION_TOP)} / {WEST_TAIL}D END, 0D)",
    ),
    "norm_cdf": (
        "x DOUBLE",
        "(CASE WHEN x > 0D THEN 1D ELSE 0D END) - (CASE WHEN x > 0D THEN 1D WHEN x IS NOT NULL THEN -1D END) "
        "* norm_tail(least(coalesce(abs(x), 0D), 38D), coalesce(exp(-x * x / 2D), 0D))",
    ),
    "bs_d1": (
        f"{_QUOTE}, q DOUBLE DEFAULT 0.0D",
        f"try_divide(ln(try_divide(S, K)) + (r - q + 0.5D * sigma * sigma) * T, sigma * {_ROOT})",
    ),
    "bs_d2": (f"{_QUOTE}, q DOUBLE DEFAULT 0.0D", f"{_D1} - sigma * {_ROOT}"),
    "calculate_price": (
        f"{_QUOTE}, {_TYPE}",
        "CASE WHEN T <= 0D THEN greatest(CASE WHEN option_type = 'call' THEN S - K ELSE K - S END, 0D) "
        f"WHEN option_type = 'call' THEN S * {_CARRY} * norm_cdf({_D1}) - K * {_DISCOUNT} * norm_cdf({_D2}) "
        f"ELSE K * {_DISCOUNT} * norm_cdf(-{_D2}) - S * {_CARRY} * norm_cdf(-{_D1}) END",
    ),
    "calculate_delta": (
        f"{_QUOTE}, {_TYPE}",
        "CASE WHEN T <= 0D THEN CASE WHEN option_type = 'call' AND S > K THEN 1D ELSE 0D END "
        f"WHEN option_type = 'call' THEN {_CARRY} * norm_cdf({_D1}) "
        f"ELSE -{_CARRY} * norm_cdf(-{_D1}) END",
    ),
    "calculate_gamma": (
        f"{_QUOTE}, q DOUBLE DEFAULT 0.0D",
        f"CASE WHEN T <= 0D THEN 0D ELSE try_divide({_CARRY} * norm_pdf({_D1}), S * sigma * {_ROOT}) END",
    ),
    "calculate_vega": (
        f"{_QUOTE}, q DOUBLE DEFAULT 0.0D",
        f"CASE WHEN T <= 0D THEN 0D ELSE S * {_CARRY} * norm_pdf({_D1}) * {_ROOT} / 100D END",
    ),
    "calculate_theta": (
        f"{_QUOTE}, {_TYPE}",
        "CASE WHEN T <= 0D THEN 0D WHEN option_type = 'call' THEN "
        f"({_DECAY} - r * K * {_DISCOUNT} * norm_cdf({_D2}) + q * S * {_CARRY} * norm_cdf({_D1})) / 365D "
        f"ELSE ({_DECAY} + r * K * {_DISCOUNT} * norm_cdf(-{_D2}) - q * S * {_CARRY} * norm_cdf(-{_D1})) / 365D END",
    ),
    "calculate_rho": (
        f"{_QUOTE}, {_TYPE}",
        "CASE WHEN T <= 0D THEN 0D "
        f"WHEN option_type = 'call' THEN K * T * {_DISCOUNT} * norm_cdf({_D2}) / 100D "
        f"ELSE -K * T * {_DISCOUNT} * norm_cdf(-{_D2}) / 100D END",
    ),
}


def register(spark: SparkSession) -> None:
    """Create the functions in this session.

    Several of them in one SELECT make a generated method larger than the 8,000 bytes the JVM
    compiles, and it would be interpreted.  The setting lets Spark generate small methods then.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS DOUBLE RETURN {body}"
        )
    spark.udf.register("implied_vol", implied_vol_udf())
