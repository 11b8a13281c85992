"""Black-Scholes prices and Greeks over quote tables.

Every function takes column names, Columns or numbers.  ``with_values`` keeps d1, d2 and
the two normal terms as columns of their own, so the long CDF expression enters the plan
once.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.mathfn import (
    NORM,
    WEST_DENOMINATOR,
    WEST_NUMERATOR,
    WEST_SWITCH,
    WEST_TAIL,
    col,
    horner,
    known,
    norm_ppf,
    upper_tail,
)
from barloom.shipping import ship

ship(__name__)

RATE, DIVIDEND = 0.05, 0.02
YEAR_SECONDS = 365.25 * 24 * 3600


def d1(s, k, t, r, sigma, q=0.0) -> Column:
    s, k, t, r, sigma, q = map(col, (s, k, t, r, sigma, q))
    spread = sigma * F.sqrt(F.when(t > 0, t))
    return F.try_divide(F.ln(F.try_divide(s, k)) + (r - q + 0.5 * sigma * sigma) * t, spread)


def d2(s, k, t, r, sigma, q=0.0) -> Column:
    return d1(s, k, t, r, sigma, q) - col(sigma) * F.sqrt(F.when(col(t) > 0, col(t)))


def is_call(option_type) -> Column:
    return (F.col(option_type) if isinstance(option_type, str) else option_type) == "call"


def moneyness(s, k) -> Column:
    return F.try_divide(col(s), col(k))


def intrinsic(s, k, option_type) -> Column:
    s, k = col(s), col(k)
    return F.greatest(F.when(is_call(option_type), s - k).otherwise(k - s), F.lit(0.0))


def years_to(expiration, ts) -> Column:
    """Years from ts to expiration (date, timestamp or ISO text)."""
    e, t = (F.col(c) if isinstance(c, str) else c for c in (expiration, ts))
    as_seconds = [F.unix_micros(c.cast("timestamp")) / 1e6 for c in (e, t)]
    return (as_seconds[0] - as_seconds[1]) / YEAR_SECONDS


def _terms(option_type):
    """Price and Greeks over the working columns, none of which is null."""
    c = F.col
    s, k, t, r, q, v, root = (c(f"_{n}") for n in ("s", "k", "t", "r", "q", "v", "root"))
    n1, n2, pdf, carry, discount = (c(f"_{n}") for n in ("n1", "n2", "pdf", "carry", "discount"))
    call = known(is_call(option_type), False)
    decay = known(F.try_divide(-s * carry * pdf * v, root)) * 0.5
    side = F.when(call, 1.0).otherwise(-1.0)
    # N(d) for calls and -N(-d) for puts.
    w1, w2 = (F.when(call, n).otherwise(n - 1.0) for n in (n1, n2))
    live = {
        "price": s * carry * w1 - k * discount * w2,
        "delta": carry * w1,
        "gamma": known(F.try_divide(carry * pdf, s * v * root)),
        "vega": s * carry * pdf * root * 0.01,
        "theta": (decay - r * k * discount * w2 + q * s * carry * w1) * (1.0 / 365.0),
        "rho": k * t * discount * w2 * 0.01,
    }
    # An expired option is worth its intrinsic value and has delta 1 only as an in-the-money call.
    expired = {
        "price": F.greatest((s - k) * side, F.lit(0.0)),
        "delta": F.when(call & (s > k), 1.0).otherwise(0.0),
    }
    return live, expired


def with_values(
    df: DataFrame,
    outputs=("price", "delta", "gamma", "vega", "theta", "rho"),
    s="underlying_price",
    k="strike",
    t="time_to_expiration",
    sigma="implied_volatility",
    option_type="option_type",
    r=RATE,
    q=DIVIDEND,
) -> DataFrame:
    """Append the wanted outputs; a null volatility, price, strike or time gives nulls.

    Nulls are replaced before the arithmetic and put back after it.  The steps are columns
    of their own, so each is computed once.
    """
    inputs = {"s": s, "k": k, "t": t, "v": sigma, "r": r, "q": q}
    varying = {n: col(x) for n, x in inputs.items() if not isinstance(x, (int, float))}
    c = F.col
    given, positive = F.lit(True), F.lit(True)
    for n, x in varying.items():
        given = given & x.isNotNull()
        positive = positive & (x > 0) if n in "skv" else positive
    t = col(t)
    # 1: live, 2: expired, 0: an input is missing, or a price or volatility is not positive.
    mode = F.when(~given, 0).when(t <= 0, 2).when(positive, 1).otherwise(0)
    staged = df.withColumn("_mode", mode)
    staged = staged.withColumns(
        {f"_{n}": known(F.when(c("_mode") == 1, x), 1.0) for n, x in varying.items() if n in "tv"}
        | {f"_{n}": known(x, 1.0) for n, x in varying.items() if n not in "tv"}
        | {f"_{n}": F.lit(float(x)) for n, x in inputs.items() if n not in varying}
    )
    staged = staged.withColumn("_root", F.sqrt("_t"))
    numerator = known(F.ln(known(F.try_divide("_s", "_k"), 1.0))) + (c("_r") - c("_q") + c("_v") * c("_v") * 0.5) * c("_t")
    staged = staged.withColumn("_d1", known(F.try_divide(numerator, c("_v") * c("_root"))))
    staged = staged.withColumn("_d2", c("_d1") - c("_v") * c("_root"))
    staged = staged.withColumns({f"_z{i}": F.least(F.abs(f"_d{i}"), F.lit(38.0)) for i in (1, 2)})
    staged = staged.withColumns({f"_e{i}": F.exp(c(f"_z{i}") * c(f"_z{i}") * -0.5) for i in (1, 2)})
    staged = staged.withColumns({f"_u{i}": upper_tail(c(f"_z{i}"), c(f"_e{i}")) for i in (1, 2)})
    staged = staged.withColumns(
        {f"_n{i}": F.when(c(f"_d{i}") > 0, 1.0 - c(f"_u{i}")).otherwise(c(f"_u{i}")) for i in (1, 2)}
        | {"_pdf": c("_e1") * NORM, "_carry": F.exp(-c("_q") * c("_t")), "_discount": F.exp(-c("_r") * c("_t"))}
    )
    live, expired = _terms(option_type)
    final = {
        o: F.when(c("_mode") == 1, live[o]).when(c("_mode") == 2, expired.get(o, F.lit(0.0))) for o in outputs
    }
    return staged.select(*df.columns, *[final[o].alias(o) for o in outputs])


def with_greeks(quotes: DataFrame, r=RATE, q=DIVIDEND, ts="ts") -> DataFrame:
    """Time to expiration, Greeks, moneyness and intrinsic value; batch or stream."""
    timed = quotes.withColumn("time_to_expiration", years_to("expiration", ts))
    return with_values(timed, ("delta", "gamma", "vega", "theta", "rho"), r=r, q=q).withColumns(
        {
            "moneyness": moneyness("underlying_price", "strike"),
            "intrinsic_value": intrinsic("underlying_price", "strike", "option_type"),
        }
    )


def expected_move(df: DataFrame, s="underlying_price", t="time_to_expiration",
                  sigma="implied_volatility", confidence: float = 0.68) -> DataFrame:
    z = norm_ppf((1.0 + confidence) / 2.0)
    move = col(s) * col(sigma) * F.sqrt(col(t)) * z
    return df.withColumns(
        {
            "move_dollars": move,
            "upper_bound": col(s) + move,
            "lower_bound": col(s) - move,
            "move_percent": F.try_divide(move, col(s)) * 100.0,
            "confidence_level": F.lit(confidence),
        }
    )


def _cdf(x: np.ndarray) -> np.ndarray:
    z = np.abs(x)
    e = np.exp(-z * z / 2.0)
    near = e * horner(WEST_NUMERATOR, z) / horner(WEST_DENOMINATOR, z)
    fraction = z + 0.65
    for k in (4.0, 3.0, 2.0, 1.0):
        fraction = z + k / fraction
    upper = np.where(z < WEST_SWITCH, near, e / fraction / WEST_TAIL)
    upper = np.where(z > 37.0, 0.0, upper)
    return np.where(x > 0, 1.0 - upper, upper)


def implied_vol_udf(tol: float = 1e-6, max_iter: int = 100):
    """Newton iteration on whole Arrow batches; each row stops on its own."""

    @F.pandas_udf("double")
    def solve(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series,
              call: pd.Series, r: pd.Series, q: pd.Series) -> pd.Series:
        args = [np.asarray(a, dtype=float) for a in (price, s, k, t, r, q)]
        price_, s_, k_, t_, r_, q_ = args
        sign = np.where(call.fillna(False).to_numpy(dtype=bool), 1.0, -1.0)
        usable = np.all(np.isfinite(np.stack(args)), axis=0) & (s_ > 0) & (k_ > 0)
        sigma = np.full(len(price_), 0.3)
        open_ = usable & (t_ > 0)
        for _ in range(max_iter):
            i = np.flatnonzero(open_)
            if i.size == 0:
                break
            s, k, t, r, q, v = s_[i], k_[i], t_[i], r_[i], q_[i], sigma[i]
            root = np.sqrt(t)
            a = (np.log(s / k) + (r - q + 0.5 * v * v) * t) / (v * root)
            b = a - v * root
            carry, discount = s * np.exp(-q * t), k * np.exp(-r * t)
            model = sign[i] * (carry * _cdf(sign[i] * a) - discount * _cdf(sign[i] * b))
            vega = carry * np.exp(-a * a / 2.0) / math.sqrt(2.0 * math.pi) * root
            diff = price_[i] - model
            done = (np.abs(diff) < tol) | (vega == 0.0)
            step = np.divide(diff, vega, out=np.zeros_like(diff), where=~done)
            sigma[i] = np.where(done, v, np.clip(v + step, 0.01, 5.0))
            open_[i[done]] = False
        return pd.Series(np.where(usable, sigma, np.nan)).astype(object).where(usable, None)

    return solve


def implied_vol(quotes: DataFrame, price="last", s="underlying_price", k="strike",
                t="time_to_expiration", option_type="option_type", r=RATE, q=DIVIDEND,
                tol: float = 1e-6, max_iter: int = 100, out="implied_volatility") -> DataFrame:
    """Volatility that reproduces ``price``; starts at 0.3 and stays within [0.01, 5]."""
    solve = implied_vol_udf(tol, max_iter)
    return quotes.withColumn(
        out, solve(col(price), col(s), col(k), col(t), is_call(option_type), col(r), col(q))
    )
