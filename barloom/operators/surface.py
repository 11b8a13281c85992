"""Volatility surface from the newest quote of every contract, with gaps filled by monotone interpolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.shipping import ship

ship(__name__)


def newest_quotes(quotes: DataFrame, as_of=None, contract: str = "options_ticker", ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """The newest row per contract at ``as_of`` (the last by ``tie`` among equal times), reduced before the shuffle; contracts already expired then are left out."""
    rows = quotes.dropna(subset=[contract, ts])
    if as_of is not None:
        now = F.lit(as_of).cast("timestamp")
        rows = rows.where((F.col(ts) <= now) & (F.col("expiration") >= F.to_date(now)))
    rest = [c for c in quotes.columns if c != contract]
    return rows.groupBy(contract).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie, F.xxhash64(*rest))).alias("_q")).select(contract, "_q.*").select(*quotes.columns)


def surface_cells(quotes: DataFrame, as_of, strike_width: float = 10.0, day_width: int = 30, contract: str = "options_ticker", ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """(symbol, strike_bucket, days_bucket, implied_volatility, quotes): means over the newest quotes, days counted from ``as_of``."""
    days = F.date_diff("expiration", F.to_date(F.lit(as_of).cast("timestamp")))
    rows = newest_quotes(quotes, as_of, contract, ts, tie).where(F.col("implied_volatility").isNotNull() & ~F.isnan("implied_volatility"))
    return rows.groupBy(
        "symbol", (F.floor(F.col("strike") / strike_width) * strike_width).alias("strike_bucket"), (F.floor(days / day_width) * day_width).cast("bigint").alias("days_bucket"),
    ).agg(F.avg("implied_volatility").alias("implied_volatility"), F.count(F.lit(1)).alias("quotes"))


def monotone(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic interpolation that stays between neighbouring values (Fritsch and Carlson's limits on the slopes); nothing outside the known range."""
    inside = (at >= x[0]) & (at <= x[-1])
    out = np.full(len(at), np.nan)
    if len(x) == 1:
        out[at == x[0]] = y[0]
        return out
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.empty(len(x))
    m[0], m[-1] = d[0], d[-1]
    if len(x) > 2:
        left, right = h[1:] + 2 * h[:-1], 2 * h[1:] + h[:-1]
        same = d[:-1] * d[1:] > 0
        slope = np.divide(left + right, left / np.where(same, d[1:], 1) + right / np.where(same, d[:-1], 1), where=same, out=np.zeros(len(same)))
        m[1:-1] = np.where(same, slope, 0.0)
    k = np.clip(np.searchsorted(x, at[inside], side="right") - 1, 0, len(h) - 1)
    t = (at[inside] - x[k]) / h[k]
    out[inside] = (
        y[k] * (1 + 2 * t) * (1 - t) ** 2 + h[k] * m[k] * t * (1 - t) ** 2 + y[k + 1] * t * t * (3 - 2 * t) + h[k] * m[k + 1] * t * t * (t - 1)
    )
    return out


FILLED = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("strike_bucket", T.DoubleType()), T.StructField("days_bucket", T.LongType()),
    T.StructField("implied_volatility", T.DoubleType()), T.StructField("quotes", T.LongType()), T.StructField("filled", T.StringType()),
])


def _fill(pdf: pd.DataFrame) -> pd.DataFrame:
    grid = pdf.pivot(index="strike_bucket", columns="days_bucket", values="implied_volatility").sort_index().sort_index(axis=1)
    count = pdf.pivot(index="strike_bucket", columns="days_bucket", values="quotes").reindex(index=grid.index, columns=grid.columns).fillna(0)
    strikes, days, value = grid.index.to_numpy(float), grid.columns.to_numpy(float), grid.to_numpy(float).copy()
    how = np.where(np.isnan(value), "", "observed").astype(object)
    # Along strikes within an expiry first, then along expiries what is still open, from observed and strike-filled cells alike.
    for axis, name in ((0, "strike"), (1, "expiry")):
        before = value.copy()
        for k in range(value.shape[1 - axis]):
            line, own, at = (before[:, k], value[:, k], strikes) if axis == 0 else (before[k], value[k], days)
            known = ~np.isnan(line)
            if known.any() and not known.all():
                made = monotone(at[known], line[known], at)
                gaps = ~known & ~np.isnan(made)
                own[gaps] = made[gaps]
                (how[:, k] if axis == 0 else how[k])[gaps] = name
    i, j = np.nonzero(~np.isnan(value))
    return pd.DataFrame({
        "symbol": pdf["symbol"].iloc[0], "strike_bucket": strikes[i], "days_bucket": days[j].astype(np.int64), "implied_volatility": value[i, j],
        "quotes": count.to_numpy()[i, j].astype(np.int64), "filled": how[i, j],
    })


def latest_surface(quotes: DataFrame, as_of, strike_width: float = 10.0, day_width: int = 30, contract: str = "options_ticker", ts: str = "ts", tie: Sequence[str] = ()) -> DataFrame:
    """``surface_cells`` with the gaps of each symbol's grid filled: column ``filled`` says observed, strike or expiry.

    The grid has the strikes and expiries seen for the symbol; cells outside the known range of their row and column stay out.
    What meets in one task is a symbol's grid, a row per cell, not its quotes.
    """
    cells = surface_cells(quotes, as_of, strike_width, day_width, contract, ts, tie).dropna(subset=["symbol", "strike_bucket", "days_bucket"])
    cells = cells.withColumns({"symbol": F.col("symbol").cast("string"), "strike_bucket": F.col("strike_bucket").cast("double")})
    return cells.groupBy("symbol").applyInPandas(_fill, FILLED)
