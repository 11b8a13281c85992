"""Order search and forecasts for ARIMA models per series, from sums only.

How often to difference follows from the KPSS statistic, whose partial sums are running sums carried from slot to slot.
Moving-average terms come from two regressions: a long autoregression gives estimates of the shocks, and the series is
then regressed on its own lags and lagged shocks.  All orders up to the largest are corners of one matrix of sums.
No series is gathered in one task, and nothing is iterated.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import ordered as o
from barloom.operators.lookup import last_n
from barloom.operators.models import _gram, _symmetric, solve_udf
from barloom.shipping import ship
from barloom.sources.staging import staged

ship(__name__)

# Fixed value: the KPSS statistic that a level-stationary series exceeds once in 20 times.
LEVEL_5_PERCENT = 0.463


def _values(series: DataFrame, value: str, by: str, ts: str, tie: Sequence[str]) -> DataFrame:
    """The narrow series: keys, order and value; rows without one of them or without a number are left out."""
    x = F.col(value).cast("double")
    return series.select(by, ts, *tie, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).dropna(subset=[by, ts])


def stationarity(series: DataFrame, value: str = "close", max_d: int = 1, lags: int = 8, critical: float = LEVEL_5_PERCENT,
                 by: str = "symbol", ts: str = "ts", tie: Sequence[str] = (), rows=o.CHUNK_ROWS, slot=o.SLOT) -> DataFrame:
    """(by, n, kpss_0, kpss_1, d): the KPSS statistics of the level and of its first difference, and how often to difference.

    The statistic is the sum of the squared partial sums of the deviations from the mean, over n squared times the long-run
    variance (Bartlett weights up to ``lags``).  ``d`` is 0 if that of the level is at most ``critical``, otherwise ``max_d`` (0 or 1).
    Running sums before each slot travel with the slot table; everything else is sums.  A constant series has statistic 0.
    """
    if max_d not in (0, 1):
        raise ValueError("max_d must be 0 or 1")
    narrow = _values(series, value, by, ts, tie)
    series_of = W.partitionBy(by).orderBy(o._SLOT)

    def carry(table: DataFrame) -> DataFrame:
        before = F.coalesce(F.sum("_slot_sum").over(series_of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
        origin = F.first("_slot_first").over(series_of.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        return table.withColumns({"_prefix": before, "_origin": origin}).drop("_slot_sum", "_slot_first")

    first = F.min_by("_x", F.struct(ts, *tie)).alias("_slot_first")
    cut = o.spread(narrow, by, ts, lags + 1, 0, rows, slot, [F.sum("_x").alias("_slot_sum"), first], carry)
    w = o.chunk_window(by, ts, tie)
    running = w.rowsBetween(W.unboundedPreceding, 0)
    # Levels and their running sums are measured from the first level, which keeps the sums small.
    at = cut.withColumn("_t", o.position(w).cast("double"))
    at = at.withColumns({"_y0": F.col("_x") - F.col("_origin"), "_p0": F.first("_prefix").over(running) + F.sum("_x").over(running) - F.col("_t") * F.col("_origin")})
    at = at.withColumns({"_y1": F.col("_y0") - F.lag("_y0").over(w), "_p1": F.col("_y0")})
    at = at.withColumns({f"_y{d}_{k}": F.lag(f"_y{d}", k).over(w) for d in (0, 1) for k in range(1, lags + 1)})
    own = o.settle(at)
    sums = []
    for d in (0, 1):
        # A difference has no value at the first row; its j-th value stands at row j + 1.
        y, p, j = F.col(f"_y{d}"), F.when(F.col("_t") > d, F.col(f"_p{d}")), F.col("_t") - d
        sums += [F.count(y).alias(f"n{d}"), F.sum(y).alias(f"s{d}"), F.sum(y * y).alias(f"ss{d}")]
        sums += [F.sum(p * p).alias(f"pp{d}"), F.sum(p * j).alias(f"pj{d}")]
        for k in range(1, lags + 1):
            z = F.col(f"_y{d}_{k}")
            sums += [F.sum(y * z).alias(f"c{d}_{k}"), F.sum(F.when(z.isNotNull(), y + z)).alias(f"e{d}_{k}"), F.count(z).alias(f"m{d}_{k}")]
    total = own.groupBy(by).agg(*sums)

    def kpss(d: int):
        n, mean = F.col(f"n{d}").cast("double"), F.try_divide(F.col(f"s{d}"), F.col(f"n{d}"))
        squares = F.col(f"pp{d}") - 2 * mean * F.col(f"pj{d}") + mean * mean * n * (n + 1) * (2 * n + 1) / 6
        variance = F.col(f"ss{d}") - n * mean * mean
        for k in range(1, lags + 1):
            product = F.coalesce(F.col(f"c{d}_{k}") - mean * F.col(f"e{d}_{k}") + F.col(f"m{d}_{k}") * mean * mean, F.lit(0.0))
            variance = variance + 2.0 * (1 - k / (lags + 1)) * product
        constant = F.col(f"ss{d}") - n * mean * mean <= 1e-14 * F.col(f"ss{d}")
        return F.when(n > 0, F.when(constant, 0.0).otherwise(F.try_divide(squares, n * variance)))

    found = total.select(by, F.col("n0").alias("n"), kpss(0).alias("kpss_0"), kpss(1).alias("kpss_1"))
    return found.withColumn("d", F.when(F.col("kpss_0") <= critical, 0).otherwise(max_d).cast("int"))


MODEL = [T.StructField("d", T.IntegerType()), T.StructField("p", T.IntegerType()), T.StructField("q", T.IntegerType()), T.StructField("n", T.LongType())] + [
    T.StructField("intercept", T.DoubleType()), T.StructField("ar", T.ArrayType(T.DoubleType())), T.StructField("ma", T.ArrayType(T.DoubleType())),
    T.StructField("sigma2", T.DoubleType()), T.StructField("aic", T.DoubleType()),
]


def _corners(by: str, max_p: int, max_q: int):
    """Every order (p, q) of a series from the sums of the largest: least squares of a corner of the matrix."""
    size = 1 + max_p + max_q

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                xx, xy, yy, n = _symmetric(row["_xx"], size), np.asarray(row["_xy"], dtype=float), row["_yy"], row["_n"]
                for p in range(max_p + 1):
                    for q in range(max_q + 1):
                        at = np.array([0, *range(1, p + 1), *range(1 + max_p, 1 + max_p + q)])
                        if n <= len(at):
                            continue
                        b = np.linalg.lstsq(xx[np.ix_(at, at)], xy[at], rcond=1e-12)[0]
                        left = max(yy - 2 * b @ xy[at] + b @ xx[np.ix_(at, at)] @ b, 1e-300)
                        out.append([row[by], row["_d"], p, q, n, b[0], b[1 : p + 1].tolist(), b[p + 1 :].tolist(), left / n, n * np.log(left / n) + 2 * (len(at))])
            yield pd.DataFrame(out, columns=[by, *(f.name for f in MODEL)])

    return run


class _Search:
    """The differenced series with its lags and lagged shocks, and what was found on the way."""

    def __init__(self, series, value, max_p, max_q, max_d, season, long, d, by, ts, tie, rows, slot):
        self.by, self.ts, self.tie, self.p, self.q, self.season, self.long = by, ts, list(tie), max_p, max_q, season, long if max_q else 0
        self.chunks = {"by": by, "ts": ts, "tie": self.tie, "rows": rows, "slot": slot}
        narrow = staged(_values(series, value, by, ts, tie), "arma-series")
        if d is None:
            orders = stationarity(narrow, "_x", max_d, by=by, ts=ts, tie=tie, rows=rows, slot=slot).select(by, F.col("d").alias("_d"))
            narrow = narrow.join(staged(orders, "arma-differences"), by)
        else:
            narrow = narrow.withColumn("_d", F.lit(int(d)))
        self.narrow = narrow
        if self.long:
            lagged = o.ordered(narrow, lambda df, w: self._lags(self._y(df, w), w, "_y", self.long), back=self.long + self.lost, **self.chunks)
            names = [f"_y_{k}" for k in range(1, self.long + 1)]
            sums = lagged.dropna(subset=["_y", *names]).groupBy(by).agg(*_gram([F.col(c) for c in names], F.col("_y")))
            self.narrow = narrow.join(staged(sums.select(by, solve_udf(self.long + 1)("_xx", "_xy").alias("_long")), "arma-long"), by)

    @property
    def lost(self) -> int:
        """Rows that differencing reaches back."""
        return 1 + (self.season or 0)

    def _y(self, df, w):
        df = df.withColumn("_y", F.when(F.col("_d") == 0, F.col("_x")).otherwise(F.col("_x") - F.lag("_x").over(w)))
        return df.withColumn("_y", F.col("_y") - F.lag("_y", self.season).over(w)) if self.season else df

    @staticmethod
    def _lags(df, w, name: str, n: int):
        return df.withColumns({f"{name}_{k}": F.lag(name, k).over(w) for k in range(1, n + 1)})

    def rows(self) -> DataFrame:
        """Every row with _y, its lags, and (with moving-average terms) the shock _e and its lags."""
        def layer(df, w):
            df = self._lags(self._y(df, w), w, "_y", max(self.p, self.long))
            if not self.long:
                return df
            fitted = F.col("_long")[0]
            for k in range(1, self.long + 1):
                fitted = fitted + F.col("_long")[k] * F.col(f"_y_{k}")
            return self._lags(df.withColumn("_e", F.col("_y") - fitted), w, "_e", self.q)

        return o.ordered(self.narrow, layer, back=self.lost + max(self.p, self.long + self.q), **self.chunks)

    def regressors(self) -> list[str]:
        return [f"_y_{k}" for k in range(1, self.p + 1)] + [f"_e_{k}" for k in range(1, self.q + 1)]

    def orders(self, rows: DataFrame) -> DataFrame:
        names = self.regressors()
        known = rows.dropna(subset=["_y", *names])
        sums = known.groupBy(self.by).agg(*_gram([F.col(c) for c in names], F.col("_y")), F.min("_d").alias("_d"))
        return sums.mapInPandas(_corners(self.by, self.p, self.q), T.StructType([rows.schema[self.by], *MODEL]))


def arma_orders(series: DataFrame, max_p: int = 3, max_q: int = 2, max_d: int = 1, season: int | None = None, value: str = "close", long: int = 8,
                d: int | None = None, by="symbol", ts="ts", tie: Sequence[str] = (), rows=o.CHUNK_ROWS, slot=o.SLOT) -> DataFrame:
    """Every order (p, q) up to the largest, per series: d, n, intercept, ar, ma, sigma2 and aic.

    ``d`` is chosen by ``stationarity`` unless given.  ``season`` differences against that many rows before.  ``long`` is the
    order of the autoregression that gives the shocks.  All orders of a series are fitted on the same rows, so their AICs
    compare.  Rows without a value are left out; a series with no more rows than coefficients has no row for that order.
    """
    search = _Search(series, value, max_p, max_q, max_d, season, long, d, by, ts, tie, rows, slot)
    return search.orders(search.rows())


def best_arma(orders: DataFrame, by="symbol") -> DataFrame:
    """The order of the least AIC per series, the smaller one if they tie."""
    rest = [c for c in orders.columns if c != by]
    return orders.groupBy(by).agg(F.min_by(F.struct(*rest), F.struct("aic", F.col("p") + F.col("q"), "q")).alias("_m")).select(by, "_m.*")


def psi_weights(ar: Sequence[float], ma: Sequence[float], d: int, season: int | None, steps: int) -> np.ndarray:
    """Effect of a shock on the level 0, 1, ... steps ahead, by the recursion of the integrated model."""
    poly = np.concatenate(([1.0], -np.asarray(ar, dtype=float)))
    for lag in [1] * d + ([season] if season else []):
        poly = np.convolve(poly, np.concatenate(([1.0], np.zeros(lag - 1), [-1.0])))
    psi = np.zeros(steps)
    for h in range(steps):
        psi[h] = (1.0 if h == 0 else float(ma[h - 1]) if h <= len(ma) else 0.0) - sum(poly[i] * psi[h - i] for i in range(1, min(h, len(poly) - 1) + 1))
    return psi


def _ahead(by: str, steps: int, z: float, season: int | None, names: Sequence[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                ar, ma = (np.asarray(row[c], dtype=float) for c in ("ar", "ma"))
                tail = sorted(row["_tail"], key=lambda r: r["_at"])
                y, e, x = ([r[c] for r in tail] for c in ("_y", "_e", "_x"))
                delta = np.array([1.0])
                for lag in [1] * row["d"] + ([season] if season else []):
                    delta = np.convolve(delta, np.concatenate(([1.0], np.zeros(lag - 1), [-1.0])))
                width = z * np.sqrt(row["sigma2"] * np.cumsum(psi_weights(ar, ma, row["d"], season, steps) ** 2))
                if len(x) < len(delta) - 1 or any(v is None for v in [*(y[-len(ar):] if len(ar) else []), *(e[-len(ma):] if len(ma) else [])]):
                    continue
                for h in range(steps):
                    value = row["intercept"] + sum(c * y[-1 - k] for k, c in enumerate(ar)) + sum(c * e[-1 - k] for k, c in enumerate(ma))
                    y.append(value)
                    e.append(0.0)
                    x.append(value - sum(delta[k] * x[-k] for k in range(1, len(delta))))
                    out.append([row[by], h + 1, row["d"], row["p"], row["q"], x[-1], x[-1] - width[h], x[-1] + width[h]])
            yield pd.DataFrame(out, columns=list(names))

    return run


def forecast_arma(series: DataFrame, steps: int = 5, max_p: int = 3, max_q: int = 2, max_d: int = 1, season: int | None = None, value: str = "close", z: float = 1.96,
                  long: int = 8, d: int | None = None, order: tuple[int, int] | None = None, by="symbol", ts="ts", tie: Sequence[str] = (), rows=o.CHUNK_ROWS, slot=o.SLOT) -> DataFrame:
    """(by, step, d, p, q, forecast, lower_bound, upper_bound) for ``steps`` rows ahead of every series.

    The order is that of the least AIC, or ``order``.  Shocks ahead are taken as nothing; the bounds add up the effects of
    all shocks on the way (psi weights).  A series too short for its model has no forecast.
    """
    p, q = order or (max_p, max_q)
    search = _Search(series, value, p, q, max_d, season, long, d, by, ts, tie, rows, slot)
    made = search.rows()
    fitted = search.orders(made)
    models = fitted.where((F.col("p") == p) & (F.col("q") == q)) if order else best_arma(fitted, by)
    shock = F.col("_e") if search.long else F.lit(None).cast("double")
    depth = max(p, q, search.lost)
    ends = last_n(made.select(by, ts, *tie, "_y", shock.alias("_e"), "_x"), depth, by, ts, tie)
    tails = ends.groupBy(by).agg(F.collect_list(F.struct(F.struct(ts, *tie).alias("_at"), "_y", "_e", "_x")).alias("_tail"))
    tails = tails.select(by, F.transform(F.array_sort("_tail"), lambda r, i: F.struct(i.alias("_at"), r["_y"].alias("_y"), r["_e"].alias("_e"), r["_x"].alias("_x"))).alias("_tail"))
    schema = T.StructType([made.schema[by], *[T.StructField(c, T.IntegerType()) for c in ("step", "d", "p", "q")], *[T.StructField(c, T.DoubleType()) for c in ("forecast", "lower_bound", "upper_bound")]])
    return models.join(tails, by).mapInPandas(_ahead(by, steps, z, season, schema.names), schema)
