"""Ridge grids and order search against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import arma, ridge
from barloom.operators import indicators as ind
from barloom.operators import models as md
from barloom.sources.staging import staged

GRID = (0.0, 1.0, 30.0, 500.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(9)
    frames = []
    for symbol, n in (("A", 400), ("B", 61), ("C", 3)):
        x = rng.normal(0, 1, (n, 3)) * [1.0, 50.0, 0.01] + [0.0, 900.0, 3.0]
        y = x @ [2.0, -0.1, 30.0] + rng.normal(0, 2, n)
        frames.append(pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), "symbol": symbol, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "flat": 7.0, "target": y}))
    pdf = pd.concat(frames, ignore_index=True)
    pdf.loc[5, "b"] = np.nan
    return pdf, ridge.chrono_folds(spark.createDataFrame(pdf), rows=100)


def plain_fit(x, y, penalty):
    mean, std = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(std == 0, 1, std)
    w = np.linalg.pinv(z.T @ z + penalty * np.eye(x.shape[1])) @ (z.T @ (y - y.mean()))
    return lambda q: y.mean() + ((q - mean) / np.where(std == 0, 1, std)) @ w


def test_ridge_grid_equals_fits_without_each_fold(table):
    pdf, folded = table
    names = ["a", "b", "c", "flat"]
    models = staged(ridge.ridge_path(folded, names, grid=GRID), "models")
    got = {(r.symbol, r.fold, r.ridge): (r.rows, r.squared_error) for r in ridge.grid_errors(models, GRID).collect()}
    folds = folded.select("symbol", "ts", "fold").toPandas()
    seen = 0
    for symbol, own in pdf.merge(folds, on=["symbol", "ts"]).groupby("symbol"):
        n = len(own)
        assert (own.sort_values("ts").fold.notna() == (np.arange(n) < int(n * 0.8))).all()
        train = own[own.fold.notna()].dropna()
        totals = {}
        for fold, out in train.groupby("fold"):
            rest = train[train.fold != fold]
            for penalty in GRID:
                predicted = plain_fit(rest[names].to_numpy(), rest.target.to_numpy(), penalty)(out[names].to_numpy())
                want = ((out.target - predicted) ** 2).sum()
                rows, error = got[symbol, fold, penalty]
                assert rows == len(out) and error == pytest.approx(want, rel=1e-6, abs=1e-8)
                totals[penalty] = totals.get(penalty, 0) + want
                seen += 1
        model = models.where(F.col("symbol") == symbol).first()
        assert model.ridge == min(GRID, key=lambda g: (totals[g], g)) and model.train_rows == len(train)
        predict = plain_fit(train[names].to_numpy(), train.target.to_numpy(), model.ridge)
        z = (train[names].to_numpy() - [model[f"{f}_mean"] for f in names]) / np.array([model[f"{f}_std"] or 1.0 for f in names])
        np.testing.assert_allclose(z @ model.coefficients[1:] + model.coefficients[0], predict(train[names].to_numpy()), atol=1e-6)
    assert seen == len(got) > 40


def test_training_with_a_grid_reads_the_data_twice(spark, table, tmp_path):
    _, folded = table
    folded.dropna(subset=["b"]).write.parquet(f"{tmp_path}/folds")
    data = spark.read.parquet(f"{tmp_path}/folds")
    models, results = ridge.train_grid(data, ["a", "b", "c"], grid=GRID)
    for frame, most in ((models, 1), (results, 3)):  # the models once more for the penalty in the results
        assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") <= most
    got = {r.symbol: r for r in results.collect()}
    assert got["A"].train_rows + got["A"].test_rows == 399 and got["A"].test_mae < 3 and got["C"].n_features == 3
    with pytest.raises(ValueError, match="empty"):
        ridge.ridge_path(data, ["a"], grid=())
    assert ridge.ridge_path(data.limit(0), ["a"], grid=GRID).count() == 0


@pytest.fixture(scope="module")
def simulated(spark):
    """An ARMA(1,1), its running sum, and a constant series."""
    rng = np.random.default_rng(3)
    n = 2_500
    e, level = rng.normal(0, 1, n), np.zeros(n)
    for t in range(1, n):
        level[t] = 0.6 * level[t - 1] + e[t] + 0.4 * e[t - 1]
    series = {"L": 50 + level, "S": 100 + np.cumsum(level), "K": np.full(40, 7.0)}
    frames = [pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(x)), unit="h"), "symbol": s, "close": x}) for s, x in series.items()]
    return series, spark.createDataFrame(pd.concat(frames)).cache()


def plain_kpss(x, lags=8):
    u = x - x.mean()
    s, v = np.cumsum(u), u @ u
    for k in range(1, lags + 1):
        v += 2 * (1 - k / (lags + 1)) * (u[k:] @ u[:-k])
    return s @ s / (len(x) * v)


def test_stationarity_equals_plain_statistic_for_any_chunk(simulated):
    series, df = simulated
    for rows in (150, 65_536):
        got = {r.symbol: r for r in arma.stationarity(df, rows=rows).collect()}
        for s in "LS":
            assert got[s].kpss_0 == pytest.approx(plain_kpss(series[s]), rel=1e-8) and got[s].kpss_1 == pytest.approx(plain_kpss(np.diff(series[s])), rel=1e-8)
        assert [got[s].d for s in "LSK"] == [0, 1, 0] and got["K"].kpss_0 == 0


def plain_arma(y, p, q, long, max_p, max_q):
    """Two-stage regression of one order on the rows that the largest order can use; coefficients, variance and AIC."""
    lag = lambda v, k: np.concatenate((np.full(k, np.nan), v[:-k])) if k else v
    z = np.column_stack([np.ones(len(y)), *(lag(y, k) for k in range(1, long + 1))])
    ok = ~np.isnan(z).any(axis=1)
    e = y - z @ np.linalg.lstsq(z[ok], y[ok], rcond=None)[0]
    every = np.column_stack([np.ones(len(y)), *(lag(y, k) for k in range(1, max_p + 1)), *(lag(e, k) for k in range(1, max_q + 1))])
    ok = ~np.isnan(every).any(axis=1)
    x = every[ok][:, [0, *range(1, p + 1), *range(1 + max_p, 1 + max_p + q)]]
    b = np.linalg.lstsq(x, y[ok], rcond=None)[0]
    left = ((y[ok] - x @ b) ** 2).sum()
    return b, left / ok.sum(), ok.sum() * np.log(left / ok.sum()) + 2 * (1 + p + q), e


def test_orders_equal_plain_regressions(simulated):
    series, df = simulated
    got = {(r.symbol, r.p, r.q): r for r in arma.arma_orders(df.where("symbol <> 'K'"), max_p=2, max_q=2, rows=400).collect()}
    assert len(got) == 18
    for (s, p, q), r in got.items():
        b, variance, aic, _ = plain_arma(series[s] if s == "L" else np.diff(series[s]), p, q, 8, 2, 2)
        np.testing.assert_allclose([r.intercept, *r.ar, *r.ma], b, rtol=1e-6, atol=1e-7)
        assert r.sigma2 == pytest.approx(variance, rel=1e-8) and r.aic == pytest.approx(aic, abs=1e-4) and r.d == (s == "S")
    best = {r.symbol: r for r in arma.best_arma(arma.arma_orders(df.where("symbol <> 'K'"))).collect()}
    for s in "LS":
        assert (best[s].p, best[s].q) == (1, 1) and best[s].ar[0] == pytest.approx(0.6, abs=0.06) and best[s].ma[0] == pytest.approx(0.4, abs=0.06)


@pytest.mark.parametrize("season", [None, 5])
def test_forecast_equals_plain_recursion(simulated, season):
    series, df = simulated
    got = arma.forecast_arma(df.where("symbol = 'S'"), steps=12, order=(2, 1), d=1, season=season, rows=600).orderBy("step").toPandas()
    x = series["S"]
    y = np.diff(x)
    y = y if season is None else y[season:] - y[:-season]
    b, variance, _, e = plain_arma(y, 2, 1, 8, 2, 1)
    y, e, levels = list(y), list(e), list(x)
    delta = np.array([1.0, -1.0]) if season is None else np.convolve([1.0, -1.0], [1.0, 0, 0, 0, 0, -1.0])
    for _ in range(12):
        y.append(b[0] + b[1] * y[-1] + b[2] * y[-2] + b[3] * e[-1])
        e.append(0.0)
        levels.append(y[-1] - sum(delta[k] * levels[-k] for k in range(1, len(delta))))
    np.testing.assert_allclose(got.forecast, levels[-12:], rtol=1e-7)
    # The effect of one shock, by simulating with it and without.
    def impulse(h):
        ys, out = [0.0] * 3, [0.0] * 8
        for t in range(h + 1):
            ys.append(b[1] * ys[-1] + b[2] * ys[-2] + (t == 0) + b[3] * (t == 1))
            out.append(ys[-1] - sum(delta[k] * out[-k] for k in range(1, len(delta))))
        return out[-1]

    width = 1.96 * np.sqrt(variance * np.cumsum([impulse(h) ** 2 for h in range(12)]))
    np.testing.assert_allclose(got.upper_bound - got.forecast, width, rtol=1e-7)
    np.testing.assert_allclose(got.forecast - got.lower_bound, width, rtol=1e-7)


def test_plain_autoregression_bounds_are_the_corner_of_the_search(simulated):
    _, df = simulated
    some = df.where("symbol <> 'K'")
    for p in (1, 3):
        one = md.forecast_ar(some, steps=6, p=p, d=1).orderBy("symbol", "step").toPandas()
        two = arma.forecast_arma(some, steps=6, order=(p, 0), d=1).orderBy("symbol", "step").toPandas()
        for c in ("forecast", "lower_bound", "upper_bound"):
            np.testing.assert_allclose(one[c], two[c], rtol=1e-9)


def test_short_and_empty_series(simulated):
    _, df = simulated
    tiny = df.where("ts < TIMESTAMP '2024-01-01 03:00'")
    assert arma.forecast_arma(tiny).count() == 0
    assert arma.arma_orders(df.limit(0)).count() == 0 and arma.stationarity(df.limit(0)).count() == 0
    holes = df.where("symbol = 'K'").withColumn("close", F.lit(None).cast("double"))
    assert arma.stationarity(holes).count() == 0


def test_exponential_means_read_their_input_twice(spark, bars, tmp_path):
    bars.write.parquet(f"{tmp_path}/bars")
    stored = spark.read.parquet(f"{tmp_path}/bars")
    for made in (ind.macd_ema(stored), ind.ema(stored)):
        assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
