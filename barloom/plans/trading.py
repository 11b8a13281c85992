"""Queries: models, predictions, signals and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import arma
from barloom.operators import indicators as ind
from barloom.operators import lookup as lk
from barloom.operators import metrics as mt
from barloom.operators import models as md
from barloom.operators import ordered as o
from barloom.operators import prep, ridge
from barloom.operators import signals as sg
from barloom.operators import strategies as st
from barloom.plans import shapes
from barloom.plans import sql_fits as fits
from barloom.plans import sql_views as v
from barloom.plans.registry import AS_OF, add
from barloom.sources import adapters as a
from barloom.sources.storage import staged

KEY = ("ts", "symbol")
PRED_CTES = (v.BARS, v.PREDICTIONS)
FEATURES = ("close", "sma_5", "rsi", "volume")

# --- models -----------------------------------------------------------------


def _training_layer(df, w):
    df = ind.rsi_layer()(ind.sma_layer((5,))(df, w), w)
    n, i = o.series_length(), o.position(w)
    n_train = F.floor(n * F.lit(0.8))
    return df.withColumns({
        "target": F.lead("close").over(w),
        "split": F.when(i <= n_train, "train").otherwise("test"),
    })


def training_data(s, d):
    """Features, next close and split in one ordered pass."""
    made = o.ordered(a.bars_hourly(s, d), _training_layer, back=14, ahead=1)
    # Scaler, fit and score read the features: staged, the ticks are scanned for them once.
    return staged(made.dropna(subset=["target", *FEATURES]), "training")


def trained(s, d, fit_on="train"):
    return md.train_per_symbol(training_data(s, d), FEATURES, fit_on=fit_on)


add("m02_train_per_symbol", lambda s, d: trained(s, d)[1], ("symbol", "train_rows", "test_rows", "n_features"), ("train_mae", "test_mae"), fits.TRAINED, fits.trained())
add("m02_train_fit_on_all", lambda s, d: trained(s, d, "all")[1], ("symbol", "train_rows", "test_rows", "n_features"), ("train_mae", "test_mae"), fits.TRAINED, fits.trained("all"))


def _one_feature(s, d):
    """One feature and no penalty: the fit has a closed form SQL knows."""
    data = training_data(s, d)
    return md.train_per_symbol(data, ("close",), ridge=0.0)


ONE = f"""td AS (SELECT symbol, ts, close, lead(close) OVER {v.over()} AS target, row_number() OVER {v.over()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars
  QUALIFY lead(close) OVER {v.over()} IS NOT NULL)"""
FIT = "fit AS (SELECT symbol, regr_slope(target, close) AS b, regr_intercept(target, close) AS c FROM td WHERE i <= floor(n * 0.8::DOUBLE) GROUP BY 1)"
add("m02_train_one_feature", lambda s, d: _one_feature(s, d)[1], ("symbol", "train_rows", "test_rows", "n_features"), ("train_mae", "test_mae"),
    """SELECT symbol, count(*) FILTER (i <= floor(n * 0.8::DOUBLE)) AS train_rows, count(*) FILTER (i > floor(n * 0.8::DOUBLE)) AS test_rows, 1::BIGINT AS n_features,
       avg(abs(target - b * close - c)) FILTER (i <= floor(n * 0.8::DOUBLE)) AS train_mae, avg(abs(target - b * close - c)) FILTER (i > floor(n * 0.8::DOUBLE)) AS test_mae
       FROM td JOIN fit USING (symbol) GROUP BY 1""", (v.BARS, ONE, FIT))


# A grid of penalties: the error of each on each fold left out, and the model chosen.
PENALTIES = (0.0, 1.0, 10.0, 100.0, 1_000.0)


def folded(s, d):
    """Training rows in runs of time; the last fifth of a series has no fold and is the test part."""
    made = ridge.chrono_folds(a.bars_hourly(s, d).withColumn("volume", F.col("volume").cast("double")))
    made = ind.rsi(ind.sma(prep.next_target(made), (5,)))
    return staged(made.dropna(subset=["target", *FEATURES]), "folds")


FOLDED = f"""pos AS (SELECT symbol, ts, close, lead(close) OVER {v.over()} AS target, row_number() OVER {v.over()} AS i, floor(count(*) OVER (PARTITION BY symbol) * 0.8::DOUBLE) AS n FROM bars),
  fd AS (SELECT symbol, ts, close, target, CASE WHEN i <= n THEN floor((i - 1) * 5 / n)::INT END AS fold FROM pos WHERE target IS NOT NULL),
  lo AS (SELECT symbol, k.fold, count(*) AS n, avg(close) AS m, stddev_pop(close) AS s, avg(target) AS y, covar_pop(target, close) AS c
         FROM fd JOIN (SELECT unnest(range(5))::INT AS fold) AS k ON fd.fold <> k.fold GROUP BY 1, 2),
  al AS (SELECT symbol, count(*) AS n, avg(close) AS m, stddev_pop(close) AS s, avg(target) AS y, covar_pop(target, close) AS c FROM fd WHERE fold IS NOT NULL GROUP BY 1),
  pen AS (SELECT unnest([{", ".join(map(repr, PENALTIES))}])::DOUBLE AS ridge),
  se AS (SELECT symbol, fold, ridge, count(*) AS rows, sum((target - lo.y - c / s * lo.n / (lo.n + ridge) * (close - m) / s) ** 2) AS squared_error
         FROM fd JOIN lo USING (symbol, fold) CROSS JOIN pen GROUP BY 1, 2, 3)"""
add("m02_ridge_grid", lambda s, d: ridge.grid_errors(ridge.ridge_path(folded(s, d), ("close",), grid=PENALTIES), PENALTIES),
    ("symbol", "fold", "ridge", "rows"), ("squared_error",), "SELECT * FROM se", (v.BARS, FOLDED), digits=4)
add("m02_ridge_choice", lambda s, d: ridge.train_grid(folded(s, d), ("close",), grid=PENALTIES)[1],
    ("symbol", "ridge", "train_rows", "test_rows", "n_features"), ("validation_mse", "train_mae", "test_mae"),
    """SELECT symbol, ridge, count(*) FILTER (fold IS NOT NULL) AS train_rows, count(*) FILTER (fold IS NULL) AS test_rows, 1::BIGINT AS n_features, any_value(mse) AS validation_mse,
       avg(abs(target - y - c / s * n / (n + ridge) * (close - m) / s)) FILTER (fold IS NOT NULL) AS train_mae,
       avg(abs(target - y - c / s * n / (n + ridge) * (close - m) / s)) FILTER (fold IS NULL) AS test_mae
       FROM fd JOIN al USING (symbol) JOIN (SELECT symbol, ridge, sum(squared_error) / sum(rows) AS mse FROM se GROUP BY 1, 2
            QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY mse, ridge) = 1) USING (symbol) GROUP BY symbol, ridge""", (v.BARS, FOLDED), digits=5)
add("m02_grid_all_features", lambda s, d: ridge.train_grid(folded(s, d), FEATURES, grid=PENALTIES)[1],
    ("symbol", "ridge", "train_rows", "test_rows", "n_features"), ("validation_mse", "train_mae", "test_mae"))


def _predicted(s, d):
    models, _ = _one_feature(s, d)
    return md.predict_per_symbol(training_data(s, d), models, ("close",))


add("m03_predict_per_symbol", _predicted, KEY, ("predicted",), "SELECT ts, symbol, b * close + c AS predicted FROM td JOIN fit USING (symbol)", (v.BARS, ONE, FIT))
add("m03_predict_all_features", lambda s, d: md.predict_per_symbol(training_data(s, d), trained(s, d)[0], FEATURES), KEY, ("predicted",),
    "SELECT ts, symbol, predicted FROM pr", fits.trained())
add("a09_training_summary",
    lambda s, d: mt.training_summary(_one_feature(s, d)[1], a.bars_hourly(s, d)), ("models", "best_symbol", "worst_symbol", "requested"),
    ("avg_train_mae", "avg_test_mae", "best_test_mae", "worst_test_mae", "success_rate"),
    """SELECT count(*) AS models, avg(tr) AS avg_train_mae, avg(te) AS avg_test_mae, arg_min(symbol, te) AS best_symbol, min(te) AS best_test_mae,
       arg_max(symbol, te) AS worst_symbol, max(te) AS worst_test_mae, count(*) AS requested, 100 AS success_rate FROM (
       SELECT symbol, avg(abs(target - b * close - c)) FILTER (i <= floor(n * 0.8::DOUBLE)) AS tr, avg(abs(target - b * close - c)) FILTER (i > floor(n * 0.8::DOUBLE)) AS te
       FROM td JOIN fit USING (symbol) GROUP BY 1)""", (v.BARS, ONE, FIT))
add("t05_top_models", lambda s, d: lk.top_rows(_one_feature(s, d)[1], 3, "test_mae", "symbol"), ("symbol",), ("test_mae",),
    """SELECT symbol, avg(abs(target - b * close - c)) FILTER (i > floor(n * 0.8::DOUBLE)) AS test_mae FROM td JOIN fit USING (symbol)
       GROUP BY 1 ORDER BY 2, 1 LIMIT 3""", (v.BARS, ONE, FIT))
BOUNDS = ("forecast", "lower_bound", "upper_bound")


def add_fitted(name, fn, exact, rounded, made, digits=6):
    ctes, sql = made
    add(name, fn, exact, rounded, sql, ctes, digits)


def bars(s, d):
    """Hourly bars, staged: an ordered operator reads them twice, the ticks are scanned once."""
    return staged(a.bars_hourly(s, d), "bars")


add_fitted("m04_forecast_ar", lambda s, d: md.forecast_ar(bars(s, d), steps=5, p=5, d=1), ("symbol", "step"), BOUNDS, fits.ar_forecast(range(1, 6), 5))
add_fitted("m04_forecast_seasonal", lambda s, d: md.forecast_ar(bars(s, d), steps=3, p=2, d=1, season=12), ("symbol", "step"), BOUNDS, fits.ar_forecast((1, 2, 12), 3))
add_fitted("m05_stationarity", lambda s, d: arma.stationarity(bars(s, d), lags=8), ("symbol", "n", "d"), ("kpss_0", "kpss_1"), fits.stationarity(8))
add_fitted("m05_arma_orders", lambda s, d: arma.arma_orders(bars(s, d), max_p=2, max_q=1, d=1, long=4), ("symbol", "p", "q", "n"), ("intercept", "sigma2", "aic"), fits.arma_orders(4, 2, 1), digits=4)
add_fitted("m04_arma_corner", lambda s, d: arma.forecast_arma(bars(s, d), steps=4, d=1, order=(1, 0)).withColumn("step", F.col("step").cast("bigint")), ("symbol", "step"), BOUNDS, fits.ar_forecast((1,), 4))
add_fitted("m04_arma_forecast", lambda s, d: arma.forecast_arma(bars(s, d), steps=3, d=1, order=(1, 1), long=4), ("symbol", "step"), BOUNDS, fits.arma_11(4, 3), digits=5)
add("m04_arma_search", lambda s, d: arma.forecast_arma(bars(s, d), steps=3), ("symbol", "step", "d", "p", "q"), BOUNDS)
add("m04_ar1", lambda s, d: md.ar1(a.bars_hourly(s, d)), ("symbol", "n"), ("slope", "intercept"),
    f"""SELECT symbol, regr_slope(y, y1) AS slope, regr_intercept(y, y1) AS intercept, count(*) AS n FROM (SELECT symbol, y, lag(y) OVER {v.over()} AS y1 FROM (
        SELECT symbol, ts, close - lag(close) OVER {v.over()} AS y FROM bars)) WHERE y IS NOT NULL AND y1 IS NOT NULL GROUP BY symbol""", (v.BARS,))


def _forecast_one(s, d):
    return md.forecast_ar(a.bars_hourly(s, d), steps=1, p=1, d=1)


AR1 = f"""dy AS (SELECT symbol, ts, close, y, lag(y) OVER {v.over()} AS y1 FROM (SELECT symbol, ts, close, close - lag(close) OVER {v.over()} AS y FROM bars)),
  ar AS (SELECT symbol, regr_slope(y, y1) AS b, regr_intercept(y, y1) AS c FROM dy WHERE y1 IS NOT NULL GROUP BY 1),
  err AS (SELECT symbol, sqrt(avg((y - b * y1 - c) * (y - b * y1 - c))) AS sd FROM dy JOIN ar USING (symbol) WHERE y1 IS NOT NULL GROUP BY 1)"""
add("m04_forecast_one_step", _forecast_one, ("symbol", "step"), ("forecast", "lower_bound", "upper_bound"),
    """SELECT symbol, 1::BIGINT AS step, f AS forecast, f - 1.96 * sd AS lower_bound, f + 1.96 * sd AS upper_bound FROM (
       SELECT symbol, sd, close + c + b * y AS f FROM dy JOIN ar USING (symbol) JOIN err USING (symbol)
       QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)""", (v.BARS, AR1))
add_fitted("m05_ar_orders", lambda s, d: md.ar_orders(bars(s, d)), ("symbol", "order"), ("aic",), fits.ar_orders(5))
AIC, AICS = fits.ar_orders(5)
add("m05_best_order", lambda s, d: md.best_order(md.ar_orders(bars(s, d))), ("symbol", "order"), ("aic",),
    'SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY aic, "order") = 1', [*AIC, f"orders AS ({AICS})"])


def _recursive(s, d):
    """Three lags per bar and fixed weights, five steps ahead."""
    def layer(df, w):
        return df.withColumn("lags", F.array("close", F.lag("close", 1).over(w), F.lag("close", 2).over(w)))

    lagged = o.ordered(a.bars_hourly(s, d), layer, back=2).filter(F.col("lags")[2].isNotNull())
    made = md.recursive_forecast(lagged.withColumn("coefficients", F.array(*map(F.lit, (1.0, 0.5, 0.3, 0.1)))), 4)
    return made.select("*", *[F.col("predictions")[i].alias(f"step_{i + 1}") for i in range(4)])


STEPS = "1 + 0.5 * {} + 0.3 * {} + 0.1 * {}"
add("m06_recursive_forecast", _recursive, KEY, ("step_1", "step_2", "step_3", "step_4"),
    f"""SELECT *, {STEPS.format('step_3', 'step_2', 'step_1')} AS step_4 FROM (SELECT *, {STEPS.format('step_2', 'step_1', 'close')} AS step_3 FROM (
        SELECT *, {STEPS.format('step_1', 'close', 'l1')} AS step_2 FROM (SELECT *, {STEPS.format('close', 'l1', 'l2')} AS step_1 FROM (
        SELECT ts, symbol, close, lag(close) OVER {v.over()} AS l1, lag(close, 2) OVER {v.over()} AS l2 FROM bars) WHERE l2 IS NOT NULL)))""", (v.BARS,))


def _record(s, d):
    """Ticks of a day as draws around the day's prediction."""
    draws = a.ticks(s, d).withColumn("value", F.col("price") / 1000.0)
    summary = mt.draw_summary(draws).withColumn("current_price", F.lit(0.05))
    return md.prediction_record(summary, "short_term", "day", AS_OF, predicted="mean", std="std")


add("m07_prediction_record", _record, ("symbol", "model_name", "prediction_time", "steps_ahead"),
    ("current_price", "predicted_price", "confidence", "lower_bound", "upper_bound"),
    f"""SELECT symbol, 'short_term' AS model_name, TIMESTAMP '{AS_OF}' AS prediction_time, 1::BIGINT AS steps_ahead, 0.05 AS current_price,
        avg(x) AS predicted_price, 1 - stddev_pop(x) AS confidence, quantile_cont(x, 0.05) AS lower_bound, quantile_cont(x, 0.95) AS upper_bound
        FROM (SELECT symbol, price / 1000 AS x FROM ticks) GROUP BY symbol""", (v.TICKS,))
add("m08_baseline_interval", lambda s, d: md.baseline_interval(shapes.predictions(s, d)), ("prediction_time", "symbol"), ("lower_bound", "upper_bound"),
    """SELECT *, predicted_price * (1 - 0.1 * confidence) AS lower_bound, predicted_price * (1 + 0.1 * confidence) AS upper_bound FROM preds""", PRED_CTES)


def _three_models(s, d):
    i = ind.sma(a.bars_hourly(s, d), (5, 10, 20))
    parts = F.array(*[F.struct(F.lit(m).alias("model_name"), F.col(c).alias("predicted_price"))
                      for m, c in (("lstm", "sma_5"), ("transformer", "sma_10"), ("fundamental_dl", "sma_20"))])
    return i.select("symbol", F.col("ts").alias("target_time"), F.explode(parts).alias("p")).select("symbol", "target_time", "p.*").filter(
        ~((F.col("model_name") == "lstm") & (F.hour("target_time") == 4)))


add("m09_ensemble", lambda s, d: md.ensemble(_three_models(s, d)), ("symbol", "target_time", "models"), ("predicted_price",),
    """SELECT symbol, ts AS target_time, CASE WHEN hour(ts) = 4 THEN 2 ELSE 3 END::BIGINT AS models, CASE WHEN hour(ts) = 4
       THEN (0.4 * sma_10 + 0.2 * sma_20) / 0.6 ELSE 0.4 * sma_5 + 0.4 * sma_10 + 0.2 * sma_20 END AS predicted_price FROM ind""",
    (v.BARS, *v.ind_ctes()))


def _drift(s, d):
    t = a.ticks(s, d)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return md.drift(t.filter(F.col("ts") < cut), t.filter(F.col("ts") >= cut), "price")


PROBS = [i / 10 for i in range(1, 10)]
add("m10_drift", _drift, ("drifted",), ("psi",),
    f"""SELECT sum((q - r) * ln(q / r)) AS psi, sum((q - r) * ln(q / r)) > 0.1 AS drifted FROM (SELECT bucket,
        greatest(count(*) FILTER (old) / (sum(count(*) FILTER (old)) OVER ())::DOUBLE, 1e-6) AS r,
        greatest(count(*) FILTER (NOT old) / (sum(count(*) FILTER (NOT old)) OVER ())::DOUBLE, 1e-6) AS q
        FROM (SELECT ts < '2024-01-16' AS old, len(list_filter(cuts, lambda c: c < price)) AS bucket FROM ticks,
        (SELECT quantile_cont(price, {PROBS}) AS cuts FROM ticks WHERE ts < '2024-01-16')) GROUP BY bucket)""", (v.TICKS,))
add("m11_news_sentiment", lambda s, d: md.news_sentiment(a.news(s, d)), ("symbol", "date", "articles"), ("sentiment",),
    """SELECT symbol, date::VARCHAR AS date, (sum(c) OVER w)::BIGINT AS articles, sum(x) OVER w / sum(c) OVER w AS sentiment FROM (
       SELECT symbol, ts::DATE AS date, sum(score) AS x, count(*) AS c FROM news GROUP BY 1, 2)
       WINDOW w AS (PARTITION BY symbol ORDER BY date RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)""", (v.NEWS,))


def _fundamentals(s, d):
    """Accounts as balance sheets: one row per supplier with invented use of its columns."""
    b = F.abs("s_acctbal")
    return md.fundamental_ratios(a.table(s, d, "supplier").select(
        "s_suppkey", (b + 10.0).alias("price"), (b / 50.0 - 20.0).alias("eps"), (b / 3.0 + 1.0).alias("book_value_per_share"),
        F.col("s_acctbal").alias("net_income"), (b * 2.0 + 1.0).alias("equity"), (b / 2.0).alias("debt"),
        b.alias("current_assets"), F.col("s_nationkey").cast("double").alias("current_liabilities")))


add("m12_fundamental_ratios", _fundamentals, ("s_suppkey",), ("pe_ratio", "pb_ratio", "roe", "debt_to_equity", "current_ratio"),
    """SELECT s_suppkey, (b + 10) / nullif(b / 50 - 20, 0) AS pe_ratio, (b + 10) / (b / 3 + 1) AS pb_ratio, s_acctbal / (b * 2 + 1) AS roe,
       b / 2 / (b * 2 + 1) AS debt_to_equity, b / nullif(s_nationkey, 0) AS current_ratio FROM (SELECT *, abs(s_acctbal) AS b FROM supplier)""")


def _quarters(s, d):
    """Order totals per priority and quarter as reported figures."""
    orders = a.table(s, d, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("quarter", F.col("o_orderdate").cast("timestamp")).alias("ts")).agg(
        F.sum("o_totalprice").alias("revenue"), F.avg("o_totalprice").alias("earnings"), F.max("o_totalprice").alias("fcf"))


QUARTERS = """quarters AS (SELECT o_orderpriority AS symbol, date_trunc('quarter', o_orderdate)::TIMESTAMP AS ts, sum(o_totalprice) AS revenue,
  avg(o_totalprice) AS earnings, max(o_totalprice) AS fcf FROM orders GROUP BY 1, 2)"""
add("m12_fundamental_growth", lambda s, d: md.fundamental_growth(_quarters(s, d)), KEY, ("revenue_growth", "earnings_growth", "fcf_growth"),
    "SELECT *, " + ", ".join(f"{c} / lag({c}, 4) OVER {v.over()} - 1 AS {c}_growth" for c in ("revenue", "earnings", "fcf")) + " FROM quarters",
    (QUARTERS,))


def _with_fundamentals(s, d):
    """Each order with the figures of the quarter it falls into."""
    orders = a.table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    return lk.asof_join(orders, _quarters(s, d), ["revenue"], slot="52 weeks")


add("m12_fundamentals_as_of", _with_fundamentals, ("o_orderkey", "symbol"), ("revenue",),
    "SELECT o_orderkey, o_orderpriority AS symbol, revenue FROM orders ASOF LEFT JOIN quarters q ON q.symbol = o_orderpriority AND q.ts <= o_orderdate",
    (QUARTERS,), digits=2)

# --- signals ----------------------------------------------------------------


def _scores(s, d):
    full = ind.indicator_set(a.bars_hourly(s, d))
    return full.withColumns({"technical_score": sg.technical_score(full.columns), "momentum_score": sg.momentum_score(full.columns)})


add("r01_r02_scores", _scores, KEY, ("technical_score", "momentum_score"),
    f"SELECT *, {v.TECHNICAL_SCORE} AS technical_score, {v.MOMENTUM_SCORE} AS momentum_score FROM ind", (v.BARS, *v.ind_ctes()))
SIGNAL = ("expected_return", "technical_score", "momentum_score", "confidence", "target_1", "target_2", "target_3", "stop_loss",
          "position_size", "risk_reward_ratio")
for _horizon, _days in sg.HORIZON_DAYS.items():
    add(f"r08_signals_{_horizon}", lambda s, d, h=_horizon: shapes.signals(s, d, h), (*KEY, "signal_type", "time_horizon"), SIGNAL,
        f"""SELECT *, '{_horizon}' AS time_horizon, CASE WHEN current_price = stop_loss THEN 0 ELSE abs(target_1 - current_price) / abs(current_price - stop_loss) END
            AS risk_reward_ratio FROM signals""", v.signal_ctes(_days))


def _formulas(s, d):
    """R-03 to R-07 as separate expressions over line items."""
    li = a.table(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
        (F.col("l_discount") * 4.0 - 0.2).alias("ret"), (F.col("l_quantity") / 50.0).alias("conf"), (F.col("l_tax") * 10.0 + 0.05).alias("vol"))
    c = F.col
    out = li.withColumn("strength", sg.signal_strength(c("ret"), c("conf"), c("conf"), c("vol"), c("vol")))
    out = out.withColumn("signal_type", sg.signal_type(c("ret"), c("strength")))
    out = out.withColumns(sg.targets(c("p"), c("vol"), c("signal_type"), "medium"))
    return out.withColumns({"size": sg.position_size(c("strength"), c("vol")), "rr": sg.risk_reward(c("p"), c("target_3"), c("stop_loss")),
                            "band": sg.confidence_band("strength")})


LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
FORMULAS = """x1 AS (SELECT *, l_extendedprice / l_quantity AS p, l_discount * 4 - 0.2::DOUBLE AS ret, l_quantity / 50 AS conf, l_tax * 10 + 0.05::DOUBLE AS vol FROM lineitem),
  x2 AS (SELECT *, least(greatest(0.4 * least(abs(ret) * conf / 0.1, 1) + 0.3 * conf + 0.2 * vol + 0.1 * (1 - least(vol, 1)), 0), 1) AS strength,
  CASE WHEN ret > 0.02 THEN 1 WHEN ret < -0.02 THEN -1 ELSE 0 END AS side, p * vol * sqrt(5 / 252.0::DOUBLE) AS mv FROM x1),
  x3 AS (SELECT *, p + mv * side * 0.5 AS target_1, p + mv * side AS target_2, p + mv * side * 1.5 AS target_3,
  CASE WHEN side = 0 THEN p - mv * 0.3 ELSE p - mv * side * 0.5 END AS stop_loss FROM x2)"""
add("r03_r07_formulas", _formulas, (*LINE, "signal_type"), ("strength", "target_1", "target_2", "target_3", "stop_loss", "size", "rr"),
    """SELECT *, CASE WHEN side <> 0 AND strength > 0.7 THEN 'strong_' ELSE '' END || CASE side WHEN 1 THEN 'buy' WHEN -1 THEN 'sell' ELSE 'hold' END AS signal_type,
       least(greatest(strength * 0.5 * (1 - least(vol, 0.5)), 0.05), 0.25) AS size,
       CASE WHEN p = stop_loss THEN 0 ELSE abs(target_3 - p) / abs(p - stop_loss) END AS rr FROM x3""", (FORMULAS,))
add("r09_confidence_band", lambda s, d: a.table(s, d, "lineitem").select(*LINE, sg.confidence_band(F.col("l_quantity") / 50.0).alias("band")), (*LINE, "band"), (),
    """SELECT *, CASE WHEN l_quantity / 50 BETWEEN 0.7 AND 0.8 THEN 'high' WHEN l_quantity / 50 BETWEEN 0.5 AND 0.6 THEN 'medium'
       WHEN l_quantity / 50 BETWEEN 0.3 AND 0.4 THEN 'low' END AS band FROM lineitem""")
add("k04_signal_table", lambda s, d: sg.to_signal_table(shapes.signals(s, d)).withColumn("score", F.col("metadata")["technical_score"]),
    (*KEY, "signal_type", "strategy"), ("target_price", "stop_loss", "confidence", "score"),
    "SELECT *, 'prediction' AS strategy, target_1 AS target_price, technical_score AS score FROM signals", v.signal_ctes())

# --- strategies -------------------------------------------------------------

NAME = """CASE outlook WHEN 'bullish' THEN CASE WHEN risk_tolerance = 'aggressive' THEN 'Long Call' ELSE 'Bull Call Spread' END
  WHEN 'bearish' THEN CASE WHEN risk_tolerance = 'aggressive' THEN 'Long Put' ELSE 'Bear Put Spread' END
  WHEN 'neutral' THEN CASE WHEN implied_volatility > 0.3 THEN 'Iron Condor' ELSE 'Covered Call' END ELSE 'Long Straddle' END"""
NAMED = f"named AS (SELECT *, {NAME} AS strategy FROM legs_input)"
# Fixed values, written out apart from the operator's own table.
LEG_TABLE = """legs AS (SELECT * FROM (VALUES
  ('Long Call', 0, 'buy', 'call', 1.05::DOUBLE, 1, 60, 'Unlimited', 'Premium paid', 'Strike + Premium'),
  ('Bull Call Spread', 0, 'buy', 'call', 1.02, 1, 45, NULL, 'Net premium paid', 'Lower strike + Net premium'),
  ('Bull Call Spread', 1, 'sell', 'call', 1.08, 1, 45, NULL, 'Net premium paid', 'Lower strike + Net premium'),
  ('Long Put', 0, 'buy', 'put', 0.95, 1, 60, 'Strike - Premium', 'Premium paid', 'Strike - Premium'),
  ('Bear Put Spread', 0, 'buy', 'put', 0.98, 1, 45, NULL, 'Net premium paid', 'Upper strike - Net premium'),
  ('Bear Put Spread', 1, 'sell', 'put', 0.92, 1, 45, NULL, 'Net premium paid', 'Upper strike - Net premium'),
  ('Iron Condor', 0, 'sell', 'put', 0.95, 1, 30, 'Net premium received', 'Width of spread - Net premium', 'Two breakevens'),
  ('Iron Condor', 1, 'buy', 'put', 0.90, 1, 30, 'Net premium received', 'Width of spread - Net premium', 'Two breakevens'),
  ('Iron Condor', 2, 'sell', 'call', 1.05, 1, 30, 'Net premium received', 'Width of spread - Net premium', 'Two breakevens'),
  ('Iron Condor', 3, 'buy', 'call', 1.10, 1, 30, 'Net premium received', 'Width of spread - Net premium', 'Two breakevens'),
  ('Covered Call', 0, 'own', 'stock', NULL, 100, 30, 'Strike - Stock cost + Premium', 'Stock cost - Premium', 'Stock cost - Premium'),
  ('Covered Call', 1, 'sell', 'call', 1.05, 1, 30, 'Strike - Stock cost + Premium', 'Stock cost - Premium', 'Stock cost - Premium'),
  ('Long Straddle', 0, 'buy', 'call', 1.0, 1, 45, 'Unlimited', 'Total premium paid', 'Strike ± Total premium'),
  ('Long Straddle', 1, 'buy', 'put', 1.0, 1, 45, 'Unlimited', 'Total premium paid', 'Strike ± Total premium')
) AS t(strategy, leg_no, action, option_type, multiple, quantity, cap, max_profit, max_loss, breakeven))"""
add("r10_recommend_strategy", lambda s, d: st.recommend_strategy(a.legs_input(s, d)), ("p_partkey", "strategy", "error"), (),
    "SELECT *, NULL::VARCHAR AS error FROM named", (v.LEGS_INPUT, NAMED))
add("r11_strategy_legs",
    lambda s, d: st.explode_legs(st.strategy_legs(st.recommend_strategy(a.legs_input(s, d)))).withColumns(
        {"leg_no": F.col("leg_no").cast("bigint"), "recommended_dte": F.col("recommended_dte").cast("bigint"),
         # A width of strikes is compared as a number, the text around it as text.
         "profit_amount": F.regexp_extract("max_profit", r"^\$([0-9.Ee+-]+) - Net Premium$", 1).try_cast("double"),
         "profit_text": F.regexp_replace("max_profit", r"^\$[0-9.Ee+-]+", "\\$")}),
    ("p_partkey", "strategy", "leg_no", "action", "option_type", "quantity", "recommended_dte", "profit_text", "max_loss", "breakeven"), ("strike", "profit_amount"),
    """SELECT n.*, leg_no::BIGINT AS leg_no, action, option_type, quantity::BIGINT AS quantity, least(time_to_expiration, cap)::BIGINT AS recommended_dte,
       coalesce(max_profit, '$ - Net Premium') AS profit_text, max_loss, breakeven, current_price * multiple AS strike,
       CASE strategy WHEN 'Bull Call Spread' THEN current_price * 1.08::DOUBLE - current_price * 1.02::DOUBLE
                     WHEN 'Bear Put Spread' THEN current_price * 0.98::DOUBLE - current_price * 0.92::DOUBLE END AS profit_amount FROM named n JOIN legs USING (strategy)""", (v.LEGS_INPUT, NAMED, LEG_TABLE))


def _strategies(s, d):
    prices = lk.latest(a.bars_hourly(s, d)).select("symbol", F.col("close").alias("current_price"))
    return st.expiry_strategies(shapes.predictions(s, d), prices, AS_OF, ts="prediction_time")


def _consistent(s, d):
    return st.prediction_consistency(shapes.predictions(s, d), ts="prediction_time")


LAST11 = """last11 AS (SELECT symbol, predicted_price AS p, lag(predicted_price) OVER (PARTITION BY symbol ORDER BY prediction_time DESC) AS nxt,
   row_number() OVER (PARTITION BY symbol ORDER BY prediction_time DESC) AS k FROM preds QUALIFY k <= 11),
  cons AS (SELECT symbol, coalesce(avg(1 - least(abs(p - nxt) / nxt, 1)) FILTER (nxt <> 0) * 100, 75) AS consistency FROM last11 GROUP BY 1)"""
add("w15_prediction_consistency", _consistent, ("symbol",), ("consistency",), "SELECT * FROM cons", (*PRED_CTES, LAST11))


def half_up(x: str, digits: int) -> str:
    """Round the printed number, as Spark does, and not its binary neighbour."""
    return f"round(({x})::DOUBLE::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE"


STRATS = f"""st1 AS (SELECT c.symbol, c.consistency, b.price, avg(l.p) FILTER (k <= 3) - b.price AS chg, stddev_pop(l.p) FILTER (k <= 10) AS vol
   FROM cons c JOIN last11 l USING (symbol) JOIN (SELECT symbol, arg_max(close, ts) AS price FROM bars GROUP BY 1) b USING (symbol) GROUP BY 1, 2, 3),
  st2 AS (SELECT *, CASE WHEN chg > 0 THEN 'CALL' ELSE 'PUT' END AS option_type, {half_up('price * CASE WHEN chg > 0 THEN 1.02::DOUBLE ELSE 0.98::DOUBLE END', 2)} AS strike_price,
   {half_up('price + chg * 0.5', 2)} AS target_1, {half_up('price + chg', 2)} AS target_2, {half_up('price + chg * 1.5', 2)} AS target_3,
   least({half_up('consistency', 1)}, 95) AS confidence_1, least({half_up('consistency * 0.85', 1)}, 85) AS confidence_2, least({half_up('consistency * 0.65', 1)}, 70) AS confidence_3,
   chg / price * 100 AS predicted_move FROM st1),
  st3 AS (SELECT *, round({half_up('abs(strike_price - price) + vol * sqrt(days / 365.0::DOUBLE) * price * 0.1', 2)} * 100, 2) AS capital_required,
   strftime(DATE '2024-01-30' + days, '%Y-%m-%d') AS expiry_date, CASE days WHEN 7 THEN target_1 WHEN 14 THEN target_2 ELSE target_3 END AS tgt
   FROM st2, (VALUES (7), (14), (30)) AS e(days)),
  strategies AS (SELECT *, CASE WHEN capital_required > 0 THEN {half_up('abs(tgt - strike_price) * 100 / capital_required', 2)} ELSE 0 END AS risk_reward,
   CASE WHEN abs(predicted_move) < 2 THEN 'LOW' WHEN abs(predicted_move) < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS risk_level, price AS stock_price FROM st3)"""
STRAT_CTES = (*PRED_CTES, LAST11, STRATS)
add("r12_r14_expiry_strategies", _strategies, ("symbol", "option_type", "days", "expiry_date", "risk_level"),
    ("stock_price", "strike_price", "target_1", "target_2", "target_3", "confidence_1", "confidence_2", "confidence_3", "capital_required", "risk_reward", "predicted_move"),
    "SELECT * FROM strategies", STRAT_CTES)
add("f09_display_strategies", lambda s, d: st.display_strategies(_strategies(s, d)),
    ("symbol", "expiry_date", "stock_price", "target_2", "confidence_1", "capital_required", "risk_reward"), (),
    """SELECT symbol, expiry_date, printf('$%.2f', stock_price) AS stock_price, printf('$%.2f', target_2) AS target_2, printf('%.1f%%', confidence_1) AS confidence_1,
       printf('$%.2f', capital_required) AS capital_required, printf('%.2f', risk_reward) AS risk_reward FROM strategies""", STRAT_CTES)
add("a12_strategy_summary", lambda s, d: mt.strategy_summary(_strategies(s, d)), ("symbol", "cheapest_expiry"), ("min_capital", "best_risk_reward", "avg_confidence"),
    """SELECT symbol, arg_min(expiry_date, capital_required) AS cheapest_expiry, min(capital_required) AS min_capital, max(risk_reward) AS best_risk_reward,
       avg(confidence_1) AS avg_confidence FROM strategies GROUP BY 1""", STRAT_CTES)
add("r15_status_rows", lambda s, d: st.status_rows(a.bars_hourly(s, d), shapes.predictions(s, d).withColumnRenamed("prediction_time", "ts")),
    ("symbol", "data_points"), ("current_price", "previous_price", "change", "change_pct", "predicted_price", "prediction_diff"),
    f"""SELECT b.symbol, n AS data_points, close AS current_price, prev AS previous_price, close - prev AS change, (close - prev) / prev * 100 AS change_pct,
        predicted_price, predicted_price - close AS prediction_diff FROM (SELECT *, lag(close) OVER {v.over()} AS prev, count(*) OVER (PARTITION BY symbol) AS n
        FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1) b JOIN preds p ON p.symbol = b.symbol AND p.prediction_time = b.ts""", PRED_CTES)
