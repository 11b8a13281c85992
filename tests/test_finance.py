"""Option formulas, scenarios, models, signals: identities, brute force and edge rows."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from helpers import by_key
from pyspark.sql import functions as F

from barloom.functions import mathfn as m
from barloom.functions import options as op
from barloom.functions import sqlfn
from barloom.operators import chains, models, scenarios, strategies, validate
from barloom.operators import signals as sg
from barloom.operators.prep import fit_scaler, scale, unscale

QUOTE = "id int, underlying_price double, strike double, time_to_expiration double, implied_volatility double, option_type string"


def quotes(spark):
    rows = [(i, 100.0, 60.0 + 5 * (i % 17), 0.05 + 0.1 * (i % 7), 0.1 + 0.05 * (i % 9), t)
            for i in range(63) for t in ("call", "put")]
    return spark.createDataFrame(rows, QUOTE)


def test_normal_functions(spark):
    x = np.linspace(-10, 10, 801)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = df.select(m.norm_cdf("x"), m.norm_pdf("x")).collect()
    np.testing.assert_allclose([r[0] for r in got[:-1]], [0.5 * math.erfc(-v / math.sqrt(2)) for v in x], atol=1e-15, rtol=1e-6)
    assert got[-1][0] is None
    p = [1e-9, 0.001, 0.02, 0.3, 0.5, 0.77, 0.99, 1 - 1e-6]
    got = spark.createDataFrame([(v,) for v in p], "p double").select(m.norm_ppf("p")).collect()
    np.testing.assert_allclose([r[0] for r in got], [NormalDist().inv_cdf(v) for v in p], atol=1e-9)


def test_parity_and_delta(spark):
    v = by_key(op.with_values(quotes(spark)), "id", "option_type")
    call, put = v[v.option_type == "call"].reset_index(), v[v.option_type == "put"].reset_index()
    t, k, s = call.time_to_expiration, call.strike, call.underlying_price
    np.testing.assert_allclose(call.price - put.price, s * np.exp(-0.02 * t) - k * np.exp(-0.05 * t), atol=1e-9)
    np.testing.assert_allclose(call.delta - put.delta, np.exp(-0.02 * t), atol=1e-12)
    np.testing.assert_allclose(call.gamma, put.gamma, atol=1e-12)
    # vega is the price change per 1 % volatility
    up = by_key(op.with_values(quotes(spark).withColumn("implied_volatility", F.col("implied_volatility") + 1e-5), ("price",)), "id", "option_type")
    np.testing.assert_allclose((up.price - v.price) / 1e-3, v.vega, atol=1e-4)


def test_expired_null_and_odd_quotes(spark):
    rows = [(1, 110.0, 100.0, 0.0, 0.2, "call"), (2, 90.0, 100.0, -0.1, 0.2, "put"), (3, 90.0, 100.0, 0.5, None, "put"), (4, 90.0, 0.0, 0.5, 0.2, "call")]
    r = {x.id: x for x in op.with_values(spark.createDataFrame(rows, QUOTE)).collect()}
    assert (r[1].price, r[1].delta, r[1].gamma, r[1].theta) == (10.0, 1.0, 0.0, 0.0)
    assert (r[2].price, r[2].delta) == (10.0, 0.0)
    assert r[3].price is None and r[3].delta is None
    assert r[4].price is None


def test_implied_vol_recovers_sigma(spark):
    known = op.with_values(quotes(spark), ("price", "vega")).filter("vega > 0.02")
    got = op.implied_vol(known, price="price", out="iv").select("iv", "implied_volatility").toPandas()
    np.testing.assert_allclose(got.iv, got.implied_volatility, atol=1e-5)
    none = op.implied_vol(known.withColumn("price", F.lit(None).cast("double")), price="price", out="iv").select("iv").distinct().collect()
    assert [r.iv for r in none] == [None]


def test_sql_functions_match_columns(spark):
    sqlfn.register(spark)
    q = op.with_values(quotes(spark), ("price", "delta", "theta"))
    q.createOrReplaceTempView("q")
    a = "underlying_price, strike, time_to_expiration, 0.05D, implied_volatility, option_type, 0.02D"
    worst = spark.sql(f"SELECT max(abs(calculate_price({a}) - price)) p, max(abs(calculate_delta({a}) - delta)) d, max(abs(calculate_theta({a}) - theta)) t FROM q").first()
    assert max(worst) < 1e-10
    assert spark.sql("SELECT calculate_delta(110D, 100D, 0D, 0.05D, 0.2D) d").first().d == 1.0


def test_knock_in_plus_knock_out_is_european(spark):
    rng = np.random.default_rng(1)
    steps = 100 * np.exp(np.cumsum(np.hstack([np.zeros((50, 1)), rng.normal(0, 0.02, (50, 8))]), axis=1))
    paths = spark.createDataFrame([("S", p, s, float(steps[p, s])) for p in range(50) for s in range(9)], "symbol string, path_id int, step int, price double")
    contracts = spark.createDataFrame([("c1", "S", "call", 101.0, 97.0, 0.05, 0.5)], "contract_id string, symbol string, option_type string, strike double, barrier double, rate double, years double")
    price = {k: scenarios.scenario_payoff(paths, contracts, k, on="symbol").first() for k in ("european", "asian", "down-in", "down-out")}
    assert price["down-in"].price + price["down-out"].price == pytest.approx(price["european"].price)
    pay = np.exp(-0.025) * np.maximum(steps[:, -1] - 101, 0)
    assert price["european"].price == pytest.approx(pay.mean())
    assert price["european"].std_error == pytest.approx(pay.std() / np.sqrt(50))
    assert price["asian"].price == pytest.approx((np.exp(-0.025) * np.maximum(steps.mean(axis=1) - 101, 0)).mean())
    with pytest.raises(ValueError):
        scenarios.payoff("sideways")


def test_max_pain_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [("S", "E", float(k), t, int(rng.integers(0, 50))) for k in range(80, 121, 5) for t in ("call", "put")]
    got = chains.max_pain(spark.createDataFrame(rows, "symbol string, expiration string, strike double, option_type string, open_interest long")).first()
    pain = {x: sum(oi * max(x - k if t == "call" else k - x, 0) for _, _, k, t, oi in rows) for x in range(80, 121, 5)}
    assert got.payout == pytest.approx(min(pain.values()))
    assert pain[int(got.max_pain)] == pytest.approx(got.payout)


def test_daily_iv_is_the_exact_mean_in_any_order(spark):
    """Means over 64 quotes often end halfway between two six-digit values, where a sum of doubles depends on its order."""
    rng = np.random.default_rng(5)
    discounts = rng.integers(0, 11, (300, 64))
    made = [(f"S{day}", float(x) / 100.0 * 3.0 + 0.10) for day, row in enumerate(discounts) for x in row]
    halfway = sum(int(row.sum()) * 30_000 % 64 == 32 for row in discounts)
    wanted = {f"S{day}": float((int(row.sum()) * 30_000 * 2 + 64) // 128 + 100_000) / 1e6 for day, row in enumerate(discounts)}
    for rows in (made, made[::-1], sorted(made, key=lambda r: r[1])):
        df = spark.createDataFrame(rows, "symbol string, implied_volatility double").coalesce(1).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
        assert halfway > 30 and {r.symbol: r.implied_volatility for r in chains.daily_iv(df).collect()} == wanted
    odd = [("A", float("nan")), ("A", 0.1), ("B", None), ("B", 0.2), ("C", None), ("D", 1e30), ("D", 3e30)]
    df = spark.createDataFrame(odd, "symbol string, implied_volatility double").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    got = {r.symbol: r.implied_volatility for r in chains.daily_iv(df).collect()}
    assert math.isnan(got["A"]) and got["B"] == 0.2 and got["C"] is None and got["D"] == 2e30


def test_linear_fit_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 100, 5]
    y = x @ [1.5, -0.2, 8.0] + 3 + rng.normal(0, 0.1, 300)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(symbol="S", ts=pd.date_range("2024-01-01", periods=300, freq="h"), target=y,
                                                          split=np.where(np.arange(300) < 240, "train", "test"))
    df = spark.createDataFrame(pdf)
    fitted, results = models.train_per_symbol(df, ["a", "b", "c"], ridge=0.0)
    beta = np.linalg.lstsq(np.c_[np.ones(240), x[:240]], y[:240], rcond=None)[0]
    r = results.first()
    assert (r.train_rows, r.test_rows) == (240, 60)
    assert r.test_mae == pytest.approx(np.abs(y[240:] - np.c_[np.ones(60), x[240:]] @ beta).mean(), rel=1e-6)
    got = by_key(models.predict_per_symbol(df, fitted, ["a", "b", "c"]), "ts")
    np.testing.assert_allclose(got.predicted, np.c_[np.ones(300), x] @ beta, rtol=1e-8)


def test_ar_forecast_against_numpy(spark, bars, bars_pdf):
    got = by_key(models.forecast_ar(bars.filter("symbol = 'BIG'"), steps=4, p=3, d=1, rows=40), "step")
    close = bars_pdf[bars_pdf.symbol == "BIG"].close.to_numpy()
    y = np.diff(close)
    X = np.c_[np.ones(len(y) - 3), y[2:-1], y[1:-2], y[:-3]]
    b = np.linalg.lstsq(X, y[3:], rcond=None)[0]
    recent, level, out = list(y[::-1][:3]), close[-1], []
    for _ in range(4):
        nxt = b[0] + b[1:] @ np.array(recent)
        recent, level = [nxt, *recent[:2]], level + nxt
        out.append(level)
    np.testing.assert_allclose(got.forecast, out, rtol=1e-8)
    best = models.best_order(models.ar_orders(bars.filter("symbol = 'BIG'"), 3, rows=40)).first()
    assert best.order in (1, 2, 3)


def test_scaler_round_trip(spark, bars):
    scaler = fit_scaler(bars, ["close"])
    back = unscale(scale(bars, scaler, ["close"]), scaler, ["close"])
    worst = back.alias("b").join(bars.alias("a"), ["symbol", "ts"]).agg(F.max(F.abs(F.col("a.close") - F.col("b.close")))).first()[0]
    assert worst < 1e-9


def test_drift_of_equal_data_is_zero(spark, bars):
    row = models.drift(bars, bars, "close").first()
    assert row.psi == pytest.approx(0.0) and not row.drifted


def test_signal_row(spark):
    df = spark.createDataFrame([("S", 100.0, 110.0, 0.9, 25.0, 2.0, 1.0, 12.0, 11.0, 0.1, 2.0, 0.15)],
                               "symbol string, current_price double, predicted_price double, confidence double, rsi double, macd double, macd_signal double, sma_20 double, sma_50 double, return_5d double, volume_ratio double, volatility double")
    r = sg.generate_signals(df).first()
    assert r.technical_score == pytest.approx(1.0) and r.momentum_score == pytest.approx(0.9)
    strength = 0.4 * 0.9 + 0.3 * 1.0 + 0.2 * 0.9 + 0.1 * 0.85
    assert r.confidence == pytest.approx(strength) and r.signal_type == "strong_buy"
    move = 100 * 0.15 * math.sqrt(1 / 252)
    assert (r.target_2, r.stop_loss) == (pytest.approx(100 + move), pytest.approx(100 - move / 2))
    assert r.position_size == pytest.approx(0.25) and r.risk_reward_ratio == pytest.approx(1.0)
    bare = sg.generate_signals(df.select("symbol", "current_price", "predicted_price")).first()
    assert bare.technical_score == 0.5 and bare.signal_type == "buy"


def test_strategies(spark):
    df = spark.createDataFrame([(100.0, "neutral", "moderate", 0.4, 50), (100.0, "sideways", "moderate", 0.4, 50)],
                               "current_price double, outlook string, risk_tolerance string, implied_volatility double, time_to_expiration int")
    made = strategies.strategy_legs(strategies.recommend_strategy(df)).collect()
    assert made[0].strategy == "Iron Condor" and made[0].recommended_dte == 30
    assert [x.strike for x in made[0].legs] == pytest.approx([95.0, 90.0, 105.0, 110.0])
    assert made[1].strategy is None and made[1].error == "Unknown market outlook: sideways"


def test_consistency_of_one_prediction_is_75(spark):
    df = spark.createDataFrame([("S", pd.Timestamp("2024-01-01").to_pydatetime(), 10.0)], "symbol string, ts timestamp, predicted_price double")
    assert strategies.prediction_consistency(df).first().consistency == 75.0


def test_validators_skip_what_is_missing(spark):
    df = spark.createDataFrame([(1, None, 5.0, 4.0, 4.5, 0), (2, 3.0, 2.0, 4.0, 2.5, -1)], "id int, open double, high double, low double, close double, volume int")
    r = {x.id: x for x in validate.validate_bars(df).collect()}
    assert r[1].errors == ["Zero volume (may be non-trading period)"]
    assert len(r[2].errors) == 4 and not r[2].is_valid
    assert validate.validate_bars(df.select("id")).filter("is_valid").count() == 2
    summary = validate.validation_summary(df.limit(0), "price").first()
    assert (summary.total, summary.success_rate) == (0, 0.0)


def test_many_contracts_equal_each_contract_over_its_paths(spark):
    """Strikes equal to prices, barriers of their own, bins split into parts; against the join of paths and contracts."""
    import numpy as np
    from pyspark.sql import functions as F

    from barloom.operators import scenarios as sc

    rng = np.random.default_rng(4)
    paths = [(s, i, k, float(p)) for s, n in (("A", 300), ("B", 40)) for i in range(n) for k, p in enumerate(np.round(100 * np.exp(np.cumsum(np.r_[0, rng.normal(0, 0.02, 4)])), 1))]
    facts = sc.path_facts(spark.createDataFrame(paths, "symbol string, path_id long, step int, price double"), ("symbol",))
    ends = sorted({r.terminal for r in facts.collect()})
    rows = [(i, "AB"[i % 2], float(rng.choice(ends)) if i % 3 else float(rng.uniform(60, 140)), ("call", "put")[i % 4 // 2], float(rng.choice([96.0, 98.0, 102.0, 105.0])), 0.05, 0.25) for i in range(60)]
    contracts = spark.createDataFrame(rows, "contract_id long, symbol string, strike double, option_type string, barrier double, rate double, years double")
    for kind in sc.KINDS:
        value = sc.payoff(kind, 2.0) * F.exp(-F.col("rate") * F.col("years"))
        want = sc.estimate(facts.join(contracts, "symbol").withColumn("_value", value), "_value").orderBy("contract_id").toPandas()
        got = sc.scenario_payoff_many(facts, contracts, kind, payout=2.0, rows=20).orderBy("contract_id").toPandas()
        assert (got.paths == want.paths).all() and len(got) == 60
        for c in ("price", "std_error", "ci_lower", "ci_upper"):
            np.testing.assert_allclose(got[c], want[c], atol=1e-6, err_msg=f"{kind} {c}")
