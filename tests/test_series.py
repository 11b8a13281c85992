"""Chunked series against pandas and against the uncut window."""

import numpy as np
import pandas as pd
import pytest
from helpers import by_key
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import lookup as lk
from barloom.operators import ordered as o
from barloom.operators import prep
from barloom.operators.quantiles import exact_quantiles, lower_tail, order_statistics

KEY = ("symbol", "ts")


@pytest.mark.parametrize("rows", [50, 64, 300])
def test_chunks_give_the_numbers_of_the_uncut_window(bars, rows):
    whole = by_key(ind.indicator_layers()(bars, W.partitionBy("symbol").orderBy("ts")), *KEY)
    cut = by_key(ind.indicator_set(bars, rows=rows), *KEY)
    assert len(cut) == len(whole)
    for c in whole.columns:
        if whole[c].dtype.kind == "f":
            np.testing.assert_allclose(cut[c], whole[c], rtol=0, atol=1e-9, err_msg=c)


def test_no_task_gets_a_whole_symbol(bars):
    sizes = o.spread(bars, back=19, rows=40).groupBy("symbol", "_chunk").count().agg(F.max("count")).first()[0]
    # 40 rows, at most one slot (24 bars) over, and whole slots of copies.
    assert sizes <= 40 + 24 + 20 + 24


def test_positions_and_split(bars, bars_pdf):
    got = by_key(ind.row_num(bars, rows=30), *KEY)
    assert (got.row_num == got.groupby("symbol").cumcount() + 1).all()
    split = by_key(prep.chrono_split(bars, rows=30), *KEY)
    big = split[split.symbol == "BIG"].split
    assert list(big.value_counts().reindex(["train", "validation", "test"])) == [612, 108, 180]
    assert len(split) == len(bars_pdf)


def test_lead_and_sequences_across_cuts(bars):
    got = by_key(prep.next_target(bars, lead=3, rows=20), *KEY)
    expected = got.groupby("symbol").close.shift(-3).dropna()
    np.testing.assert_array_equal(got.target[expected.index], expected)
    seq = prep.sequences(bars, ["close"], n=15, rows=20)
    assert seq.count() == 885 + 55
    assert seq.filter(F.size("sequence") != 15).count() == 0


def test_fill_missing_over_long_gaps(spark, bars, bars_pdf):
    holes = bars_pdf.assign(close=bars_pdf.close.where(bars_pdf.index % 97 == 5))
    expected = holes.assign(close=holes.groupby("symbol").close.ffill())
    expected["close"] = expected.groupby("symbol").close.bfill()
    got = by_key(prep.fill_missing(spark.createDataFrame(holes), ["close"], rows=25), *KEY)
    want = by_key(expected.dropna(subset=["close"]), *KEY)
    np.testing.assert_array_equal(got.close, want.close)
    assert len(got) == len(want)


def test_exponential_means(bars):
    got = by_key(ind.macd_ema(bars, rows=530), *KEY)
    for symbol, g in got.groupby("symbol"):
        line = g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean()
        np.testing.assert_allclose(g.macd, line, atol=1e-9)
        np.testing.assert_allclose(g.macd_signal, line.ewm(span=9, adjust=False).mean(), atol=1e-9)


@pytest.mark.parametrize(("rows", "slot"), [(7, "1 hour"), (90, "1 day"), (700, "7 days"), (100_000, "1 day")])
def test_exponential_means_carry_over_gaps(spark, rows, slot):
    rng = np.random.default_rng(8)
    frames = []
    for symbol, gaps in (("A", [(900, 1600)]), ("B", [(0, 40), (41, 42), (2990, 3000)]), ("C", [(0, 3000)])):
        close = 100 + rng.normal(0, 1, 3000).cumsum()
        for a, b in gaps:
            close[a:b] = np.nan
        close[rng.choice(3000, 200, replace=False)] = np.nan
        frames.append(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=3000, freq="17min"), "symbol": symbol, "close": close}))
    df = spark.createDataFrame(pd.concat(frames))
    got = by_key(ind.macd_ema(df, rows=rows, slot=slot).join(ind.ema(df, spans=(5, 200), rows=rows, slot=slot).drop("close"), ["symbol", "ts"]), *KEY)
    assert len(got) == 9000
    for _, g in got.groupby("symbol"):
        mean = lambda s, x=g.close: x.ewm(span=s, adjust=False).mean()
        line = mean(12) - mean(26)
        for c, want in (("macd", line), ("macd_signal", line.ewm(span=9, adjust=False).mean()), ("ema_5", mean(5)), ("ema_200", mean(200))):
            np.testing.assert_allclose(g[c], want, atol=1e-9)


def test_rows_without_key_stay(spark, bars):
    stray = spark.createDataFrame([(None, "BIG", 5.0), (pd.Timestamp("2024-01-02").to_pydatetime(), None, 6.0), (None, None, None)], "ts timestamp, symbol string, close double")
    holed = bars.unionByName(stray, allowMissingColumns=True)
    n = bars.count()
    for op in (ind.sma, ind.ema, ind.macd_ema, ind.row_num, ind.indicator_set, ind.rsi):
        got = op(holed, rows=64)
        new = [c for c in got.columns if c not in holed.columns and c not in ("price_range", "price_range_pct")]
        assert new and got.count() == n + 3
        assert got.filter("ts IS NULL OR symbol IS NULL").filter(" OR ".join(f"{c} IS NOT NULL" for c in new)).count() == 0
        a, b = (by_key(x.dropna(subset=["ts", "symbol"]), *KEY) for x in (got, op(bars, rows=64)))
        np.testing.assert_allclose(a[new].to_numpy(float), b[new].to_numpy(float), atol=1e-9)
    assert prep.fill_missing(holed, ["close"]).count() == n + 2


def test_frames_longer_than_a_chunk(bars):
    whole = by_key(ind.sma_layer((200,))(bars, W.partitionBy("symbol").orderBy("ts")), *KEY)
    got = by_key(ind.sma(bars, (200,), rows=30), *KEY)
    np.testing.assert_allclose(got.sma_200, whole.sma_200, atol=1e-9)
    wide = by_key(ind.indicator_set(bars, periods=(5, 200), rows=64), *KEY)
    np.testing.assert_allclose(wide.sma_200, whole.sma_200, atol=1e-9)
    ahead = lambda df, w: df.withColumn("later", F.lead("close", 100).over(w))
    far = by_key(o.ordered(bars, ahead, ahead=100, rows=30), *KEY)
    np.testing.assert_array_equal(far.later, by_key(ahead(bars, W.partitionBy("symbol").orderBy("ts")), *KEY).later)


def test_no_indicators_give_the_bars(bars):
    some = ind.sma(bars).select("ts", "symbol", "sma_5").filter("symbol = 'MID'")
    assert lk.with_indicators(bars, some).count() == 70
    none = lk.with_indicators(bars, some.limit(0))
    assert none.count() == bars.count() and none.filter("sma_5 IS NOT NULL").count() == 0
    assert lk.with_indicators(bars, None) is bars


def test_rsi_bounds_and_constant_price(spark, bars):
    x = ind.rsi(bars).agg(F.min("rsi"), F.max("rsi")).first()
    assert 0 <= x[0] <= x[1] <= 100
    flat = spark.createDataFrame(pd.DataFrame({"ts": pd.date_range("2024-01-01", periods=30, freq="h"), "symbol": "F",
                                               "close": 5.0, "high": 5.0, "low": 5.0, "volume": 0}))
    row = ind.bollinger(ind.rsi(flat, epsilon=0.0)).orderBy(F.desc("ts")).first()
    assert row.rsi is None and row.bb_position is None and row.bb_width == 0


def test_empty_input(spark, bars):
    assert ind.indicator_set(bars.limit(0)).count() == 0
    assert ind.ema(bars.limit(0)).count() == 0


@pytest.mark.parametrize("forward", [False, True])
def test_asof_join_with_a_hot_slot(spark, bars, bars_pdf, forward):
    rng = np.random.default_rng(3)
    hot = pd.Timestamp("2024-01-20 12:00")
    ts = [hot + pd.Timedelta(seconds=int(x)) for x in rng.integers(0, 3000, 400)]
    ts += [pd.Timestamp("2023-12-25") + pd.Timedelta(minutes=int(x)) for x in rng.integers(0, 300_000, 300)]
    left = pd.DataFrame({"symbol": rng.choice(["BIG", "MID", "NONE"], 700), "ts": ts, "id": range(700)})
    got = by_key(lk.asof_join(spark.createDataFrame(left), bars.withColumn("price", F.col("close")), ["price"], forward=forward, rows=16), "id")
    want = pd.merge_asof(left.astype({"ts": "datetime64[ns]"}).sort_values("ts"),
                         bars_pdf.astype({"ts": "datetime64[ns]"})[["symbol", "ts", "close"]].sort_values("ts"),
                         on="ts", by="symbol", direction="forward" if forward else "backward").sort_values("id").reset_index(drop=True)
    np.testing.assert_array_equal(got.price, want.close)
    holed = spark.createDataFrame(left).withColumn("ts", F.when(F.col("id") > 4, F.col("ts")))
    kept = lk.asof_join(holed, bars.withColumn("price", F.col("close")), ["price"], forward=forward)
    assert kept.count() == 700 and kept.filter("id <= 4 AND price IS NULL").count() == 5


def test_exact_quantiles_with_a_heavy_value(spark):
    df = spark.range(2_500_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 100_003).cast("double")).alias("x"), (F.col("id") % 2).alias("g"))
    got = {r.g: r for r in exact_quantiles(df, "x", [0.05, 0.5, 0.95], ["g"]).collect()}
    i = np.arange(2_500_000)
    x = np.where(i % 3 == 0, 7.0, (i * 7919 % 100_003).astype(float))
    for g in (0, 1):
        np.testing.assert_allclose([got[g].q_0, got[g].q_1, got[g].q_2], np.quantile(x[i % 2 == g], [0.05, 0.5, 0.95]))
    tail = lower_tail(df, "x", ["g"], 1.0 - 0.95).filter("g = 0").first()
    s = np.sort(x[i % 2 == 0])
    k = int((1.0 - 0.95) * len(s))
    assert tail.at_rank == s[k]
    assert tail.mean_before == pytest.approx(s[:k].mean())


def test_order_statistics_of_hard_groups(spark):
    rng = np.random.default_rng(4)
    groups = {
        "wide": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 500)), 10.0 ** rng.uniform(-300, 300, 500), [0.0, -0.0, np.inf, -np.inf]]),
        "close": 1.0 + rng.permutation(3000) * 2.0**-52, "ties": np.repeat([3.0, -2.0, 3.5], [700, 200, 100]), "constant": np.full(50, -7.25), "one": np.array([5.0]), None: np.arange(9.0),
    }
    df = spark.createDataFrame([(g, float(x)) for g, xs in groups.items() for x in xs] + [("empty", None), ("empty", float("nan"))], "g string, x double")
    ranks = lambda n: [F.lit(1), F.ceil(n / 3), F.ceil(n * 0.9), n]
    got = {r.g: r for r in order_statistics(df, "x", ranks, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        s = np.sort(xs)
        assert [got[g][f"v_{i}"] for i in range(4)] == [s[0], s[-(-len(s) // 3) - 1], s[int(np.ceil(len(s) * 0.9)) - 1], s[-1]]


def test_quantiles_of_a_whole_table_count_without_a_sketch(spark):
    df = spark.range(2_000_000).select((F.col("id") * 7919 % 2_000_003).cast("double").alias("x"))
    r = exact_quantiles(df, "x", [0.25, 0.75]).first()
    np.testing.assert_allclose([r.q_0, r.q_1], np.quantile(np.arange(2_000_000) * 7919 % 2_000_003, [0.25, 0.75]))
    plan = exact_quantiles(df, "x", [0.25, 0.75])._jdf.queryExecution().toString()
    assert "percentile" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    empty = exact_quantiles(df.limit(0), "x", [0.5]).collect()
    assert [x.q_0 for x in empty] == [None]


def test_quantiles_of_few_rows(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (None,), (float("nan"),)], "x double")
    r = exact_quantiles(df, "x", [0.25, 0.75]).first()
    assert (r.q_0, r.q_1) == (1.5, 3.0)
