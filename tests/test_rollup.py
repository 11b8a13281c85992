"""Bars from parts of their ticks, the surface from newest quotes, and figures taken while writing."""

from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import surface
from barloom.operators import validate as va
from barloom.sources import readers, rollup, writers
from barloom.streaming import jobs, observed


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(6)
    n = 3_000
    pdf = pd.DataFrame({"event_id": np.arange(n), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 8 * 24 * 60, n), unit="min"), "symbol": rng.choice(["A", "B"], n), "price": rng.normal(100, 5, n).round(2)})
    return spark.createDataFrame(pdf).cache()


def rows(df):
    return sorted(tuple(r) for r in df.select("ts", "symbol", *rollup.BAR).collect())


def test_bars_from_any_parts_equal_one_resample(spark, ticks, tmp_path):
    path, want = str(tmp_path / "bars"), rows(readers.resample_ohlcv(ticks, "1 hour", tie=("event_id",)))
    lots = [ticks.where(F.col("event_id") % 3 == k) for k in (2, 0, 1)]
    for k, lot in enumerate(lots):
        for _ in range(2 if k == 1 else 1):  # the second batch comes twice
            rollup.add_ticks(spark, path, lot, f"batch-{k}", tie=("event_id",))
    assert rows(rollup.read_bars(spark, path)) == want
    files = {p.name for p in (tmp_path / "bars").glob("date=2024-01-05/*.parquet")}
    rollup.add_ticks(spark, path, ticks.where("ts < TIMESTAMP '2024-01-02'").limit(5), "few", tie=("event_id",))
    assert {p.name for p in (tmp_path / "bars").glob("date=2024-01-05/*.parquet")} == files  # only touched days are written


def test_raw_days_go_once_they_are_rolled_up(spark, ticks, tmp_path, monkeypatch):
    raw, bars = str(tmp_path / "raw"), str(tmp_path / "bars")
    dated = ticks.withColumn("date", F.to_date("ts"))
    dated.where("event_id % 2 = 0").write.partitionBy("date").parquet(raw)


    real = rollup.add_ticks

    def then_die(*args, **kwargs):
        real(*args, **kwargs)
        raise RuntimeError("died")

    with monkeypatch.context() as m:  # after the bars are in and before the raw days are gone
        m.setattr(rollup, "add_ticks", then_die)
        with pytest.raises(RuntimeError):
            rollup.roll_up(spark, raw, bars, date(2024, 1, 8), 3, tie=("event_id",))
    assert rollup.roll_up(spark, raw, bars, date(2024, 1, 8), 3, tie=("event_id",)) == [f"date=2024-01-0{k}" for k in (1, 2, 3, 4)]
    assert sorted(writers.partitions_of(spark, raw)) == [f"date=2024-01-0{k}" for k in (5, 6, 7, 8)]
    dated.where("event_id % 2 = 1").write.mode("append").partitionBy("date").parquet(raw)  # late ticks, for days gone as well
    rollup.roll_up(spark, raw, bars, date(2100, 1, 1), 3, tie=("event_id",))
    assert rows(rollup.read_bars(spark, bars)) == rows(readers.resample_ohlcv(ticks, "1 hour", tie=("event_id",)))
    assert rollup.roll_up(spark, raw, bars, date(2100, 1, 1), 3) == [] and writers.partitions_of(spark, raw) == []


def test_monotone_interpolation():
    x, y = np.array([0.0, 1.0, 3.0, 4.0, 7.0]), np.array([1.0, 2.0, 2.0, 5.0, 4.0])
    at = np.linspace(-1, 8, 181)
    got = surface.monotone(x, y, at)
    assert np.isnan(got[(at < 0) | (at > 7)]).all() and np.allclose(surface.monotone(x, y, x), y)
    for a, b, lo, hi in zip(x, x[1:], np.minimum(y, np.roll(y, -1)), np.maximum(y, np.roll(y, -1))):
        inside = got[(at >= a) & (at <= b)]
        assert (inside >= lo - 1e-12).all() and (inside <= hi + 1e-12).all()
        assert (np.diff(inside) >= -1e-12).all() or (np.diff(inside) <= 1e-12).all()
    assert np.allclose(surface.monotone(np.array([0.0, 2.0]), np.array([1.0, 3.0]), np.array([0.5, 1.0])), [1.5, 2.0])


def test_surface_takes_newest_quotes_and_fills_gaps(spark):
    day = lambda k: pd.Timestamp("2024-01-01") + pd.Timedelta(days=k)
    data = []
    for strike in (100.0, 110.0, 120.0, 130.0):
        for k, expiry in enumerate((20, 50, 80)):
            if (strike, expiry) not in ((110.0, 20), (120.0, 50), (130.0, 20), (100.0, 80)):
                data.append((f"{strike}-{expiry}", "S", strike, day(expiry).date(), day(-3), 9.0))
                data.append((f"{strike}-{expiry}", "S", strike, day(expiry).date(), day(0), 0.2 + strike / 1000 + k / 10))
    data += [("gone", "S", 100.0, day(-1).date(), day(-2), 5.0), ("later", "S", 140.0, day(20).date(), day(3), 5.0), ("none", "S", 100.0, day(20).date(), day(0), None)]
    quotes = spark.createDataFrame([(a, b, c, e, t.to_pydatetime(), iv) for a, b, c, e, t, iv in data], "options_ticker string, symbol string, strike double, expiration date, ts timestamp, implied_volatility double")
    got = {(r.strike_bucket, r.days_bucket): r for r in surface.latest_surface(quotes, "2024-01-01 00:00:00").collect()}
    assert {k for k, r in got.items() if r.filled == "observed"} == {(s, d) for s in (100.0, 110.0, 120.0, 130.0) for d in (0, 30, 60)} - {(110.0, 0), (120.0, 30), (130.0, 0), (100.0, 60)}
    assert got[100.0, 30].implied_volatility == pytest.approx(0.4) and got[100.0, 30].quotes == 1
    assert got[110.0, 0].filled == "strike" and got[110.0, 0].implied_volatility == pytest.approx(0.31)  # half way between 100 and 120
    want = surface.monotone(np.array([100.0, 110.0, 130.0]), np.array([0.4, 0.41, 0.43]), np.array([120.0]))[0]
    assert got[120.0, 30].filled == "strike" and got[120.0, 30].implied_volatility == pytest.approx(want)
    assert (130.0, 0) not in got and (100.0, 60) not in got and len(got) == 10  # beyond what is known
    assert surface.latest_surface(quotes.limit(0), "2024-01-01 00:00:00").count() == 0


def test_gaps_that_strikes_leave_are_filled_along_expiries():
    cells = pd.DataFrame({"symbol": "S", "strike_bucket": [100.0, 110.0, 100.0, 110.0, 110.0], "days_bucket": [0, 0, 60, 60, 30], "implied_volatility": [0.2, 0.3, 0.4, 0.5, 0.45], "quotes": 1})
    got = surface._fill(cells).set_index(["strike_bucket", "days_bucket"])
    assert got.loc[(100.0, 30), "filled"] == "expiry" and got.loc[(100.0, 30), "implied_volatility"] == pytest.approx(0.3) and len(got) == 6


def test_figures_of_the_pass_that_writes(spark, bars, tmp_path):
    bad = bars.withColumn("low", F.when(F.hour("ts") == 3, F.col("high") + 1).otherwise(F.col("low")))
    want = va.validation_summary(bad, "price").first().asDict()
    found = observed.write_validated(bad, "price", str(tmp_path / "out"), ts="ts")
    assert {k: found[k] for k in want} == pytest.approx(want) and found["first_ts"] == bars.agg(F.min("ts")).first()[0]
    stored = spark.read.parquet(str(tmp_path / "out")).withColumn("is_valid", F.col("is_valid").cast("boolean"))
    assert stored.where("is_valid").count() == want["valid"] and stored.where("NOT is_valid AND size(errors) > 0").count() == want["invalid"]

    bad.repartition(3).write.parquet(f"{tmp_path}/in")
    listener = observed.ValidationListener()
    spark.streams.addListener(listener)
    try:
        live = spark.readStream.schema(bad.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.finish(observed.observed_stream(live, "price").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start())
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert len(listener.batches) == 3 and {k: listener.summary()[k] for k in want} == pytest.approx(want)
    finally:
        spark.streams.removeListener(listener)
