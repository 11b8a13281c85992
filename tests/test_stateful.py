"""Stateful indicators: any cut, order within the delay, restart and stored start give the batch numbers."""

import numpy as np
import pandas as pd
import pytest
from helpers import by_key
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.streaming import jobs, state

SCHEMA = "ts timestamp, symbol string, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="module")
def gapped():
    """Three symbols with missing closes at the start, in runs and at the end."""
    rng = np.random.default_rng(11)
    frames = []
    for symbol, n in (("A", 90), ("B", 40), ("C", 7)):
        close = 100 + rng.normal(0, 1, n).cumsum()
        pdf = pd.DataFrame({"ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), "symbol": symbol, "open": close, "high": close + 1, "low": close - 1, "close": close, "volume": rng.integers(1, 9, n)})
        pdf.loc[rng.random(n) < 0.2, "close"] = np.nan
        pdf.loc[pdf.index[10:16], "close"] = np.nan
        pdf.loc[pdf.index[-2:], "close"] = np.nan
        frames.append(pdf)
    frames[1].loc[frames[1].index[:3], "close"] = np.nan
    return pd.concat(frames, ignore_index=True)


def table(spark, pdf):
    plain = lambda v: None if v is None or v is pd.NaT or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v
    rows = [tuple(map(plain, r)) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA)


def batch(spark, pdf):
    bars = table(spark, pdf)
    want = ind.indicator_set(bars).join(ind.macd_ema(bars).select("ts", "symbol", F.col("macd").alias("macd_ema"), F.col("macd_signal").alias("macd_ema_signal")), ["ts", "symbol"])
    return by_key(want, "symbol", "ts")


def same(got, want):
    assert len(got) == len(want) and (got.ts == want.ts).all()
    for c in state.INDICATOR_FIELDS:
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1e-7, err_msg=c)


def run(spark, slices, root, live=None, **options):
    """One job per slice, each going on from the checkpoint of the one before."""
    for k, pdf in enumerate(slices):
        table(spark, pdf).coalesce(1).write.mode("append").parquet(f"{root}/in")
        made = state.streaming_indicators(spark.readStream.schema(SCHEMA).parquet(f"{root}/in"), **options)
        jobs.finish(made.writeStream.format("parquet").option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start(f"{root}/out"))
    return by_key(spark.read.schema(made.schema).parquet(f"{root}/out"), "symbol", "ts")


def test_gaps_across_micro_batches_equal_batch(spark, gapped, tmp_path):
    edges = [pd.Timestamp(t) for t in ("2024-01-01", "2024-01-01 13:00", "2024-01-03", "2030-01-01")]
    slices = [gapped[(gapped.ts >= a) & (gapped.ts < b)] for a, b in zip(edges, edges[1:])]
    same(run(spark, slices, tmp_path), batch(spark, gapped))


class Held:
    """State without a stream."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update


def test_any_cut_equals_one_run(gapped):
    one = gapped[gapped.symbol == "A"].reset_index(drop=True)

    def through(cuts):
        processor, out = state.IndicatorProcessor(), []
        processor.bars, processor.means = Held(), Held()
        for a, b in zip([0, *cuts], [*cuts, len(one)]):
            out += list(processor.handleInputRows(("A",), iter([one[a:b]]), None)) if b > a else []
        return pd.concat(out, ignore_index=True)

    want = through([])
    for cut in range(1, len(one)):
        pd.testing.assert_frame_equal(through([cut]), want, atol=1e-9)
    pd.testing.assert_frame_equal(through(list(range(1, len(one)))), want, atol=1e-9)


def test_rows_without_time_or_symbol_leave_no_trace(spark, gapped, tmp_path):
    odd = pd.DataFrame({"ts": [None, pd.Timestamp("2024-01-01 05:00")], "symbol": ["A", None], "open": 1.0, "high": 1.0, "low": 1.0, "close": 5_000.0, "volume": 1})
    first, second = gapped[gapped.ts < "2024-01-02"], gapped[gapped.ts >= "2024-01-02"]
    got = run(spark, [pd.concat([odd, first]), pd.concat([second, odd])], tmp_path)
    nowhere = got.ts.isna() | got.symbol.isna()
    assert nowhere.sum() == 4 and got[nowhere][list(state.INDICATOR_FIELDS)].isna().all().all() and not got.late.any()
    same(got[~nowhere].reset_index(drop=True), batch(spark, gapped))


def test_bars_out_of_order_within_the_delay_equal_batch(spark, gapped, tmp_path):
    """Rows arrive up to five hours late, in three jobs; a far bar of another symbol lets the watermark pass all."""
    rng = np.random.default_rng(2)
    arrival = gapped.ts + pd.to_timedelta(rng.integers(0, 5, len(gapped)), unit="h")
    mixed = gapped.iloc[np.lexsort((rng.random(len(gapped)), arrival))]
    edges = [pd.Timestamp(t) for t in ("2024-01-01", "2024-01-02", "2024-01-03 12:00", "2030-01-01")]
    when = arrival.loc[mixed.index]
    slices = [mixed[(when >= a) & (when < b)] for a, b in zip(edges, edges[1:])]
    far = gapped.head(1).assign(symbol="far", ts=pd.Timestamp("2025-01-01"))
    again = mixed[mixed.symbol == "A"].tail(1)
    got = run(spark, [slices[0], slices[1], pd.concat([slices[2], again]), far], tmp_path, delay="6 hours")
    assert got.late.sum() == 1
    same(got[~got.late & (got.symbol != "far")].reset_index(drop=True), batch(spark, gapped))


def test_new_query_goes_on_from_a_stored_table(spark, gapped, tmp_path):
    old, new = gapped[gapped.ts < "2024-01-01 15:00"], gapped[gapped.ts >= "2024-01-01 15:00"]
    stored = state.stored_state(table(spark, old))
    got = run(spark, [new], tmp_path, stored=stored)
    want = batch(spark, gapped)
    same(got, want[want.ts >= "2024-01-01 15:00"].reset_index(drop=True))
