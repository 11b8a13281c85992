"""Indicators on a live bar stream, with the same numbers as the batch operators.

Row-count windows do not exist on streams, so each symbol keeps its last bars and its
exponential means as state.  A symbol's bars of one micro-batch form one group; the
source's rate limit (maxFilesPerTrigger, maxOffsetsPerTrigger) bounds it.

Without a delay, bars are taken in the order of their micro-batches, and one that comes after a newer one is set aside.
With a delay, bars wait in state until the watermark has passed them and are then taken in time order.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.indicators import _continued, ema
from barloom.operators.lookup import last_n
from barloom.shipping import ship

ship(__name__)

HISTORY = 50
BAR_FIELDS = ("open", "high", "low", "close", "volume")
EMA_SPANS = {"e12": 12, "e26": 26, "e9": 9}

INDICATOR_FIELDS = (
    "sma_5", "sma_10", "sma_20", "sma_50", "return_1d", "return_5d", "return_20d", "volatility_20d",
    "volume_sma_20", "volume_ratio", "rsi", "bb_middle", "bb_std", "bb_upper", "bb_lower", "bb_width",
    "bb_position", "macd", "macd_signal", "macd_histogram", "macd_ema", "macd_ema_signal",
)

OUTPUT = T.StructType(
    [T.StructField("ts", T.TimestampType()), T.StructField("symbol", T.StringType())]
    + [T.StructField(c, T.LongType() if c == "volume" else T.DoubleType()) for c in BAR_FIELDS]
    + [T.StructField(c, T.DoubleType()) for c in INDICATOR_FIELDS]
    + [T.StructField("late", T.BooleanType())]
)

BARS_STATE = T.StructType(
    [T.StructField("ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_FIELDS]
)
#: The means, and the bars without a close since the last one with it, which the next mean has to know.
EMA_STATE = T.StructType([*(T.StructField(c, T.DoubleType()) for c in EMA_SPANS), T.StructField("gap", T.LongType())])


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return (a / b).where(b != 0)


def rolling_columns(bars: pd.DataFrame) -> pd.DataFrame:
    """The batch indicator set over an ordered run of bars."""
    def mean(x, n):
        return x.rolling(n, min_periods=1).mean()

    close, volume = bars["close"], bars["volume"].astype(float)
    out = {f"sma_{n}": mean(close, n) for n in (5, 10, 20, 50)}
    out |= {f"return_{k}d": _ratio(close, close.shift(k)) - 1.0 for k in (1, 5, 20)}
    out["volatility_20d"] = out["return_1d"].rolling(20, min_periods=2).std()
    out["volume_sma_20"] = mean(volume, 20)
    out["volume_ratio"] = _ratio(volume, out["volume_sma_20"])
    change = close.diff()
    gain, loss = change.clip(lower=0).fillna(0.0), (-change).clip(lower=0).fillna(0.0)
    out["rsi"] = 100.0 - 100.0 / (1.0 + mean(gain, 14) / (mean(loss, 14) + 1e-6))
    out["bb_middle"], out["bb_std"] = mean(close, 20), close.rolling(20, min_periods=2).std()
    out["bb_upper"] = out["bb_middle"] + 2.0 * out["bb_std"]
    out["bb_lower"] = out["bb_middle"] - 2.0 * out["bb_std"]
    out["bb_width"] = out["bb_upper"] - out["bb_lower"]
    out["bb_position"] = _ratio(close - out["bb_lower"], out["bb_width"])
    out["macd"] = mean(close, 12) - mean(close, 26)
    out["macd_signal"] = mean(out["macd"], 9)
    out["macd_histogram"] = out["macd"] - out["macd_signal"]
    return pd.DataFrame(out)


def _plain(bars: pd.DataFrame, late: bool) -> pd.DataFrame:
    """Bars without indicators."""
    return bars.assign(**{c: np.nan for c in INDICATOR_FIELDS}, late=late)[OUTPUT.names]


class IndicatorProcessor(StatefulProcessor):
    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", BARS_STATE, self.ttl_ms)
        self.means = handle.getValueState("means", EMA_STATE, self.ttl_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Go on from a row set of ``stored_state``."""
        last = initialState.dropna(subset=["ts"]).sort_values("ts").tail(HISTORY)
        if len(last):
            self._keep(last)
            self.means.update((*(float(last[c].iloc[-1]) for c in EMA_SPANS), int(last["gap"].iloc[-1])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values("ts", kind="stable")
        # Rows of no series get no indicators, as in the batch operators, and leave no trace.
        nowhere = new["ts"].isna() | (key[0] is None)
        if nowhere.any():
            yield _plain(new[nowhere], False)
        yield from self._timed(key, new[~nowhere], timerValues)

    def _timed(self, key, new: pd.DataFrame, timerValues) -> Iterator[pd.DataFrame]:
        yield from self._take(key, new)

    def _past(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.bars.get()) if self.bars.exists() else [], columns=["ts", *BAR_FIELDS])

    def _keep(self, bars: pd.DataFrame) -> None:
        self.bars.put([(r.ts.to_pydatetime(), *(float(getattr(r, c)) for c in BAR_FIELDS)) for r in bars.itertuples()])

    def _take(self, key, new: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Bars in time order.  What was emitted cannot be revised: one not newer than the last is set aside."""
        past = self._past()
        late = new["ts"] <= pd.Timestamp(past["ts"].iloc[-1]) if len(past) else pd.Series(False, index=new.index)
        late = late | new["ts"].duplicated()
        fresh, aside = new[~late], new[late]
        if len(fresh):
            yield self._advance(key, past, fresh)
        if len(aside):
            yield _plain(aside, True)

    def _advance(self, key, past: pd.DataFrame, fresh: pd.DataFrame) -> pd.DataFrame:
        columns = ["ts", *BAR_FIELDS]
        run = pd.concat([past, fresh[columns]], ignore_index=True) if len(past) else fresh[columns].reset_index(drop=True)
        values = rolling_columns(run).iloc[len(past):]
        close = fresh["close"].to_numpy(dtype=float)
        e12, e26, e9, gap = self.means.get() if self.means.exists() else (np.nan, np.nan, np.nan, 0)
        fast, slow = _continued(close, 12, e12, gap), _continued(close, 26, e26, gap)
        signal = _continued(fast - slow, 9, e9, 0)  # the line goes on where a close is missing
        seen = np.flatnonzero(~np.isnan(close))
        gap = len(close) - 1 - int(seen[-1]) if len(seen) else gap + len(close)
        self.means.update((float(fast[-1]), float(slow[-1]), float(signal[-1]), gap))
        self._keep(run.tail(HISTORY))
        out = fresh[columns].reset_index(drop=True).assign(symbol=key[0], late=False)
        out = pd.concat([out, values.reset_index(drop=True)], axis=1)
        out["macd_ema"], out["macd_ema_signal"] = fast - slow, signal
        return out[OUTPUT.names]

    def close(self) -> None:
        pass


class OrderedIndicatorProcessor(IndicatorProcessor):
    """Bars wait until the watermark has passed them; a timer stands at the earliest that waits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "micros long", BARS_STATE)

    def _timed(self, key, new: pd.DataFrame, timerValues) -> Iterator[pd.DataFrame]:
        repeated = []
        for r in new.itertuples():
            at = (r.ts.value // 1_000,)
            if self.waiting.containsKey(at):  # the first bar of a time counts
                repeated.append(r.Index)
            else:
                self.waiting.updateValue(at, (r.ts.to_pydatetime(), *(float(getattr(r, c)) for c in BAR_FIELDS)))
        if repeated:
            yield _plain(new.loc[repeated], True)
        if len(new):
            self.handle.registerTimer(-(-(new["ts"].min().value // 1_000) // 1_000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1_000
        times = sorted(k[0] for k in self.waiting.keys())
        due = [t for t in times if t <= passed]
        if due:
            ready = pd.DataFrame([self.waiting.getValue((t,)) for t in due], columns=["ts", *BAR_FIELDS]).assign(symbol=key[0])
            for t in due:
                self.waiting.removeKey((t,))
            yield from self._take(key, ready)
        if len(times) > len(due):
            self.handle.registerTimer(-(-times[len(due)] // 1_000))


def stored_state(bars: DataFrame, **ordering) -> DataFrame:
    """What the processor would hold after the given bars: the last bars per symbol with the means at the end."""
    bars = bars.select("ts", "symbol", *[F.col(c).cast("double").alias(c) for c in BAR_FIELDS]).dropna(subset=["ts", "symbol"])
    means = ema(bars, "close", (12, 26), ("e12", "e26"), **ordering).withColumn("_line", F.col("e12") - F.col("e26"))
    means = ema(means, "_line", (9,), ("e9",), **ordering)
    valued = F.col("close").isNotNull() & ~F.isnan("close")
    last_value = bars.groupBy("symbol").agg(F.max(F.when(valued, F.col("ts"))).alias("_at"))
    since = F.when(F.col("_at").isNull() | (F.col("ts") > F.col("_at")), 1)
    gaps = bars.join(last_value, "symbol").groupBy("symbol").agg(F.count(since).alias("gap"))
    return last_n(means, HISTORY).join(gaps, "symbol").select("ts", "symbol", *BAR_FIELDS, *EMA_SPANS, "gap")


class NewestRow(StatefulProcessor):
    """Keeps the newest row of a key and gives it out when the key first appears and then once per interval, rows or no rows."""

    def __init__(self, schema: T.StructType, ts: str, every_ms: int):
        self.schema, self.ts, self.every_ms = schema, ts, every_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def _out(self, at_ms: int) -> pd.DataFrame:
        row = pd.DataFrame([tuple(self.newest.get())], columns=self.schema.names)
        return row.assign(cycle=pd.Timestamp(at_ms, unit="ms"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at = self.schema.names.index(self.ts)
        new = pd.concat(list(rows)).dropna(subset=[self.ts]).sort_values(self.ts, kind="stable")
        if key[0] is None or not len(new):
            return
        first = not self.newest.exists()
        last = tuple(_plain_value(new[c].iloc[-1]) for c in self.schema.names)
        if first or last[at] >= self.newest.get()[at].replace(tzinfo=None):
            self.newest.update(last)
        if first:
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.every_ms)
            yield self._out(now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()
        # Intervals missed while the job was down are not made up for.
        self.handle.registerTimer(due + self.every_ms * (1 + max(0, now - due) // self.every_ms))
        yield self._out(due)

    def close(self) -> None:
        pass


def _plain_value(v):
    if v is None or v is pd.NaT or v != v:
        return None
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if isinstance(v, np.generic) else v


def newest_every(rows: DataFrame, every: timedelta, by: str = "symbol", ts: str = "ts") -> DataFrame:
    """The newest row per key of a stream, with the time of the ``cycle``: at once for a new key, then every interval by a processing-time timer.

    A key that falls silent goes on being given out.  Among rows of the same time the last to come counts; rows without key or time are left out.
    """
    if "cycle" in rows.columns:
        raise ValueError("a column named cycle is in the way")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields])
    out = T.StructType([*schema.fields, T.StructField("cycle", T.TimestampType())])
    processor = NewestRow(schema, ts, int(every.total_seconds() * 1_000))
    return rows.groupBy(by).transformWithStateInPandas(processor, out, "Append", "ProcessingTime")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_indicators(bars: DataFrame, delay: str | None = None, stored: DataFrame | None = None, ttl: timedelta | None = None) -> DataFrame:
    """Indicators of a stream of bars; needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider.

    ``delay``: bars may come in any order within it, are taken in time order once the watermark has passed them, and are dropped
    if they come later still.  ``stored``: a table of ``stored_state`` from which a new query goes on.  ``ttl``: a symbol
    without bars for so long (processing time) is forgotten; not together with ``delay``, whose timers follow event time.
    Rows without a time or symbol come out without indicators and leave no trace in the state.
    """
    if delay and ttl:
        raise ValueError("state that waits for the watermark cannot expire by processing time")
    rows = bars.select("ts", "symbol", *BAR_FIELDS)
    rows = rows.withWatermark("ts", delay) if delay else rows
    processor = OrderedIndicatorProcessor() if delay else IndicatorProcessor(int(ttl.total_seconds() * 1_000) if ttl else None)
    mode = "EventTime" if delay else "ProcessingTime" if ttl else "None"
    start = stored.groupBy("symbol") if stored is not None else None
    made = rows.groupBy("symbol").transformWithStateInPandas(processor, OUTPUT, "Append", mode, start)
    return made.withColumn("date", F.to_date("ts"))
