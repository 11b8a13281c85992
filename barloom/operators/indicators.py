"""Technical indicators over bars.

A *layer* takes a DataFrame and a window specification and appends columns; the
public operators run one layer over chunked series (see ``ordered``).  Layers
compose, so a whole indicator set costs one shuffle.

``min_periods`` is 1 for means from the first row on, or the window length for
null until the window is full.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import ordered as o
from barloom.shipping import ship

ship(__name__)


def _full(value: Column, column: str, frame, min_periods: int) -> Column:
    if min_periods <= 1:
        return value
    return F.when(F.count(column).over(frame) >= min_periods, value)


def rolling_mean(column: str, n: int, w, min_periods: int = 1) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return _full(F.avg(column).over(frame), column, frame, min_periods)


def rolling_std(column: str, n: int, w, min_periods: int = 1) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return _full(F.stddev_samp(column).over(frame), column, frame, min_periods)


def change_ratio(column: str, k: int, w) -> Column:
    return F.try_divide(F.col(column), F.lag(column, k).over(w)) - 1.0


# --- layers -----------------------------------------------------------------


def row_num_layer():
    return lambda df, w: df.withColumn("row_num", o.position(w))


def sma_layer(periods=(5, 10, 20, 50), column="close", min_periods=1, prefix="sma_"):
    def layer(df, w):
        return df.withColumns(
            {f"{prefix}{n}": rolling_mean(column, n, w, n if min_periods != 1 else 1) for n in periods}
        )

    return layer


def returns_layer(periods=(1, 5, 20), column="close"):
    return lambda df, w: df.withColumns({f"return_{k}d": change_ratio(column, k, w) for k in periods})


def volatility_layer(n=20, min_periods=1, column="close"):
    def layer(df, w):
        with_return = df.withColumn("_r1", change_ratio(column, 1, w))
        return with_return.withColumn(f"volatility_{n}d", rolling_std("_r1", n, w, min_periods)).drop("_r1")

    return layer


def close_std_layer(n=20, min_periods=1, column="close"):
    return lambda df, w: df.withColumn(f"close_std_{n}", rolling_std(column, n, w, min_periods))


def volume_layer(n=20, min_periods=1):
    def layer(df, w):
        mean = df.withColumn(f"volume_sma_{n}", rolling_mean("volume", n, w, min_periods))
        return mean.withColumn(
            "volume_ratio", F.try_divide(F.col("volume").cast("double"), F.col(f"volume_sma_{n}"))
        )

    return layer


def gain_loss_layer(column="close"):
    def layer(df, w):
        change = F.col("price_change")
        return df.withColumn("price_change", F.col(column) - F.lag(column).over(w)).withColumns(
            {
                "gain": F.when(change > 0, change).otherwise(0.0),
                "loss": F.when(change < 0, -change).otherwise(0.0),
            }
        )

    return layer


def rsi_layer(period=14, epsilon=1e-6, min_periods=1, out="rsi", column="close"):
    """Simple-average RSI.  With epsilon 0: no loss gives 100, neither gain nor loss gives null."""

    def layer(df, w):
        moved = gain_loss_layer(column)(df, w).withColumns(
            {
                "_gain": rolling_mean("gain", period, w, min_periods),
                "_loss": rolling_mean("loss", period, w, min_periods),
            }
        )
        gain, loss = F.col("_gain"), F.col("_loss")
        if epsilon:
            value = 100.0 - 100.0 / (1.0 + gain / (loss + epsilon))
        else:
            value = F.when((loss == 0) & (gain > 0), 100.0).when(
                loss > 0, 100.0 - 100.0 / (1.0 + F.try_divide(gain, loss))
            )
        return moved.withColumn(out, value).drop("_gain", "_loss", "price_change", "gain", "loss")

    return layer


def bollinger_layer(period=20, k=2.0, min_periods=1, column="close"):
    def layer(df, w):
        banded = df.withColumns(
            {
                "bb_middle": rolling_mean(column, period, w, min_periods),
                "bb_std": rolling_std(column, period, w, min_periods),
            }
        )
        return (
            banded.withColumns(
                {
                    "bb_upper": F.col("bb_middle") + F.col("bb_std") * k,
                    "bb_lower": F.col("bb_middle") - F.col("bb_std") * k,
                }
            )
            .withColumn("bb_width", F.col("bb_upper") - F.col("bb_lower"))
            .withColumn(
                "bb_position", F.try_divide(F.col(column) - F.col("bb_lower"), F.col("bb_width"))
            )
        )

    return layer


def macd_sma_layer(fast=12, slow=26, signal=9, column="close"):
    def layer(df, w):
        line = df.withColumn("macd", rolling_mean(column, fast, w) - rolling_mean(column, slow, w))
        return line.withColumn("macd_signal", rolling_mean("macd", signal, w)).withColumn(
            "macd_histogram", F.col("macd") - F.col("macd_signal")
        )

    return layer


def change_layer(column="close"):
    def layer(df, w):
        return df.withColumn("prev_close", F.lag(column).over(w)).withColumns(
            {
                "change": F.col(column) - F.col("prev_close"),
                "change_pct": (F.try_divide(F.col(column), F.col("prev_close")) - 1.0) * 100.0,
            }
        )

    return layer


def change_from_layer(rows_back=24, column="close"):
    """Change against the ``rows_back``-th row from the end, or the first row if there are fewer."""

    def layer(df, w):
        base = F.coalesce(
            F.lag(column, rows_back - 1).over(w),
            F.first(column).over(w.rowsBetween(-(rows_back - 1), 0)),
        )
        return df.withColumn("base_close", base).withColumns(
            {
                "change": F.col(column) - F.col("base_close"),
                "change_pct": (F.try_divide(F.col(column), F.col("base_close")) - 1.0) * 100.0,
            }
        )

    return layer


def atr_layer(n=14):
    def layer(df, w):
        prev = F.lag("close").over(w)
        true_range = F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        )
        return df.withColumn("_tr", true_range).withColumn(f"atr_{n}", rolling_mean("_tr", n, w)).drop("_tr")

    return layer


def stochastic_layer(k=14, d=3):
    def layer(df, w):
        frame = w.rowsBetween(-(k - 1), 0)
        low, high = F.min("low").over(frame), F.max("high").over(frame)
        return df.withColumn(
            "stoch_k", F.try_divide(F.col("close") - low, high - low) * 100.0
        ).withColumn("stoch_d", rolling_mean("stoch_k", d, w))

    return layer


# --- operators --------------------------------------------------------------


def row_num(df: DataFrame, **ordering) -> DataFrame:
    return o.ordered(df, row_num_layer(), **ordering)


def sma(df, periods=(5, 10, 20, 50), column="close", min_periods=1, **ordering) -> DataFrame:
    """min_periods=1: partial frames count; anything else: null until the window is full."""
    return o.ordered(df, sma_layer(periods, column, min_periods), back=max(periods) - 1, **ordering)


def returns(df, periods=(1, 5, 20), column="close", **ordering) -> DataFrame:
    return o.ordered(df, returns_layer(periods, column), back=max(periods), **ordering)


def volatility(df, n=20, min_periods=1, **ordering) -> DataFrame:
    return o.ordered(df, volatility_layer(n, min_periods), back=n, **ordering)


def close_std(df, n=20, min_periods=1, **ordering) -> DataFrame:
    return o.ordered(df, close_std_layer(n, min_periods), back=n - 1, **ordering)


def volume_stats(df, n=20, min_periods=1, **ordering) -> DataFrame:
    return o.ordered(df, volume_layer(n, min_periods), back=n - 1, **ordering)


def gain_loss(df, **ordering) -> DataFrame:
    return o.ordered(df, gain_loss_layer(), back=1, **ordering)


def rsi(df, period=14, epsilon=1e-6, min_periods=1, out="rsi", **ordering) -> DataFrame:
    return o.ordered(df, rsi_layer(period, epsilon, min_periods, out), back=period, **ordering)


def bollinger(df, period=20, k=2.0, min_periods=1, **ordering) -> DataFrame:
    return o.ordered(df, bollinger_layer(period, k, min_periods), back=period - 1, **ordering)


def macd_sma(df, fast=12, slow=26, signal=9, **ordering) -> DataFrame:
    return o.ordered(df, macd_sma_layer(fast, slow, signal), back=slow + signal - 2, **ordering)


def previous_change(df, **ordering) -> DataFrame:
    return o.ordered(df, change_layer(), back=1, **ordering)


def change_from(df, rows_back=24, **ordering) -> DataFrame:
    return o.ordered(df, change_from_layer(rows_back), back=rows_back - 1, **ordering)


def atr(df, n=14, **ordering) -> DataFrame:
    return o.ordered(df, atr_layer(n), back=n, **ordering)


def stochastic(df, k=14, d=3, **ordering) -> DataFrame:
    return o.ordered(df, stochastic_layer(k, d), back=k + d - 2, **ordering)


def indicator_reach(periods=(5, 10, 20, 50)) -> int:
    """Rows that the widest of the layers below looks back: a mean, or the nine-row mean of a 26-row one."""
    return max(*periods, 20 + 1, 26 + 9)


def indicator_layers(min_periods=1, epsilon=1e-6, periods=(5, 10, 20, 50)):
    """The feature job's columns as one composed layer."""
    steps = [
        sma_layer(periods, min_periods=min_periods),
        returns_layer(),
        volatility_layer(20, 20 if min_periods != 1 else 1),
        volume_layer(20, 20 if min_periods != 1 else 1),
        rsi_layer(14, epsilon, 14 if min_periods != 1 else 1),
        bollinger_layer(20, 2.0, 20 if min_periods != 1 else 1),
        macd_sma_layer(),
    ]

    def layer(df, w):
        for step in steps:
            df = step(df, w)
        return df

    return layer


def indicator_set(df, min_periods=1, epsilon=1e-6, periods=(5, 10, 20, 50), **ordering) -> DataFrame:
    full = o.ordered(df, indicator_layers(min_periods, epsilon, periods), back=indicator_reach(periods), **ordering)
    return price_range(full)


def price_range(df: DataFrame) -> DataFrame:
    width = F.col("high") - F.col("low")
    return df.withColumns(
        {"price_range": width, "price_range_pct": F.try_divide(width, F.col("close"))}
    )


def rsi_zone(df: DataFrame, rsi_col="rsi") -> DataFrame:
    x = F.col(rsi_col)
    zone = F.when(x < 30, "oversold").when(x > 70, "overbought").when(x.isNotNull(), "neutral")
    return df.withColumn("rsi_zone", zone)


def bar_direction(df: DataFrame) -> DataFrame:
    return df.withColumn("direction", F.when(F.col("close") < F.col("open"), "down").otherwise("up"))


# --- exponential means ------------------------------------------------------


# The recursion  mean' = (o * mean + alpha * x) / (o + alpha),  o = (1 - alpha) ** (nulls before x + 1),  is affine in
# the mean.  A time slot therefore comes down to a few numbers, which are chained per series; every chunk then
# starts from the exact mean before it.  Nulls carry the mean on, as pandas' ``ewm(adjust=False)`` does.


def _continued(values: np.ndarray, span: int, start: float, gap: int) -> np.ndarray:
    """Means of ``values`` after a mean ``start`` that ``gap`` nulls followed."""
    forgotten = math.ceil(-750.0 / math.log1p(-2.0 / (span + 1.0)))  # the old mean's weight is 0 by then
    before = np.concatenate(([start], np.full(min(gap, forgotten), np.nan))) if start == start else np.zeros(0)
    return pd.Series(np.concatenate((before, values))).ewm(span=span, adjust=False).mean().to_numpy()[len(before):]


def _slot_parts(values: Column, spans, signal: int | None) -> Column:
    """What a slot (its values in time order) does to the means: ``lead`` nulls, a first value, then mean -> a * mean + b, ``trail`` nulls.

    With ``signal``, the mean of the line between the two spans goes along: after the first value it becomes
    p * signal + qa * mean of the first span + qb * mean of the second + r.
    """
    number = lambda x: F.lit(x).cast("double")
    start = F.struct(
        F.lit(0).cast("long").alias("lead"), F.lit(0).cast("long").alias("trail"), F.lit(None).cast("double").alias("first"),
        *[number(float(k == "a")).alias(f"{k}{s}") for s in spans for k in "ab"], *[number(float(k == "p")).alias(k) for k in ("p", "qa", "qb", "r")],
    )

    def step(acc: Column, x: Column) -> Column:
        new = acc["first"].isNull()
        same = x.isNull() | new
        means = {}
        for s in spans:
            alpha = 2.0 / (s + 1.0)
            old = F.pow(F.lit(1.0 - alpha), acc["trail"] + 1)
            means[f"a{s}"] = F.when(same, acc[f"a{s}"]).otherwise(acc[f"a{s}"] * old / (old + alpha))
            means[f"b{s}"] = F.when(same, acc[f"b{s}"]).otherwise((old * acc[f"b{s}"] + alpha * x) / (old + alpha))
        line = {k: acc[k] for k in ("p", "qa", "qb", "r")}
        if signal:
            c, (one, two) = 2.0 / (signal + 1.0), spans
            moved = {
                "p": (1 - c) * acc["p"], "qa": (1 - c) * acc["qa"] + c * means[f"a{one}"], "qb": (1 - c) * acc["qb"] - c * means[f"a{two}"],
                "r": (1 - c) * acc["r"] + c * (means[f"b{one}"] - means[f"b{two}"]),
            }
            line = {k: F.when(new, acc[k]).otherwise(m) for k, m in moved.items()}  # the line goes on over nulls
        return F.struct(
            (acc["lead"] + F.when(x.isNull() & new, 1).otherwise(0)).cast("long").alias("lead"),
            F.when(x.isNull(), acc["trail"] + 1).otherwise(0).cast("long").alias("trail"), F.coalesce(acc["first"], x).alias("first"),
            *[m.alias(k) for k, m in means.items()], *[m.alias(k) for k, m in line.items()],
        )

    return F.aggregate(values, start, step)


def _chained(table: DataFrame, spans, signal: int | None, by) -> DataFrame:
    """The slot table with the means before every slot (``_m<span>``, ``_signal``) and the nulls since the last value (``_gap``)."""
    kept = [f for f in table.schema.fields if f.name != "_rows"]
    schema = T.StructType([*kept, T.StructField("_gap", T.LongType()), *(T.StructField(f"_m{s}", T.DoubleType()) for s in spans), T.StructField("_signal", T.DoubleType())])
    names = [f.name for f in kept]
    parts = table.select(*names, _slot_parts(F.transform("_rows", lambda r: r["_x"]), spans, signal).alias("_part")).select(*names, "_part.*")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(o._SLOT)
        mean, line, gap, out = dict.fromkeys(spans, math.nan), math.nan, 0, []
        c = 2.0 / (signal + 1.0) if signal else 0.0
        for r in pdf.to_dict("records"):
            out.append([*(r[n] for n in names), gap, *(mean[s] for s in spans), line])
            height = mean[spans[0]] - mean[spans[-1]]
            if pd.isna(r["first"]):
                line = height + (1 - c) ** r["trail"] * (line - height)
                gap += r["trail"]
                continue
            line = height + (1 - c) ** r["lead"] * (line - height)
            firsts = []
            for s in spans:
                alpha = 2.0 / (s + 1.0)
                old = (1.0 - alpha) ** (gap + r["lead"] + 1)
                first = r["first"] if mean[s] != mean[s] else (old * mean[s] + alpha * r["first"]) / (old + alpha)
                firsts.append(first)
                mean[s] = r[f"a{s}"] * first + r[f"b{s}"]
            height = firsts[0] - firsts[-1]
            line = height if line != line else (1 - c) * line + c * height
            line = r["p"] * line + r["qa"] * firsts[0] + r["qb"] * firsts[-1] + r["r"]
            gap = r["trail"]
        return pd.DataFrame(out, columns=schema.names)

    return parts.groupBy(*by).applyInPandas(chain, schema)


def _means(df, column, spans, signal: int | None, out: Callable[[pd.DataFrame], dict], names, by, ts, tie, rows, slot) -> DataFrame:
    """Cut the series into chunks that know the means before them, and add the columns ``names`` by ``out``.

    The input is read twice: for the slot table, which carries all means, and for the chunks.
    """
    by = o.keys(by)
    x = F.col(column).cast("double")
    inside = F.sort_array(F.collect_list(F.struct(ts, *[c for c in tie if c != ts], F.when(~F.isnan(x), x).alias("_x")))).alias("_rows")
    cut = o.spread(df, by, ts, 0, 0, rows, slot, [inside], lambda table: _chained(table, spans, signal, by))
    cut = cut.withColumn("_x", x).drop(o._BEFORE, o._TOTAL, o._SLOT, o._OWN)
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])
    order, chunk = [ts, *tie], o._CHUNK

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        nowhere = pdf.iloc[0][chunk] < 0
        made = dict.fromkeys(names, math.nan) if nowhere else out(pdf)
        return pdf.assign(**made)[schema.names]

    return cut.groupBy(*by, o._CHUNK).applyInPandas(smooth, schema)


def _span_mean(pdf: pd.DataFrame, span: int) -> np.ndarray:
    head = pdf.iloc[0]
    return _continued(pdf["_x"].to_numpy(dtype=float), span, float(head[f"_m{span}"]), 0 if pd.isna(head["_gap"]) else int(head["_gap"]))


def ema(df, column="close", spans=(12, 26), names=None, by="symbol", ts="ts", tie=(), rows=o.CHUNK_ROWS, slot=o.SLOT) -> DataFrame:
    """Exponential means ``ema_<span>`` (or ``names``) of ``column`` in time order, for any chunk size."""
    spans = list(spans)
    names = [f"ema_{s}" for s in spans] if names is None else list(names)

    def out(pdf: pd.DataFrame) -> dict:
        return {name: _span_mean(pdf, s) for name, s in zip(names, spans)}

    return _means(df, column, spans, None, out, names, by, ts, tie, rows, slot)


def macd_ema(df, fast=12, slow=26, signal=9, column="close", by="symbol", ts="ts", tie=(), rows=o.CHUNK_ROWS, slot=o.SLOT) -> DataFrame:
    """``macd`` (fast mean minus slow mean), its exponential mean ``macd_signal`` and ``macd_histogram``, in one pass over the chunks."""
    def out(pdf: pd.DataFrame) -> dict:
        line = _span_mean(pdf, fast) - _span_mean(pdf, slow)
        smooth = _continued(line, signal, float(pdf.iloc[0]["_signal"]), 0)
        return {"macd": line, "macd_signal": smooth, "macd_histogram": line - smooth}

    return _means(df, column, [fast, slow], signal, out, ["macd", "macd_signal", "macd_histogram"], by, ts, tie, rows, slot)
