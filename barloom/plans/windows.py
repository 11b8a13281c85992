"""Queries: bars, projections, indicators and data preparation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import lookup as lk
from barloom.operators import prep
from barloom.operators import signals as sg
from barloom.plans import sql_views as v
from barloom.plans.registry import AS_OF, add
from barloom.sources import adapters as a
from barloom.sources import readers
from barloom.sources.storage import staged

KEY = ("ts", "symbol")
IND = ["sma_5", "sma_10", "sma_20", "sma_50"]
DAY = {"slot": "52 weeks"}  # daily bars: a slot holds at most 364 of them


def flagship(spark, sf_dir):
    """Ticks to hourly bars, indicators, technical score, newest row per symbol."""
    full = ind.indicator_set(staged(a.bars_hourly(spark, sf_dir), "bars"))
    scored = full.withColumn("technical_score", sg.technical_score(full.columns))
    return lk.latest(scored)


add("entry_latest_scores", flagship, KEY, ("close", "sma_20", "rsi", "bb_upper", "bb_lower", "technical_score"),
    f"""SELECT * FROM (SELECT *, {v.TECHNICAL_SCORE} AS technical_score,
    row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS newest FROM ind) WHERE newest = 1""",
    (v.BARS, *v.ind_ctes()))

# --- bars -------------------------------------------------------------------

add("s12_resample_hourly", a.bars_hourly, (*KEY, "volume"), ("open", "high", "low", "close"),
    "SELECT * FROM bars", (v.BARS,))
add("s12_resample_daily", a.bars_daily, (*KEY, "volume"), ("open", "high", "low", "close"),
    "SELECT * FROM daily", (v.DAILY,))
add("s12_bars_to_4_hours", lambda s, d: readers.bars_to_bars(a.bars_hourly(s, d), "4 hours"),
    (*KEY, "volume"), ("open", "high", "low", "close"),
    """SELECT time_bucket(INTERVAL '4 hours', ts, TIMESTAMP '2000-01-01') AS ts, symbol, first(open ORDER BY ts) AS open,
    max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume
    FROM bars GROUP BY 1, 2""", (v.BARS,))


def _actions(bars):
    """A 2:1 split on the 10th and a dividend of 1.0 on the 20th, at midnight of each symbol."""
    split = bars.filter(F.col("ts") == F.lit("2024-01-10 00:00:00").cast("timestamp"))
    paid = bars.filter(F.col("ts") == F.lit("2024-01-20 00:00:00").cast("timestamp"))
    return (split.select("symbol", "ts", F.lit(2.0).alias("ratio")),
            paid.select("symbol", "ts", F.lit(0.01).alias("amount")))


def _adjusted(s, d):
    bars = staged(a.bars_hourly(s, d), "bars")
    return readers.adjust_bars(bars, *_actions(bars))


add("s13_adjust_bars", _adjusted, (*KEY, "volume"), ("open", "high", "low", "close", "adjustment"),
    f"""SELECT ts, symbol, open * f AS open, high * f AS high, low * f AS low, close * f AS close, f AS adjustment,
      round(volume * sp)::BIGINT AS volume FROM (
      SELECT *, exp(coalesce(sum(lnf) OVER {v.over('BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING')}, 0)) AS f,
        exp(coalesce(sum(lns) OVER {v.over('BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING')}, 0)) AS sp FROM (
       SELECT *, CASE WHEN ts = TIMESTAMP '2024-01-10' THEN ln(2) ELSE 0 END AS lns,
        CASE WHEN ts = TIMESTAMP '2024-01-10' THEN -ln(2) WHEN ts = TIMESTAMP '2024-01-20'
        THEN coalesce(ln(1 - 0.01 / nullif(lag(close) OVER {v.over()}, 0)), 0) ELSE 0 END AS lnf FROM bars))""",
    (v.BARS,))

# --- projections ------------------------------------------------------------

add("p01_add_meta", lambda s, d: lk.add_meta(a.bars_hourly(s, d), as_of=AS_OF), (*KEY, "processing_time", "date"), ("close",),
    f"SELECT *, TIMESTAMP '{AS_OF}' AS processing_time, ts::DATE::VARCHAR AS date FROM bars", (v.BARS,))
add("p02_price_range", lambda s, d: ind.price_range(a.bars_hourly(s, d)), KEY, ("price_range", "price_range_pct"),
    "SELECT *, high - low AS price_range, (high - low) / nullif(close, 0) AS price_range_pct FROM bars", (v.BARS,))
add("p05_price_history",
    lambda s, d: lk.price_history(a.bars_hourly(s, d), "click", "2024-01-05 00:00:00", "2024-01-12 00:00:00"),
    (*KEY, "volume"), ("open", "high", "low", "close"),
    "SELECT * FROM bars WHERE symbol = 'click' AND ts BETWEEN '2024-01-05' AND '2024-01-12'", (v.BARS,))
add("p06_relative_range", lambda s, d: lk.relative_range(a.bars_hourly(s, d), "24 hours", AS_OF), KEY, ("close",),
    f"SELECT * FROM bars WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}'", (v.BARS,))

FEATURES = ("close", "volume", *IND, "rsi", "macd", "macd_signal", "bb_upper", "bb_lower", "volatility", "bb_std",
            "volatility_20d", "return_5d")
PRESENT = [c for c in FEATURES if c != "volatility"]
add("p07_select_features",
    lambda s, d: prep.select_features(ind.indicator_set(a.bars_hourly(s, d)), FEATURES), KEY, PRESENT,
    "SELECT * FROM ind",
    (v.BARS, *v.ind_ctes()))
add("p08_drop_incomplete",
    lambda s, d: prep.drop_incomplete(ind.indicator_set(a.bars_hourly(s, d)), ["return_20d", "volatility_20d", "rsi"], 500),
    KEY, ("return_20d", "rsi"),
    """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ind
       WHERE return_20d IS NOT NULL AND volatility_20d IS NOT NULL) WHERE n >= 500""", (v.BARS, *v.ind_ctes()))
add("p09_rsi_zone", lambda s, d: ind.rsi_zone(ind.rsi(a.bars_hourly(s, d))), (*KEY, "rsi_zone"), ("rsi",),
    "SELECT *, CASE WHEN rsi < 30 THEN 'oversold' WHEN rsi > 70 THEN 'overbought' ELSE 'neutral' END AS rsi_zone FROM ind",
    (v.BARS, *v.ind_ctes()))
add("p10_bar_direction", lambda s, d: ind.bar_direction(a.bars_hourly(s, d)), (*KEY, "direction"), (),
    "SELECT *, CASE WHEN close < open THEN 'down' ELSE 'up' END AS direction FROM bars", (v.BARS,))

# --- window functions -------------------------------------------------------

add("w01_row_num", lambda s, d: ind.row_num(a.bars_hourly(s, d)), (*KEY, "row_num"), (),
    f"SELECT *, row_number() OVER {v.over()} AS row_num FROM bars", (v.BARS,))


def _indicator(name, op, columns, daily=False):
    """One indicator against the shared indicator SQL."""
    source = "daily" if daily else "bars"
    read = a.bars_daily if daily else a.bars_hourly
    kw = DAY if daily else {}
    # Ordered operators read their input twice: the ticks are resampled once, into a stored table.
    add(name, lambda s, d: op(staged(read(s, d), "bars"), **kw), KEY, columns,
        "SELECT * FROM ind",
        (v.DAILY if daily else v.BARS, *v.ind_ctes(source)))


_indicator("w02_sma", ind.sma, IND)
_indicator("w02_sma_daily", ind.sma, IND, daily=True)
_indicator("w03_returns", ind.returns, ("return_1d", "return_5d", "return_20d"))
_indicator("w04_volatility", ind.volatility, ("volatility_20d",))
_indicator("w06_volume_ratio", ind.volume_stats, ("volume_sma_20", "volume_ratio"))
_indicator("w08_rsi", ind.rsi, ("rsi",))
_indicator("w09_bollinger", ind.bollinger, ("bb_middle", "bb_std", "bb_upper", "bb_lower", "bb_width", "bb_position"))
_indicator("w10_macd_sma", ind.macd_sma, ("macd", "macd_signal", "macd_histogram"))
_indicator("indicator_set_hourly", ind.indicator_set,
           (*IND, "return_1d", "return_5d", "return_20d", "volatility_20d", "volume_sma_20", "volume_ratio", "rsi",
            "bb_upper", "bb_lower", "bb_position", "macd", "macd_signal", "macd_histogram", "price_range", "price_range_pct"))
_indicator("indicator_set_daily", ind.indicator_set,
           (*IND, "return_20d", "volatility_20d", "volume_ratio", "rsi", "bb_upper", "bb_lower", "macd", "macd_signal"),
           daily=True)

add("w02_sma_full_window", lambda s, d: ind.sma(a.bars_hourly(s, d), min_periods=None), KEY, IND,
    "SELECT *, " + ", ".join(
        f"CASE WHEN count(*) OVER {v.last(n)} = {n} THEN avg(close) OVER {v.last(n)} END AS sma_{n}" for n in (5, 10, 20, 50)
    ) + " FROM bars", (v.BARS,))
add("w05_close_std", lambda s, d: ind.close_std(a.bars_hourly(s, d), min_periods=20), KEY, ("close_std_20",),
    f"SELECT *, CASE WHEN count(*) OVER {v.last(20)} = 20 THEN stddev_samp(close) OVER {v.last(20)} END AS close_std_20 FROM bars",
    (v.BARS,))
add("w07_gain_loss", lambda s, d: ind.gain_loss(a.bars_hourly(s, d)), KEY, ("price_change", "gain", "loss"),
    """SELECT *, CASE WHEN price_change > 0 THEN price_change ELSE 0 END AS gain,
       CASE WHEN price_change < 0 THEN -price_change ELSE 0 END AS loss FROM i1""", (v.BARS, *v.ind_ctes()[:1]))
add("w08_rsi_without_epsilon", lambda s, d: ind.rsi(a.bars_hourly(s, d), epsilon=0.0, min_periods=14), KEY, ("rsi",),
    f"""SELECT *, CASE WHEN n < 14 THEN NULL WHEN l = 0 AND g > 0 THEN 100 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi FROM (
        SELECT *, count(*) OVER {v.last(14)} AS n,
        avg(CASE WHEN price_change > 0 THEN price_change ELSE 0 END) OVER {v.last(14)} AS g,
        avg(CASE WHEN price_change < 0 THEN -price_change ELSE 0 END) OVER {v.last(14)} AS l FROM i1)""",
    (v.BARS, *v.ind_ctes()[:1]))


def ema_sql(source: str, column: str, span: int, out: str) -> str:
    """Closed form of the recursion: every earlier value with its weight."""
    alpha = 2.0 / (span + 1.0)
    keep = 1.0 - alpha
    return f"""{out} AS (SELECT x.symbol, x.ts,
      sum(y.{column} * pow({keep!r}, x.rn - y.rn) * CASE WHEN y.rn = 1 THEN 1 ELSE {alpha!r} END) AS e
      FROM {source} x JOIN {source} y ON x.symbol = y.symbol AND y.rn <= x.rn GROUP BY 1, 2)"""


NUMBERED = f"nb AS (SELECT *, row_number() OVER {v.over()} AS rn FROM bars)"
add("w11_ema", lambda s, d: ind.ema(a.bars_hourly(s, d)), KEY, ("ema_12", "ema_26"),
    "SELECT ts, symbol, e12.e AS ema_12, e26.e AS ema_26 FROM e12 JOIN e26 USING (ts, symbol)",
    (v.BARS, NUMBERED, ema_sql("nb", "close", 12, "e12"), ema_sql("nb", "close", 26, "e26")))
add("w12_macd_ema", lambda s, d: ind.macd_ema(a.bars_hourly(s, d)), KEY, ("macd", "macd_signal", "macd_histogram"),
    "SELECT ts, symbol, line AS macd, sig.e AS macd_signal, line - sig.e AS macd_histogram FROM ml JOIN sig USING (ts, symbol)",
    (v.BARS, NUMBERED, ema_sql("nb", "close", 12, "e12"), ema_sql("nb", "close", 26, "e26"),
     "ml AS (SELECT nb.ts, nb.symbol, rn, e12.e - e26.e AS line FROM nb JOIN e12 USING (ts, symbol) JOIN e26 USING (ts, symbol))",
     ema_sql("ml", "line", 9, "sig")))
add("w13_previous_change", lambda s, d: ind.previous_change(a.bars_hourly(s, d)), KEY, ("prev_close", "change", "change_pct"),
    f"""SELECT *, close - prev_close AS change, (close / nullif(prev_close, 0) - 1) * 100 AS change_pct FROM (
        SELECT *, lag(close) OVER {v.over()} AS prev_close FROM bars)""", (v.BARS,))
add("w14_change_from_24_rows", lambda s, d: ind.change_from(a.bars_hourly(s, d), 24), KEY, ("base_close", "change", "change_pct"),
    f"""SELECT *, close - base_close AS change, (close / nullif(base_close, 0) - 1) * 100 AS change_pct FROM (
        SELECT *, coalesce(lag(close, 23) OVER {v.over()}, first_value(close) OVER {v.over()}) AS base_close FROM bars)""",
    (v.BARS,))
add("w20_atr", lambda s, d: ind.atr(a.bars_hourly(s, d)), KEY, ("atr_14",),
    f"""SELECT ts, symbol, avg(tr) OVER {v.last(14)} AS atr_14 FROM (SELECT ts, symbol,
        greatest(high - low, abs(high - lag(close) OVER {v.over()}), abs(low - lag(close) OVER {v.over()})) AS tr FROM bars)""",
    (v.BARS,))
add("w20_stochastic", lambda s, d: ind.stochastic(a.bars_hourly(s, d)), KEY, ("stoch_k", "stoch_d"),
    f"""SELECT ts, symbol, k AS stoch_k, avg(k) OVER {v.last(3)} AS stoch_d FROM (SELECT ts, symbol,
        100 * (close - min(low) OVER {v.last(14)}) / nullif(max(high) OVER {v.last(14)} - min(low) OVER {v.last(14)}, 0) AS k
        FROM bars)""", (v.BARS,))
add("w20_sma_200", lambda s, d: ind.sma(a.bars_hourly(s, d), periods=(200,)), KEY, ("sma_200",),
    f"SELECT *, avg(close) OVER {v.last(200)} AS sma_200 FROM bars", (v.BARS,))

# --- preparation ------------------------------------------------------------


def _gappy(s, d):
    """Hourly bars in which low-volume closes and volumes are unknown."""
    bars = a.bars_hourly(s, d)
    return bars.withColumns({
        "close": F.when(F.col("volume") > 2, F.col("close")),
        "open": F.when(F.col("volume") > 3, F.col("open")),
    })


GAPPY = """gappy AS (SELECT ts, symbol, CASE WHEN volume > 2 THEN close END AS close,
  CASE WHEN volume > 3 THEN open END AS open FROM bars)"""


def fill_sql(c: str) -> str:
    forward = f"last_value({c} IGNORE NULLS) OVER {v.over('BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}"
    backward = f"first_value({c} IGNORE NULLS) OVER {v.over('BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')}"
    return f"coalesce({forward}, {backward}) AS {c}"


add("w16_fill_missing", lambda s, d: prep.fill_missing(_gappy(s, d), ["close", "open"]), KEY, ("close", "open"),
    f"SELECT * FROM (SELECT ts, symbol, {fill_sql('close')}, {fill_sql('open')} FROM gappy) WHERE close IS NOT NULL AND open IS NOT NULL",
    (v.BARS, GAPPY))
add("w17_next_target", lambda s, d: prep.next_target(a.bars_hourly(s, d)), KEY, ("close", "target"),
    f"SELECT * FROM (SELECT *, lead(close) OVER {v.over()} AS target FROM bars) WHERE target IS NOT NULL", (v.BARS,))


def _sequences(s, d):
    made = prep.sequences(a.bars_hourly(s, d), ["close", "volume"], n=10)
    flat = F.flatten("sequence")
    return made.withColumns({
        "n_values": F.size(flat).cast("bigint"),
        "oldest": F.col("sequence")[0][0],
        "newest": F.col("sequence")[9][0],
        "total": F.aggregate(flat, F.lit(0.0), lambda x, y: x + y),
    })


add("w18_sequences", _sequences, (*KEY, "n_values"), ("oldest", "newest", "total", "target"),
    f"""SELECT ts, symbol, 20::BIGINT AS n_values, lag(close, 10) OVER {v.over()} AS oldest, lag(close) OVER {v.over()} AS newest,
        sum(close + volume) OVER {v.over('BETWEEN 10 PRECEDING AND 1 PRECEDING')} AS total, close AS target
        FROM bars QUALIFY row_number() OVER {v.over()} > 10""", (v.BARS,))
add("w19_chrono_split", lambda s, d: prep.chrono_split(a.bars_hourly(s, d)), (*KEY, "split"), (),
    f"""SELECT ts, symbol, CASE WHEN i <= floor(floor(n * 0.8::DOUBLE) * 0.85::DOUBLE) THEN 'train'
        WHEN i <= floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM (
        SELECT *, row_number() OVER {v.over()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars)""", (v.BARS,))
add("w19_chrono_split_ceil", lambda s, d: prep.chrono_split(a.bars_hourly(s, d), rounding="ceil_test"), (*KEY, "split"), (),
    f"""SELECT ts, symbol, CASE WHEN i <= t - ceil(t * 0.15::DOUBLE) THEN 'train' WHEN i <= t THEN 'validation'
        ELSE 'test' END AS split FROM (SELECT *, n - ceil(n * 0.2::DOUBLE) AS t FROM (
        SELECT *, row_number() OVER {v.over()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars))""", (v.BARS,))

add("a14_fit_scaler", lambda s, d: prep.fit_scaler(a.bars_hourly(s, d), ["close", "volume"]), ("symbol",),
    ("close_mean", "close_std", "volume_mean", "volume_std"),
    """SELECT symbol, avg(close) AS close_mean, stddev_pop(close) AS close_std, avg(volume) AS volume_mean,
       stddev_pop(volume) AS volume_std FROM bars GROUP BY symbol""", (v.BARS,))


def _scaled(s, d):
    bars = a.bars_hourly(s, d)
    scaler = prep.fit_scaler(bars, ["close", "volume"])
    return prep.scale(bars, scaler, ["close", "volume"])


add("m01_scale", _scaled, KEY, ("close", "volume"),
    """SELECT ts, symbol, (close - avg(close) OVER w) / stddev_pop(close) OVER w AS close,
       (volume - avg(volume) OVER w) / stddev_pop(volume) OVER w AS volume FROM bars WINDOW w AS (PARTITION BY symbol)""",
    (v.BARS,))


def _restored(s, d):
    bars = a.bars_hourly(s, d)
    scaler = prep.fit_scaler(bars, ["close"])
    return prep.unscale(prep.scale(bars, scaler, ["close"]), scaler, ["close"])


add("m01_unscale", _restored, KEY, ("close",), "SELECT * FROM bars", (v.BARS,))
