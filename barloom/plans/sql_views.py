"""The adapters of ``barloom.sources.adapters`` and shared steps as SQL text for the checks."""

from __future__ import annotations

import math

TICKS = "ticks AS (SELECT ts, event_type AS symbol, value AS price, event_id FROM events)"

BARS = """bars AS (
 SELECT date_trunc('hour', ts) AS ts, symbol,
  first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts, event_id) AS close, count(*)::BIGINT AS volume
 FROM (SELECT ts, event_type AS symbol, value AS price, event_id FROM events) GROUP BY 1, 2)"""

_LINE = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
DAILY = f"""daily AS (
 SELECT date_trunc('day', ts)::TIMESTAMP AS ts, symbol,
  first(price ORDER BY {_LINE}) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY {_LINE}) AS close, sum(l_quantity)::BIGINT AS volume
 FROM (SELECT l_shipdate AS ts, l_returnflag AS symbol, l_extendedprice / l_quantity AS price, * FROM lineitem)
 GROUP BY 1, 2)"""

QUOTES = """quotes AS (
 SELECT l_shipdate AS ts, p_brand AS symbol,
  concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS options_ticker,
  p_retailprice * (l_linenumber * 0.05::DOUBLE + 0.80::DOUBLE) AS strike,
  l_shipdate::DATE + floor(l_quantity * 365.25::DOUBLE / 100.0::DOUBLE)::INT AS expiration,
  CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS option_type,
  p_retailprice AS underlying_price,
  l_discount * 3.0::DOUBLE + 0.10::DOUBLE AS implied_volatility,
  l_quantity / 100.0::DOUBLE AS time_to_expiration,
  l_quantity::BIGINT AS volume, (l_quantity * 10)::BIGINT AS open_interest
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def cdf(x: str, terms: int = 150) -> str:
    """Normal CDF by its series, summed in logarithms; beyond 9 deviations it is 0 or 1."""
    z = f"least(abs({x}), 9.0)"
    lz = f"ln(greatest({z}, 1e-300))"
    term = (
        f"exp((2 * k + 1) * {lz} - {z} * {z} / 2 - (k + 1) * ln(2::DOUBLE) - lgamma(k + 1.5)"
        f" + {0.5 * math.log(math.pi)!r})"
    )
    total = f"list_sum(list_transform(range(0, {terms}), lambda k: {term}))"
    return f"(0.5 + sign({x}) * {total} / {math.sqrt(2 * math.pi)!r})"


def pdf(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) / {math.sqrt(2 * math.pi)!r})"


R, Q = "0.05::DOUBLE", "0.02::DOUBLE"

# d1, d2 and the two CDF values once per quote; t can be replaced for other clocks.
def greeks_ctes(source: str = "quotes", t: str = "time_to_expiration") -> list[str]:
    return [
        f"""base AS (SELECT *, {t} AS t, underlying_price AS s, strike AS k, implied_volatility AS v FROM {source})""",
        f"""dd AS (SELECT *, (ln(s / k) + ({R} - {Q} + 0.5 * v * v) * t) / (v * sqrt(t)) AS d1 FROM base)""",
        """dd2 AS (SELECT *, d1 - v * sqrt(t) AS d2 FROM dd)""",
        f"""nn AS (SELECT *, {cdf('d1')} AS n1, {cdf('d2')} AS n2, {pdf('d1')} AS pdf,
  exp(-{Q} * t) AS cq, exp(-{R} * t) AS cr FROM dd2)""",
        f"""greeks AS (SELECT *,
  CASE WHEN option_type = 'call' THEN s * cq * n1 - k * cr * n2 ELSE k * cr * (1 - n2) - s * cq * (1 - n1) END AS price,
  CASE WHEN option_type = 'call' THEN cq * n1 ELSE -cq * (1 - n1) END AS delta,
  cq * pdf / (s * v * sqrt(t)) AS gamma,
  s * cq * pdf * sqrt(t) / 100 AS vega,
  (-s * cq * pdf * v / (2 * sqrt(t)) + CASE WHEN option_type = 'call'
    THEN -{R} * k * cr * n2 + {Q} * s * cq * n1
    ELSE {R} * k * cr * (1 - n2) - {Q} * s * cq * (1 - n1) END) / 365 AS theta,
  CASE WHEN option_type = 'call' THEN k * t * cr * n2 / 100 ELSE -k * t * cr * (1 - n2) / 100 END AS rho
  FROM nn)""",
    ]


UNIVERSE = """universe AS (
 SELECT sector, symbol, row_number() OVER (PARTITION BY sector ORDER BY symbol) AS rank
 FROM (SELECT DISTINCT p_type AS sector, p_brand AS symbol FROM part))"""

LEGS_INPUT = """legs_input AS (
 SELECT p_partkey, p_retailprice AS current_price,
  (['bullish', 'bearish', 'neutral', 'volatile'])[p_size % 4 + 1] AS outlook,
  (['conservative', 'moderate', 'aggressive'])[p_size % 3 + 1] AS risk_tolerance,
  p_size / 100.0::DOUBLE AS implied_volatility, p_size + 10 AS time_to_expiration
 FROM part)"""

NEWS = """news AS (
 SELECT doc_id::VARCHAR AS id, source AS symbol, (quality - toxic)::DOUBLE AS score,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(doc_id) AS ts
 FROM documents JOIN labels USING (doc_id))"""


def over(frame: str | None = None) -> str:
    return f"(PARTITION BY symbol ORDER BY ts{'' if frame is None else ' ROWS ' + frame})"


def last(n: int) -> str:
    return over(f"BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def ind_ctes(source: str = "bars") -> list[str]:
    """All columns of the indicator set, partial frames counting."""
    return [
        f"""i1 AS (SELECT *, close / nullif(lag(close) OVER {over()}, 0) - 1 AS r1,
  close - lag(close) OVER {over()} AS price_change,
  avg(close) OVER {last(12)} - avg(close) OVER {last(26)} AS macd FROM {source})""",
        f"""i2 AS (SELECT ts, symbol, open, high, low, close, volume,
  {', '.join(f'avg(close) OVER {last(n)} AS sma_{n}' for n in (5, 10, 20, 50))},
  {', '.join(f'close / nullif(lag(close, {k}) OVER {over()}, 0) - 1 AS return_{k}d' for k in (1, 5, 20))},
  stddev_samp(r1) OVER {last(20)} AS volatility_20d,
  avg(volume) OVER {last(20)} AS volume_sma_20,
  volume / nullif(avg(volume) OVER {last(20)}, 0) AS volume_ratio,
  100 - 100 / (1 + avg(CASE WHEN price_change > 0 THEN price_change ELSE 0 END) OVER {last(14)}
    / (avg(CASE WHEN price_change < 0 THEN -price_change ELSE 0 END) OVER {last(14)} + 1e-6)) AS rsi,
  avg(close) OVER {last(20)} AS bb_middle, stddev_samp(close) OVER {last(20)} AS bb_std,
  macd, avg(macd) OVER {last(9)} AS macd_signal, macd - avg(macd) OVER {last(9)} AS macd_histogram,
  high - low AS price_range, (high - low) / nullif(close, 0) AS price_range_pct
 FROM i1)""",
        """ind AS (SELECT *, bb_middle + 2 * bb_std AS bb_upper, bb_middle - 2 * bb_std AS bb_lower, 4 * bb_std AS bb_width,
  (close - (bb_middle - 2 * bb_std)) / nullif(4 * bb_std, 0) AS bb_position FROM i2)""",
    ]


PREDICTIONS = f"""preds AS (
 SELECT ts AS prediction_time, symbol,
  CASE WHEN rn % 2 = 1 THEN 'short_term' ELSE 'medium_term' END AS model_name, 'hour' AS horizon,
  lead(ts) OVER {over()} AS target_time, close AS current_price,
  avg(close) OVER {last(5)} AS predicted_price,
  1 / (1 + abs(close / lag(close) OVER {over()} - 1)) AS confidence,
  lead(close) OVER {over()} AS actual_price
 FROM (SELECT *, row_number() OVER {over()} AS rn FROM bars))"""

TECHNICAL_SCORE = """least(greatest(0.5::DOUBLE
  + CASE WHEN rsi IS NULL THEN 0 WHEN rsi < 30 THEN 0.2::DOUBLE WHEN rsi > 70 THEN -0.2::DOUBLE ELSE 0 END
  + CASE WHEN macd IS NULL OR macd_signal IS NULL THEN 0 WHEN macd > macd_signal THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END
  + CASE WHEN sma_20 IS NULL OR sma_50 IS NULL THEN 0 WHEN sma_20 > sma_50 THEN 0.15::DOUBLE ELSE -0.15::DOUBLE END, 0), 1)"""

MOMENTUM_SCORE = """least(greatest(0.5::DOUBLE
  + CASE WHEN return_5d IS NULL THEN 0 ELSE least(greatest(return_5d * 5, -0.3::DOUBLE), 0.3::DOUBLE) END
  + CASE WHEN volume_ratio > 1.5 THEN 0.1::DOUBLE WHEN volume_ratio < 0.5 THEN -0.1::DOUBLE ELSE 0 END, 0), 1)"""


def signal_ctes(days: int = 1, predictions: tuple[str, ...] = (PREDICTIONS,)) -> list[str]:
    """Signals over bars, indicators and predictions; ``predictions`` ends in a view ``preds``."""
    factor = math.sqrt(days / 252)
    return [
        BARS, *ind_ctes(), *predictions,
        f"""sig0 AS (SELECT i.ts, i.symbol, p.current_price, p.predicted_price,
  coalesce(p.confidence, 0.5) AS conf, coalesce(i.volatility_20d, 0.2) AS vol, i.close,
  (p.predicted_price - p.current_price) / nullif(p.current_price, 0) AS expected_return,
  {TECHNICAL_SCORE} AS technical_score, {MOMENTUM_SCORE} AS momentum_score
 FROM ind i JOIN preds p ON p.symbol = i.symbol AND p.prediction_time = i.ts)""",
        """sig1 AS (SELECT *, least(greatest(0.4 * least(abs(expected_return) * conf / 0.1, 1)
  + 0.3 * technical_score + 0.2 * momentum_score + 0.1 * (1 - least(vol, 1)), 0), 1) AS confidence FROM sig0)""",
        """sig2 AS (SELECT *, CASE WHEN expected_return > 0.02 THEN 'buy' WHEN expected_return < -0.02 THEN 'sell' ELSE 'hold' END AS base FROM sig1)""",
        f"""sig3 AS (SELECT *, CASE WHEN confidence > 0.7 AND base <> 'hold' THEN 'strong_' || base ELSE base END AS signal_type,
  CASE base WHEN 'buy' THEN 1 WHEN 'sell' THEN -1 ELSE 0 END AS side, current_price * vol * {factor!r} AS mv FROM sig2)""",
        """signals AS (SELECT *, current_price + mv * side * 0.5 AS target_1, current_price + mv * side AS target_2,
  current_price + mv * side * 1.5 AS target_3,
  CASE WHEN side = 0 THEN current_price - mv * 0.3 ELSE current_price - mv * side * 0.5 END AS stop_loss,
  least(greatest(confidence * 0.5 * (1 - least(vol, 0.5)), 0.05), 0.25) AS position_size FROM sig3)""",
    ]
