"""Trading signals from prices, predictions and indicators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.mathfn import clip

# Trading days per horizon, and weights of the four strength parts.
HORIZON_DAYS = {"short": 1, "medium": 5, "long": 21}
W_PREDICTION, W_TECHNICAL, W_MOMENTUM, W_VOLATILITY = 0.4, 0.3, 0.2, 0.1


def _step(columns: set, needed: tuple[str, ...], value: Column) -> Column:
    """A score step: nothing if a column is absent or null."""
    if not set(needed) <= columns:
        return F.lit(0.0)
    known = F.lit(True)
    for c in needed:
        known = known & F.col(c).isNotNull()
    return F.when(known, value).otherwise(0.0)


def technical_score(columns) -> Column:
    columns = set(columns)
    c = F.col
    zone = F.when(c("rsi") < 30, 0.2).when(c("rsi") > 70, -0.2).otherwise(0.0)
    macd = F.when(c("macd") > c("macd_signal"), 0.15).otherwise(-0.15)
    cross = F.when(c("sma_20") > c("sma_50"), 0.15).otherwise(-0.15)
    score = (
        F.lit(0.5)
        + _step(columns, ("rsi",), zone)
        + _step(columns, ("macd", "macd_signal"), macd)
        + _step(columns, ("sma_20", "sma_50"), cross)
    )
    return clip(score, 0.0, 1.0)


def momentum_score(columns) -> Column:
    columns = set(columns)
    c = F.col
    volume = F.when(c("volume_ratio") > 1.5, 0.1).when(c("volume_ratio") < 0.5, -0.1).otherwise(0.0)
    score = (
        F.lit(0.5)
        + _step(columns, ("return_5d",), clip(c("return_5d") * 5.0, -0.3, 0.3))
        + _step(columns, ("volume_ratio",), volume)
    )
    return clip(score, 0.0, 1.0)


def signal_strength(expected_return, confidence, technical, momentum, volatility) -> Column:
    prediction = F.least(F.abs(expected_return) * confidence / 0.1, F.lit(1.0))
    calm = 1.0 - F.least(volatility, F.lit(1.0))
    total = (
        prediction * W_PREDICTION + technical * W_TECHNICAL + momentum * W_MOMENTUM + calm * W_VOLATILITY
    )
    return clip(total, 0.0, 1.0)


def expected_return(current, predicted) -> Column:
    return F.try_divide(F.col(predicted) - F.col(current), F.col(current))


def signal_type(expected, strength) -> Column:
    base = F.when(expected > 0.02, "buy").when(expected < -0.02, "sell").otherwise("hold")
    return F.when((strength > 0.7) & (base != "hold"), F.concat(F.lit("strong_"), base)).otherwise(base)


def direction(signal) -> Column:
    """+1 for buys, -1 for sells, 0 for hold."""
    return F.when(signal.endswith("buy"), 1.0).when(signal.endswith("sell"), -1.0).otherwise(0.0)


def targets(price, volatility, signal, horizon: str) -> dict[str, Column]:
    days = HORIZON_DAYS.get(horizon, HORIZON_DAYS["short"])
    move = price * volatility * math.sqrt(days / 252)
    side = direction(signal)
    return {
        "target_1": price + move * side * 0.5,
        "target_2": price + move * side,
        "target_3": price + move * side * 1.5,
        "stop_loss": F.when(side == 0, price - move * 0.3).otherwise(price - move * side * 0.5),
    }


def position_size(strength, volatility) -> Column:
    return clip(strength * 0.5 * (1.0 - F.least(volatility, F.lit(0.5))), 0.05, 0.25)


def risk_reward(entry, target, stop) -> Column:
    risk = F.abs(entry - stop)
    return F.when(risk == 0, 0.0).otherwise(F.try_divide(F.abs(target - entry), risk))


def generate_signals(df: DataFrame, horizon: str = "short", current="current_price",
                     predicted="predicted_price", confidence="confidence", volatility="volatility") -> DataFrame:
    """Input columns are kept; ``confidence`` of the result is the signal strength."""
    c = F.col
    given = set(df.columns)
    base = df.withColumns(
        {
            "_conf": F.coalesce(c(confidence), F.lit(0.5)) if confidence in given else F.lit(0.5),
            "_vol": F.coalesce(c(volatility), F.lit(0.2)) if volatility in given else F.lit(0.2),
            "expected_return": expected_return(current, predicted),
            "technical_score": technical_score(given),
            "momentum_score": momentum_score(given),
        }
    )
    scored = base.withColumn(
        "confidence",
        signal_strength(c("expected_return"), c("_conf"), c("technical_score"), c("momentum_score"), c("_vol")),
    ).withColumn("signal_type", signal_type(c("expected_return"), c("confidence")))
    priced = scored.withColumns(targets(c(current), c("_vol"), c("signal_type"), horizon))
    return priced.withColumns(
        {
            "position_size": position_size(c("confidence"), c("_vol")),
            "risk_reward_ratio": risk_reward(c(current), c("target_1"), c("stop_loss")),
            "time_horizon": F.lit(horizon),
        }
    ).drop("_conf", "_vol")


def confidence_band(x) -> Column:
    """Fixed bands: high 0.7-0.8, medium 0.5-0.6, low 0.3-0.4; anything between is null."""
    x = F.col(x) if isinstance(x, str) else x
    return (
        F.when(x.between(0.7, 0.8), "high")
        .when(x.between(0.5, 0.6), "medium")
        .when(x.between(0.3, 0.4), "low")
    )


def to_signal_table(signals: DataFrame, strategy="prediction", ts="ts", more: Sequence[str] | None = None) -> DataFrame:
    """The stored signal record; the scores go into the metadata map.

    With ``more``, the metadata is a VARIANT that also holds these columns with types of their own.
    """
    extra = ("expected_return", "technical_score", "momentum_score", "position_size", "risk_reward_ratio")
    pairs = [x for c in extra for x in (F.lit(c), F.col(c))]
    metadata = F.create_map(*pairs) if more is None else F.to_variant_object(F.struct(*extra, *more))
    return signals.select(
        F.col(ts).alias("ts"),
        "symbol",
        "signal_type",
        F.lit(strategy).alias("strategy"),
        F.col("target_1").alias("target_price"),
        "stop_loss",
        "confidence",
        metadata.alias("metadata"),
    )
