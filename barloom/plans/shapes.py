"""Derived inputs several queries share: predictions and signals over the hourly bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import lookup as lk
from barloom.operators import ordered as o
from barloom.operators import signals as sg
from barloom.sources import adapters as a


def _prediction_layer(df, w):
    df = df.withColumns(
        {
            "_rn": o.position(w),
            "predicted_price": ind.rolling_mean("close", 5, w),
            "_r": ind.change_ratio("close", 1, w),
            "target_time": F.lead("ts").over(w),
            "actual_price": F.lead("close").over(w),
        }
    )
    return df.withColumns(
        {
            "confidence": 1.0 / (1.0 + F.abs("_r")),
            "model_name": F.when(F.col("_rn") % 2 == 1, "short_term").otherwise("medium_term"),
        }
    )


PREDICTION_COLUMNS = (
    "symbol", "model_name", "horizon", "target_time", "current_price", "predicted_price", "confidence", "actual_price",
)


def predictions(spark, sf_dir) -> DataFrame:
    bars = a.bars_hourly(spark, sf_dir)
    made = o.ordered(bars, _prediction_layer, back=4, ahead=1)
    return made.withColumns({"horizon": F.lit("hour"), "current_price": F.col("close")}).select(
        F.col("ts").alias("prediction_time"), *PREDICTION_COLUMNS
    )


def signals(spark, sf_dir, horizon="short") -> DataFrame:
    """Indicators and predictions over the same bars in one ordered pass, then the signal columns."""
    full = ind.indicator_layers()

    def layer(df, w):
        return _prediction_layer(full(df, w), w)

    bars = a.bars_hourly(spark, sf_dir)
    both = o.ordered(bars, layer, back=ind.indicator_reach(), ahead=1)
    return sg.generate_signals(
        both.withColumn("current_price", F.col("close")), horizon, volatility="volatility_20d"
    )


def last_signals(spark, sf_dir) -> DataFrame:
    return lk.latest(signals(spark, sf_dir))
