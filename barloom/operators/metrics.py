"""Aggregates behind dashboards, training reports and ingestion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import ordered as o
from barloom.operators.lookup import last_n, missing_keys, relative_range
from barloom.operators.quantiles import exact_quantiles


def mape_over_time(predictions: DataFrame, every="5 minutes", ts="prediction_time") -> DataFrame:
    error = F.try_divide(F.abs(F.col("predicted_price") - F.col("actual_price")), F.col("actual_price"))
    return (
        predictions.filter(F.col("actual_price").isNotNull())
        .groupBy(F.window(ts, every)["start"].alias("time"), "model_name")
        .agg(F.avg(error * 100.0).alias("error"))
    )


def model_activity(predictions: DataFrame, as_of, lookback="24 hours", ts="prediction_time") -> DataFrame:
    """Average confidence and number of predictions per model."""
    recent = relative_range(predictions, lookback, as_of, ts)
    return recent.groupBy("model_name").agg(
        F.avg("confidence").alias("avg_confidence"), F.count(F.lit(1)).alias("predictions")
    )


def signal_counts(signals: DataFrame, as_of, lookback="7 days") -> DataFrame:
    return relative_range(signals, lookback, as_of).groupBy("signal_type").agg(F.count(F.lit(1)).alias("count"))


def prediction_errors(predictions: DataFrame, as_of, lookback="7 days", ts="prediction_time") -> DataFrame:
    recent = relative_range(predictions, lookback, as_of, ts).filter(F.col("actual_price").isNotNull())
    return recent.withColumn("error", F.col("predicted_price") - F.col("actual_price"))


def histogram(df: DataFrame, column: str, low: float, high: float, buckets: int) -> DataFrame:
    bucket = F.width_bucket(F.col(column), F.lit(float(low)), F.lit(float(high)), F.lit(buckets))
    return df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))


def field_mean(points: DataFrame, measurement: str, field: str, lookback: str, as_of, tags=("symbol",)) -> DataFrame:
    """Mean of one field per series of a long point table."""
    wanted = points.filter((F.col("measurement") == measurement) & (F.col("field") == field))
    series = [F.col("tags")[t].alias(t) for t in tags]
    return relative_range(wanted, lookback, as_of).groupBy(*series).agg(F.avg("value").alias("mean"))


def regression_metrics(df: DataFrame, actual="actual", predicted="predicted", by="symbol",
                       last: int | None = None, ts="ts", tie=()) -> DataFrame:
    if last is not None:
        df = last_n(df, last, by, ts, tie)
    error = F.col(actual) - F.col(predicted)
    return (
        df.groupBy(*o.keys(by))
        .agg(
            F.count(error).alias("n"),
            F.avg(F.abs(error)).alias("mae"),
            F.avg(error * error).alias("mse"),
            (F.avg(F.abs(F.try_divide(error, F.col(actual)))) * 100.0).alias("mape"),
        )
        .withColumn("rmse", F.sqrt("mse"))
    )


def training_summary(results: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """Averages, best and worst model and success rate over a training results table."""
    summary = results.agg(
        F.count(F.lit(1)).alias("models"),
        F.avg("train_mae").alias("avg_train_mae"),
        F.avg("test_mae").alias("avg_test_mae"),
        F.min_by("symbol", F.struct("test_mae", "symbol")).alias("best_symbol"),
        F.min("test_mae").alias("best_test_mae"),
        F.max_by("symbol", F.struct("test_mae", "symbol")).alias("worst_symbol"),
        F.max("test_mae").alias("worst_test_mae"),
    )
    if requested is None:
        return summary
    total = requested.agg(F.count_distinct("symbol"))
    return summary.withColumn("requested", total.scalar()).withColumn(
        "success_rate", F.try_divide(F.col("models") * 100.0, F.col("requested"))
    )


def ingest_summary(bars: DataFrame) -> DataFrame:
    """Rows and time range per symbol."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def ingest_totals(bars: DataFrame) -> DataFrame:
    return bars.agg(
        F.count(F.lit(1)).alias("total_records"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def ingest_report(requested: DataFrame, loaded: DataFrame, show: int = 10) -> DataFrame:
    """Successful and failed symbols, success rate, and the first failed symbols."""
    wanted = requested.select("symbol").distinct()
    have = loaded.select("symbol").distinct().withColumn("_ok", F.lit(1))
    counts = wanted.join(have, "symbol", "left").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_ok").alias("successful")
    )
    failed = missing_keys(requested, loaded, ["symbol"]).orderBy("symbol").limit(show)
    names = failed.agg(F.array_sort(F.collect_list("symbol")))
    return counts.withColumns(
        {
            "failed_symbols": names.scalar(),
            "failed": F.col("requested") - F.col("successful"),
            "success_rate": F.try_divide(F.col("successful") * 100.0, F.col("requested")),
        }
    )


def strategy_summary(strategies: DataFrame) -> DataFrame:
    """Per symbol: the cheapest expiry, the best risk/reward and the mean confidence."""
    return strategies.groupBy("symbol").agg(
        F.min_by("expiry_date", F.struct("capital_required", "expiry_date")).alias("cheapest_expiry"),
        F.min("capital_required").alias("min_capital"),
        F.max("risk_reward").alias("best_risk_reward"),
        F.avg("confidence_1").alias("avg_confidence"),
    )


def volume_profile(bars: DataFrame, width: float) -> DataFrame:
    bucket = (F.floor(F.col("close") / width) * width).alias("price_bucket")
    return bars.groupBy("symbol", bucket).agg(F.sum("volume").alias("volume"))


def draw_summary(draws: DataFrame, by=("symbol",), value="value") -> DataFrame:
    """Mean, population deviation and 5th/95th percentile over repeated model draws."""
    by = list(by)
    moments = draws.groupBy(*by).agg(
        F.count(value).alias("draws"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")
    )
    tails = exact_quantiles(draws, value, [0.05, 0.95], by)
    return moments.join(tails, by).withColumnsRenamed({"q_0": "lower_bound", "q_1": "upper_bound"})
