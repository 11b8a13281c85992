"""Option chain reports: pivots, volatility surface, positioning measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import ordered as o


def chain_pivot(quotes: DataFrame, value="last", by=("symbol",)) -> DataFrame:
    """Call and put value by strike."""
    return quotes.groupBy(*by, "strike").pivot("option_type", ["call", "put"]).agg(F.avg(value))


def iv_surface(quotes: DataFrame, as_of_col="ts", strike_width=10.0, day_width=30) -> DataFrame:
    """Mean implied volatility by strike bucket and days-to-expiry bucket."""
    days = F.date_diff("expiration", F.to_date(as_of_col))
    return quotes.groupBy(
        "symbol",
        (F.floor(F.col("strike") / strike_width) * strike_width).alias("strike_bucket"),
        (F.floor(days / day_width) * day_width).cast("bigint").alias("days_bucket"),
    ).agg(F.avg("implied_volatility").alias("implied_volatility"), F.count(F.lit(1)).alias("quotes"))


def put_call_ratio(quotes: DataFrame, period=20, **ordering) -> DataFrame:
    """Put volume over call volume, summed over the last ``period`` trading days per symbol."""
    put = F.col("option_type") == "put"
    daily = quotes.groupBy("symbol", F.to_date("ts").cast("timestamp").alias("ts")).agg(
        F.sum(F.when(put, F.col("volume")).otherwise(0)).alias("puts"),
        F.sum(F.when(~put, F.col("volume")).otherwise(0)).alias("calls"),
    )

    def layer(df, w):
        frame = w.rowsBetween(-(period - 1), 0)
        return df.withColumn(
            "put_call_ratio",
            F.try_divide(F.sum("puts").over(frame).cast("double"), F.sum("calls").over(frame)),
        )

    return o.ordered(daily, layer, back=period - 1, **{"slot": "52 weeks", **ordering})


def daily_iv(quotes: DataFrame, column="implied_volatility", digits=6) -> DataFrame:
    """Mean of ``column`` per symbol and day, rounded half up to ``digits``.

    The mean is taken in decimals, which add up alike in any order: a mean that ends halfway between two
    rounded values falls the same way in every run, and days of equal mean stay equal.  A day with a value
    that is no decimal (NaN, infinite) has the plain mean.
    """
    value = F.col(column)
    exact = value.try_cast("decimal(28,12)")
    whole = F.count(exact) == F.count(value)
    mean = F.when(whole, F.round(F.avg(exact), digits).cast("double")).otherwise(F.round(F.avg(value), digits))
    return quotes.groupBy("symbol", F.to_date("ts").cast("timestamp").alias("ts")).agg(mean.alias(column))


def iv_percentile(daily_iv: DataFrame, lookback=252, column="implied_volatility", **ordering) -> DataFrame:
    """Share (percent) of the last ``lookback`` values, the current one included, that lie below it."""
    def layer(df, w):
        past = F.collect_list(column).over(w.rowsBetween(-(lookback - 1), 0))
        return df.withColumn("_past", past)

    below = F.size(F.filter("_past", lambda x: x < F.col(column)))
    framed = o.ordered(daily_iv, layer, back=lookback - 1, **ordering)
    return framed.withColumn(
        "iv_percentile", F.try_divide(below.cast("double"), F.size("_past")) * 100.0
    ).drop("_past")


def max_pain(quotes: DataFrame, by=("symbol", "expiration")) -> DataFrame:
    """The strike at which option holders receive least, per expiration.

    The payout at strike x is  x * (call interest below) - (call interest * strike below)
    plus the mirror image for puts, so running sums over the strikes replace the
    strike-by-strike comparison.
    """
    by = list(by)
    call = F.col("option_type") == "call"
    interest = F.col("open_interest").cast("double")
    ladder = quotes.groupBy(*by, "strike").agg(
        F.sum(F.when(call, interest).otherwise(0.0)).alias("_c"),
        F.sum(F.when(~call, interest).otherwise(0.0)).alias("_p"),
    )
    w = W.partitionBy(*by).orderBy("strike")
    below = w.rowsBetween(W.unboundedPreceding, -1)
    above = w.rowsBetween(1, W.unboundedFollowing)

    def total(x, frame):
        return F.coalesce(F.sum(x).over(frame), F.lit(0.0))

    k = F.col("strike")
    pain = (
        k * total("_c", below) - total(F.col("_c") * k, below)
        + total(F.col("_p") * k, above) - k * total("_p", above)
    )
    return (
        ladder.withColumn("_pain", pain)
        .groupBy(*by)
        .agg(F.min_by("strike", F.struct(F.round("_pain", 4), "strike")).alias("max_pain"),
             F.min("_pain").alias("payout"))
    )


def gamma_exposure(quotes: DataFrame, by=("symbol",)) -> DataFrame:
    """Gamma times open interest per 1 % move; calls positive, puts negative."""
    sign = F.when(F.col("option_type") == "call", 1.0).otherwise(-1.0)
    s = F.col("underlying_price")
    exposure = F.col("gamma") * F.col("open_interest") * 100.0 * s * s * 0.01 * sign
    return quotes.groupBy(*by).agg(F.sum(exposure).alias("gamma_exposure"))
