"""Option strategies: by market outlook, and by predicted move with expiries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.mathfn import expiry_text, money, percent, signed_percent
from barloom.operators.lookup import first_ranked, instant, last_n

# Legs as (action, type, strike multiple, quantity), cap on days to
# expiry, and the texts for profit, loss and breakeven.
LEGS = {
    "Long Call": (
        [("buy", "call", 1.05, 1)], 60, "Unlimited", "Premium paid", "Strike + Premium"),
    "Bull Call Spread": (
        [("buy", "call", 1.02, 1), ("sell", "call", 1.08, 1)], 45,
        None, "Net premium paid", "Lower strike + Net premium"),
    "Long Put": (
        [("buy", "put", 0.95, 1)], 60, "Strike - Premium", "Premium paid", "Strike - Premium"),
    "Bear Put Spread": (
        [("buy", "put", 0.98, 1), ("sell", "put", 0.92, 1)], 45,
        None, "Net premium paid", "Upper strike - Net premium"),
    "Iron Condor": (
        [("sell", "put", 0.95, 1), ("buy", "put", 0.90, 1), ("sell", "call", 1.05, 1), ("buy", "call", 1.10, 1)],
        30, "Net premium received", "Width of spread - Net premium", "Two breakevens"),
    "Covered Call": (
        [("own", "stock", None, 100), ("sell", "call", 1.05, 1)], 30,
        "Strike - Stock cost + Premium", "Stock cost - Premium", "Stock cost - Premium"),
    "Long Straddle": (
        [("buy", "call", 1.0, 1), ("buy", "put", 1.0, 1)], 45,
        "Unlimited", "Total premium paid", "Strike ± Total premium"),
}
OUTLOOKS = ("bullish", "bearish", "neutral", "volatile")
EXPIRY_DAYS = (7, 14, 30)


def strategy_name(outlook="outlook", risk="risk_tolerance", iv="implied_volatility") -> Column:
    view, bold = F.col(outlook), F.col(risk) == "aggressive"
    return (
        F.when(view == "bullish", F.when(bold, "Long Call").otherwise("Bull Call Spread"))
        .when(view == "bearish", F.when(bold, "Long Put").otherwise("Bear Put Spread"))
        .when(view == "neutral", F.when(F.col(iv) > 0.3, "Iron Condor").otherwise("Covered Call"))
        .when(view == "volatile", "Long Straddle")
    )


def recommend_strategy(df: DataFrame, outlook="outlook", risk="risk_tolerance", iv="implied_volatility") -> DataFrame:
    unknown = ~F.col(outlook).isin(*OUTLOOKS) | F.col(outlook).isNull()
    return df.withColumn("strategy", strategy_name(outlook, risk, iv)).withColumn(
        "error", F.when(unknown, F.concat(F.lit("Unknown market outlook: "), F.coalesce(F.col(outlook), F.lit("null"))))
    )


def _leg(leg, price) -> Column:
    action, kind, multiple, quantity = leg
    strike = price * multiple if multiple is not None else F.lit(None).cast("double")
    return F.struct(
        F.lit(action).alias("action"),
        F.lit(kind).alias("option_type"),
        strike.alias("strike"),
        F.lit(quantity).cast("bigint").alias("quantity"),
    )


def _choose(name, values: dict) -> Column:
    chain = None
    for key, value in values.items():
        chain = (F if chain is None else chain).when(F.col(name) == key, value)
    return chain


def strategy_legs(df: DataFrame, price="current_price", dte="time_to_expiration", name="strategy") -> DataFrame:
    p = F.col(price)
    legs, profit = {}, {}
    for key, (parts, _, text, _, _) in LEGS.items():
        legs[key] = F.array(*[_leg(x, p) for x in parts])
        strikes = [x[2] for x in parts]
        width = p * max(strikes) - p * min(strikes) if text is None else None
        profit[key] = F.lit(text) if text else F.concat(F.lit("$"), width.cast("string"), F.lit(" - Net Premium"))
    cap = _choose(name, {k: F.lit(v[1]) for k, v in LEGS.items()})
    return df.withColumns(
        {
            "legs": _choose(name, legs),
            "max_profit": _choose(name, profit),
            "max_loss": _choose(name, {k: F.lit(v[3]) for k, v in LEGS.items()}),
            "breakeven": _choose(name, {k: F.lit(v[4]) for k, v in LEGS.items()}),
            "recommended_dte": F.when(cap.isNotNull(), F.least(F.col(dte), cap)),
        }
    )


def explode_legs(df: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c != "legs"]
    return df.select(*kept, F.posexplode("legs").alias("leg_no", "leg")).select(*kept, "leg_no", "leg.*")


def prediction_consistency(predictions: DataFrame, by="symbol", ts="ts", predicted="predicted_price", tie=()) -> DataFrame:
    """Mean agreement of each of the last 10 predictions with its successor, in percent; 75 without any."""
    recent = last_n(predictions, 11, by, ts, tie)
    return _consistency(_recent_lists(recent, by, ts, predicted, tie)).select(by, "consistency")


def _recent_lists(recent: DataFrame, by, ts, predicted, tie) -> DataFrame:
    """At most 11 predictions per key as one array, oldest first."""
    pairs = F.array_sort(F.collect_list(F.struct(ts, *tie, F.col(predicted).alias("_p"))))
    return recent.groupBy(by).agg(F.transform(pairs, lambda x: x["_p"]).alias("_preds"))


def _mean(values: Column) -> Column:
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))


def _consistency(df: DataFrame) -> DataFrame:
    steps = F.zip_with(
        F.slice("_preds", 1, F.greatest(F.size("_preds") - 1, F.lit(0))),
        F.slice("_preds", 2, F.size("_preds")),
        lambda p, a: F.when(a != 0, 1.0 - F.least(F.abs(p - a) / F.when(a != 0, a), F.lit(1.0))),
    )
    known = F.filter(steps, lambda x: x.isNotNull())
    return df.withColumn("consistency", F.coalesce(_mean(known) * 100.0, F.lit(75.0)))


def expiry_strategies(predictions: DataFrame, prices: DataFrame, as_of, *, ts="ts", predicted="predicted_price",
                      price="current_price", tie=()) -> DataFrame:
    """Three expiries per symbol from its last predictions; ``prices`` is one row per symbol.

    Only the last 11 predictions of a symbol are used, so a symbol of any size reaches the
    shuffle as 11 rows per map task.
    """
    c = F.col
    recent = _recent_lists(last_n(predictions, 11, "symbol", ts, tie), "symbol", ts, predicted, tie)
    base = _consistency(recent.join(prices.select("symbol", c(price).alias("_price")), "symbol"))
    last10 = F.slice("_preds", F.greatest(F.size("_preds") - 9, F.lit(1)), 10)
    last3 = F.slice("_preds", F.greatest(F.size("_preds") - 2, F.lit(1)), 3)
    base = base.withColumns({"_mean10": _mean(last10), "_change": _mean(last3) - c("_price")})
    variance = _mean(F.transform(last10, lambda x: (x - c("_mean10")) * (x - c("_mean10"))))
    up = c("_change") > 0
    base = base.withColumns(
        {
            "volatility": F.sqrt(variance),
            "option_type": F.when(up, "CALL").otherwise("PUT"),
            "strike_price": F.round(c("_price") * F.when(up, 1.02).otherwise(0.98), 2),
            "predicted_move": c("_change") / c("_price") * 100.0,
            "target_1": F.round(c("_price") + c("_change") * 0.5, 2),
            "target_2": F.round(c("_price") + c("_change"), 2),
            "target_3": F.round(c("_price") + c("_change") * 1.5, 2),
            "confidence_1": F.least(F.round("consistency", 1), F.lit(95.0)),
            "confidence_2": F.least(F.round(c("consistency") * 0.85, 1), F.lit(85.0)),
            "confidence_3": F.least(F.round(c("consistency") * 0.65, 1), F.lit(70.0)),
        }
    )
    move = F.abs("predicted_move")
    choices = F.array(
        *[
            F.struct(F.lit(d).alias("days"), c(f"target_{i}").alias("_target"))
            for i, d in enumerate(EXPIRY_DAYS, start=1)
        ]
    )
    rows = base.withColumn("_choice", F.explode(choices)).select("*", "_choice.*")
    time_value = c("volatility") * F.sqrt(c("days") / 365.0) * c("_price") * 0.1
    rows = rows.withColumn(
        "premium", F.round(F.abs(c("strike_price") - c("_price")) + time_value, 2)
    ).withColumn("capital_required", F.round(c("premium") * 100.0, 2))
    profit = F.abs(c("_target") - c("strike_price")) * 100.0
    return rows.select(
        "symbol",
        "option_type",
        "days",
        expiry_text(instant(as_of), c("days")).alias("expiry_date"),
        c("_price").alias("stock_price"),
        "strike_price",
        "target_1", "target_2", "target_3",
        "confidence_1", "confidence_2", "confidence_3",
        "capital_required",
        F.when(move < 2, "LOW").when(move < 5, "MEDIUM").otherwise("HIGH").alias("risk_level"),
        F.when(
            c("capital_required") > 0, F.round(F.try_divide(profit, c("capital_required")), 2)
        ).otherwise(0.0).alias("risk_reward"),
        "predicted_move",
    )


def display_strategies(strategies: DataFrame) -> DataFrame:
    """The numeric strategy table as formatted text columns."""
    dollars = ("stock_price", "strike_price", "target_1", "target_2", "target_3", "capital_required")
    shares = ("confidence_1", "confidence_2", "confidence_3")
    return strategies.withColumns(
        {c: money(c) for c in dollars}
        | {c: percent(c) for c in shares}
        | {"risk_reward": F.format_string("%.2f", "risk_reward"), "predicted_move": signed_percent("predicted_move")}
    )


def status_rows(bars: DataFrame, predictions: DataFrame, ts="ts", predicted="predicted_price") -> DataFrame:
    """Per symbol: latest price, change from the bar before, latest prediction, rows."""
    two = first_ranked(bars, "symbol", [F.col(ts).desc()], 2)
    pair = two.groupBy("symbol").agg(
        F.max_by("close", ts).alias("current_price"), F.min_by("close", ts).alias("previous_price")
    )
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("data_points"))
    newest = predictions.filter(F.col(predicted).isNotNull()).groupBy("symbol").agg(
        F.max_by(predicted, ts).alias("predicted_price")
    )
    change = F.col("current_price") - F.col("previous_price")
    return (
        pair.join(counts, "symbol").join(newest, "symbol", "left")
        .withColumns(
            {
                "change": change,
                "change_pct": F.try_divide(change, F.col("previous_price")) * 100.0,
                "prediction_diff": F.col("predicted_price") - F.col("current_price"),
            }
        )
    )
