"""Record checks.  Each adds ``errors ARRAY<STRING>`` and ``is_valid``.

A check on absent columns or null values is skipped; only the chain check
requires its fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.mathfn import age_seconds, parse_iso
from barloom.operators import ordered as o
from barloom.operators.lookup import instant
from barloom.operators.quantiles import exact_quantiles


def _text(template: str, *cols) -> Column:
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, tail in zip(cols, parts[1:]):
        out += [F.col(c).cast("string"), F.lit(tail)]
    return F.concat(*out)


def _with_errors(df: DataFrame, checks: list[tuple[Column, Column | str]]) -> DataFrame:
    found = [F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks]
    errors = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    return df.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)


def _has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


# Fixed values, here and below: the error texts and the limits.


def validate_bars(df: DataFrame) -> DataFrame:
    c, checks = F.col, []
    if _has(df, "open", "high", "low", "close"):
        ohlc = ("open", "high", "low", "close")
        known = c("open").isNotNull() & c("high").isNotNull() & c("low").isNotNull() & c("close").isNotNull()
        checks += [
            (known & (F.least(*ohlc) <= 0), "Non-positive OHLC values"),
            (known & (c("low") > c("high")), _text("Low ({}) > High ({})", "low", "high")),
            (known & ~c("open").between(c("low"), c("high")),
             _text("Open ({}) not between Low ({}) and High ({})", "open", "low", "high")),
            (known & ~c("close").between(c("low"), c("high")),
             _text("Close ({}) not between Low ({}) and High ({})", "close", "low", "high")),
        ]
    if _has(df, "volume"):
        checks += [
            (c("volume") < 0, "Negative volume"),
            (c("volume") == 0, "Zero volume (may be non-trading period)"),
        ]
    return _with_errors(df, checks)


def validate_quotes(df: DataFrame) -> DataFrame:
    c, checks = F.col, []
    if _has(df, "bid", "ask"):
        known = c("bid").isNotNull() & c("ask").isNotNull()
        spread = F.try_divide(c("ask") - c("bid"), (c("ask") + c("bid")) / 2.0) * 100.0
        checks += [
            (known & ((c("bid") < 0) | (c("ask") < 0)), "Negative bid or ask price"),
            (known & (c("bid") > c("ask")), _text("Bid ({}) > Ask ({})", "bid", "ask")),
            (known & (c("ask") > 0) & (spread > 50), F.format_string("Suspicious spread: %.2f%%", spread)),
        ]
    if _has(df, "volume"):
        checks.append((c("volume") < 0, "Negative volume"))
    if _has(df, "implied_volatility"):
        iv = c("implied_volatility")
        checks.append(((iv < 0) | (iv > 5), _text("Suspicious implied volatility: {}", "implied_volatility")))
    return _with_errors(df, checks)


def validate_greeks(df: DataFrame) -> DataFrame:
    c, checks = F.col, []
    if _has(df, "delta"):
        checks.append((~c("delta").between(-1, 1), _text("Delta ({}) out of range [-1, 1]", "delta")))
    if _has(df, "gamma"):
        checks.append((c("gamma") < 0, _text("Negative gamma ({})", "gamma")))
    if _has(df, "vega"):
        checks.append((c("vega") < 0, _text("Negative vega ({})", "vega")))
    if _has(df, "theta"):
        checks.append((c("theta") > 1, _text("Unusually high positive theta ({})", "theta")))
    return _with_errors(df, checks)


def validate_chain(df: DataFrame) -> DataFrame:
    """Chain payloads: symbol, data.results[]; one error per failed check and contract."""
    def contract(x):
        strike, kind = x["strike_price"], x["contract_type"]
        return F.array(
            F.when(strike.isNull() | (strike <= 0), "Invalid strike price in contract"),
            F.when(x["expiration_date"].isNull(), "Missing expiration date"),
            F.when(kind.isNull() | ~kind.isin("call", "put"), "Invalid contract type"),
        )

    fields = F.array(
        F.when(F.col("symbol").isNull(), "Missing required field: symbol"),
        F.when(F.col("data").isNull(), "Missing required field: data"),
    )
    per_contract = F.flatten(F.transform("data.results", contract))
    errors = F.concat(fields, F.coalesce(per_contract, F.array().cast("array<string>")))
    return df.withColumn("errors", F.filter(errors, lambda x: x.isNotNull())).withColumn(
        "is_valid", F.size("errors") == 0
    )


def validate_timestamps(df: DataFrame, as_of, text="timestamp", max_age: float = 86_400) -> DataFrame:
    """Unparsable, too old or future timestamps."""
    age = F.col("_age")
    aged = df.withColumn("_age", age_seconds(parse_iso(text), instant(as_of)))
    checks = [
        (age.isNull(), "Invalid timestamp format"),
        (age > max_age, F.format_string("Timestamp too old: %.1f hours", age / 3600.0)),
        (age < 0, F.format_string("Timestamp in future: %.1f minutes", -age / 60.0)),
    ]
    return _with_errors(aged, checks).drop("_age")


VALIDATORS = {
    "options_chain": validate_chain,
    "quote": validate_quotes,
    "price": validate_bars,
    "greeks": validate_greeks,
}


def flag_outliers(df: DataFrame, column: str, method="iqr", threshold: float = 3.0, by=()) -> DataFrame:
    """Add ``is_outlier`` by interquartile range or z-score, over the table or per group."""
    by = o.keys(by)
    x = F.col(column)
    if method == "iqr":
        stats = exact_quantiles(df, column, [0.25, 0.75], by)
        reach = (F.col("q_1") - F.col("q_0")) * threshold
        flag = (x < F.col("q_0") - reach) | (x > F.col("q_1") + reach)
    elif method == "zscore":
        stats = df.groupBy(*by).agg(F.avg(x).alias("q_0"), F.stddev_samp(x).alias("q_1"))
        flag = F.abs(F.try_divide(x - F.col("q_0"), F.col("q_1"))) > threshold
    else:
        raise ValueError(f"Unknown method: {method}")
    if by:
        joined = df.join(stats, by, "left")
    else:
        joined = df.withColumn("_s", stats.select(F.struct("q_0", "q_1")).scalar()).select("*", "_s.*").drop("_s")
    return joined.withColumn("is_outlier", F.coalesce(flag, F.lit(False))).drop("q_0", "q_1")


def validation_summary(df: DataFrame, kind: str) -> DataFrame:
    """One row: total, valid, invalid and success_rate in percent."""
    checked = VALIDATORS[kind](df)
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
    ).withColumn(
        "success_rate",
        F.coalesce(F.try_divide(F.col("valid").cast("double"), F.col("total")) * 100.0, F.lit(0.0)),
    )


def validation_errors(df: DataFrame, kind: str) -> DataFrame:
    """The invalid rows' errors, each with the first 100 characters of the record."""
    sample = F.substring(F.to_json(F.struct(*df.columns)), 1, 100)
    checked = VALIDATORS[kind](df).withColumn("data_sample", sample)
    return checked.filter(~F.col("is_valid")).select("errors", "data_sample")


def split_valid(df: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows in their own columns, quarantined rows with their errors)."""
    checked = VALIDATORS[kind](df)
    return checked.filter("is_valid").drop("errors", "is_valid"), checked.filter(~F.col("is_valid"))
