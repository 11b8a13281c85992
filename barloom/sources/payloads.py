"""Nested payloads to rows: option chains, news feeds, chain joins, wide columns, points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions.mathfn import first_key


def explode_chain(payloads: DataFrame, value="value") -> DataFrame:
    """One row per contract; a chain without contracts keeps one row of nulls."""
    parsed = payloads.select(F.from_json(value, schemas.CHAIN_PAYLOAD).alias("p"))
    contract = F.explode_outer("p.data.results").alias("c")
    return parsed.select("p.symbol", contract).select(
        "symbol",
        F.col("c.strike_price").alias("strike"),
        F.to_date(F.try_to_timestamp("c.expiration_date")).alias("expiration"),
        F.col("c.contract_type").alias("option_type"),
    )


def explode_news(payloads: DataFrame, value="value") -> DataFrame:
    """One row per article with its key: the id, else the first 50 characters of the headline."""
    parsed = payloads.select(F.from_json(value, schemas.NEWS_PAYLOAD).alias("p"))
    articles = parsed.select(F.explode("p.feed").alias("a")).select("a.*")
    return articles.withColumn("key", first_key("id", "headline"))


def chain_sides(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Separate call and put tables as one chain with option_type."""
    return calls.withColumn("option_type", F.lit("call")).unionByName(
        puts.withColumn("option_type", F.lit("put")), allowMissingColumns=True
    )


def wide_to_long(df: DataFrame, symbols: Sequence[str], fields: Sequence[str], keep=("ts",), sep="_") -> DataFrame:
    """Columns named symbol<sep>field to one row per symbol; rows without any value are dropped."""
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{s}{sep}{f}`").alias(f) for f in fields])
            for s in symbols
        ]
    )
    long = df.select(*keep, F.explode(rows).alias("_r")).select(*keep, "_r.*")
    return long.dropna(how="all", subset=list(fields))


# Measurement names with their tags.
POINT_TAGS = {
    "stock_price": ("symbol",),
    "option_quote": ("symbol", "options_ticker", "option_type", "expiration"),
    "option_greeks": ("options_ticker",),
    "technical_indicators": ("symbol",),
    "prediction": ("symbol", "model_name", "horizon"),
}


def wide_to_points(df: DataFrame, measurement: str, fields: Sequence[str], tags: Sequence[str] | None = None, ts="ts") -> DataFrame:
    """One row per non-null field, value as double."""
    tags = POINT_TAGS[measurement] if tags is None else tags
    pairs = [x for t in tags for x in (F.lit(t), F.col(t).cast("string"))]
    values = df.select(
        F.lit(measurement).alias("measurement"),
        F.create_map(*pairs).alias("tags"),
        F.col(ts).alias("ts"),
        *[F.col(f).cast("double").alias(f) for f in fields],
    )
    return values.unpivot(["measurement", "tags", "ts"], list(fields), "field", "value").filter(
        F.col("value").isNotNull()
    )


def points_to_wide(points: DataFrame, measurement: str, fields: Sequence[str], tags: Sequence[str] | None = None) -> DataFrame:
    """Field rows back to one row per time and series; the field list is known, so one pass does."""
    tags = POINT_TAGS[measurement] if tags is None else tags
    series = [F.col("tags")[t].alias(t) for t in tags]
    wanted = points.filter((F.col("measurement") == measurement) & F.col("field").isin(*fields))
    return wanted.groupBy("ts", *series).agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields]
    )
