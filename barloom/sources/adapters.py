"""The driver's tables in the shapes the operators read (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.options import with_values
from barloom.sources.readers import resample_ohlcv

LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream.  The glob lets the source accept a single file too."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def ticks(spark, sf_dir) -> DataFrame:
    return ticks_from(table(spark, sf_dir, "events"))


def ticks_from(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("symbol"),
        F.col("value").alias("price"),
        "event_id",
    )


def bars_hourly(spark, sf_dir) -> DataFrame:
    return resample_ohlcv(ticks(spark, sf_dir), "1 hour", tie=("event_id",))


def bars_daily(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_returnflag").alias("symbol"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        *LINE_ORDER,
    )
    return resample_ohlcv(lines, "1 day", volume=F.col("l_quantity"), tie=LINE_ORDER)


def quotes(spark, sf_dir) -> DataFrame:
    return quotes_from(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part"))


def quotes_from(line: DataFrame, part: DataFrame) -> DataFrame:
    """Quotes with underlying price, true volatility and years to expiry; no model price yet."""
    c = F.col
    return line.join(part, c("l_partkey") == c("p_partkey")).select(
        c("l_shipdate").cast("timestamp").alias("ts"),
        c("p_brand").alias("symbol"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("options_ticker"),
        (c("p_retailprice") * (c("l_linenumber") * 0.05 + 0.80)).alias("strike"),
        F.date_add(F.to_date("l_shipdate"), F.floor(c("l_quantity") * 365.25 / 100.0).cast("int")).alias("expiration"),
        F.when(c("l_linestatus") == "O", "call").otherwise("put").alias("option_type"),
        c("p_retailprice").alias("underlying_price"),
        (c("l_discount") * 3.0 + 0.10).alias("implied_volatility"),
        (c("l_quantity") / 100.0).alias("time_to_expiration"),
        c("l_quantity").cast("bigint").alias("volume"),
        (c("l_quantity") * 10.0).cast("bigint").alias("open_interest"),
    )


def priced_quotes(spark, sf_dir) -> DataFrame:
    priced = with_values(quotes(spark, sf_dir), ("price",))
    return priced.withColumns(
        {"last": F.col("price"), "bid": F.col("price") * 0.95, "ask": F.col("price") * 1.05}
    ).drop("price")


def universe(spark, sf_dir) -> DataFrame:
    """sector, rank, symbol: the distinct (type, brand) pairs, ranked by brand."""
    pairs = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("sector"), F.col("p_brand").alias("symbol")
    ).distinct()
    return pairs.withColumn("rank", F.row_number().over(W.partitionBy("sector").orderBy("symbol")).cast("bigint"))


def legs_input(spark, sf_dir) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.col("p_retailprice").alias("current_price"),
        F.element_at(F.array(*map(F.lit, ("bullish", "bearish", "neutral", "volatile"))), size % 4 + 1).alias("outlook"),
        F.element_at(F.array(*map(F.lit, ("conservative", "moderate", "aggressive"))), size % 3 + 1).alias("risk_tolerance"),
        (size / 100.0).alias("implied_volatility"),
        (size + 10).alias("time_to_expiration"),
    )


def news(spark, sf_dir) -> DataFrame:
    """Scored articles; one per hour in id order from 2024 on."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("symbol"),
        (F.col("quality") - F.col("toxic")).cast("double").alias("score"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 3600).alias("ts"),
    )
