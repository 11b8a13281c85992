"""Scans: tables, per-symbol CSV files, message streams, and resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.functions.mathfn import parse_iso
from barloom.operators import ordered as o


def read_messages(spark: SparkSession, fmt: str, options: dict, path: str | None = None, stream: bool = True) -> DataFrame:
    """A frame with the message text in ``value``; Kafka needs its connector on the classpath."""
    reader = (spark.readStream if stream else spark.read).format(fmt).options(**options)
    raw = reader.load(path) if path else reader.load()
    return raw.withColumn("value", F.col("value").cast("string"))


def parse_bars(messages: DataFrame) -> DataFrame:
    m = messages.select(F.from_json("value", schemas.BAR_MESSAGE).alias("m")).select("m.*")
    return m.select(parse_iso("timestamp").alias("ts"), "symbol", "data.*")


def parse_quotes(messages: DataFrame) -> DataFrame:
    """Flat messages and messages wrapped under ``data``."""
    m = messages.select(F.from_json("value", schemas.QUOTE_MESSAGE).alias("m")).select("m.*")
    names = [f.name for f in schemas.QUOTE_MESSAGE if f.name != "data"]
    flat = m.select(*[F.coalesce(F.col(n), F.col("data")[n]).alias(n) for n in names])
    return flat.select(
        parse_iso("timestamp").alias("ts"),
        *[n for n in names if n not in ("timestamp", "expiration")],
        parse_iso("expiration").cast("date").alias("expiration"),
    )


def read_bar_stream(spark, fmt="kafka", options=None, path=None) -> DataFrame:
    return parse_bars(read_messages(spark, fmt, options or {}, path))


def read_quote_stream(spark, fmt="kafka", options=None, path=None) -> DataFrame:
    return parse_quotes(read_messages(spark, fmt, options or {}, path))


def read_symbol_csvs(spark: SparkSession, path: str, schema: T.StructType | None = None,
                     suffix_pattern: str = r"([^/]+?)(?:_\w+)?\.csv$", ts: str = "timestamp") -> DataFrame:
    """CSV files per symbol: symbol from the file's path, lower-case columns, parsed time."""
    reader = spark.read.option("header", True)
    raw = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    symbol = F.regexp_extract(F.col("_metadata.file_path"), suffix_pattern, 1)
    with_symbol = raw.select("*", symbol.alias("symbol"))
    lower = with_symbol.toDF(*[c.lower() for c in with_symbol.columns])
    return lower.withColumn(ts, F.col(ts).cast("timestamp")).withColumnRenamed(ts, "ts")


def read_table(spark: SparkSession, name: str, path: str | None = None, jdbc: dict | None = None) -> DataFrame:
    """One of the six record tables, from Parquet or from a database whose driver is present."""
    if jdbc is not None:
        return spark.read.format("jdbc").options(**jdbc).load()
    return spark.read.schema(schemas.TABLES[name]).parquet(path)


def resample_ohlcv(ticks: DataFrame, every="1 hour", price: str | Column = "price", volume: Column | None = None,
                   by="symbol", ts="ts", tie=()) -> DataFrame:
    """Ticks (or bars) to bars of ``every``.  Plain aggregates, pre-reduced before the shuffle."""
    price = F.col(price) if isinstance(price, str) else price
    order = F.struct(ts, *tie) if tie else F.col(ts)
    amount = F.count(F.lit(1)) if volume is None else F.sum(volume)
    return (
        ticks.groupBy(*o.keys(by), F.window(ts, every).alias("_w"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            amount.cast("bigint").alias("volume"),
        )
        .select(F.col("_w.start").alias("ts"), *o.keys(by), "open", "high", "low", "close", "volume")
    )


def bars_to_bars(bars: DataFrame, every: str, by="symbol", ts="ts") -> DataFrame:
    """Coarser bars from finer ones."""
    return (
        bars.groupBy(*o.keys(by), F.window(ts, every).alias("_w"))
        .agg(
            F.min_by("open", ts).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", ts).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select(F.col("_w.start").alias("ts"), *o.keys(by), "open", "high", "low", "close", "volume")
    )


def adjust_bars(bars: DataFrame, splits: DataFrame, dividends: DataFrame, rows=o.CHUNK_ROWS, slot=o.SLOT) -> DataFrame:
    """Prices before a split or dividend are scaled to today's terms.

    A split of ratio r scales earlier prices by 1/r (and volume by r), a dividend d by
    1 - d / previous close.  Actions carry the time of the bar they take effect on, as
    ``(symbol, ts, ratio)`` and ``(symbol, ts, amount)``.  The factor of a bar is the
    product over later bars: a suffix sum of logarithms, whose part beyond the bar's own
    time slot comes from the slot table.
    """
    acted = bars.join(splits.select("symbol", "ts", "ratio"), ["symbol", "ts"], "left").join(
        dividends.select("symbol", "ts", "amount"), ["symbol", "ts"], "left"
    )

    def own_factor(df, w):
        paid = 1.0 - F.coalesce(F.try_divide(F.col("amount"), F.lag("close").over(w)), F.lit(0.0))
        split = F.coalesce(F.col("ratio"), F.lit(1.0))
        return df.withColumns({"_lnf": F.ln(paid) - F.ln(split), "_lns": F.ln(split)})

    factored = o.ordered(acted, own_factor, back=1, rows=rows, slot=slot)

    def later(table):
        after = W.partitionBy("symbol").orderBy("_slot").rowsBetween(1, W.unboundedFollowing)
        return table.withColumns(
            {f"_a{c}": F.coalesce(F.sum(f"_s{c}").over(after), F.lit(0.0)) for c in ("_lnf", "_lns")}
        ).drop("_s_lnf", "_s_lns")

    extra = [F.sum(c).alias(f"_s{c}") for c in ("_lnf", "_lns")]
    cut = o.spread(factored, rows=rows, slot=slot, extra=extra, carry=later)
    # Inside a slot: the bars after this one.
    in_slot = W.partitionBy("symbol", "_chunk", "_slot").orderBy("ts").rowsBetween(1, W.unboundedFollowing)
    sums = cut.withColumns(
        {f"_t{c}": F.coalesce(F.sum(c).over(in_slot), F.lit(0.0)) + F.col(f"_a{c}") for c in ("_lnf", "_lns")}
    )
    factor = F.exp("_t_lnf")
    adjusted = sums.withColumns(
        {c: F.col(c) * factor for c in schemas.OHLC}
        | {"volume": F.round(F.col("volume") * F.exp("_t_lns")).cast("bigint"), "adjustment": factor}
    )
    return o.settle(adjusted).select(*bars.columns, "adjustment")
