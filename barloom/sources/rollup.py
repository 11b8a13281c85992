"""Bars that grow with their ticks: states that merge in any order, and raw days that go once they are rolled up.

A bar's state is its values with the order keys of its first and last tick, so the state of all ticks is the merge of the
states of any parts of them.  Only the days that new ticks touch are read and rewritten (``writers.upsert``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators import ordered as o
from barloom.sources import writers

BAR = ("open", "high", "low", "close", "volume")


def bar_states(ticks: DataFrame, every: str = "1 hour", price: str | Column = "price", volume: Column | None = None, by="symbol", ts="ts", tie: Sequence[str] = ()) -> DataFrame:
    """(ts, by, bar, first, last): like ``resample_ohlcv``, with the order keys of the first and the last tick.

    Ticks without a time or key have no bar; those without a price count for the volume only.
    """
    price = F.col(price) if isinstance(price, str) else price
    own, amount = F.struct(ts, *tie), F.lit(1) if volume is None else volume
    priced = F.when(price.isNotNull(), own)
    return (
        ticks.dropna(subset=[*o.keys(by), ts]).groupBy(*o.keys(by), F.window(ts, every).alias("_w"))
        .agg(
            F.min_by(price, priced).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, priced).alias("close"),
            F.sum(amount).cast("bigint").alias("volume"), F.min(priced).alias("first"), F.max(priced).alias("last"),
        )
        .select(F.col("_w.start").alias("ts"), *o.keys(by), *BAR, "first", "last")
    )


def merge_states(states: DataFrame, by="symbol") -> DataFrame:
    """One state per bar from any number of states of its ticks."""
    return states.groupBy("ts", *o.keys(by)).agg(
        F.min_by("open", "first").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last").alias("close"),
        F.sum("volume").alias("volume"), F.min("first").alias("first"), F.max("last").alias("last"),
    )


def add_ticks(spark: SparkSession, path: str, ticks: DataFrame, token: str | Column, **options) -> str:
    """Merge the bars of ``ticks`` into the table at ``path``.

    ``token`` names this batch (a Column over the bar's ``ts`` if every day has its own).  A stored bar knows the batch merged
    into it last, so a batch that is sent again after a failure changes nothing; batches come one after the other.
    """
    token = F.lit(token) if isinstance(token, str) else token
    new = bar_states(ticks, **options).withColumn("token", token)
    keys = [*o.keys(options.get("by", "symbol")), "ts"]
    known = [*keys, "token"]

    def merge(stored: DataFrame, updates: DataFrame) -> DataFrame:
        again = stored.select(*[F.col(k).alias(f"_{k}") for k in known])
        fresh = updates.join(again, [F.col(k) == F.col(f"_{k}") for k in known], "left_anti")
        both = stored.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        merged = merge_states(both, keys[:-1]).join(both.groupBy(*keys).agg(F.max_by("token", "_new").alias("token")), keys)
        return merged.withColumn("date", F.to_date("ts")).select(*updates.columns)

    return writers.upsert(spark, path, new, keys, merge=merge)


def read_bars(spark: SparkSession, path: str, by="symbol") -> DataFrame:
    return writers.read_current(spark, path).select("ts", *o.keys(by), *BAR)


def roll_up(spark: SparkSession, raw: str, bars: str, as_of: date, keep_days: int, **options) -> list[str]:
    """Merge the raw ``date=...`` partitions older than ``keep_days`` into the bars at ``bars``, then delete them; returns their names.

    All these days are one update; each is merged under a token made of its file names.  Bars must not span days.  A job that dies in between finds the same files and so
    changes nothing when it is run again; ticks that come later for a day already gone are a new partition with other files
    and are merged into its bars.  Rows without a time stay.
    """
    limit, tokens = as_of - timedelta(days=keep_days), {}
    for name in writers.partitions_of(spark, raw):
        day = writers.partition_date(name)
        if day is not None and day < limit:
            fs, place = writers._fs(spark, f"{raw.rstrip('/')}/{name}")
            files = sorted(f.getPath().getName() for f in fs.listStatus(place))
            tokens[name] = (day, hashlib.md5("\n".join(files).encode()).hexdigest())
    if not tokens:
        return []
    ticks = spark.read.option("basePath", raw).parquet(*[f"{raw.rstrip('/')}/{name}" for name in tokens])
    by_day = F.create_map(*[F.lit(x) for day, token in tokens.values() for x in (day, token)])
    add_ticks(spark, bars, ticks, F.element_at(by_day, F.to_date("ts")), **options)
    for name in tokens:
        fs, place = writers._fs(spark, f"{raw.rstrip('/')}/{name}")
        fs.delete(place, True)
    return list(tokens)
