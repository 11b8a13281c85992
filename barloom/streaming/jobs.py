"""Structured Streaming jobs around the batch operators.

Sources and sinks are format names with options: Kafka on a cluster that has its
connector, files elsewhere.  Every sink has a checkpoint of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.options import DIVIDEND, RATE, with_greeks
from barloom.operators import lookup as lk
from barloom.operators import models as md
from barloom.operators import signals as sg
from barloom.operators import validate as va
from barloom.sources import keyledger, readers, writers
from barloom.streaming import state

AVAILABLE = {"availableNow": True}


def greeks_stream(quotes: DataFrame, r=RATE, q=DIVIDEND) -> DataFrame:
    """Quotes to Greeks; no state."""
    return lk.add_meta(with_greeks(quotes, r, q))


def event_time_bars(ticks: DataFrame, every="1 hour", slide: str | None = None, delay="10 minutes",
                    price="price", tie: Sequence[str] = (), ts="ts") -> DataFrame:
    """Bars from ticks once the watermark has passed their window; later ticks are dropped."""
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    order = F.struct(ts, *tie) if tie else F.col(ts)
    return (
        ticks.withWatermark(ts, delay)
        .groupBy(window.alias("_w"), "symbol")
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            F.count(F.lit(1)).alias("volume"),
        )
        .select(F.col("_w.start").alias("ts"), "symbol", "open", "high", "low", "close", "volume")
    )


def once_per_key(messages: DataFrame, keys: Sequence[str], delay="10 minutes", ts="ts") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark delay."""
    return messages.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def once_ever(messages: DataFrame, keys: Sequence[str], ledger: str, out: str, checkpoint: str, ts="ts", order=(), trigger=None,
              observe: Callable[[int, dict], None] | None = None):
    """Each key once, however late its repeats come: a stored ledger remembers what the watermark forgets.

    ``observe`` is told, per micro-batch, how many dates the ledger holds and how many of them were read.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        fresh, figures = keyledger.admit(batch.sparkSession, ledger, batch, keys, batch_id, ts, order)
        write_batch(fresh, out, batch_id)
        if observe:
            observe(batch_id, figures)

    return _start(messages, handle, checkpoint, trigger)


def fresh_only(messages: DataFrame, text="timestamp", as_of=None, max_age: float = 86_400) -> DataFrame:
    """Keep messages not older than ``max_age`` seconds and not from the future."""
    now = F.current_timestamp() if as_of is None else as_of
    return va.validate_timestamps(messages, now, text, max_age).filter("is_valid").drop("errors", "is_valid")


def _start(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None):
    w = df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def start_sinks(df: DataFrame, root: str, checkpoint: str, key="symbol", partitions=("date", "symbol"), trigger=None,
                console: bool = False, kafka: dict | None = None) -> list:
    """JSON messages, partitioned Parquet and optionally the console, one query each."""
    fmt, options, path = ("kafka", kafka, None) if kafka else ("json", {}, f"{root}/messages")
    queries = [
        writers.write_stream_json(df, key, fmt, options, f"{checkpoint}/messages", path, trigger),
        writers.write_stream_parquet(df, f"{root}/table", f"{checkpoint}/table", partitions, trigger),
    ]
    if console:
        queries.append(writers.write_stream_console(df, f"{checkpoint}/console", trigger))
    return queries


def fan_out(df: DataFrame, sinks: Sequence[Callable[[DataFrame, int], None]], checkpoint: str, trigger=None):
    """Several sinks off one read of the source: each micro-batch is kept while all are written."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    return _start(df, handle, checkpoint, trigger)


def write_batch(batch: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten if the batch is repeated after a failure."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def validated_stream(df: DataFrame, kind: str, accepted: str, quarantine: str, checkpoint: str, trigger=None):
    """Valid rows to one table, the rest with their errors to another."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        checked = va.VALIDATORS[kind](batch).persist()
        try:
            write_batch(checked.filter("is_valid").drop("errors", "is_valid"), accepted, batch_id)
            write_batch(checked.filter(~F.col("is_valid")), quarantine, batch_id)
        finally:
            checked.unpersist()

    return _start(df, handle, checkpoint, trigger)


def upsert_stream(df: DataFrame, path: str, keys: Sequence[str], checkpoint: str, update_cols=None, order=(), trigger=None):
    """Each micro-batch is merged into a keyed table; repeating a batch changes nothing."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            writers.upsert(batch.sparkSession, path, batch, keys, update_cols, order)

    return _start(df, handle, checkpoint, trigger)


def prediction_cycle(features: DataFrame, models: DataFrame, feature_names: Sequence[str], predictions: str, signals: str,
                     checkpoint: str, model_name="short_term", horizon="short", trigger=None, every: timedelta | None = None):
    """Features to stored predictions and signals, every 60 seconds unless told otherwise.

    ``models`` comes from ``train_per_symbol``.  Without ``every`` the newest row per symbol of a micro-batch is predicted.
    With it, every symbol seen so far is predicted once per interval from the newest features that are known of it, also
    if nothing new came in; the prediction's time is then that of the cycle.  That needs the RocksDB state store.
    """
    rows = state.newest_every(features, every) if every else features

    def handle(batch: DataFrame, batch_id: int) -> None:
        newest = batch.withColumn("ts", F.col("cycle")).drop("cycle") if every else lk.latest(batch)
        made = md.predict_per_symbol(newest, models, feature_names, out="predicted_price").withColumns(
            {"current_price": F.col("close"), "confidence": F.lit(0.5)}
        ).persist()
        try:
            if made.isEmpty():
                return
            stored = made.select(
                F.col("ts").alias("prediction_time"), "symbol", F.lit(model_name).alias("model_name"),
                F.lit(horizon).alias("horizon"), "predicted_price", "confidence",
            )
            keys = ["symbol", "model_name", "horizon", "prediction_time"]
            writers.upsert(batch.sparkSession, predictions, stored, keys, ts="prediction_time")
            signal = sg.to_signal_table(sg.generate_signals(made, horizon, volatility="volatility_20d"))
            writers.upsert(batch.sparkSession, signals, signal.withColumn("metadata", F.to_json("metadata")),
                           ["symbol", "strategy", "ts"])
        finally:
            made.unpersist()

    return _start(rows, handle, checkpoint, trigger or {"processingTime": "60 seconds"})


def greeks_job(spark: SparkSession, source: dict, root: str, checkpoint: str, trigger=None) -> list:
    """Quote messages to Greeks messages and table; ``source`` has fmt, options and path."""
    return start_sinks(greeks_stream(readers.read_quote_stream(spark, **source)), root, checkpoint,
                       key="options_ticker", trigger=trigger)


def finish(queries) -> None:
    """Wait for queries started with availableNow; a failure is raised here."""
    for q in queries if isinstance(queries, (list, tuple)) else [queries]:
        q.awaitTermination()
