"""Queries: stored tables read back, and streaming jobs run until their input is used up."""

from __future__ import annotations

import time
from datetime import date, timedelta

from pyspark.sql import functions as F

from barloom.operators import signals as sg
from barloom.operators import indicators as ind
from barloom.plans import quality, shapes, trading, windows
from barloom.plans import sql_views as v
from barloom.plans.registry import add
from barloom.sources import adapters as a
from barloom.sources import openfields as of
from barloom.sources import readers, rollup, writers
from barloom.sources.messagelog import MessageLog
from barloom.sources.storage import drop_old_partitions, shared_dir, staged
from barloom.streaming import jobs, observed, state

KEY = ("ts", "symbol")
OHLC = ("open", "high", "low", "close")
TICKER = ("options_ticker",)


def drained(spark, frame, name):
    """Run a stream over all its input into a table and read that."""
    root = shared_dir(spark, name)
    q = frame.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    jobs.finish(q.trigger(**jobs.AVAILABLE).start(f"{root}/out"))
    return spark.read.schema(frame.schema).parquet(f"{root}/out")


# --- stored tables ----------------------------------------------------------


def _stored_bars(s, d):
    path = shared_dir(s, "bars")
    a.bars_hourly(s, d).write.parquet(path)
    return readers.read_table(s, "bars", path)


add("s04_read_table", _stored_bars, (*KEY, "volume"), OHLC, "SELECT * FROM bars", (v.BARS,))


def _symbol_files(s, d):
    path = shared_dir(s, "symbols")
    writers.write_symbol_files(a.bars_hourly(s, d).withColumnRenamed("ts", "Timestamp").withColumnRenamed("close", "Close"), path)
    return readers.read_symbol_csvs(s, f"{path}/symbol=*/", suffix_pattern=r"symbol=([^/]+)/")


add("s03_k07_symbol_files", _symbol_files, (*KEY,), (*OHLC, "volume"), "SELECT * FROM bars", (v.BARS,))


def _upserted(s, d):
    """Bars stored, then changed in place partition by partition."""
    path = shared_dir(s, "upsert")
    base = a.bars_hourly(s, d).withColumn("version", F.lit(0))
    writers.upsert(s, path, base, ["symbol", "ts"], order=["version"])
    writers.upsert(s, path, quality._changes(s, d), ["symbol", "ts"], ["close", "version"], ["version"])
    return writers.read_current(s, path)


add("k04_upsert_table", _upserted, (*KEY, "volume", "version"), ("close", "open"),
    """SELECT ts, symbol, open, close + CASE WHEN hour(ts) < 2 THEN 2 WHEN hour(ts) < 6 THEN 1 ELSE 0 END AS close, volume,
       CASE WHEN hour(ts) < 2 THEN 2 WHEN hour(ts) < 6 THEN 1 ELSE 0 END::INT AS version FROM bars
       UNION ALL SELECT ts + INTERVAL 30 MINUTE, symbol, open, close, volume, 1::INT FROM bars WHERE hour(ts) = 23""", (v.BARS,))


def _some_without_time(df):
    """Every fourth hour's rows lose their time; ``slot`` still tells them apart."""
    return df.withColumn("slot", F.unix_seconds("ts")).withColumn("ts", F.when(F.hour("ts") % 4 != 0, F.col("ts")))


def _upserted_null_times(s, d):
    path, keys = shared_dir(s, "upsert-null"), ["symbol", "slot", "ts"]
    changes = _some_without_time(quality._changes(s, d))
    writers.upsert(s, path, _some_without_time(a.bars_hourly(s, d).withColumn("version", F.lit(0))), keys, order=["version"])
    writers.upsert(s, path, changes, keys, ["close", "version"], ["version"])
    # Once more with a part of the rows without a time only: the others of their partition stay.
    writers.upsert(s, path, changes.where("ts IS NULL AND version = 2"), keys, ["close", "version"], ["version"])
    return writers.read_current(s, path)


add("k04_upsert_null_times", _upserted_null_times, ("symbol", "slot", "ts", "volume", "version"), ("close", "open"),
    """SELECT symbol, epoch(ts)::BIGINT AS slot, CASE WHEN hour(ts) % 4 <> 0 THEN ts END AS ts, open, close + CASE WHEN hour(ts) < 2 THEN 2 WHEN hour(ts) < 6 THEN 1 ELSE 0 END AS close,
       volume, CASE WHEN hour(ts) < 2 THEN 2 WHEN hour(ts) < 6 THEN 1 ELSE 0 END::INT AS version FROM bars
       UNION ALL SELECT symbol, epoch(ts)::BIGINT + 1800, ts + INTERVAL 30 MINUTE, open, close, volume, 1::INT FROM bars WHERE hour(ts) = 23""", (v.BARS,))


def _signal_metadata(s, d):
    """Signals stored with metadata of open fields; a later job adds a field of its own, then signals are found by path."""
    path, keys = shared_dir(s, "signal-metadata"), ["symbol", "strategy", "ts"]
    made = staged(shapes.signals(s, d).select("ts", "symbol", "signal_type", "confidence", "target_1", "stop_loss", "expected_return", "technical_score", "momentum_score",
                                              "position_size", "risk_reward_ratio", F.to_json(F.struct("symbol")).alias("tags")), "signals")
    writers.upsert(s, path, sg.to_signal_table(made, more=()), keys, order=["confidence"])
    later = made.where(F.hour("ts") < 6).withColumns({"model": F.struct(F.lit("v2").alias("version"), F.hour("ts").alias("hour")), "tags": F.array("symbol", "signal_type")})
    writers.upsert(s, path, sg.to_signal_table(later, more=("model", "tags")), keys, order=["confidence"])
    stored = writers.read_current(s, path).withColumns({
        "score": of.at("metadata", "$.technical_score", "double"), "version": of.at("metadata", "$.model.version", "string"),
        "hour": of.at("metadata", "$.model.hour", "string"), "tag": of.at("metadata", "$.tags[1]", "string")})
    return stored.where(of.present("metadata", "$.model") | (F.col("score") > 0.5))


add("k04_signal_metadata", _signal_metadata, (*KEY, "signal_type", "version", "hour", "tag"), ("confidence", "score"),
    """SELECT ts, symbol, signal_type, confidence, technical_score AS score, CASE WHEN hour(ts) < 6 THEN 'v2' END AS version, CASE WHEN hour(ts) < 6 THEN hour(ts)::VARCHAR END AS hour,
       CASE WHEN hour(ts) < 6 THEN signal_type END AS tag FROM signals WHERE hour(ts) < 6 OR technical_score > 0.5""", v.signal_ctes())


def _training_results(s, d):
    path = shared_dir(s, "results")
    writers.write_results(trading._one_feature(s, d)[1], path)
    return s.read.option("header", True).schema(
        "symbol STRING, train_rows BIGINT, test_rows BIGINT, n_features BIGINT, train_mae DOUBLE, test_mae DOUBLE").csv(path)


add("k09_training_results", _training_results, ("symbol", "train_rows", "test_rows"), ("train_mae", "test_mae"),
    """SELECT symbol, count(*) FILTER (i <= floor(n * 0.8::DOUBLE)) AS train_rows, count(*) FILTER (i > floor(n * 0.8::DOUBLE)) AS test_rows,
       avg(abs(target - b * close - c)) FILTER (i <= floor(n * 0.8::DOUBLE)) AS train_mae, avg(abs(target - b * close - c)) FILTER (i > floor(n * 0.8::DOUBLE)) AS test_mae
       FROM td JOIN fit USING (symbol) GROUP BY 1""", (v.BARS, trading.ONE, trading.FIT))


def _retained(s, d):
    path = shared_dir(s, "retention")
    a.bars_hourly(s, d).withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    drop_old_partitions(s, path, date(2024, 1, 30), 7)
    return s.read.parquet(path)


add("st10_retention", _retained, KEY, ("close",), "SELECT * FROM bars WHERE ts::DATE >= DATE '2024-01-23'", (v.BARS,))

# --- message streams --------------------------------------------------------

# A compressed file is read by one task: rows a file may have.
FILE_ROWS = 200_000


def _sent(messages, name):
    """Messages as text files in a folder of their own; JSON repeats its names in every row, so the files are compressed."""
    path = shared_dir(messages.sparkSession, name)
    messages.write.option("maxRecordsPerFile", FILE_ROWS).text(path, compression="gzip")
    return path


def _bar_messages(s, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    body = F.struct(*OHLC, "volume").alias("data")
    return _sent(a.bars_hourly(s, d).select(F.to_json(F.struct("symbol", stamp, body)).alias("value")), "bar-messages")


def _bar_stream(s, d):
    return drained(s, readers.read_bar_stream(s, "text", {}, _bar_messages(s, d)), "bar-stream")


add("s01_bar_stream", _bar_stream, (*KEY, "volume"), OHLC, "SELECT * FROM bars", (v.BARS,))


def _quote_stream(s, d):
    """Half of the messages flat, half wrapped the way the producer wraps them."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")
    fields = ["symbol", "strike", F.col("expiration").cast("string").alias("expiration"), "option_type", "underlying_price", "implied_volatility"]
    flat = F.to_json(F.struct("options_ticker", stamp, *fields))
    nested = F.to_json(F.struct("options_ticker", stamp, F.struct(*fields).alias("data")))
    path = _sent(a.quotes(s, d).select(F.when(F.col("volume") % 2 == 0, flat).otherwise(nested).alias("value")), "quote-messages")
    return drained(s, readers.read_quote_stream(s, "text", {}, path), "quote-stream")


add("s02_quote_stream", _quote_stream, ("ts", "symbol", *TICKER, "option_type", "expiration"), ("strike", "underlying_price", "implied_volatility"),
    "SELECT * EXCLUDE (expiration), expiration::VARCHAR AS expiration FROM quotes", (v.QUOTES,))

# --- jobs -------------------------------------------------------------------


def _live_quotes(s, d):
    return a.quotes_from(a.stream(s, d, "lineitem"), a.table(s, d, "part"))


add("st01_greeks_stream", lambda s, d: drained(s, jobs.greeks_stream(_live_quotes(s, d)), "greeks"), (*TICKER, "date"),
    ("time_to_expiration", "delta", "gamma", "vega", "theta", "rho", "moneyness", "intrinsic_value"),
    """SELECT options_ticker, ts::DATE::VARCHAR AS date, t AS time_to_expiration, s / k AS moneyness, greatest(CASE WHEN option_type = 'call' THEN s - k ELSE k - s END, 0) AS intrinsic_value,
       CASE WHEN t <= 0 THEN CASE WHEN option_type = 'call' AND s > k THEN 1 ELSE 0 END ELSE delta END AS delta, CASE WHEN t <= 0 THEN 0 ELSE gamma END AS gamma,
       CASE WHEN t <= 0 THEN 0 ELSE vega END AS vega, CASE WHEN t <= 0 THEN 0 ELSE theta END AS theta, CASE WHEN t <= 0 THEN 0 ELSE rho END AS rho FROM greeks""",
    (v.QUOTES, *v.greeks_ctes(t="epoch(expiration::TIMESTAMP - ts) / (365.25::DOUBLE * 24 * 3600)")))

SLICES = ("0001-01-01", "2024-01-11", "2024-01-21", "2999-01-01")


def _stateful(s, d):
    """The bars arrive in three micro-batches; state carries the indicators across them."""
    path = shared_dir(s, "bar-slices")
    bars = a.bars_hourly(s, d)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(provider)
    s.conf.set(provider, state.STATE_STORE)
    try:
        for start, end in zip(SLICES, SLICES[1:]):
            bars.filter((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp"))).write.mode("append").parquet(path)
            # Each run of the job continues from its checkpoint.
            live = s.readStream.schema(bars.schema).parquet(path)
            made = state.streaming_indicators(live)
            q = made.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint")
            jobs.finish(q.trigger(**jobs.AVAILABLE).start(f"{path}-out"))
    finally:
        s.conf.set(provider, before)
    return s.read.schema(made.schema).parquet(f"{path}-out")


add("st02_stateful_indicators", _stateful, (*KEY, "late"),
    ("sma_5", "sma_50", "return_1d", "return_20d", "volatility_20d", "volume_ratio", "rsi", "bb_upper", "bb_lower", "macd", "macd_signal", "macd_ema"),
    "SELECT i.*, false AS late, e12.e - e26.e AS macd_ema FROM ind i JOIN e12 USING (ts, symbol) JOIN e26 USING (ts, symbol)",
    (v.BARS, *v.ind_ctes(), windows.NUMBERED, windows.ema_sql("nb", "close", 12, "e12"), windows.ema_sql("nb", "close", 26, "e26")))


def _two_sinks(s, d):
    """Messages and table written by one job; both are read back."""
    root = shared_dir(s, "sinks")
    live = a.ticks_from(a.stream(s, d, "events")).withColumn("date", F.to_date("ts"))
    jobs.finish(jobs.start_sinks(live, root, f"{root}/checkpoint", trigger=jobs.AVAILABLE))
    stored = s.read.parquet(f"{root}/table").select(F.lit("table").alias("sink"), F.col("symbol").alias("key"), "event_id", "price")
    sent = s.read.schema("key STRING, value STRING").json(f"{root}/messages")
    sent = sent.select(F.lit("messages").alias("sink"), "key", F.from_json("value", "event_id BIGINT, price DOUBLE").alias("v")).select("sink", "key", "v.*")
    return stored.unionByName(sent)


add("st03_k01_k02_sinks", _two_sinks, ("sink", "key", "event_id"), ("price",),
    "SELECT sink, event_type AS key, event_id, value AS price FROM events, (VALUES ('table'), ('messages')) AS t(sink)")


def _validated(s, d):
    root = shared_dir(s, "validated")
    live = quality.spoil_quotes(_live_quotes(s, d))
    jobs.finish(jobs.validated_stream(live, "quote", f"{root}/ok", f"{root}/bad", f"{root}/checkpoint", jobs.AVAILABLE))
    ok = s.read.parquet(f"{root}/ok").select("options_ticker", F.lit(True).alias("accepted"))
    return ok.unionByName(s.read.parquet(f"{root}/bad").select("options_ticker", F.lit(False).alias("accepted")))


add("st04_validated_stream", _validated, (*TICKER, "accepted"), (),
    f"SELECT *, {quality.QUOTE_ERRORS} = '' AS accepted FROM badq", (v.QUOTES, quality.BAD_QUOTES))


def _closed(every, slide=None):
    def run(s, d):
        live = a.ticks_from(a.stream(s, d, "events"))
        return drained(s, jobs.event_time_bars(live, every, slide, tie=("event_id",)), "bars")

    return run


CLOSED = "ts + INTERVAL {n} MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"
add("st05_tumbling_bars", _closed("1 hour"), (*KEY, "volume"), OHLC, f"SELECT * FROM bars WHERE {CLOSED.format(n=60)}", (v.BARS,))
SLIDING = """sliding AS (SELECT ts, symbol, first(price ORDER BY at, event_id) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY at, event_id) AS close, count(*) AS volume FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - to_minutes(30 * k) AS ts,
  ts AS at, symbol, price, event_id FROM ticks, (VALUES (0), (1)) AS s(k)) GROUP BY 1, 2)"""
add("st05_sliding_bars", _closed("1 hour", "30 minutes"), (*KEY, "volume"), OHLC, f"SELECT * FROM sliding WHERE {CLOSED.format(n=60)}",
    (v.TICKS, SLIDING.replace(" at,", " seen,").replace("AS at", "AS seen")))


def _once(s, d):
    """Every event delivered twice."""
    live = a.ticks_from(a.stream(s, d, "events"))
    again = a.ticks_from(a.stream(s, d, "events"))
    return drained(s, jobs.once_per_key(live.unionByName(again), ["event_id"], "1 hour"), "once")


add("st06_once_per_key", _once, ("event_id", "symbol", "ts"), ("price",), "SELECT * FROM ticks", (v.TICKS,))


def _once_ever(s, d):
    """Every event comes again 40 days later under a later time, far beyond any watermark."""
    root = shared_dir(s, "once-ever")
    ticks = a.ticks(s, d).select("event_id", "symbol", "ts", "price")
    for days in (0, 40):
        ticks.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {days} DAYS")).write.mode("append").parquet(f"{root}/in")
        live = s.readStream.schema(ticks.schema).parquet(f"{root}/in")
        jobs.finish(jobs.once_ever(live, ["event_id"], f"{root}/ledger", f"{root}/out", f"{root}/checkpoint", trigger=jobs.AVAILABLE))
    return s.read.parquet(f"{root}/out")


add("st06_once_ever", _once_ever, ("event_id", "symbol", "ts"), ("price",), "SELECT * FROM ticks", (v.TICKS,))


def _upsert_stream(s, d):
    """The day's last price per user and symbol, kept by merging micro-batches."""
    root = shared_dir(s, "upsert-stream")
    live = a.stream(s, d, "events").select(
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), "user_id", F.col("event_type").alias("symbol"),
        F.col("value").alias("price"), "event_id")
    jobs.finish(jobs.upsert_stream(live, f"{root}/table", ["user_id", "symbol", "ts"], f"{root}/checkpoint", order=("event_id",), trigger=jobs.AVAILABLE))
    return writers.read_current(s, f"{root}/table")


add("st07_upsert_stream", _upsert_stream, ("user_id", "symbol", "ts", "event_id"), ("price",),
    """SELECT user_id, event_type AS symbol, date_trunc('day', ts)::TIMESTAMP AS ts, max(event_id) AS event_id, arg_max(value, event_id) AS price
       FROM events GROUP BY 1, 2, 3""")


def _fresh(s, d):
    live = quality.with_stamps(a.stream(s, d, "events"))
    return drained(s, jobs.fresh_only(live, as_of=quality.NOON), "fresh")


add("st08_fresh_only", _fresh, ("event_id", "timestamp"), (),
    f"""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM events WHERE event_id % 10 <> 0
        AND date_trunc('second', ts) BETWEEN TIMESTAMP '{quality.NOON}' - INTERVAL 24 HOUR AND TIMESTAMP '{quality.NOON}'""")


def _cycle(s, d):
    """Models from the history; the newest features of each symbol become predictions and signals."""
    root = shared_dir(s, "cycle")
    models, _ = trading._one_feature(s, d)
    models.write.parquet(f"{root}/models")
    features = ind.indicator_set(a.bars_hourly(s, d))
    features.write.parquet(f"{root}/features")
    live = s.readStream.schema(features.schema).parquet(f"{root}/features")
    jobs.finish(jobs.prediction_cycle(live, s.read.parquet(f"{root}/models"), ("close",), f"{root}/predictions", f"{root}/signals",
                                      f"{root}/checkpoint", trigger=jobs.AVAILABLE))
    made = s.read.parquet(f"{root}/predictions").select("symbol", F.col("prediction_time").alias("ts"), "predicted_price")
    signal = s.read.parquet(f"{root}/signals").select("symbol", "ts", "signal_type", "confidence", "target_price", "stop_loss")
    return made.join(signal, ["symbol", "ts"])


NEWEST = """preds AS (SELECT symbol, max(ts) AS prediction_time, arg_max(close, ts) AS current_price, 0.5::DOUBLE AS confidence,
  any_value(c) + any_value(b) * arg_max(close, ts) AS predicted_price FROM bars JOIN fit USING (symbol) GROUP BY symbol)"""
add("st09_prediction_cycle", _cycle, (*KEY, "signal_type"), ("predicted_price", "confidence", "target_price", "stop_loss"),
    "SELECT *, target_1 AS target_price FROM signals", v.signal_ctes(sg.HORIZON_DAYS["short"], (trading.ONE, trading.FIT, NEWEST)))


def _periodic(s, d):
    """All symbols once, then older rows of one of them: the others are silent, and all are predicted again and again."""
    root = shared_dir(s, "periodic")
    trading._one_feature(s, d)[0].write.parquet(f"{root}/models")
    features = staged(ind.indicator_set(a.bars_hourly(s, d)), "features")
    features.coalesce(1).write.parquet(f"{root}/features")
    features.where("symbol = 'click'").orderBy("ts").limit(5).coalesce(1).write.mode("append").parquet(f"{root}/features")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = s.conf.get(provider)
    s.conf.set(provider, state.STATE_STORE)
    try:
        live = s.readStream.schema(features.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/features")
        q = jobs.prediction_cycle(live, s.read.parquet(f"{root}/models"), ("close",), f"{root}/predictions", f"{root}/signals",
                                  f"{root}/checkpoint", trigger={"processingTime": "1 second"}, every=timedelta(seconds=1))
        end = time.monotonic() + 180
        while q.isActive and time.monotonic() < end and not any(p["batchId"] >= 2 for p in q.recentProgress):
            time.sleep(0.5)
        q.stop()
        if q.exception() is not None:
            raise q.exception()
    finally:
        s.conf.set(provider, before)
    made = writers.read_current(s, f"{root}/predictions")
    return made.groupBy("symbol").agg((F.countDistinct("prediction_time") > 1).alias("again"), F.min("predicted_price").alias("predicted_price"), F.max("predicted_price").alias("highest"))


add("st09_periodic_predictions", _periodic, ("symbol", "again"), ("predicted_price", "highest"),
    "SELECT symbol, true AS again, predicted_price, predicted_price AS highest FROM preds", (v.BARS, trading.ONE, trading.FIT, NEWEST))


def _message_log(s, d):
    """Bars sent to a message log in two batches; a stream reads the first, and after a restart the rest."""
    s.dataSource.register(MessageLog)
    root = shared_dir(s, "log")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    messages = a.bars_hourly(s, d).select(F.col("symbol").alias("key"), F.to_json(F.struct("symbol", stamp, F.struct(*OHLC, "volume").alias("data"))).alias("value"), F.hour("ts").alias("h"))
    options = {"path": f"{root}/log", "partitions": "4"}
    for part in ("h < 12", "h >= 12"):
        writers.send_batch(messages.where(part).drop("h"), "message_log", options, raw=True)
        made = readers.parse_bars(readers.read_messages(s, "message_log", options))
        jobs.finish(made.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(**jobs.AVAILABLE).start(f"{root}/out"))
    return s.read.schema(made.schema).parquet(f"{root}/out")


add("s01_k06_message_log", _message_log, (*KEY, "volume"), OHLC, "SELECT * FROM bars", (v.BARS,))


def _rolled(s, d):
    """Ticks by day in three lots, dealt by event and not by time; days older than a week are rolled up, and ticks for them come once more."""
    root = shared_dir(s, "rollup")
    ticks = a.ticks(s, d).withColumn("date", F.to_date("ts"))
    for lot in range(3):
        ticks.where(F.col("event_id") % 3 == lot).write.mode("append").partitionBy("date").parquet(f"{root}/raw")
        rollup.roll_up(s, f"{root}/raw", f"{root}/bars", date(2024, 1, 30) if lot else date(2024, 1, 10), 7, tie=("event_id",))
    rollup.roll_up(s, f"{root}/raw", f"{root}/bars", date(2100, 1, 1), 7, tie=("event_id",))
    return rollup.read_bars(s, f"{root}/bars")


add("s12_st10_rolled_bars", _rolled, (*KEY, "volume"), OHLC, "SELECT * FROM bars", (v.BARS,))


def _observed(s, d):
    """Checked bars written in one pass, with the figures of that pass."""
    found = observed.write_validated(quality._bad_bars(s, d), "price", f"{shared_dir(s, 'observed')}/bars")
    return s.createDataFrame([(found["total"], found["valid"], found["invalid"], found["success_rate"])], "total long, valid long, invalid long, success_rate double")


add("v07_observed_summary", _observed, ("total", "valid", "invalid"), ("success_rate",),
    f"""SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid,
        count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS success_rate FROM (SELECT {quality.BAR_ERRORS} = '' AS ok FROM bad)""", (v.BARS, quality.BAD_BARS))
