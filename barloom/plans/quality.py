"""Queries: validation, aggregates and sinks (as the frames they would write)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import options as op
from barloom.operators import indicators as ind
from barloom.operators import lookup as lk
from barloom.operators import metrics as mt
from barloom.operators import validate as va
from barloom.plans import shapes
from barloom.plans import sql_views as v
from barloom.plans.registry import AS_OF, add
from barloom.sources import adapters as a
from barloom.sources import payloads as pl
from barloom.sources import writers

KEY = ("ts", "symbol")
TICKER = ("options_ticker",)


def _text(df):
    """Errors as one text and the flag."""
    return df.withColumn("problems", F.array_join("errors", "; "))


CHECKED = ("problems", "is_valid")

# --- validation -------------------------------------------------------------


def _bad_bars(s, d):
    """Hourly bars, some of them spoiled by rules on the hour of day."""
    h = F.hour("ts")
    return a.bars_hourly(s, d).withColumns({
        "low": F.when(h == 3, F.col("high") + 1.0).otherwise(F.col("low")),
        "close": F.when(h == 5, F.col("high") + 0.5).otherwise(F.col("close")),
        "open": F.when(h == 7, -1.0).otherwise(F.col("open")),
        "volume": F.when(h == 9, 0).when(h == 11, -5).otherwise(F.col("volume")),
    })


BAD_BARS = """bad AS (SELECT ts, symbol, CASE WHEN hour(ts) = 7 THEN -1 ELSE open END AS open, high,
  CASE WHEN hour(ts) = 3 THEN high + 1 ELSE low END AS low, CASE WHEN hour(ts) = 5 THEN high + 0.5 ELSE close END AS close,
  CASE WHEN hour(ts) = 9 THEN 0 WHEN hour(ts) = 11 THEN -5 ELSE volume END AS volume FROM bars)"""
# The measured numbers inside the messages print differently per engine and are cut out on both sides.
BAR_ERRORS = """concat_ws('; ', CASE WHEN least(open, high, low, close) <= 0 THEN 'Non-positive OHLC values' END,
  CASE WHEN low > high THEN 'Low (#) > High (#)' END,
  CASE WHEN open < low OR open > high THEN 'Open (#) not between Low (#) and High (#)' END,
  CASE WHEN close < low OR close > high THEN 'Close (#) not between Low (#) and High (#)' END,
  CASE WHEN volume < 0 THEN 'Negative volume' END, CASE WHEN volume = 0 THEN 'Zero volume (may be non-trading period)' END)"""


def _masked(df):
    return _text(df).withColumn("problems", F.regexp_replace("problems", r"-?[0-9]+\.[0-9E]+", "#"))


add("v01_validate_bars", lambda s, d: _masked(va.validate_bars(_bad_bars(s, d))), (*KEY, *CHECKED), (),
    f"SELECT *, problems = '' AS is_valid FROM (SELECT *, {BAR_ERRORS} AS problems FROM bad)", (v.BARS, BAD_BARS))


def _bad_quotes(s, d):
    return spoil_quotes(a.quotes(s, d))


def spoil_quotes(q):
    """Break some rule for the smallest volumes."""
    n = F.col("volume")
    mid = F.col("underlying_price") * F.col("implied_volatility")
    return q.withColumns({
        "bid": F.when(n == 1, mid * 1.2).when(n == 2, mid * 0.5).when(n == 3, F.lit(-1.0)).otherwise(mid * 0.95),
        "ask": F.when(n == 4, F.lit(0.0)).otherwise(mid * 1.05),
        "implied_volatility": F.when(n == 5, F.lit(6.0)).when(n != 6, F.col("implied_volatility")),
        "volume": F.when(n == 7, F.lit(-1)).otherwise(n),
    })


BAD_QUOTES = """badq AS (SELECT options_ticker, CASE n WHEN 1 THEN mid * 1.2::DOUBLE WHEN 2 THEN mid * 0.5 WHEN 3 THEN -1 ELSE mid * 0.95::DOUBLE END AS bid,
  CASE WHEN n = 4 THEN 0 ELSE mid * 1.05::DOUBLE END AS ask, CASE WHEN n = 5 THEN 6.0 WHEN n <> 6 THEN iv END AS iv,
  CASE WHEN n = 7 THEN -1 ELSE n END AS volume
  FROM (SELECT options_ticker, volume AS n, implied_volatility AS iv, underlying_price * implied_volatility AS mid FROM quotes))"""
QUOTE_ERRORS = """concat_ws('; ', CASE WHEN bid < 0 OR ask < 0 THEN 'Negative bid or ask price' END,
  CASE WHEN bid > ask THEN 'Bid (#) > Ask (#)' END,
  CASE WHEN ask > 0 AND (ask - bid) / ((ask + bid) / 2) * 100 > 50 THEN 'Suspicious spread: #%' END,
  CASE WHEN volume < 0 THEN 'Negative volume' END,
  CASE WHEN iv < 0 OR iv > 5 THEN 'Suspicious implied volatility: #' END)"""
add("v02_validate_quotes", lambda s, d: _masked(va.validate_quotes(_bad_quotes(s, d))), (*TICKER, *CHECKED), (),
    f"SELECT *, problems = '' AS is_valid FROM (SELECT *, {QUOTE_ERRORS} AS problems FROM badq)", (v.QUOTES, BAD_QUOTES))


def _chains(s, d):
    """One chain per part with two contracts, some without strike, date or with an odd type."""
    size = F.col("p_size")
    kind = F.when(size % 5 == 0, "straddle").otherwise("call")

    def contract(strike, date, kind):
        return F.struct(strike.alias("strike_price"), date.alias("expiration_date"), kind.alias("contract_type"))

    good = contract(F.col("p_retailprice"), F.lit("2024-03-15"), F.lit("put"))
    odd = contract(F.when(size % 7 == 0, 0.0).otherwise(F.col("p_retailprice")), F.when(size % 3 != 0, "2024-03-15"), kind)
    data = F.struct(F.array(good, odd).alias("results"))
    return a.table(s, d, "part").select(
        "p_partkey", F.when(size % 11 != 0, F.col("p_brand")).alias("symbol"), F.when(size % 13 != 0, data).alias("data"))


add("v03_validate_chain", lambda s, d: _text(va.validate_chain(_chains(s, d))), ("p_partkey", *CHECKED), (),
    """SELECT *, problems = '' AS is_valid FROM (SELECT p_partkey, concat_ws('; ',
       CASE WHEN p_size % 11 = 0 THEN 'Missing required field: symbol' END,
       CASE WHEN p_size % 13 = 0 THEN 'Missing required field: data' END,
       CASE WHEN p_size % 13 <> 0 AND p_size % 7 = 0 THEN 'Invalid strike price in contract' END,
       CASE WHEN p_size % 13 <> 0 AND p_size % 3 = 0 THEN 'Missing expiration date' END,
       CASE WHEN p_size % 13 <> 0 AND p_size % 5 = 0 THEN 'Invalid contract type' END) AS problems FROM part)""")


def _scaled_greeks(s, d):
    """Greeks with the deep contracts' values pushed out of range."""
    g = op.with_values(a.quotes(s, d), ("delta", "gamma", "vega", "theta"))
    n = F.col("volume")
    return g.withColumns({
        "delta": F.when(n == 1, F.lit(1.5)).otherwise(F.col("delta")), "gamma": F.when(n == 2, F.lit(-0.25)).otherwise(F.col("gamma")),
        "vega": F.when(n == 3, F.lit(-0.5)).otherwise(F.col("vega")), "theta": F.when(n == 4, F.lit(2.5)).otherwise(F.col("theta"))})


add("v04_validate_greeks", lambda s, d: _text(va.validate_greeks(_scaled_greeks(s, d))), (*TICKER, *CHECKED), (),
    """SELECT *, problems = '' AS is_valid FROM (SELECT options_ticker, CASE volume WHEN 1 THEN 'Delta (1.5) out of range [-1, 1]'
       WHEN 2 THEN 'Negative gamma (-0.25)' WHEN 3 THEN 'Negative vega (-0.5)' WHEN 4 THEN 'Unusually high positive theta (2.5)'
       ELSE '' END AS problems FROM quotes)""", (v.QUOTES,))
add("v05_outliers_iqr", lambda s, d: va.flag_outliers(a.table(s, d, "events"), "value", threshold=1.5), ("event_id", "is_outlier"), ("value",),
    """SELECT *, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS is_outlier FROM events,
       (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)""")
add("v05_outliers_iqr_per_symbol",
    lambda s, d: va.flag_outliers(a.ticks(s, d), "price", threshold=3.0, by=("symbol",)), ("event_id", "symbol", "is_outlier"), (),
    """SELECT event_id, symbol, price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1) AS is_outlier FROM ticks JOIN
       (SELECT symbol, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM ticks GROUP BY 1) USING (symbol)""",
    (v.TICKS,))
add("v05_outliers_zscore", lambda s, d: va.flag_outliers(a.table(s, d, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity")), "price", "zscore"),
    ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "is_outlier"), (),
    """SELECT *, abs((l_extendedprice / l_quantity - m) / sd) > 3 AS is_outlier FROM lineitem,
       (SELECT avg(l_extendedprice / l_quantity) AS m, stddev_samp(l_extendedprice / l_quantity) AS sd FROM lineitem)""")


def _stamps(s, d):
    return with_stamps(a.table(s, d, "events"))


def with_stamps(events):
    """Event times as text, every tenth unreadable."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.when(F.col("event_id") % 10 == 0, F.lit("yesterday")).otherwise(ts)
    return events.select("event_id", text.alias("timestamp"))


NOON = "2024-01-25 12:00:00.5"  # half a second off, so that no age is an exact tie of the printed digit
add("v06_validate_timestamps", lambda s, d: _text(va.validate_timestamps(_stamps(s, d), NOON)), ("event_id", *CHECKED), (),
    f"""SELECT *, problems = '' AS is_valid FROM (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'Invalid timestamp format'
        WHEN age > 86400 THEN printf('Timestamp too old: %.1f hours', age / 3600)
        WHEN age < 0 THEN printf('Timestamp in future: %.1f minutes', -age / 60) ELSE '' END AS problems
        FROM (SELECT event_id, (epoch(TIMESTAMP '{NOON}') - epoch(date_trunc('second', ts)))::DOUBLE AS age FROM events))""")
add("v07_validation_summary", lambda s, d: va.validation_summary(_bad_bars(s, d), "price"), ("total", "valid", "invalid"), ("success_rate",),
    f"""SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid,
        count(*) FILTER (ok) * 100.0::DOUBLE / count(*) AS success_rate FROM (SELECT {BAR_ERRORS} = '' AS ok FROM bad)""", (v.BARS, BAD_BARS))
add("v07_validation_errors",
    lambda s, d: va.validation_errors(_chains(s, d), "options_chain").withColumns(
        {"n_errors": F.size("errors").cast("bigint"), "sample_start": F.substring("data_sample", 1, 13), "sample_size": F.length("data_sample").cast("bigint")}),
    ("n_errors", "sample_start", "sample_size"), (),
    """SELECT (p_size % 11 = 0)::BIGINT + (CASE WHEN p_size % 13 = 0 THEN 1 ELSE (p_size % 7 = 0)::INT + (p_size % 3 = 0)::INT
       + (p_size % 5 = 0)::INT END)::BIGINT AS n_errors, substring('{"p_partkey":' || p_partkey, 1, 13) AS sample_start,
       CASE WHEN p_size % 13 <> 0 THEN 100 ELSE length('{"p_partkey":' || p_partkey || CASE WHEN p_size % 11 <> 0 THEN ',"symbol":"' || p_brand || '"' ELSE '' END || '}') END AS sample_size
       FROM part WHERE p_size % 11 = 0 OR p_size % 13 = 0 OR p_size % 7 = 0 OR p_size % 3 = 0 OR p_size % 5 = 0""")
add("v08_valid_rows", lambda s, d: va.split_valid(_bad_bars(s, d), "price")[0], KEY, ("close",),
    f"SELECT * FROM bad WHERE {BAR_ERRORS} = ''", (v.BARS, BAD_BARS))
add("v08_quarantined_rows", lambda s, d: _masked(va.split_valid(_bad_bars(s, d), "price")[1]), (*KEY, "problems"), (),
    f"SELECT *, {BAR_ERRORS} AS problems FROM bad WHERE {BAR_ERRORS} <> ''", (v.BARS, BAD_BARS))

# --- aggregates -------------------------------------------------------------

PRED_CTES = (v.BARS, v.PREDICTIONS)
RECENT = "{t} > TIMESTAMP '" + AS_OF + "' - INTERVAL {n} AND {t} <= TIMESTAMP '" + AS_OF + "'"
LAST_DAY = RECENT.format(t="prediction_time", n="24 HOUR")
LAST_WEEK = RECENT.format(t="prediction_time", n="7 DAY")

add("a01_mape_over_time", lambda s, d: mt.mape_over_time(shapes.predictions(s, d)), ("time", "model_name"), ("error",),
    """SELECT time_bucket(INTERVAL 5 MINUTE, prediction_time) AS time, model_name,
       avg(abs(predicted_price - actual_price) / nullif(actual_price, 0) * 100) AS error FROM preds WHERE actual_price IS NOT NULL GROUP BY 1, 2""",
    PRED_CTES, digits=4)
add("a02_a03_model_activity", lambda s, d: mt.model_activity(shapes.predictions(s, d), AS_OF), ("model_name", "predictions"), ("avg_confidence",),
    f"SELECT model_name, count(*) AS predictions, avg(confidence) AS avg_confidence FROM preds WHERE {LAST_DAY} GROUP BY 1", PRED_CTES)
add("a04_signal_counts", lambda s, d: mt.signal_counts(shapes.signals(s, d), AS_OF), ("signal_type", "count"), (),
    f"SELECT signal_type, count(*) AS count FROM signals WHERE {RECENT.format(t='ts', n='7 DAY')} GROUP BY 1", v.signal_ctes())
add("a05_prediction_errors", lambda s, d: mt.prediction_errors(shapes.predictions(s, d), AS_OF), ("prediction_time", "symbol"), ("error",),
    f"SELECT *, predicted_price - actual_price AS error FROM preds WHERE actual_price IS NOT NULL AND {LAST_WEEK}", PRED_CTES)
add("a05_error_histogram",
    lambda s, d: mt.histogram(mt.prediction_errors(shapes.predictions(s, d), AS_OF), "error", -100, 100, 20).withColumn("bucket", F.col("bucket").cast("bigint")),
    ("bucket", "count"), (),
    f"""SELECT CASE WHEN e < -100 THEN 0 WHEN e >= 100 THEN 21 ELSE floor((e + 100) / 10.0::DOUBLE) + 1 END::BIGINT AS bucket, count(*) AS count
        FROM (SELECT predicted_price - actual_price AS e FROM preds WHERE actual_price IS NOT NULL AND {LAST_WEEK}) GROUP BY 1""", PRED_CTES)
add("a06_distinct_symbols", lambda s, d: shapes.predictions(s, d).select("symbol").distinct().orderBy("symbol"), ("symbol",), (),
    "SELECT DISTINCT symbol FROM preds", PRED_CTES)


def _confidence_points(s, d):
    p = shapes.predictions(s, d).withColumnRenamed("prediction_time", "ts")
    return pl.wide_to_points(p, "prediction", ("confidence", "predicted_price"))


add("a07_field_mean", lambda s, d: mt.field_mean(_confidence_points(s, d), "prediction", "confidence", "24 hours", AS_OF, ("symbol", "model_name")),
    ("symbol", "model_name"), ("mean",), f"SELECT symbol, model_name, avg(confidence) AS mean FROM preds WHERE {LAST_DAY} GROUP BY 1, 2", PRED_CTES)


def _scored(s, d):
    return shapes.predictions(s, d).filter("actual_price IS NOT NULL")


METRICS = """count(*) AS n, avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e / nullif(actual_price, 0))) * 100 AS mape
  FROM (SELECT *, actual_price - predicted_price AS e FROM {src})"""
add("a08_regression_metrics", lambda s, d: mt.regression_metrics(_scored(s, d), "actual_price", "predicted_price"), ("symbol", "n"),
    ("mae", "mse", "rmse", "mape"), f"SELECT symbol, {METRICS.format(src='preds WHERE actual_price IS NOT NULL')} GROUP BY symbol", PRED_CTES, digits=5)
add("a08_metrics_last_50", lambda s, d: mt.regression_metrics(_scored(s, d), "actual_price", "predicted_price", last=50, ts="prediction_time"),
    ("symbol", "n"), ("mae", "mse", "rmse", "mape"), f"SELECT symbol, {METRICS.format(src='last50')} GROUP BY symbol",
    (*PRED_CTES, """last50 AS (SELECT * FROM preds WHERE actual_price IS NOT NULL
     QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY prediction_time DESC) <= 50)"""), digits=5)
add("a10_ingest_summary", lambda s, d: mt.ingest_summary(a.bars_hourly(s, d)), ("symbol", "records", "first_ts", "last_ts"), (),
    "SELECT symbol, count(*) AS records, min(ts) AS first_ts, max(ts) AS last_ts FROM bars GROUP BY 1", (v.BARS,))
add("a10_ingest_totals", lambda s, d: mt.ingest_totals(a.bars_daily(s, d)), ("total_records", "first_ts", "last_ts"), (),
    "SELECT count(*) AS total_records, min(ts) AS first_ts, max(ts) AS last_ts FROM daily", (v.DAILY,))


def _report(s, d):
    """Brands asked for, of which those with a type SMALL part were loaded."""
    part = a.table(s, d, "part")
    wanted = part.select(F.concat_ws("/", "p_brand", "p_size").alias("symbol"))
    have = part.filter("p_type = 'SMALL'").select(F.concat_ws("/", "p_brand", "p_size").alias("symbol"))
    return mt.ingest_report(wanted, have).withColumn("failed_symbols", F.array_join("failed_symbols", ","))


add("a11_ingest_report", _report, ("requested", "successful", "failed", "failed_symbols"), ("success_rate",),
    """SELECT count(*) AS requested, count(*) FILTER (ok) AS successful, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (ok) * 100.0 / count(*) AS success_rate,
       array_to_string(list_slice(list(symbol ORDER BY symbol) FILTER (NOT ok), 1, 10), ',') AS failed_symbols
       FROM (SELECT p_brand || '/' || p_size AS symbol, bool_or(p_type = 'SMALL') AS ok FROM part GROUP BY 1)""")
add("a13_volume_profile", lambda s, d: mt.volume_profile(a.bars_daily(s, d), 500.0), ("symbol", "volume"), ("price_bucket",),
    "SELECT symbol, floor(close / 500) * 500 AS price_bucket, sum(volume)::BIGINT AS volume FROM daily GROUP BY 1, 2", (v.DAILY,))
add("a15_draw_summary",
    lambda s, d: mt.draw_summary(a.ticks(s, d).withColumn("day", F.to_date("ts")), ("symbol", "day"), "price"), ("symbol", "day", "draws"),
    ("mean", "std", "lower_bound", "upper_bound"),
    """SELECT symbol, ts::DATE::VARCHAR AS day, count(*) AS draws, avg(price) AS mean, stddev_pop(price) AS std,
       quantile_cont(price, 0.05) AS lower_bound, quantile_cont(price, 0.95) AS upper_bound FROM ticks GROUP BY 1, 2""", (v.TICKS,))

# --- sinks ------------------------------------------------------------------


def _changes(s, d):
    """Updates to half of the bars, new rows, and two versions of some keys."""
    bars = a.bars_hourly(s, d)
    h = F.hour("ts")
    first = bars.filter(h < 6).withColumns({"close": F.col("close") + 1.0, "volume": F.lit(1).cast("bigint"), "version": F.lit(1)})
    second = bars.filter(h < 2).withColumns({"close": F.col("close") + 2.0, "volume": F.lit(2).cast("bigint"), "version": F.lit(2)})
    added = bars.filter(h == 23).withColumns({"ts": F.col("ts") + F.expr("INTERVAL '30' MINUTE"), "version": F.lit(1)})
    return first.unionByName(second).unionByName(added)


def _merged(s, d):
    base = a.bars_hourly(s, d).withColumn("version", F.lit(0))
    return writers.merge_updates(base, _changes(s, d), ["symbol", "ts"], update_cols=["close", "version"], order=["version"])


add("k04_merge_updates", _merged, (*KEY, "volume", "version"), ("close", "open"),
    """SELECT ts, symbol, open, close + CASE WHEN hour(ts) < 2 THEN 2 WHEN hour(ts) < 6 THEN 1 ELSE 0 END AS close, volume,
       CASE WHEN hour(ts) < 2 THEN 2 WHEN hour(ts) < 6 THEN 1 ELSE 0 END::INT AS version FROM bars
       UNION ALL SELECT ts + INTERVAL 30 MINUTE, symbol, open, close, volume, 1::INT FROM bars WHERE hour(ts) = 23""", (v.BARS,))


def _read_back(frame, field, names):
    """Envelope fields read back from the JSON text."""
    j = F.col("value")
    parts = {n: F.get_json_object(j, f"$.{field}.{n}") for n in names}
    return frame.withColumns({"sent": F.get_json_object(j, "$.timestamp"), **parts})


STAMP = "'2024-01-30T00:00:00.000000' AS sent"
add("k05_price_envelope",
    lambda s, d: _read_back(writers.to_envelope(a.bars_hourly(s, d), "price", ("ts", "close", "volume"), AS_OF), "data", ("close", "volume")),
    ("key", "sent"), ("close", "volume"), f"SELECT symbol AS key, {STAMP}, close, volume FROM bars", (v.BARS,))
add("k05_quote_envelope",
    lambda s, d: _read_back(writers.to_envelope(a.quotes(s, d), "quote", ("strike", "volume"), AS_OF), "data", ("strike", "volume")),
    ("key", "sent"), ("strike", "volume"), f"SELECT options_ticker AS key, {STAMP}, strike, volume FROM quotes", (v.QUOTES,), digits=4)
add("k05_greeks_envelope",
    lambda s, d: _read_back(writers.to_envelope(op.with_values(a.quotes(s, d), ("delta", "gamma")), "greeks", ("delta", "gamma"), AS_OF), "greeks", ("delta", "gamma")),
    ("key", "sent"), ("delta", "gamma"), f"SELECT options_ticker AS key, {STAMP}, delta, gamma FROM greeks", (v.QUOTES, *v.greeks_ctes()))
add("k05_chain_envelope",
    lambda s, d: _read_back(writers.to_envelope(_chains(s, d).filter("symbol IS NOT NULL AND data IS NOT NULL").select("p_partkey", "symbol", "data.results"), "chain", ("p_partkey", "results"), AS_OF), "data", ("p_partkey",)),
    ("key", "sent"), ("p_partkey",), f"SELECT p_brand AS key, {STAMP}, p_partkey FROM part WHERE p_size % 11 <> 0 AND p_size % 13 <> 0")


def _articles(s, d):
    return a.table(s, d, "documents").select(
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("headline"), "n_chars")


add("k05_article_envelope",
    lambda s, d: _read_back(writers.to_envelope(_articles(s, d), "article", ("id", "headline", "n_chars"), AS_OF), "article", ("n_chars",)),
    ("key", "sent"), ("n_chars",),
    f"SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE substring(text, 1, 50) END AS key, {STAMP}, n_chars FROM documents")
add("k05_sentiment_envelope",
    lambda s, d: _read_back(writers.to_envelope(a.news(s, d), "sentiment", ("id", "score"), AS_OF), "sentiment", ("id", "score")),
    ("key", "sent", "id"), ("score",), f"SELECT symbol AS key, {STAMP}, id, score FROM news", (v.NEWS,))


def _mixed(s, d):
    q = a.quotes(s, d).select(F.when(F.col("volume") > 25, F.col("symbol")).alias("symbol"), "options_ticker", "strike")
    out = writers.to_batch_messages(q)
    return out.withColumn("strike", F.get_json_object("value", "$.strike"))


add("k06_batch_messages", _mixed, ("key",), ("strike",),
    "SELECT CASE WHEN volume > 25 THEN symbol ELSE options_ticker END AS key, strike FROM quotes", (v.QUOTES,), digits=4)
add("k01_json_rows",
    lambda s, d: writers.to_json_rows(a.bars_hourly(s, d), "symbol").withColumn("close", F.get_json_object("value", "$.close")), ("key",), ("close",),
    "SELECT symbol AS key, close FROM bars", (v.BARS,))
