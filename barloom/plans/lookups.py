"""Queries: latest values, top-k, joins, set operations, payloads and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.operators import lookup as lk
from barloom.plans import shapes
from barloom.plans import sql_views as v
from barloom.plans.registry import AS_OF, add
from barloom.sources import adapters as a
from barloom.sources import openfields as of
from barloom.sources import payloads as pl
from barloom.sources.storage import shared_dir, staged

KEY = ("ts", "symbol")
OHLC = ("open", "high", "low", "close")
PRED = ("prediction_time", "symbol", "model_name")

# --- latest and top-k -------------------------------------------------------

add("t01_latest_price", lambda s, d: lk.latest(a.bars_hourly(s, d)), (*KEY, "volume"), OHLC,
    "SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1", (v.BARS,))
add("t01_latest_price_last_hour", lambda s, d: lk.latest(a.bars_hourly(s, d), lookback="1 hour", as_of=AS_OF),
    (*KEY, "volume"), OHLC,
    f"""SELECT * FROM bars WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{AS_OF}'
        QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1""", (v.BARS,))
add("t02_last_60_rows", lambda s, d: lk.last_n(a.bars_hourly(s, d), 60), KEY, ("close",),
    "SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 60", (v.BARS,))
add("t03_latest_20_signals", lambda s, d: lk.newest_rows(shapes.signals(s, d), 20, tie=("symbol",)), (*KEY, "signal_type"),
    ("confidence", "target_1", "stop_loss"), "SELECT * FROM signals ORDER BY ts DESC, symbol LIMIT 20", v.signal_ctes())
add("t03_latest_10_of_symbol", lambda s, d: lk.newest_rows(shapes.signals(s, d), 10, symbol="view"), (*KEY, "signal_type"),
    ("confidence",), "SELECT * FROM signals WHERE symbol = 'view' ORDER BY ts DESC LIMIT 10", v.signal_ctes())
add("t03_predictions_in_range",
    lambda s, d: lk.relative_range(shapes.predictions(s, d), "7 days", AS_OF, ts="prediction_time"),
    PRED, ("predicted_price",),
    f"""SELECT * FROM preds WHERE prediction_time > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY
        AND prediction_time <= TIMESTAMP '{AS_OF}'""", (v.BARS, v.PREDICTIONS))


def _one_contract_often(s, d):
    """Coarser tickers, so that a contract has several quotes."""
    q = a.quotes(s, d)
    ticker = F.concat_ws("-", "symbol", "option_type", F.date_format("expiration", "yyyy-MM"))
    return q.withColumnsRenamed({"options_ticker": "quote_id"}).withColumn("options_ticker", ticker)


OFTEN = """often AS (SELECT * EXCLUDE (options_ticker), options_ticker AS quote_id,
  concat_ws('-', symbol, option_type, strftime(expiration, '%Y-%m')) AS options_ticker FROM quotes)"""
add("t04_latest_chain",
    lambda s, d: lk.latest_chain(_one_contract_often(s, d), "Brand#3", "1998-01-01", tie=("quote_id",)),
    ("ts", "options_ticker", "quote_id"), ("strike",),
    """SELECT * FROM often WHERE symbol = 'Brand#3' AND expiration >= DATE '1998-01-01'
       QUALIFY row_number() OVER (PARTITION BY options_ticker ORDER BY ts DESC, quote_id DESC) = 1""", (v.QUOTES, OFTEN))
add("t06_top_n_per_sector", lambda s, d: lk.top_n_per_sector(a.universe(s, d), 10), ("sector", "symbol", "rank"), (),
    "SELECT * FROM universe WHERE rank <= 10", (v.UNIVERSE,))


def _movers(s, d):
    changed = ind.previous_change(staged(a.bars_hourly(s, d), "bars"))
    return lk.market_movers(lk.latest(changed), 3)


add("t07_market_movers", _movers, ("list", *KEY, "volume"), ("change_pct",),
    f"""SELECT * FROM (SELECT 'top_gainers' AS list, * FROM lastbar ORDER BY change_pct DESC, symbol LIMIT 3) UNION ALL
        SELECT * FROM (SELECT 'top_losers' AS list, * FROM lastbar ORDER BY change_pct, symbol LIMIT 3) UNION ALL
        SELECT * FROM (SELECT 'most_actively_traded' AS list, * FROM lastbar ORDER BY volume DESC, symbol LIMIT 3)""",
    (v.BARS, f"""lastbar AS (SELECT ts, symbol, volume, (close / nullif(lag(close) OVER {v.over()}, 0) - 1) * 100 AS change_pct
       FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)"""))


def _expirations(s, d):
    out = lk.expirations(a.quotes(s, d))
    return out.withColumns({"listed": F.size("expirations").cast("bigint"), "last": F.array_max("expirations")})


add("t08_expirations", _expirations, ("symbol", "nearest", "listed", "last"), (),
    """SELECT symbol, min(expiration)::VARCHAR AS nearest, count(DISTINCT expiration) AS listed,
       max(expiration)::VARCHAR AS last FROM quotes GROUP BY symbol""", (v.QUOTES,))
add("s11_universe", lambda s, d: lk.universe_symbols(a.universe(s, d)), ("symbol",), (),
    "SELECT DISTINCT symbol FROM universe", (v.UNIVERSE,))
add("s11_universe_of_sector", lambda s, d: lk.universe_symbols(a.universe(s, d), "SMALL"), ("symbol",), (),
    "SELECT symbol FROM universe WHERE sector = 'SMALL'", (v.UNIVERSE,))


def _providers(s, d):
    """Three sources covering different symbols; the first that has a symbol wins."""
    bars = a.bars_hourly(s, d)
    frames = {
        "primary": bars.filter(F.col("symbol").isin("click", "view")),
        "second": bars.filter(F.col("symbol") != "signup"),
        "third": bars,
    }
    return lk.pick_provider(frames, ["primary", "second", "third"])


add("s10_pick_provider", _providers, (*KEY, "provider"), ("close",),
    """SELECT *, CASE WHEN symbol IN ('click', 'view') THEN 'primary' WHEN symbol <> 'signup' THEN 'second'
       ELSE 'third' END AS provider FROM bars""", (v.BARS,))

# --- joins ------------------------------------------------------------------


def _some_indicators(s, d):
    return ind.rsi(a.bars_hourly(s, d)).filter(F.col("rsi") > 40).select("ts", "symbol", "rsi")


add("j01_bars_without_indicators",
    lambda s, d: lk.with_indicators(a.bars_hourly(s, d), ind.sma(a.bars_hourly(s, d)).select(*KEY, "sma_5").filter("symbol = 'no such symbol'")),
    (*KEY, "volume"), ("close", "sma_5"), "SELECT *, NULL::DOUBLE AS sma_5 FROM bars", (v.BARS,))
add("j01_bars_with_indicators", lambda s, d: lk.with_indicators(a.bars_hourly(s, d), _some_indicators(s, d)),
    KEY, ("close", "rsi"), "SELECT * FROM ind WHERE rsi > 40", (v.BARS, *v.ind_ctes()))
add("j02_bars_left_indicators", lambda s, d: lk.with_indicators(a.bars_hourly(s, d), _some_indicators(s, d), "left"),
    KEY, ("close", "rsi"), "SELECT ts, symbol, close, CASE WHEN rsi > 40 THEN rsi END AS rsi FROM ind",
    (v.BARS, *v.ind_ctes()))


def _aligned(s, d):
    actual = a.bars_hourly(s, d).select("symbol", "ts", F.col("close").alias("actual"))
    predicted = shapes.predictions(s, d).select("symbol", F.col("target_time").alias("ts"), F.col("predicted_price").alias("predicted"))
    return lk.align(actual, predicted)


add("j03_align", _aligned, KEY, ("actual", "predicted"),
    """SELECT b.ts, b.symbol, close AS actual, predicted_price AS predicted FROM bars b
       JOIN preds p ON p.symbol = b.symbol AND p.target_time = b.ts""", (v.BARS, v.PREDICTIONS))
add("j04_actual_price", lambda s, d: lk.attach_actual(shapes.predictions(s, d), a.bars_hourly(s, d)), PRED, ("actual_price",),
    "SELECT * FROM preds", (v.BARS, v.PREDICTIONS))


def _actual_later(s, d):
    later = shapes.predictions(s, d).withColumn("target_time", F.col("prediction_time") + F.expr("INTERVAL '95' MINUTE"))
    return lk.attach_actual(later, a.bars_hourly(s, d), exact=False)


add("j04_actual_price_from_then_on", _actual_later, PRED, ("actual_price",),
    """SELECT prediction_time, p.symbol, model_name, b.close AS actual_price FROM
       (SELECT * EXCLUDE (actual_price), prediction_time + INTERVAL 95 MINUTE AS tt FROM preds) p
       ASOF LEFT JOIN bars b ON b.symbol = p.symbol AND b.ts >= p.tt""", (v.BARS, v.PREDICTIONS))


def _returnflag_quotes(s, d):
    """Quotes on the daily bars' symbols, two hours into the following day."""
    return a.table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("symbol"),
        (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL '26' HOUR")).alias("ts"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("options_ticker"),
    )


add("j05_underlying_as_of",
    lambda s, d: lk.attach_underlying(_returnflag_quotes(s, d), staged(a.bars_daily(s, d), "bars"), slot="4 weeks"),
    ("ts", "symbol", "options_ticker"), ("underlying_price",),
    """SELECT q.ts, q.symbol, options_ticker, b.close AS underlying_price FROM (SELECT l_returnflag AS symbol,
        l_shipdate + INTERVAL 26 HOUR AS ts, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS options_ticker
        FROM lineitem) q ASOF LEFT JOIN daily b ON b.symbol = q.symbol AND b.ts <= q.ts""", (v.DAILY,))


def _first_sector(s, d):
    """One sector per symbol."""
    return a.universe(s, d).groupBy("symbol").agg(F.min("sector").alias("sector"))


add("j06_quotes_with_sector", lambda s, d: lk.with_sector(a.quotes(s, d), _first_sector(s, d)),
    ("options_ticker", "symbol", "sector"), ("strike",),
    "SELECT q.*, u.sector FROM quotes q JOIN (SELECT symbol, min(sector) AS sector FROM universe GROUP BY symbol) u USING (symbol)",
    (v.QUOTES, v.UNIVERSE))


def _halves(s, d):
    bars = a.bars_hourly(s, d)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return bars.filter(F.col("ts") < cut), bars.filter(F.col("ts") >= cut - F.expr("INTERVAL '2' DAY"))


add("j07_split_keys", lambda s, d: lk.split_keys(*_halves(s, d), ["symbol", "ts"]), (*KEY, "matched"), (),
    "SELECT ts, symbol, ts < '2024-01-16' AS matched FROM bars WHERE ts >= '2024-01-14'", (v.BARS,))
add("j08_symbols_with_model",
    lambda s, d: lk.with_model(a.bars_hourly(s, d).select("symbol").distinct(),
                               shapes.predictions(s, d).filter(F.col("symbol") != "error").select("symbol")),
    ("symbol",), (), "SELECT DISTINCT symbol FROM bars WHERE symbol <> 'error'", (v.BARS,))

# --- sets -------------------------------------------------------------------

add("u01_union_sectors", lambda s, d: lk.union_sectors(a.universe(s, d), ["SMALL", "LARGE"]), ("symbol",), (),
    "SELECT symbol FROM universe WHERE sector = 'SMALL' UNION SELECT symbol FROM universe WHERE sector = 'LARGE'", (v.UNIVERSE,))
add("u02_common_keys", lambda s, d: lk.common_keys(*_halves(s, d), ["symbol", "ts"]), KEY, (),
    "SELECT ts, symbol FROM bars WHERE ts < '2024-01-16' INTERSECT SELECT ts, symbol FROM bars WHERE ts >= '2024-01-14'", (v.BARS,))
add("u03_missing_keys", lambda s, d: lk.missing_keys(*_halves(s, d), ["symbol", "ts"]), KEY, (),
    "SELECT ts, symbol FROM bars WHERE ts < '2024-01-16' EXCEPT SELECT ts, symbol FROM bars WHERE ts >= '2024-01-14'", (v.BARS,))

# --- payloads and points ----------------------------------------------------


def _chain_payloads(s, d):
    """One chain message per quote: its contract and the next strike up."""
    def contract(step):
        return F.struct(
            (F.col("strike") + step).alias("strike_price"), F.col("expiration").cast("string").alias("expiration_date"),
            F.col("option_type").alias("contract_type"),
        )

    results = F.struct(F.array(contract(0.0), contract(5.0)).alias("results")).alias("data")
    return a.quotes(s, d).select(F.to_json(F.struct("symbol", results)).alias("value"))


add("s06_explode_chain", lambda s, d: pl.explode_chain(_chain_payloads(s, d)), ("symbol", "expiration", "option_type"), ("strike",),
    """SELECT symbol, expiration::VARCHAR AS expiration, option_type, strike FROM quotes
       UNION ALL SELECT symbol, expiration::VARCHAR, option_type, strike + 5 FROM quotes""", (v.QUOTES,), digits=4)


def _feeds(s, d):
    """One feed message per document: an article with an id and one without."""
    def article(key):
        return F.struct(key.alias("id"), F.col("text").alias("headline"), F.col("source").alias("symbol"))

    doc_id = F.col("doc_id").cast("string")
    feed = F.array(article(doc_id), article(F.when(F.lit(False), doc_id))).alias("feed")
    return a.table(s, d, "documents").select(F.to_json(F.struct(feed)).alias("value"))


add("s07_explode_news",
    lambda s, d: pl.explode_news(_feeds(s, d)).withColumn("n_chars", F.length("headline").cast("bigint")),
    ("key", "symbol", "n_chars"), (),
    """SELECT doc_id::VARCHAR AS key, source AS symbol, length(text) AS n_chars FROM documents
       UNION ALL SELECT substring(text, 1, 50), source, length(text) FROM documents""")


def _open_chains(s, d):
    """Chain messages whose contracts carry fields that no schema names; every third has its strike as text that is no number."""
    odd = F.pmod(F.col("volume"), F.lit(3)) == 0
    contract = F.struct(
        F.when(odd, F.lit("n/a")).otherwise(F.col("strike").cast("string")).alias("strike_price"), F.col("expiration").cast("string").alias("expiration_date"),
        F.col("option_type").alias("contract_type"), "volume", F.struct("implied_volatility", F.array("underlying_price").alias("seen")).alias("vendor"))
    results = F.struct(F.array(contract).alias("results")).alias("data")
    return a.quotes(s, d).select(F.to_json(F.struct("symbol", results)).alias("value"))


def _open_chain(s, d):
    """Read, stored, read back, and sent out again: known fields as columns, the others by path."""
    path = shared_dir(s, "open-chain")
    of.open_chain(_open_chains(s, d)).write.parquet(path)
    stored = s.read.parquet(path)
    out = of.untyped_json({k: x for k, x in of.CONTRACT.items() if k != "expiration"})
    sent = stored.withColumn("sent", F.from_json(out, "contract_type STRING, volume BIGINT"))
    return sent.withColumns({
        "contracts": of.at("extra", "$.volume", "bigint"), "vol": of.at("extra", "$.vendor.implied_volatility", "double"), "seen": of.at("extra", "$.vendor.seen[0]", "double"),
        "raw_strike": of.at("extra", "$.strike_price", "string"), "sent_type": F.col("sent.contract_type"), "sent_volume": F.col("sent.volume")})


add("s06_open_chain", _open_chain, ("symbol", "expiration", "option_type", "contracts", "raw_strike", "sent_type", "sent_volume"), ("strike", "vol", "seen"),
    """SELECT symbol, expiration::VARCHAR AS expiration, option_type, volume AS contracts, CASE WHEN volume % 3 = 0 THEN 'n/a' END AS raw_strike, option_type AS sent_type,
       volume AS sent_volume, CASE WHEN volume % 3 <> 0 THEN strike END AS strike, implied_volatility AS vol, underlying_price AS seen FROM quotes""", (v.QUOTES,), digits=4)
add("s06_field_census", lambda s, d: of.census(of.open_chain(_open_chains(s, d), as_map=True)).withColumn("object", F.col("kind").startswith("OBJECT"))
    .groupBy("field", "object").agg(F.sum("rows").alias("rows")), ("field", "object", "rows"), (),
    """SELECT 'strike_price' AS field, false AS object, count(*) AS rows FROM quotes WHERE volume % 3 = 0 HAVING count(*) > 0
       UNION ALL SELECT 'volume', false, count(*) FROM quotes UNION ALL SELECT 'vendor', true, count(*) FROM quotes""", (v.QUOTES,))


def _open_feeds(s, d):
    """Articles with fields that no schema names, every second one without an id."""
    article = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("headline"), F.col("source").alias("symbol"),
                       F.struct(F.col("lang").alias("code"), F.length("text").alias("size")).alias("language"))
    return a.table(s, d, "documents").select(F.to_json(F.struct(F.array(article).alias("feed"))).alias("value"))


add("s07_open_news", lambda s, d: of.open_news(_open_feeds(s, d)).withColumns({
        "n_chars": F.length("headline").cast("bigint"), "code": of.at("extra", "$.language.code", "string"), "size": of.at("extra", "$.language.size", "bigint")}),
    ("key", "symbol", "n_chars", "code", "size"), (),
    """SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id::VARCHAR ELSE substring(text, 1, 50) END AS key, source AS symbol, length(text) AS n_chars, lang AS code,
       length(text) AS size FROM documents""")
add("s08_chain_sides",
    lambda s, d: pl.chain_sides(a.quotes(s, d).filter("option_type = 'call'").drop("option_type"),
                                a.quotes(s, d).filter("option_type = 'put'").drop("option_type")),
    ("options_ticker", "option_type"), ("strike",), "SELECT * FROM quotes", (v.QUOTES,))


def _wide_bars(s, d):
    """One row per hour, columns symbol_field, as a download of several symbols has them; the symbols come from the data."""
    bars = a.bars_hourly(s, d)
    return bars.groupBy("ts").pivot("symbol").agg(F.max("close").alias("close"), F.max("volume").alias("volume"))


def _long_bars(s, d):
    wide = _wide_bars(s, d)
    symbols = [c.removesuffix("_close") for c in wide.columns if c.endswith("_close")]
    return pl.wide_to_long(wide, symbols, ("close", "volume"))


add("s09_wide_to_long", _long_bars, (*KEY, "volume"), ("close",), "SELECT * FROM bars", (v.BARS,))


def _points(s, d):
    return pl.wide_to_points(ind.volatility(a.bars_hourly(s, d)), "stock_price", (*OHLC, "volume", "volatility_20d"))


def _flat_points(s, d):
    return _points(s, d).withColumn("symbol", F.col("tags")["symbol"])


add("k08_wide_to_points", _flat_points, ("measurement", "symbol", "ts", "field"), ("value",),
    "SELECT 'stock_price' AS measurement, ts, symbol, field, value FROM ("
    + " UNION ALL ".join(f"SELECT ts, symbol, '{c}' AS field, {c}::DOUBLE AS value FROM ind" for c in (*OHLC, "volume", "volatility_20d"))
    + ") WHERE value IS NOT NULL", (v.BARS, *v.ind_ctes()))
add("s05_points_to_wide", lambda s, d: pl.points_to_wide(_points(s, d), "stock_price", (*OHLC, "volatility_20d")), KEY,
    (*OHLC, "volatility_20d"), "SELECT * FROM ind", (v.BARS, *v.ind_ctes()))
