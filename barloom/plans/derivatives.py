"""Queries: scalar functions, option analytics, scenarios and chain reports."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from barloom.functions import mathfn as m
from barloom.functions import options as op
from barloom.functions import sqlfn
from barloom.operators import chains as ch
from barloom.operators import indicators as ind
from barloom.operators import scenarios as sc
from barloom.operators import surface as sf
from barloom.plans import sql_views as v
from barloom.plans.registry import AS_OF, add
from barloom.sources import adapters as a
from barloom.sources import payloads as pl

TICKER = ("options_ticker",)
KEY = ("ts", "symbol")
GREEKS = ("delta", "gamma", "vega", "theta", "rho")

# --- scalar functions -------------------------------------------------------


def _z(s, d):
    """One deviate per bar: the close scaled into about [-9, 9]."""
    return a.bars_hourly(s, d).withColumn("z", (F.col("close") - 100.0) / 12.0)


Z = "z AS (SELECT *, (close - 100) / 12 AS z FROM bars)"
add("f01_norm_cdf", lambda s, d: _z(s, d).withColumn("cdf", m.norm_cdf("z")), KEY, ("cdf",),
    f"SELECT *, {v.cdf('z', 600)} AS cdf FROM z", (v.BARS, Z), digits=9)
add("f02_norm_pdf", lambda s, d: _z(s, d).withColumn("pdf", m.norm_pdf("z")), KEY, ("pdf",),
    f"SELECT *, {v.pdf('z')} AS pdf FROM z", (v.BARS, Z), digits=9)


def _there_and_back(s, d):
    """The quantile of a probability is checked by the probability of that quantile."""
    p = a.bars_hourly(s, d).withColumn("p", (F.col("close") + 0.01) / (F.col("close") + 40.0) * 0.999)
    return p.withColumn("x", m.norm_ppf("p")).withColumns({"back": m.norm_cdf("x"), "side": F.signum("x")})


add("f03_norm_ppf", _there_and_back, KEY, ("p", "back", "side"),
    "SELECT *, p AS back, CASE WHEN p < 0.5 THEN -1 ELSE 1 END AS side FROM (SELECT *, (close + 0.01) / (close + 40) * 0.999 AS p FROM bars)",
    (v.BARS,), digits=9)
add("f04_clip", lambda s, d: a.bars_hourly(s, d).withColumn("clipped", m.clip("close", 10.0, 50.0)), KEY, ("clipped",),
    "SELECT *, least(greatest(close, 10), 50) AS clipped FROM bars", (v.BARS,))
add("f05_numeric_functions", lambda s, d: a.bars_hourly(s, d).withColumns({
        "log_close": F.ln(F.col("close") + 1.0), "exp_part": F.exp(-F.col("close") / 100.0), "root": F.sqrt("close"),
        "gap": F.abs(F.col("open") - F.col("close")), "squared": F.pow("close", F.lit(2.0)),
        "top": F.greatest("open", "close"), "bottom": F.least("open", "close")}),
    KEY, ("log_close", "exp_part", "root", "gap", "squared", "top", "bottom"),
    """SELECT *, ln(close + 1) AS log_close, exp(-close / 100) AS exp_part, sqrt(close) AS root, abs(open - close) AS gap,
       pow(close, 2) AS squared, greatest(open, close) AS top, least(open, close) AS bottom FROM bars""", (v.BARS,))
add("f06_text_functions", lambda s, d: a.table(s, d, "documents").select(
        "doc_id", F.lower("lang").alias("lower_lang"), F.replace("source", F.lit("src"), F.lit("S")).alias("short_source"),
        F.substring("text", 1, 100).alias("sample"), m.first_key(F.when(F.col("doc_id") % 3 == 0, F.col("source")), "text").alias("key")),
    ("doc_id", "lower_lang", "short_source", "sample", "key"), (),
    """SELECT doc_id, lower(lang) AS lower_lang, replace(source, 'src', 'S') AS short_source, substring(text, 1, 100) AS sample,
       CASE WHEN doc_id % 3 = 0 THEN source ELSE substring(text, 1, 50) END AS key FROM documents""")


def _iso(s, d):
    """Event times as ISO text, a third of them with a Z and some broken."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(ts, F.lit("Z"))).when(F.col("event_id") % 7 == 0, F.lit("not a time")).otherwise(ts)
    return a.table(s, d, "events").select("event_id", text.alias("timestamp"))


ISO = """iso AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ')
  WHEN event_id % 7 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS timestamp, date_trunc('second', ts) AS sent FROM events)"""
add("f07_parse_iso", lambda s, d: _iso(s, d).withColumn("age", m.age_seconds(m.parse_iso("timestamp"), F.lit(AS_OF).cast("timestamp"))),
    ("event_id", "timestamp"), ("age",),
    f"""SELECT *, CASE WHEN timestamp <> 'not a time' THEN epoch(TIMESTAMP '{AS_OF}') - epoch(sent) END AS age FROM iso""", (ISO,))
add("f08_expiry_text", lambda s, d: a.bars_hourly(s, d).withColumns({f"in_{n}": m.expiry_text(F.col("ts"), n) for n in (7, 14, 30)}),
    (*KEY, "in_7", "in_14", "in_30"), (),
    "SELECT *, " + ", ".join(f"strftime(ts::DATE + {n}, '%Y-%m-%d') AS in_{n}" for n in (7, 14, 30)) + " FROM bars", (v.BARS,))
add("f09_money_percent", lambda s, d: a.bars_hourly(s, d).withColumns(
        {"price": m.money(F.col("close") + 0.001), "moved": m.signed_percent(F.col("close") - F.col("open") + 0.001)}),
    (*KEY, "price", "moved"), (),
    "SELECT *, printf('$%.2f', close + 0.001) AS price, printf('%+.2f%%', close - open + 0.001) AS moved FROM bars", (v.BARS,))


def _json_round_trip(s, d):
    text = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("price")))
    back = F.from_json(text, "id BIGINT, kind STRING, price DOUBLE")
    k = F.from_json("props", "k INT")["k"].cast("bigint")
    return a.table(s, d, "events").select(back.alias("b"), k.alias("k")).select("b.*", "k")


add("f10_json", _json_round_trip, ("id", "kind", "k"), ("price",),
    "SELECT event_id AS id, event_type AS kind, value AS price, (props::JSON->>'k')::BIGINT AS k FROM events")
add("f11_arg_max", lambda s, d: a.bars_hourly(s, d).withColumn("probs", F.array("open", "high", "low", "close")).withColumns(
        {"best": F.array_max("probs"), "position": m.arg_max("probs").cast("bigint")}), (*KEY, "position"), ("best",),
    "SELECT *, high AS best, CASE WHEN open = high THEN 0 ELSE 1 END AS position FROM bars", (v.BARS,))

# --- option formulas --------------------------------------------------------

G = v.greeks_ctes()
add("q01_d1_d2", lambda s, d: a.quotes(s, d).withColumns({
        f: fn("underlying_price", "strike", "time_to_expiration", op.RATE, "implied_volatility", op.DIVIDEND)
        for f, fn in (("d1", op.d1), ("d2", op.d2))}), TICKER, ("d1", "d2"), "SELECT * FROM dd2", (v.QUOTES, *G[:3]))
add("q02_bs_price", lambda s, d: op.with_values(a.quotes(s, d), ("price",)), TICKER, ("price",), "SELECT * FROM greeks",
    (v.QUOTES, *G))
add("q03_q07_greeks", lambda s, d: op.with_values(a.quotes(s, d), GREEKS), TICKER, GREEKS, "SELECT * FROM greeks", (v.QUOTES, *G))
add("p03_moneyness", lambda s, d: a.quotes(s, d).withColumns({
        "moneyness": op.moneyness("underlying_price", "strike"),
        "intrinsic_value": op.intrinsic("underlying_price", "strike", "option_type")}), TICKER, ("moneyness", "intrinsic_value"),
    """SELECT *, underlying_price / strike AS moneyness, greatest(CASE WHEN option_type = 'call' THEN underlying_price - strike
       ELSE strike - underlying_price END, 0) AS intrinsic_value FROM quotes""", (v.QUOTES,))
CLOCK = "epoch(expiration::TIMESTAMP - ts) / (365.25::DOUBLE * 24 * 3600)"
add("p04_time_to_expiration", lambda s, d: a.quotes(s, d).withColumn("years", op.years_to("expiration", "ts")), TICKER, ("years",),
    f"SELECT *, {CLOCK} AS years FROM quotes", (v.QUOTES,), digits=9)
add("q08_with_greeks", lambda s, d: op.with_greeks(a.quotes(s, d)), TICKER,
    ("time_to_expiration", *GREEKS, "moneyness", "intrinsic_value"),
    """SELECT options_ticker, t AS time_to_expiration, s / k AS moneyness,
       greatest(CASE WHEN option_type = 'call' THEN s - k ELSE k - s END, 0) AS intrinsic_value,
       CASE WHEN t <= 0 THEN CASE WHEN option_type = 'call' AND s > k THEN 1 ELSE 0 END ELSE delta END AS delta,
       CASE WHEN t <= 0 THEN 0 ELSE gamma END AS gamma, CASE WHEN t <= 0 THEN 0 ELSE vega END AS vega,
       CASE WHEN t <= 0 THEN 0 ELSE theta END AS theta, CASE WHEN t <= 0 THEN 0 ELSE rho END AS rho FROM greeks""",
    (v.QUOTES, *v.greeks_ctes(t=CLOCK)))


def _recovered(s, d):
    """Price with a known volatility, then invert.  Where the price hardly depends on the
    volatility there is nothing to recover and the row shows null."""
    known = op.with_values(a.quotes(s, d), ("price", "vega"))
    solved = op.implied_vol(known, price="price", out="solved")
    return solved.withColumn("iv", F.when(F.col("vega") * 100.0 > 1.0, F.col("solved")))


add("q09_implied_vol", _recovered, TICKER, ("iv",),
    "SELECT options_ticker, CASE WHEN vega * 100 > 1 THEN v END AS iv FROM greeks", (v.QUOTES, *G), digits=4)


def _repriced(s, d):
    """Every row, also where the volatility itself cannot be recovered: the solved one has to give the price again."""
    known = op.with_values(a.quotes(s, d), ("price",)).withColumnRenamed("price", "known")
    solved = op.implied_vol(known, price="known")
    again = op.with_values(solved, ("price",))
    return again.withColumn("reproduced", F.abs(F.col("price") - F.col("known")) < 1e-4)


add("q09_repriced", _repriced, (*TICKER, "reproduced"), ("known",),
    "SELECT options_ticker, true AS reproduced, price AS known FROM greeks", (v.QUOTES, *G), digits=4)
ZED = NormalDist().inv_cdf(0.84)
add("q10_expected_move", lambda s, d: op.expected_move(a.quotes(s, d)), TICKER,
    ("move_dollars", "upper_bound", "lower_bound", "move_percent"),
    f"""SELECT *, underlying_price + mv AS upper_bound, underlying_price - mv AS lower_bound, mv AS move_dollars,
        mv / underlying_price * 100 AS move_percent FROM (SELECT *,
        underlying_price * implied_volatility * sqrt(time_to_expiration) * {ZED!r} AS mv FROM quotes)""", (v.QUOTES,))


def _sql_functions(s, d):
    sqlfn.register(s)
    a.quotes(s, d).createOrReplaceTempView("barloom_quotes")
    args = "underlying_price, strike, time_to_expiration, 0.05D, implied_volatility"
    return s.sql(f"""
        SELECT options_ticker,
          calculate_price({args}, option_type, 0.02D) AS price, calculate_delta({args}, option_type, 0.02D) AS delta,
          calculate_gamma({args}, 0.02D) AS gamma, calculate_vega({args}, 0.02D) AS vega,
          calculate_theta({args}, option_type, 0.02D) AS theta, calculate_rho({args}, option_type, 0.02D) AS rho
        FROM barloom_quotes""")


add("x01_sql_functions", _sql_functions, TICKER, ("price", *GREEKS), "SELECT * FROM greeks", (v.QUOTES, *G))

# --- scenarios --------------------------------------------------------------


HORIZON = 6


def _paths(s, d):
    """Paths from 6 consecutive 5 %-damped hourly returns per symbol, starting at 100."""
    made = ind.returns(a.bars_hourly(s, d), (1,)).withColumns(
        {"ret": m.clip(F.coalesce("return_1d", F.lit(0.0)), -0.9, 0.9) * 0.05, "s0": F.lit(100.0)}
    )
    return sc.scenario_paths(made, HORIZON)


def _ln1p(i: int) -> str:
    return " * ".join(f"(1 + lead(ret, {j}) OVER w)" if j else "(1 + ret)" for j in range(i))


RETURNS = f"""rets AS (SELECT symbol, ts, least(greatest(coalesce(close / nullif(lag(close) OVER {v.over()}, 0) - 1, 0), -0.9::DOUBLE), 0.9::DOUBLE)
  * 0.05::DOUBLE AS ret, row_number() OVER {v.over()} AS path_id, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"""
WIDE_PATHS = f"""wide_paths AS (SELECT symbol, path_id, n, 100.0::DOUBLE AS p0, {', '.join(f'100 * {_ln1p(i)} AS p{i}' for i in range(1, HORIZON + 1))}
  FROM rets WINDOW w AS (PARTITION BY symbol ORDER BY path_id) QUALIFY path_id + {HORIZON} - 1 <= n)"""
add("q14_scenario_paths", _paths, ("symbol", "path_id", "step"), ("price",),
    " UNION ALL ".join(f"SELECT symbol, path_id, {i}::INT AS step, p{i} AS price FROM wide_paths" for i in range(HORIZON + 1)),
    (v.BARS, RETURNS, WIDE_PATHS))


def _contracts(s, d):
    """Two contracts per symbol: a call at 101 and a put at 99, with barriers."""
    legs = F.array(
        F.struct(F.lit("call").alias("option_type"), F.lit(101.0).alias("strike")),
        F.struct(F.lit("put").alias("option_type"), F.lit(99.0).alias("strike")),
    )
    symbols = a.bars_hourly(s, d).select("symbol").distinct()
    return symbols.select("symbol", F.explode(legs).alias("l")).select(
        "symbol", "l.*", F.concat_ws("-", "symbol", "l.option_type").alias("contract_id"),
        F.lit(0.05).alias("rate"), F.lit(0.25).alias("years"), F.lit(None).cast("double").alias("barrier"))


FACTS = f"""facts AS (SELECT symbol, path_id, p{HORIZON} AS terminal, ({' + '.join(f'p{i}' for i in range(HORIZON + 1))}) / {HORIZON + 1} AS average,
  least({', '.join(f'p{i}' for i in range(HORIZON + 1))}) AS lowest, greatest({', '.join(f'p{i}' for i in range(HORIZON + 1))}) AS highest FROM wide_paths)"""
CONTRACTS = """contracts AS (SELECT symbol, option_type, strike, symbol || '-' || option_type AS contract_id FROM (SELECT DISTINCT symbol FROM bars),
  (VALUES ('call', 101.0::DOUBLE), ('put', 99.0::DOUBLE)) AS l(option_type, strike))"""
SETTLE = "greatest(CASE WHEN option_type = 'call' THEN {x} - strike ELSE strike - {x} END, 0)"
PAYOFF_SQL = {
    "european": SETTLE.format(x="terminal"),
    "asian": SETTLE.format(x="average"),
    "digital": "CASE WHEN option_type = 'call' THEN (terminal > strike)::INT ELSE (terminal < strike)::INT END",
    "down-out": f"CASE WHEN lowest <= 95 THEN 0 ELSE {SETTLE.format(x='terminal')} END",
    "down-in": f"CASE WHEN lowest <= 95 THEN {SETTLE.format(x='terminal')} ELSE 0 END",
    "up-out": f"CASE WHEN highest >= 106 THEN 0 ELSE {SETTLE.format(x='terminal')} END",
    "up-in": f"CASE WHEN highest >= 106 THEN {SETTLE.format(x='terminal')} ELSE 0 END",
}


def _payoff(kind):
    def run(s, d):
        barrier = 95.0 if kind.startswith("down") else 106.0
        contracts = _contracts(s, d).withColumn("barrier", F.lit(barrier))
        return sc.scenario_payoff(_paths(s, d), contracts, kind, on="symbol")

    return run


for _kind in sc.KINDS:
    add(f"q11_payoff_{_kind.replace('-', '_')}", _payoff(_kind), ("contract_id", "paths"), ("price", "std_error", "ci_lower", "ci_upper"),
        f"""SELECT *, price - 1.96 * std_error AS ci_lower, price + 1.96 * std_error AS ci_upper FROM (SELECT contract_id, count(*) AS paths,
            avg(x) AS price, stddev_pop(x) / sqrt(count(*)) AS std_error FROM (SELECT contract_id,
            exp(-0.05::DOUBLE * 0.25::DOUBLE) * ({PAYOFF_SQL[_kind]}) AS x FROM facts JOIN contracts USING (symbol)) GROUP BY 1)""",
        (v.BARS, RETURNS, WIDE_PATHS, FACTS, CONTRACTS))


def _many(kind):
    def run(s, d):
        barrier = 95.0 if kind.startswith("down") else 106.0
        contracts = _contracts(s, d).withColumn("barrier", F.lit(barrier))
        return sc.scenario_payoff_many(sc.path_facts(_paths(s, d), ("symbol",)), contracts, kind)

    return run


for _kind in ("european", "digital", "down-out"):
    add(f"q11_many_{_kind.replace('-', '_')}", _many(_kind), ("contract_id", "paths"), ("price", "std_error", "ci_lower", "ci_upper"),
        f"""SELECT *, price - 1.96 * std_error AS ci_lower, price + 1.96 * std_error AS ci_upper FROM (SELECT contract_id, count(*) AS paths,
            avg(x) AS price, stddev_pop(x) / sqrt(count(*)) AS std_error FROM (SELECT contract_id,
            exp(-0.05::DOUBLE * 0.25::DOUBLE) * ({PAYOFF_SQL[_kind]}) AS x FROM facts JOIN contracts USING (symbol)) GROUP BY 1)""",
        (v.BARS, RETURNS, WIDE_PATHS, FACTS, CONTRACTS))


def _line_values(s, d):
    """A plain payoff sample: one discounted value per line item and contract class."""
    return a.table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("contract_id"),
        (F.greatest(F.col("l_extendedprice") / F.col("l_quantity") - 1000.0, F.lit(0.0)) * F.exp(F.lit(-0.0125))).alias("value"),
    )


add("q12_estimate", lambda s, d: sc.estimate(_line_values(s, d), "value"), ("contract_id", "paths"), ("price", "std_error", "ci_lower", "ci_upper"),
    """SELECT *, price - 1.96 * std_error AS ci_lower, price + 1.96 * std_error AS ci_upper FROM (SELECT l_returnflag AS contract_id,
       count(*) AS paths, avg(x) AS price, stddev_pop(x) / sqrt(count(*)) AS std_error FROM (SELECT l_returnflag,
       greatest(l_extendedprice / l_quantity - 1000, 0) * exp(-0.0125::DOUBLE) AS x FROM lineitem) GROUP BY 1)""", digits=4)


def _pnl(s, d):
    return a.table(s, d, "lineitem").select(
        F.col("l_returnflag").alias("portfolio"),
        (F.col("l_extendedprice") - 50_000.0).alias("pnl"),
        F.lit(50_000.0).alias("initial_value"),
    )


add("q13_var_cvar", lambda s, d: sc.var_cvar(_pnl(s, d)), ("portfolio", "scenarios"), ("var", "cvar", "var_percent", "cvar_percent"),
    """SELECT portfolio, n AS scenarios, -max(CASE WHEN i = k THEN pnl END) AS var, -avg(CASE WHEN i < k THEN pnl END) AS cvar,
       -max(CASE WHEN i = k THEN pnl END) / 50000 * 100 AS var_percent, -avg(CASE WHEN i < k THEN pnl END) / 50000 * 100 AS cvar_percent
       FROM (SELECT *, floor((1 - 0.95::DOUBLE) * n) AS k FROM (SELECT l_returnflag AS portfolio, l_extendedprice - 50000 AS pnl,
       row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i,
       count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)) GROUP BY portfolio, n""", digits=4)

# --- chain reports ----------------------------------------------------------


def _monthly(s, d):
    """Quotes with strikes rounded to ten and expirations moved to the month's first day."""
    q = op.with_values(a.quotes(s, d), ("gamma",))
    return q.withColumns({"strike": F.round(F.col("strike") / 10.0 + 1e-9) * 10.0, "expiration": F.trunc("expiration", "MM"),
                          "last": F.col("underlying_price") * F.col("implied_volatility")})


MONTHLY = """monthly AS (SELECT * EXCLUDE (strike, expiration), round(strike / 10 + 1e-9) * 10 AS strike,
  date_trunc('month', expiration)::DATE AS expiration, underlying_price * implied_volatility AS last FROM quotes)"""
add("q15_chain_pivot", lambda s, d: ch.chain_pivot(_monthly(s, d)), ("symbol",), ("strike", "call", "put"),
    """SELECT symbol, strike, avg(last) FILTER (option_type = 'call') AS call, avg(last) FILTER (option_type = 'put') AS put
       FROM monthly GROUP BY 1, 2""", (v.QUOTES, MONTHLY))
add("q16_iv_surface", lambda s, d: ch.iv_surface(_monthly(s, d)), ("symbol", "days_bucket", "quotes"), ("strike_bucket", "implied_volatility"),
    """SELECT symbol, floor(strike / 10) * 10 AS strike_bucket, (floor((expiration - ts::DATE) / 30.0::DOUBLE) * 30)::BIGINT AS days_bucket,
       avg(implied_volatility) AS implied_volatility, count(*) AS quotes FROM monthly GROUP BY 1, 2, 3""", (v.QUOTES, MONTHLY))


def _latest_surface(s, d):
    """Quotes of a month, type and strike are one contract; its newest at the date counts."""
    quotes = _monthly(s, d).withColumn("contract", F.concat_ws("|", "symbol", "option_type", F.col("strike").cast("long"), "expiration"))
    made = sf.latest_surface(quotes, SURFACE_DATE, 50.0, 30, "contract", tie=("options_ticker",))
    return made.where("filled = 'observed'")


SURFACE_DATE = "1995-06-30"
add("q16_latest_surface", _latest_surface, ("symbol", "days_bucket", "quotes"), ("strike_bucket", "implied_volatility"),
    f"""SELECT symbol, floor(strike / 50) * 50 AS strike_bucket, (floor((expiration - DATE '{SURFACE_DATE}') / 30.0::DOUBLE) * 30)::BIGINT AS days_bucket,
       avg(implied_volatility) AS implied_volatility, count(*) AS quotes FROM (SELECT * FROM monthly WHERE ts <= TIMESTAMP '{SURFACE_DATE}' AND expiration >= DATE '{SURFACE_DATE}'
       QUALIFY row_number() OVER (PARTITION BY symbol, option_type, strike::BIGINT, expiration ORDER BY ts DESC, options_ticker DESC) = 1) GROUP BY 1, 2, 3""", (v.QUOTES, MONTHLY))
add("q17_put_call_ratio", lambda s, d: ch.put_call_ratio(a.quotes(s, d)), KEY, ("put_call_ratio",),
    f"""SELECT ts, symbol, sum(puts) OVER {v.last(20)} / nullif(sum(calls) OVER {v.last(20)}, 0)::DOUBLE AS put_call_ratio FROM (
        SELECT date_trunc('day', ts)::TIMESTAMP AS ts, symbol, sum(CASE WHEN option_type = 'put' THEN volume ELSE 0 END) AS puts,
        sum(CASE WHEN option_type = 'call' THEN volume ELSE 0 END) AS calls FROM quotes GROUP BY 1, 2)""", (v.QUOTES,))


add("q17_iv_percentile", lambda s, d: ch.iv_percentile(ch.daily_iv(a.quotes(s, d)), slot="52 weeks"), KEY, ("iv_percentile",),
    f"""SELECT ts, symbol, len(list_filter(past, lambda x: x < iv)) * 100.0::DOUBLE / len(past) AS iv_percentile FROM (
        SELECT *, list(iv) OVER {v.last(252)} AS past FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, symbol,
        round(avg(implied_volatility), 6) AS iv FROM quotes GROUP BY 1, 2))""", (v.QUOTES,))
add("q17_max_pain", lambda s, d: ch.max_pain(_monthly(s, d)), ("symbol", "expiration"), ("max_pain", "payout"),
    """SELECT symbol, expiration::VARCHAR AS expiration, arg_min(x, (round(pain, 4), x)) AS max_pain, min(pain) AS payout FROM (
       SELECT a.symbol, a.expiration, a.strike AS x, sum(CASE WHEN b.option_type = 'call' THEN greatest(a.strike - b.strike, 0)
       ELSE greatest(b.strike - a.strike, 0) END * b.oi) AS pain
       FROM (SELECT DISTINCT symbol, expiration, strike FROM monthly) a
       JOIN (SELECT symbol, expiration, strike, option_type, sum(open_interest)::DOUBLE AS oi FROM monthly GROUP BY 1, 2, 3, 4) b
       ON a.symbol = b.symbol AND a.expiration = b.expiration GROUP BY 1, 2, 3) GROUP BY 1, 2""", (v.QUOTES, MONTHLY), digits=3)
add("q17_gamma_exposure", lambda s, d: ch.gamma_exposure(op.with_values(a.quotes(s, d), ("gamma",))), ("symbol",), ("gamma_exposure",),
    """SELECT symbol, sum(gamma * open_interest * 100 * s * s * 0.01::DOUBLE * CASE WHEN option_type = 'call' THEN 1 ELSE -1 END) AS gamma_exposure
       FROM greeks GROUP BY symbol""", (v.QUOTES, *G), digits=1)


def _quote_points(s, d):
    priced = a.priced_quotes(s, d)
    made = pl.wide_to_points(priced, "option_quote", ("bid", "ask", "implied_volatility", "open_interest"))
    return made.withColumn("options_ticker", F.col("tags")["options_ticker"])


add("k08_quote_points", _quote_points, ("measurement", "options_ticker", "ts", "field"), ("value",),
    "SELECT 'option_quote' AS measurement, options_ticker, ts, field, value FROM ("
    + " UNION ALL ".join(f"SELECT options_ticker, ts, '{n}' AS field, {x} AS value FROM greeks" for n, x in
                         (("bid", "price * 0.95::DOUBLE"), ("ask", "price * 1.05::DOUBLE"), ("implied_volatility", "v"), ("open_interest", "open_interest::DOUBLE")))
    + ")", (v.QUOTES, *G), digits=4)
