"""Record layouts shared by readers, writers and streaming jobs."""

from pyspark.sql import types as T

_D, _S, _L, _TS = T.DoubleType(), T.StringType(), T.LongType(), T.TimestampType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


OHLC = ("open", "high", "low", "close")

BAR = _struct(
    ("ts", _TS, False),
    ("symbol", _S, False),
    *((c, _D, True) for c in OHLC),
    ("volume", _L, True),
)

BAR_MESSAGE = _struct(
    ("symbol", _S, True),
    ("timestamp", _S, True),
    ("data", _struct(*((c, _D, True) for c in OHLC), ("volume", _L, True)), True),
)

QUOTE = _struct(
    ("ts", _TS, False),
    ("symbol", _S, False),
    ("options_ticker", _S, False),
    ("strike", _D, True),
    ("expiration", T.DateType(), True),
    ("option_type", _S, True),
    ("bid", _D, True),
    ("ask", _D, True),
    ("last", _D, True),
    ("volume", _L, True),
    ("open_interest", _L, True),
    ("implied_volatility", _D, True),
)

_QUOTE_FIELDS = (
    ("symbol", _S, True),
    ("options_ticker", _S, True),
    ("strike", _D, True),
    ("expiration", _S, True),
    ("option_type", _S, True),
    ("underlying_price", _D, True),
    ("implied_volatility", _D, True),
    ("timestamp", _S, True),
)

# Quotes arrive flat, or wrapped by the producer under "data"; one schema reads both.
QUOTE_MESSAGE = _struct(*_QUOTE_FIELDS, ("data", _struct(*_QUOTE_FIELDS), True))

GREEKS = _struct(
    ("ts", _TS, False),
    ("options_ticker", _S, False),
    *((c, _D, True) for c in ("delta", "gamma", "theta", "vega", "rho")),
)

INDICATOR_COLUMNS = (
    "sma_5", "sma_10", "sma_20", "sma_50", "rsi", "macd", "macd_signal",
    "bb_upper", "bb_lower", "volatility",
)

INDICATORS = _struct(
    ("ts", _TS, False), ("symbol", _S, False), *((c, _D, True) for c in INDICATOR_COLUMNS)
)

PREDICTION = _struct(
    ("prediction_time", _TS, False),
    ("symbol", _S, False),
    ("model_name", _S, False),
    ("horizon", _S, False),
    ("target_time", _TS, True),
    ("predicted_price", _D, True),
    ("confidence", _D, True),
    ("lower_bound", _D, True),
    ("upper_bound", _D, True),
    ("actual_price", _D, True),
)

SIGNAL = _struct(
    ("ts", _TS, False),
    ("symbol", _S, False),
    ("signal_type", _S, True),
    ("strategy", _S, False),
    ("target_price", _D, True),
    ("stop_loss", _D, True),
    ("confidence", _D, True),
    ("metadata", T.MapType(_S, _D), True),
)

TABLES = {
    "bars": BAR,
    "quotes": QUOTE,
    "greeks": GREEKS,
    "indicators": INDICATORS,
    "predictions": PREDICTION,
    "signals": SIGNAL,
}

# Unique key of each table, in index order.
TABLE_KEYS = {
    "bars": ["symbol", "ts"],
    "quotes": ["options_ticker", "ts"],
    "greeks": ["options_ticker", "ts"],
    "indicators": ["symbol", "ts"],
    "predictions": ["symbol", "model_name", "horizon", "prediction_time"],
    "signals": ["symbol", "strategy", "ts"],
}

CHAIN_PAYLOAD = _struct(
    ("symbol", _S, True),
    (
        "data",
        _struct(
            (
                "results",
                T.ArrayType(
                    _struct(
                        ("strike_price", _D, True),
                        ("expiration_date", _S, True),
                        ("contract_type", _S, True),
                    )
                ),
                True,
            )
        ),
        True,
    ),
)

ARTICLE = _struct(
    ("id", _S, True),
    ("headline", _S, True),
    ("content", _S, True),
    ("symbol", _S, True),
    ("sentiment", _D, True),
    ("timestamp", _S, True),
)

NEWS_PAYLOAD = _struct(("feed", T.ArrayType(ARTICLE), True))
