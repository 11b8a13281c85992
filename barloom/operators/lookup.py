"""Filters, latest values, top-k, joins and set operations over the tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import ordered as o
from barloom.sources.staging import staged


def instant(as_of) -> Column:
    """Timestamp literal, text or Column -> Column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def interval(length: str) -> Column:
    return F.make_dt_interval(secs=F.lit(o.seconds(length)))


# --- filters ----------------------------------------------------------------


def add_meta(df: DataFrame, ts="ts", as_of=None) -> DataFrame:
    now = F.current_timestamp() if as_of is None else instant(as_of)
    return df.withColumns({"processing_time": now, "date": F.to_date(ts)})


def price_history(bars: DataFrame, symbol: str, start, end, ts="ts") -> DataFrame:
    wanted = (F.col("symbol") == symbol) & F.col(ts).between(instant(start), instant(end))
    return bars.filter(wanted).orderBy(ts)


def relative_range(df: DataFrame, lookback: str, as_of, ts="ts") -> DataFrame:
    return df.filter((F.col(ts) > instant(as_of) - interval(lookback)) & (F.col(ts) <= instant(as_of)))


# --- latest and top-k -------------------------------------------------------


def latest(df: DataFrame, by="symbol", ts="ts", tie: Sequence[str] = (), lookback=None, as_of=None) -> DataFrame:
    """Newest row per key.  Map tasks reduce to one row per key before the shuffle."""
    if lookback is not None:
        df = relative_range(df, lookback, as_of, ts)
    by = o.keys(by)
    order = F.struct(ts, *tie) if tie else F.col(ts)
    rest = [c for c in df.columns if c not in by]
    newest = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return newest.select(*by, "_row.*").select(*df.columns)


def first_ranked(df: DataFrame, by, order: Sequence[Column], n: int) -> DataFrame:
    """First n rows per key; Spark keeps n rows per key and map task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*o.keys(by)).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def last_n(df: DataFrame, n: int, by="symbol", ts="ts", tie: Sequence[str] = ()) -> DataFrame:
    return first_ranked(df, by, [F.col(c).desc() for c in (ts, *tie)], n)


def newest_rows(df: DataFrame, n: int, ts="ts", tie: Sequence[str] = (), symbol=None) -> DataFrame:
    if symbol is not None:
        df = df.filter(F.col("symbol") == symbol)
    return df.orderBy(F.col(ts).desc(), *tie).limit(n)


def latest_chain(quotes: DataFrame, symbol: str, min_expiration=None, ts="ts", tie: Sequence[str] = ()) -> DataFrame:
    """Newest quote per contract of one symbol, optionally from an expiration on; ``tie`` decides between equal times."""
    chain = quotes.filter(F.col("symbol") == symbol)
    if min_expiration is not None:
        chain = chain.filter(F.col("expiration") >= F.lit(min_expiration).cast("date"))
    return latest(chain, "options_ticker", ts, tie)


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_n_per_sector(universe: DataFrame, n: int = 10) -> DataFrame:
    return universe.filter(F.col("rank") <= n)


def universe_symbols(universe: DataFrame, sector: str | None = None) -> DataFrame:
    if sector is not None:
        return universe.filter(F.col("sector") == sector).orderBy("rank").select("symbol")
    return universe.select("symbol").distinct().orderBy("symbol")


def market_movers(changes: DataFrame, k: int = 20, by="symbol") -> DataFrame:
    """Top gainers, top losers and most active rows; input has change_pct and volume.

    One pass: every row stands for each list with its sort value, and each map task keeps k rows per list.
    """
    value = {"top_gainers": -F.col("change_pct"), "top_losers": F.col("change_pct"), "most_actively_traded": -F.col("volume")}
    lists = F.array(*[F.struct(F.lit(name).alias("list"), v.cast("double").alias("_value")) for name, v in value.items()])
    listed = changes.select("*", F.inline(lists))
    return first_ranked(listed, "list", [F.col("_value").asc_nulls_last(), F.col(by)], k).drop("_value")


def expirations(quotes: DataFrame, as_of=None) -> DataFrame:
    """Per symbol: nearest expiration and the sorted list of expirations."""
    if as_of is not None:
        quotes = quotes.filter(F.col("expiration") >= F.to_date(instant(as_of)))
    days = quotes.select("symbol", "expiration").distinct()
    return days.groupBy("symbol").agg(
        F.min("expiration").alias("nearest"),
        F.array_sort(F.collect_list("expiration")).alias("expirations"),
    )


def expiration_dates(quotes: DataFrame) -> DataFrame:
    return quotes.select("symbol", "expiration").distinct()


def pick_provider(frames: dict[str, DataFrame], priority: Sequence[str], by="symbol") -> DataFrame:
    """Per symbol, the rows of the best available provider.

    The best rank per symbol is a small aggregate joined back, so no symbol's rows are
    gathered in one task.
    """
    merged = None
    for rank, name in enumerate(priority):
        if name in frames:
            part = frames[name].withColumns({"provider": F.lit(name), "_rank": F.lit(rank)})
            merged = part if merged is None else merged.unionByName(part, allowMissingColumns=True)
    best = merged.groupBy(by).agg(F.min("_rank").alias("_rank"))
    return merged.join(best, [by, "_rank"], "left_semi").drop("_rank")


# --- joins ------------------------------------------------------------------


def with_indicators(bars: DataFrame, indicators: DataFrame | None, how="inner", on=("ts", "symbol")) -> DataFrame:
    """bars with their indicator row; without indicators, or if there are none, all bars come back (with nulls)."""
    if indicators is None:
        return bars
    extra = [c for c in indicators.columns if c in on or c not in bars.columns]
    if how != "inner":
        return bars.join(indicators.select(*extra), list(on), how)
    # Whether any row exists is a scalar subquery, so the choice is made when the plan runs.
    some = indicators.limit(1).agg(F.count(F.lit(1)).alias("_n")).select(F.col("_n") > 0).scalar()
    joined = bars.join(indicators.select(*extra).withColumn("_matched", F.lit(True)), list(on), "left")
    return joined.withColumn("_some", some).filter(F.col("_matched") | ~F.col("_some")).drop("_matched", "_some")


def align(actual: DataFrame, predicted: DataFrame, on=("symbol", "ts")) -> DataFrame:
    return actual.join(predicted, list(on))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    *,
    by="symbol",
    left_ts="ts",
    right_ts="ts",
    forward: bool = False,
    rows: int = o.CHUNK_ROWS,
    slot: str = o.SLOT,
) -> DataFrame:
    """Attach the last right row at or before ``left_ts`` (forward: the first at or after).

    Both sides meet per (key, time slot); a value from an earlier slot comes from a small
    carry table.  Where a slot holds more than ``rows`` left rows, these are split over
    several salts and only the right rows of that slot are copied to each.  ``right`` has
    one row per (key, right_ts), neither null.
    """
    by = o.keys(by)
    L = left.select(*by, F.col(left_ts).alias("_t"), F.struct(*left.columns).alias("_l"),
                    F.xxhash64(*[c for c, t in left.dtypes if not t.startswith("map")]).alias("_h"))
    R = right.select(*by, F.col(right_ts).alias("_t"), F.struct(*values).alias("_r"))
    L, R = (d.withColumn("_slot", o.slot_of("_t", slot)) for d in (L, R))
    at_right = F.when(F.col("_r").isNotNull(), F.col("_t"))
    edge = (F.min_by if forward else F.max_by)("_r", at_right)
    table = (
        L.select(*by, "_slot", "_t", F.lit(1).alias("_k"), F.lit(None).cast(R.schema["_r"].dataType).alias("_r"))
        .unionByName(R.select(*by, "_slot", "_t", F.lit(0).alias("_k"), "_r"))
        .groupBy(*by, "_slot")
        .agg(F.sum("_k").alias("_n"), edge.alias("_edge"))
    )
    series = W.partitionBy(*by).orderBy(F.col("_slot").desc() if forward else F.col("_slot"))
    # A row per slot, which both sides are joined with.
    table = staged(table.dropna(subset=[*by, "_slot"]).select(
        *by,
        "_slot",
        F.last("_edge", ignorenulls=True).over(series.rowsBetween(W.unboundedPreceding, -1)).alias("_carry"),
        F.greatest(F.ceil(F.col("_n") / rows), F.lit(1)).alias("_salts"),
    ), "slots")
    # Left rows without a key or a time meet no right row, but stay, dealt out by hash.
    salted_left = L.join(table, [*by, "_slot"], "left").withColumn("_salt", F.pmod("_h", F.coalesce("_salts", F.lit(o.APART))))
    salted_right = R.join(table, [*by, "_slot"]).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))
    )
    both = salted_left.withColumn("_side", F.lit(1)).unionByName(
        salted_right.withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    # A right row at the same instant counts in either direction, so it comes first.
    time = F.col("_t").desc() if forward else F.col("_t")
    w = W.partitionBy(*by, "_slot", "_salt").orderBy(time, "_side").rowsBetween(W.unboundedPreceding, 0)
    found = F.coalesce(F.last("_r", ignorenulls=True).over(w), F.col("_carry"))
    return both.withColumn("_m", found).filter(F.col("_side") == 1).select("_l.*", "_m.*")


def attach_underlying(quotes: DataFrame, bars: DataFrame, **kw) -> DataFrame:
    return asof_join(quotes, bars.withColumn("underlying_price", F.col("close")), ["underlying_price"], **kw)


def attach_actual(predictions: DataFrame, bars: DataFrame, exact: bool = True, **kw) -> DataFrame:
    """Price at target_time: of that very bar, or of the first bar from then on."""
    predictions = predictions.drop("actual_price")
    if exact:
        prices = bars.select("symbol", F.col("ts").alias("target_time"), F.col("close").alias("actual_price"))
        return predictions.join(prices, ["symbol", "target_time"], "left")
    bars = bars.withColumn("actual_price", F.col("close"))
    return asof_join(predictions, bars, ["actual_price"], left_ts="target_time", forward=True, **kw)


def with_sector(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe.select("symbol", "sector"), "symbol")


def split_keys(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every update key, marked as matched in the target or not."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    return (
        updates.select(*keys).distinct().join(known, list(keys), "left")
        .withColumn("matched", F.col("_known").isNotNull()).drop("_known")
    )


def with_model(symbols: DataFrame, models: DataFrame) -> DataFrame:
    return symbols.join(models, "symbol", "left_semi").orderBy("symbol")


# --- sets -------------------------------------------------------------------


def union_sectors(universe: DataFrame, sectors: Sequence[str]) -> DataFrame:
    return universe.filter(F.col("sector").isin(*sectors)).select("symbol").distinct()


def common_keys(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))


def missing_keys(requested: DataFrame, available: DataFrame, on: Sequence[str]) -> DataFrame:
    return requested.select(*on).distinct().join(available, list(on), "left_anti")
