"""Row-ordered windows that do not put a whole symbol into one task.

A window over ``partitionBy(symbol).orderBy(ts)`` sends every row of a symbol to
one task, and one symbol may hold a third of the table.  ``spread`` cuts each
symbol into runs of consecutive rows instead ("chunks").  Rows close to a cut
are copied into the neighbouring chunk, so that any frame of up to ``back``
preceding and ``ahead`` following rows sees exactly the rows it would see in
the uncut series; the copies are dropped after the window ran.

How the cut is found: one pruned pass counts rows per (symbol, time slot); a
running sum over those counts gives the position at which each slot starts, and
a slot belongs to chunk ``position div rows``.  The counts are tiny next to the
data, and AQE broadcasts them if their measured size allows.  The data itself
is shuffled once, on (symbol, chunk).

Rows without a time or key belong to no series: they stay in the result, with nulls in the derived
columns.  A slot is never split, so choose ``slot`` such that it holds a bounded number of
distinct timestamps: with 1-minute bars a 1-day slot has at most 1,440 rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 65_536
APART = 1_024  # chunks for rows that belong to no series
SLOT = "1 day"

_UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400, "week": 604_800}
_CHUNK, _OWN, _BEFORE, _TOTAL, _SLOT = "_chunk", "_own", "_before", "_total", "_slot"
_HELPERS = (_CHUNK, _OWN, _BEFORE, _TOTAL, _SLOT)


def keys(by: str | Sequence[str]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def seconds(length: str) -> int:
    """'15 minutes' -> 900."""
    n, unit = length.split()
    return int(n) * _UNITS[unit.rstrip("s")]


def slot_of(ts: str | Column, slot: str) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(ts) / F.lit(seconds(slot) * 1_000_000))


def slot_table(
    df: DataFrame, by, ts: str, slot: str, extra: Sequence[Column] = ()
) -> DataFrame:
    """Rows per (by, slot), rows before the slot and rows of the whole series."""
    by = keys(by)
    counts = (
        df.dropna(subset=[*by, ts])
        .withColumn(_SLOT, slot_of(ts, slot))
        .groupBy(*by, _SLOT)
        .agg(F.count(F.lit(1)).alias("_n"), *extra)
    )
    series = W.partitionBy(*by)
    earlier = series.orderBy(_SLOT).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumns(
        {
            _BEFORE: F.coalesce(F.sum("_n").over(earlier), F.lit(0)),
            _TOTAL: F.sum("_n").over(series),
        }
    )


def spread(
    df: DataFrame,
    by="symbol",
    ts: str = "ts",
    back: int = 0,
    ahead: int = 0,
    rows: int = CHUNK_ROWS,
    slot: str = SLOT,
    extra: Sequence[Column] = (),
    carry: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Assign chunks; adds ``_chunk``, ``_own``, ``_before`` and ``_total``.

    ``extra`` are aggregates kept per slot and ``carry`` may turn them into
    columns that travel with the rows (values known before the slot).
    """
    by = keys(by)
    table = slot_table(df, by, ts, slot, extra)
    if carry is not None:
        table = carry(table)
    own = F.floor(F.col(_BEFORE) / rows)
    end = F.col(_BEFORE) + F.col("_n")
    targets = F.array(own)
    if back > 0:
        # The next `back` rows start at `end`; a frame longer than a chunk reaches several.
        targets = F.concat(targets, F.sequence(F.floor(end / rows), F.floor((end + back - 1) / rows)))
    table = table.withColumn("_home", own)
    if ahead > 0:
        previous = W.partitionBy(*by).orderBy(_SLOT).rowsBetween(-ahead, -1)
        table = table.withColumn(
            "_earlier", F.collect_list(F.struct(end.alias("e"), own.alias("c"))).over(previous)
        )
        wanted = F.filter("_earlier", lambda x: x["e"] > F.col(_BEFORE) - ahead)
        targets = F.concat(targets, F.transform(wanted, lambda x: x["c"]))
    table = table.withColumn("_targets", F.array_distinct(targets)).drop("_n", "_earlier")
    placed = df.withColumn(_SLOT, slot_of(ts, slot)).join(table, [*by, _SLOT], "left")
    # Rows of no series are dealt out by hash below zero.
    apart = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(APART)).cast("long")
    placed = placed.withColumns({"_home": F.coalesce("_home", apart), "_targets": F.coalesce("_targets", F.array(apart))})
    if back == 0 and ahead == 0:
        return placed.withColumnsRenamed({"_home": _CHUNK}).withColumn(_OWN, F.lit(True)).drop("_targets")
    return (
        placed.withColumn(_CHUNK, F.explode("_targets"))
        .withColumn(_OWN, F.col(_CHUNK) == F.col("_home"))
        .drop("_targets", "_home")
    )


def in_series() -> Column:
    """Whether a spread row belongs to a series."""
    return F.col(_CHUNK) >= 0


def chunk_window(by="symbol", ts: str = "ts", tie: Sequence[str] = ()):
    return W.partitionBy(*keys(by), _CHUNK).orderBy(ts, *tie)


def position(w) -> Column:
    """1-based position of the row in its whole series, for use inside ``ordered``."""
    running = w.rowsBetween(W.unboundedPreceding, 0)
    return F.first(_BEFORE).over(running) + F.row_number().over(w)


def series_length() -> Column:
    return F.col(_TOTAL)


def settle(df: DataFrame) -> DataFrame:
    """Drop the copied rows and the helper columns."""
    return df.filter(_OWN).drop(*_HELPERS)


def ordered(
    df: DataFrame,
    layer: Callable,
    *,
    back: int = 0,
    ahead: int = 0,
    by="symbol",
    ts: str = "ts",
    tie: Sequence[str] = (),
    rows: int = CHUNK_ROWS,
    slot: str = SLOT,
) -> DataFrame:
    """Run ``layer(df, window)`` over every series in ``ts`` order.

    ``back``/``ahead`` is the total reach of the layer in rows: a return of a
    20-row mean of a 1-row lag reaches 20 rows back.
    """
    cut = spread(df, by, ts, back, ahead, rows, slot)
    done = layer(cut, chunk_window(by, ts, tie))
    known = {*df.columns, *_HELPERS}
    return settle(done.withColumns({c: F.when(in_series(), F.col(c)) for c in done.columns if c not in known}))
