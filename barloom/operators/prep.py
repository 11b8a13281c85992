"""Preparing training data: feature choice, gaps, targets, splits, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import ordered as o


def select_features(df: DataFrame, wanted: Sequence[str], min_features: int = 10,
                    keep: Sequence[str] = ("ts", "symbol")) -> DataFrame:
    """Keep the wanted columns that exist; too few is an error."""
    present = [c for c in wanted if c in df.columns]
    if len(present) < min_features:
        raise ValueError(f"{len(present)} of {len(wanted)} features present, {min_features} needed")
    return df.select(*[c for c in keep if c in df.columns and c not in present], *present)


def missing_features(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def drop_incomplete(df: DataFrame, cols: Sequence[str], min_rows: int = 100, by="symbol") -> DataFrame:
    """Drop rows with null or NaN, then every series left with fewer than ``min_rows`` rows."""
    types = dict(df.dtypes)
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
        if types[c] in ("double", "float"):
            whole = whole & ~F.isnan(c)
    complete = df.filter(whole)
    kept = complete.groupBy(*o.keys(by)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_rows)
    return complete.join(kept.drop("_n"), o.keys(by), "left_semi")


def fill_missing(df: DataFrame, cols: Sequence[str], by="symbol", ts="ts", tie=(),
                 rows=o.CHUNK_ROWS, slot=o.SLOT) -> DataFrame:
    """Forward fill, then backward fill, then drop rows that are still null.

    The last known value before each slot travels with the slot table, so a gap of
    any length is filled without reading the series in one task.
    """
    def clean(c):
        return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))

    extra = []
    for c in cols:
        seen = F.when(clean(c).isNotNull(), F.col(ts))
        extra += [F.max_by(clean(c), seen).alias(f"_l_{c}"), F.min_by(clean(c), seen).alias(f"_f_{c}")]

    def carry(table):
        series = W.partitionBy(*o.keys(by)).orderBy(o._SLOT)
        earlier = series.rowsBetween(W.unboundedPreceding, -1)
        whole = series.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        table = table.withColumns(
            {f"_p_{c}": F.last(f"_l_{c}", ignorenulls=True).over(earlier) for c in cols}
            | {f"_h_{c}": F.first(f"_f_{c}", ignorenulls=True).over(whole) for c in cols}
        )
        return table.drop(*(f"_{k}_{c}" for c in cols for k in "lf"))

    cut = o.spread(df, by, ts, 0, 0, rows, slot, extra, carry)
    running = o.chunk_window(by, ts, tie).rowsBetween(W.unboundedPreceding, 0)
    filled = cut.withColumns({c: clean(c) for c in cols}).withColumns(
        {
            c: F.when(o.in_series(), F.coalesce(F.last(c, ignorenulls=True).over(running), F.col(f"_p_{c}"), F.col(f"_h_{c}"))).otherwise(F.col(c))
            for c in cols
        }
    )
    return o.settle(filled).drop(*(f"_{k}_{c}" for c in cols for k in "ph")).dropna(subset=list(cols))


def next_target(df: DataFrame, column="close", lead=1, out="target", **ordering) -> DataFrame:
    """Value ``lead`` rows ahead; rows without one are removed.  ``lead=0`` is the row's own value."""
    if lead == 0:
        return df.withColumn(out, F.col(column))

    def layer(d, w):
        return d.withColumn(out, F.lead(column, lead).over(w)).withColumn(
            "_rest", o.series_length() - o.position(w)
        )

    # Positions are counted from the chunk's first row, copied or not.
    return o.ordered(df, layer, ahead=lead, **ordering).filter(F.col("_rest") >= lead).drop("_rest")


def sequences(df: DataFrame, features: Sequence[str], target="close", n=60, **ordering) -> DataFrame:
    """The n rows strictly before each row as an array of feature arrays, and the row's target."""
    def layer(d, w):
        frame = w.rowsBetween(-n, -1)
        row = F.array(*[F.col(c).cast("double") for c in features])
        return d.withColumn("sequence", F.collect_list(row).over(frame)).withColumn(
            "target", F.col(target)
        )

    return o.ordered(df, layer, back=n, **ordering).filter(F.size("sequence") == n)


def chrono_split(df: DataFrame, train=0.8, validation=0.15, rounding="floor_train", **ordering) -> DataFrame:
    """Label each row train, validation (the last part of train) or test, in time order.

    ``floor_train``: train size is int(n * train).  ``ceil_test``: the test part, and the
    validation part of the rest, are rounded up.
    """
    def layer(d, w):
        n = o.series_length()
        if rounding == "floor_train":
            n_train = F.floor(n * F.lit(train))
            n_fit = F.floor(n_train * F.lit(1.0 - validation))
        elif rounding == "ceil_test":
            # 1 - 0.8 is 0.19999999999999996 in binary; the share is meant as a decimal.
            n_train = n - F.ceil(n * F.lit(round(1.0 - train, 10)))
            n_fit = n_train - F.ceil(n_train * F.lit(validation))
        else:
            raise ValueError(f"unknown rounding: {rounding}")
        i = o.position(w)
        label = F.when(i <= n_fit, "train").when(i <= n_train, "validation").otherwise("test")
        return d.withColumn("split", label)

    return o.ordered(df, layer, **ordering)


def fit_scaler(df: DataFrame, cols: Sequence[str], by="symbol") -> DataFrame:
    """Mean and population standard deviation per feature, one row per group."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")]
    return df.groupBy(*o.keys(by)).agg(*aggs)


def _unit(std):
    return F.when(F.col(std) == 0, 1.0).otherwise(F.col(std))


def scale(df: DataFrame, scaler: DataFrame, cols: Sequence[str], by="symbol") -> DataFrame:
    """The scaler has one row per symbol; AQE broadcasts it if its measured size allows."""
    joined = df.join(scaler, o.keys(by))
    return joined.withColumns(
        {c: (F.col(c) - F.col(f"{c}_mean")) / _unit(f"{c}_std") for c in cols}
    ).select(*df.columns)


def unscale(df: DataFrame, scaler: DataFrame, cols: dict[str, str] | Sequence[str], by="symbol") -> DataFrame:
    """Back to price units.  ``cols`` maps a column to the feature whose statistics apply."""
    cols = cols if isinstance(cols, dict) else {c: c for c in cols}
    joined = df.join(scaler, o.keys(by))
    return joined.withColumns(
        {c: F.col(c) * _unit(f"{f}_std") + F.col(f"{f}_mean") for c, f in cols.items()}
    ).select(*df.columns)
