"""Exact order statistics and percentiles by counting, without sorting a group and without a sketch.

Spark's exact ``percentile`` keeps every distinct value of a group in one aggregation buffer.  Here
three passes find the values at the wanted ranks:

1. count rows per magnitude: buckets that span a quarter of a power of two, the same for all data;
2. inside the bucket that holds a rank, count rows per one of ``BINS`` equal parts of its range;
3. inside that part, count rows per distinct value.

Every pass is a plain aggregation reduced before the shuffle, so it holds as many rows per group as there are buckets, and a
rank always lies in the bucket where the running count passes it.  All sizes take the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.sources.staging import staged

BINS = 65_536
_FAR = 100_000  # bucket of the infinities, beyond every finite magnitude


def _magnitude(x: Column) -> Column:
    finite = F.floor((F.log2(F.abs(x)) + 1_080) * 4).cast("int")
    size = F.when(F.abs(x) == float("inf"), _FAR).when(x != 0, finite + 1).otherwise(0)
    return F.when(x < 0, -size).otherwise(size)


def with_row(df: DataFrame, by: Sequence[str], row: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the columns of its group's row (null keys are a group); without ``by`` the only row is a scalar subquery."""
    if not by:
        return df.withColumn("_row", row.select(F.struct(*columns)).scalar()).select("*", "_row.*").drop("_row")
    named = row.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], *columns)
    on = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    return df.join(named, on).drop(*[f"_by{i}" for i in range(len(by))])


def _slim(df: DataFrame, col: str, by: Sequence[str]) -> DataFrame:
    x = F.col(col).cast("double")
    return df.select(*by, (x + 0.0).alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))


def _holding(counts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Adds ``_upto``, the running count; a row holds the ranks (_upto - _c, _upto]."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return counts.withColumn("_upto", F.sum("_c").over(w))


def _inside(slim: DataFrame, by: Sequence[str], wanted: DataFrame) -> DataFrame:
    """Rows that lie in the range of a wanted rank, once for each such rank."""
    joined = with_row(slim, by, wanted, ["_wanted"])
    within = F.filter("_wanted", lambda t: (F.col("_x") >= t["lo"]) & (F.col("_x") <= t["hi"]))
    return joined.select(*by, "_x", F.inline(within))


def order_statistics(df: DataFrame, col: str, ranks: Callable[[Column], list[Column]], by: Sequence[str] = ()) -> DataFrame:
    """Per group ``_n`` and ``v_0, v_1, ...``: the values at the 1-based ranks that ``ranks(_n)`` names.

    Null and NaN are left out; -0.0 counts as 0.0.  The source is read once: its keys and values are staged for the three passes.
    """
    return _ranked(staged(_slim(df, col, list(by)), "values"), ranks, list(by))


def _ranked(slim: DataFrame, ranks: Callable[[Column], list[Column]], by: list[str]) -> DataFrame:
    tally = [F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")]
    coarse = _holding(slim.groupBy(*by, _magnitude(F.col("_x")).alias("_bin")).agg(*tally), by, "_bin")
    coarse = coarse.withColumn("_n", F.sum("_c").over(W.partitionBy(*by)))
    names = [r.cast("long") for r in ranks(F.col("_n"))]
    targets = F.array(*[F.struct(F.lit(i).alias("i"), r.alias("rank")) for i, r in enumerate(names)])
    held = F.filter(targets, lambda t: (t["rank"] <= F.col("_upto")) & (t["rank"] > F.col("_upto") - F.col("_c")))
    found = F.transform(held, lambda t: F.struct(t["i"].alias("i"), t["rank"].alias("rank"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("_upto") - F.col("_c")).alias("before"), F.col("_n").alias("n")))
    wanted = coarse.withColumn("_found", found).groupBy(*by).agg(F.flatten(F.collect_list("_found")).alias("_wanted"))

    part = F.floor((F.col("_x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)
    rows = _inside(slim, by, wanted).withColumn("_bin", F.when(F.col("hi") > F.col("lo"), F.least(part, F.lit(BINS - 1))).otherwise(0))
    same = ["i", "rank", "before", "n"]
    fine = _holding(rows.groupBy(*by, *same, "_bin").agg(*tally), [*by, "i"], "_bin").withColumn("_upto", F.col("_upto") + F.col("before"))
    fine = fine.filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_c")))
    wanted = fine.groupBy(*by).agg(F.collect_list(F.struct("i", "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("_upto") - F.col("_c")).alias("before"), "n")).alias("_wanted"))

    exact = _holding(_inside(slim, by, wanted).groupBy(*by, *same, "_x").agg(F.count(F.lit(1)).alias("_c")), [*by, "i"], "_x").withColumn("_upto", F.col("_upto") + F.col("before"))
    exact = exact.filter((F.col("rank") <= F.col("_upto")) & (F.col("rank") > F.col("_upto") - F.col("_c")))
    values = [F.max(F.when(F.col("i") == i, F.col("_x"))).alias(f"v_{i}") for i in range(len(names))]
    return exact.groupBy(*by).agg(F.max("n").alias("_n"), *values)


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Per group, the linearly interpolated quantiles ``q_0, q_1, ...`` of ``col``."""
    def place(n: Column, p: float) -> Column:
        return (n - 1) * F.lit(float(p))

    def low(n: Column, p: float) -> Column:
        return F.floor(place(n, p) + F.lit(1e-9))

    def ranks(n: Column) -> list[Column]:
        return [r for p in probs for r in (low(n, p) + 1, F.least(low(n, p) + 2, n))]

    def between(i: int, p: float) -> Column:
        a, b, n = F.col(f"v_{2 * i}"), F.col(f"v_{2 * i + 1}"), F.col("_n")
        return F.when(a == b, a).otherwise(a + (b - a) * F.greatest(place(n, p) - low(n, p), F.lit(0.0)))

    stats = order_statistics(df, col, ranks, by)
    return stats.select(*by, *[between(i, p).alias(f"q_{i}") for i, p in enumerate(probs)])


def lower_tail(df: DataFrame, col: str, by: Sequence[str], share: float) -> DataFrame:
    """k = int(share * n): the value at 0-based rank k, and the mean of the k values before it."""
    by = list(by)
    k = F.floor(F.lit(share) * F.col("_n"))
    slim = staged(_slim(df, col, by), "values")
    at = _ranked(slim, lambda n: [F.floor(F.lit(share) * n) + 1], by)
    below = F.col("_x") < F.col("v_0")
    sums = with_row(slim, by, at, ["_n", "v_0"]).groupBy(*by, "_n", "v_0").agg(
        F.count(F.when(below, 1)).alias("_c"), F.sum(F.when(below, F.col("_x")).otherwise(0.0)).alias("_s"),
    )
    total = F.col("_s") + F.when(k > F.col("_c"), (k - F.col("_c")) * F.col("v_0")).otherwise(0.0)
    return sums.select(*by, F.col("_n").alias("n"), F.col("v_0").alias("at_rank"), F.try_divide(total, k).alias("mean_before"))
