"""Scenario paths, option payoffs over them, and value at risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import ordered as o
from barloom.operators.quantiles import lower_tail
from barloom.sources.staging import staged

KINDS = ("european", "asian", "digital", "down-out", "down-in", "up-out", "up-in")


def scenario_paths(returns: DataFrame, horizon: int, s0="s0", ret="ret", **ordering) -> DataFrame:
    """Every run of ``horizon`` consecutive returns, applied to s0, as one path.

    Result: (symbol, path_id, step, price) with step 0 = s0.
    """
    def layer(df, w):
        frame = w.rowsBetween(0, horizon - 1)
        return df.withColumn("_run", F.collect_list(F.coalesce(F.col(ret), F.lit(0.0))).over(frame)).withColumn(
            "path_id", o.position(w).cast("bigint")
        )

    runs = o.ordered(returns, layer, ahead=horizon - 1, **ordering).filter(F.size("_run") == horizon)
    start = F.array(F.col(s0).cast("double"))
    prices = F.aggregate(
        "_run", start, lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) * (r + 1.0)))
    )
    by = o.keys(ordering.get("by", "symbol"))
    return runs.select(*by, "path_id", F.posexplode(prices).alias("step", "price"))


def path_facts(paths: DataFrame, by=("contract_id",)) -> DataFrame:
    """Terminal, mean, lowest and highest price per path."""
    return paths.groupBy(*by, "path_id").agg(
        F.max_by("price", "step").alias("terminal"),
        F.avg("price").alias("average"),
        F.min("price").alias("lowest"),
        F.max("price").alias("highest"),
    )


def payoff(kind: str, payout=1.0):
    """Payoff Column over path_facts joined with strike, option_type (and barrier)."""
    if kind not in KINDS:
        raise ValueError(f"Unknown payoff kind: {kind}")
    call, k = F.col("option_type") == "call", F.col("strike")
    settle = F.col("average") if kind == "asian" else F.col("terminal")
    if kind == "digital":
        return F.when((call & (settle > k)) | (~call & (settle < k)), F.lit(float(payout))).otherwise(0.0)
    value = F.greatest(F.when(call, settle - k).otherwise(k - settle), F.lit(0.0))
    if kind in ("european", "asian"):
        return value
    down = kind.startswith("down")
    touched = F.col("lowest") <= F.col("barrier") if down else F.col("highest") >= F.col("barrier")
    alive = ~touched if kind.endswith("out") else touched
    return F.when(alive, value).otherwise(0.0)


def estimate(df: DataFrame, value, by=("contract_id",)) -> DataFrame:
    """Mean, standard error and 95 % interval of discounted payoffs."""
    error = F.stddev_pop(value) / F.sqrt(F.count(value))
    return (
        df.groupBy(*by)
        .agg(F.count(value).alias("paths"), F.avg(value).alias("price"), error.alias("std_error"))
        .withColumns(
            {
                "ci_lower": F.col("price") - F.col("std_error") * 1.96,
                "ci_upper": F.col("price") + F.col("std_error") * 1.96,
            }
        )
    )


def scenario_payoff(paths: DataFrame, contracts: DataFrame, kind: str, key="contract_id", on=None,
                    payout: float = 1.0) -> DataFrame:
    """Price every contract over its paths.

    ``on`` is the column paths and contracts share (default: the contract id itself, i.e.
    each contract has paths of its own).  Paths are reduced to one row each before the join.
    """
    on = on or key
    facts = path_facts(paths, (on,))
    priced = facts.join(contracts, on).withColumn(
        "_value", payoff(kind, payout) * F.exp(-F.col("rate") * F.col("years"))
    )
    return estimate(priced, "_value", (key,))


def _bin(x):
    """Bins of about one percent, in the order of the values."""
    return F.floor(F.asinh(x) * 100)


def scenario_payoff_many(facts: DataFrame, contracts: DataFrame, kind: str, key="contract_id", on="symbol", payout: float = 1.0,
                         rows: int = o.CHUNK_ROWS) -> DataFrame:
    """Like ``scenario_payoff`` over ``path_facts``, for many contracts on the same paths, without a row per path and contract.

    A contract needs the number, sum and sum of squares of the prices beyond its strike (with a barrier: of the paths that count for it; paths meet the
    distinct barriers of their symbol).  Those of whole bins of prices are running sums over bins; inside the strike's bin, prices and strikes pass by
    once in order.  Bins of more than ``rows`` prices are split by hash, and the strikes copied to each part, whose sums add up.
    ``on`` and strike of a contract must not be null.
    """
    if kind not in KINDS:
        raise ValueError(f"Unknown payoff kind: {kind}")
    barred = kind[:2] in ("do", "up")
    group = [on, "barrier"] if barred else [on]
    centre = contracts.groupBy(on).agg(F.avg("strike").cast("double").alias("_c"))  # prices are measured from here, which keeps the squares small
    sized = staged(facts.join(centre, on).select(on, (F.col("average" if kind == "asian" else "terminal") - F.col("_c")).alias("_x"), "lowest", "highest"), "path-facts")
    totals = sized.groupBy(on).agg(F.count(F.lit(1)).alias("paths"))
    prices = sized
    if barred:
        touched = F.col("lowest") <= F.col("barrier") if kind.startswith("down") else F.col("highest") >= F.col("barrier")
        prices = sized.join(contracts.select(*group).distinct(), on).where(~touched if kind.endswith("out") else touched)
    prices = prices.select(*group, "_x", _bin(F.col("_x")).alias("_bin"))
    strikes = contracts.join(centre, on).select(*group, key, (F.col("strike") - F.col("_c")).alias("_k")).withColumn("_bin", _bin(F.col("_k")))
    x = F.col("_x")
    moments = [F.count(x).alias("_n"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("_q")]
    places = prices.unionByName(strikes.select(*group, F.lit(None).cast("double").alias("_x"), "_bin"))
    above = W.partitionBy(*group).orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, -1)
    below = W.partitionBy(*group).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    bins = places.groupBy(*group, "_bin").agg(*moments)
    carried = [F.coalesce(F.sum(c).over(w), F.lit(0)).cast("double").alias(f"{c}_{side}") for side, w in (("up", above), ("down", below)) for c in ("_n", "_s", "_q")]
    bins = staged(bins.select(*group, "_bin", F.greatest(F.ceil(F.col("_n") / rows), F.lit(1)).cast("int").alias("_parts"), *carried), "price-bins")
    keys = [*group, "_bin"]
    dealt = prices.join(bins.select(*keys, "_parts"), keys).select(*keys, F.pmod(F.xxhash64("_x", F.monotonically_increasing_id()), F.col("_parts")).cast("int").alias("_part"), F.col("_x").alias("_v"), "_x")
    asked = strikes.join(bins.select(*keys, "_parts"), keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    both = dealt.unionByName(asked.select(*keys, "_part", F.col("_k").alias("_v"), F.lit(None).cast("double").alias("_x"), key), allowMissingColumns=True)
    # A strike comes before equal prices in either direction, so only prices beyond it are summed.
    of = W.partitionBy(*keys, "_part")
    ask = F.col(key).isNull().cast("int")
    up, down = of.orderBy(F.col("_v").desc(), ask), of.orderBy("_v", ask)
    here = [
        F.coalesce(f.over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)).cast("double").alias(f"{c}_{side}_in")
        for side, w in (("up", up), ("down", down)) for c, f in (("_n", F.count(x)), ("_s", F.sum(x)), ("_q", F.sum(x * x)))
    ]
    inside = both.select("*", *here).where(F.col(key).isNotNull()).groupBy(key).agg(*[F.sum(f"{c}_{side}_in").alias(f"{c}_{side}_in") for side in ("up", "down") for c in ("_n", "_s", "_q")])
    found = strikes.join(bins, keys).join(inside, key).join(contracts.select(key, "option_type", "rate", "years"), key).join(totals, on)
    call = F.col("option_type") == "call"
    n, s, q = (F.when(call, F.col(f"{c}_up") + F.col(f"{c}_up_in")).otherwise(F.col(f"{c}_down") + F.col(f"{c}_down_in")) for c in ("_n", "_s", "_q"))
    k, discount = F.col("_k"), F.exp(-F.col("rate") * F.col("years"))
    if kind == "digital":
        first, second = n * payout, n * payout * payout
    else:
        first, second = F.when(call, s - k * n).otherwise(k * n - s), q - 2.0 * k * s + k * k * n
    mean, square = first / F.col("paths"), second / F.col("paths")
    return found.select(
        key, "paths", (discount * mean).alias("price"), (discount * F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)) / F.col("paths"))).alias("std_error"),
    ).withColumns({"ci_lower": F.col("price") - F.col("std_error") * 1.96, "ci_upper": F.col("price") + F.col("std_error") * 1.96})


def var_cvar(pnl: DataFrame, by=("portfolio",), value="pnl", initial="initial_value",
             confidence: float = 0.95, position_size: float = 1.0) -> DataFrame:
    """Value at risk and expected shortfall, as amounts and percent of the initial value.

    VaR is the loss at rank int((1 - confidence) * n) of the ascending P&L, the shortfall the
    mean loss of the rows before it.
    """
    by = list(by)
    sized = pnl.withColumns({"_p": F.col(value) * position_size, "_i": F.col(initial) * position_size})
    tail = lower_tail(sized, "_p", by, 1.0 - confidence)
    start = sized.groupBy(*by).agg(F.max("_i").alias("initial_value"))
    return tail.join(start, by).select(
        *by,
        F.col("n").alias("scenarios"),
        (-F.col("at_rank")).alias("var"),
        (-F.col("mean_before")).alias("cvar"),
        F.lit(confidence).alias("confidence_level"),
        (F.try_divide(-F.col("at_rank"), F.col("initial_value")) * 100.0).alias("var_percent"),
        (F.try_divide(-F.col("mean_before"), F.col("initial_value")) * 100.0).alias("cvar_percent"),
    )
