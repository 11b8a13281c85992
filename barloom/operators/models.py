"""Per-symbol models fitted by distributed sums, and their predictions.

A least-squares fit needs only X'X and X'y.  Both are plain sums, so map tasks
pre-aggregate them and a symbol with any number of rows reaches the reducer as a
few hundred numbers; the tiny linear systems are then solved row by row in an
Arrow batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import ordered as o
from barloom.operators.lookup import instant, last_n
from barloom.operators.prep import fit_scaler, scale
from barloom.operators.quantiles import exact_quantiles
from barloom.shipping import ship
from barloom.sources.staging import staged

ship(__name__)


def _gram(x: Sequence, y=None):
    """Aggregates: flattened upper triangle of X'X (with a leading 1) and X'y, y'y, n."""
    full = [F.lit(1.0), *x]
    gram = [F.sum(full[i] * full[j]) for i in range(len(full)) for j in range(i, len(full))]
    out = [F.array(*gram).alias("_xx"), F.count(F.lit(1)).alias("_n")]
    if y is not None:
        out += [F.array(*[F.sum(v * y) for v in full]).alias("_xy"), F.sum(y * y).alias("_yy")]
    return out


def _symmetric(flat, d: int) -> np.ndarray:
    m = np.zeros((d, d))
    m[np.triu_indices(d)] = flat
    return m + np.triu(m, 1).T


def solve_udf(d: int, ridge: float = 0.0):
    """(X'X, X'y) -> coefficients, intercept first; the intercept is not penalised."""

    @F.pandas_udf("array<double>")
    def solve(xx: pd.Series, xy: pd.Series) -> pd.Series:
        penalty = np.eye(d) * ridge
        penalty[0, 0] = 0.0
        out = []
        for a, b in zip(xx, xy):
            m, v = _symmetric(a, d) + penalty, np.asarray(b, dtype=float)
            out.append(np.linalg.lstsq(m, v, rcond=1e-12)[0] if np.isfinite(m).all() and np.isfinite(v).all() else None)
        return pd.Series(out)

    return solve


def dot(features: Sequence[str], coefficients="coefficients"):
    value = F.col(coefficients)[0]
    for i, f in enumerate(features, start=1):
        value = value + F.col(coefficients)[i] * F.col(f)
    return value


def fit_linear(train: DataFrame, features: Sequence[str], target: str, by="symbol", ridge: float = 0.0) -> DataFrame:
    """One row per symbol: coefficients (intercept first) over the given features."""
    x = [F.col(f).cast("double") for f in features]
    sums = train.groupBy(*o.keys(by)).agg(*_gram(x, F.col(target).cast("double")))
    solve = solve_udf(len(features) + 1, ridge)
    return sums.select(*o.keys(by), F.col("_n").alias("train_rows"), solve("_xx", "_xy").alias("coefficients"))


def train_per_symbol(data: DataFrame, features: Sequence[str], target="target", by="symbol", ridge: float = 1e-6,
                     fit_on="train", split="split") -> tuple[DataFrame, DataFrame]:
    """Fit one regression per symbol on scaled features.

    ``data`` carries a split column (see chrono_split).  Returns (models, results): models
    hold the coefficients and the feature scaler, results the row counts and the MAE of both
    parts.  ``fit_on="all"`` fits the scaler on all rows instead of the training part.
    """
    keys = o.keys(by)
    training = data.filter(F.col(split) != "test")
    scaler = fit_scaler(training if fit_on == "train" else data, features, by)
    fitted = fit_linear(scale(training, scaler, features, by), features, target, by, ridge)
    models = fitted.join(scaler, keys)
    scored = predict_per_symbol(data, models, features, by=by)
    error = F.abs(F.col(target) - F.col("predicted"))
    test = F.col(split) == "test"
    results = scored.groupBy(*keys).agg(
        F.count_if(~test).alias("train_rows"),
        F.count_if(test).alias("test_rows"),
        F.lit(len(features)).cast("bigint").alias("n_features"),
        F.avg(F.when(~test, error)).alias("train_mae"),
        F.avg(F.when(test, error)).alias("test_mae"),
    )
    return models, results


def predict_per_symbol(data: DataFrame, models: DataFrame, features: Sequence[str], out="predicted", by="symbol") -> DataFrame:
    """Predictions in price units, aligned with the input rows.

    ``models`` has one row per symbol; AQE broadcasts it if its measured size allows.
    """
    joined = data.join(models.drop("train_rows"), o.keys(by))
    scaled = [
        (F.col(f) - F.col(f"{f}_mean")) / F.when(F.col(f"{f}_std") == 0, 1.0).otherwise(F.col(f"{f}_std"))
        for f in features
    ]
    value = F.col("coefficients")[0]
    for i, x in enumerate(scaled, start=1):
        value = value + F.col("coefficients")[i] * x
    return joined.withColumn(out, value).select(*data.columns, out)


def _ar_lags(series: DataFrame, p: int, d: int, value: str, season: int | None, **ordering) -> DataFrame:
    """Differenced value with its lags 1..p (and a seasonal lag) as columns."""
    lags = list(range(1, p + 1)) + ([season] if season and season > p else [])

    def layer(df, w):
        df = df.withColumn("_y", F.col(value).cast("double"))
        for _ in range(d):
            df = df.withColumn("_y", F.col("_y") - F.lag("_y").over(w))
        return df.withColumns({f"_y{k}": F.lag("_y", k).over(w) for k in lags})

    return o.ordered(series, layer, back=max(lags) + d, **ordering), [f"_y{k}" for k in lags]


def forecast_ar(series: DataFrame, steps: int = 5, p: int = 5, d: int = 1, value="close", season: int | None = None,
                z: float = 1.96, by="symbol", ts="ts", **ordering) -> DataFrame:
    """Autoregression on the d-times differenced series (d is 0 or 1), ``steps`` rows ahead.

    Returns (symbol, step, forecast, lower_bound, upper_bound).  The bounds add up the effects that all shocks on the way
    have on the level, by the recursion of the psi weights.
    """
    if d not in (0, 1):
        raise ValueError("d must be 0 or 1")
    lagged, x = _ar_lags(series, p, d, value, season, by=by, ts=ts, **ordering)
    known = lagged.dropna(subset=["_y", *x])
    sums = known.groupBy(by).agg(*_gram([F.col(c) for c in x], F.col("_y")))
    fitted = sums.withColumn("coefficients", solve_udf(len(x) + 1)("_xx", "_xy"))
    depth = max(p, season or 0)
    recent = _ends(lagged, depth, by, ts, value)
    return _roll_forward(fitted.join(recent, by), steps, p, d, season, z, by)


def _ends(lagged, depth, by, ts, value):
    """Per symbol the last ``depth`` differenced values, newest first, and the last level."""
    tail = last_n(lagged.select(by, ts, "_y", F.col(value).cast("double").alias("_level")), depth, by, ts)
    newest_first = F.sort_array(F.collect_list(F.struct(ts, "_y", "_level")), asc=False)
    return tail.groupBy(by).agg(newest_first.alias("_tail")).select(
        by, F.transform("_tail", lambda x: x["_y"]).alias("_recent"), F.col("_tail")[0]["_level"].alias("_level")
    )


def _roll_forward(df, steps, p, d, season, z, by):
    b = F.col("coefficients")

    lags = [(k, b[k]) for k in range(1, p + 1)] + ([(season, b[p + 1])] if season and season > p else [])
    depth = max(p, season or 0)

    def step(state, _):
        y, psi = b[0], F.lit(0.0)
        for k, c in lags:
            y = y + c * state["recent"][k - 1]
            psi = psi + c * F.coalesce(F.get(state["psi"], F.lit(k - 1)), F.lit(0.0))
        psi = F.when(F.size(state["path"]) == 0, 1.0).otherwise(psi)
        level = state["level"] + y if d == 1 else y
        # A shock moves the level by its weight if there is no differencing, by the sum of the weights so far if there is.
        moved = state["moved"] + psi if d == 1 else psi
        spread = state["spread"] + moved * moved
        return F.struct(
            F.slice(F.concat(F.array(y), state["recent"]), 1, depth).alias("recent"), level.alias("level"),
            F.slice(F.concat(F.array(psi), state["psi"]), 1, depth).alias("psi"), moved.alias("moved"), spread.alias("spread"),
            F.concat(state["path"], F.array(F.struct(level.alias("level"), F.sqrt(spread).alias("width")))).alias("path"),
        )

    start = F.struct(
        F.col("_recent").alias("recent"), F.col("_level").alias("level"), F.array().cast("array<double>").alias("psi"), F.lit(0.0).alias("moved"),
        F.lit(0.0).alias("spread"), F.array().cast("array<struct<level:double,width:double>>").alias("path"),
    )
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["path"])
    fit = F.aggregate(F.zip_with("coefficients", "_xy", lambda c, v: c * v), F.lit(0.0), lambda a, v: a + v)
    sigma = F.sqrt(F.greatest((F.col("_yy") - fit) / F.col("_n"), F.lit(0.0)))
    out = df.withColumn("_sigma", sigma).select(by, "_sigma", F.posexplode(path).alias("_i", "_p"))
    width = F.col("_sigma") * z * F.col("_p.width")
    return out.select(
        by,
        (F.col("_i") + 1).cast("bigint").alias("step"),
        F.col("_p.level").alias("forecast"),
        (F.col("_p.level") - width).alias("lower_bound"),
        (F.col("_p.level") + width).alias("upper_bound"),
    )


def ar_orders(series: DataFrame, max_p: int = 5, d: int = 1, value="close", by="symbol", ts="ts", **ordering) -> DataFrame:
    """AIC of every order 1..max_p per symbol, all from one set of sums.

    The sums of a smaller order are a corner of the largest order's matrix, so the grid
    costs one pass.
    """
    lagged, x = _ar_lags(series, max_p, d, value, None, by=by, ts=ts, **ordering)
    known = lagged.dropna(subset=["_y", *x])
    sums = known.groupBy(by).agg(*_gram([F.col(c) for c in x], F.col("_y")))

    @F.pandas_udf("array<double>")
    def aic(xx: pd.Series, xy: pd.Series, yy: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for a, b, s, rows in zip(xx, xy, yy, n):
            m, v = _symmetric(a, max_p + 1), np.asarray(b, dtype=float)
            scores = []
            for k in range(1, max_p + 1):
                c = np.linalg.lstsq(m[: k + 1, : k + 1], v[: k + 1], rcond=1e-12)[0]
                rss = max(s - 2 * c @ v[: k + 1] + c @ m[: k + 1, : k + 1] @ c, 1e-300)
                scores.append(rows * np.log(rss / rows) + 2 * (k + 1))
            out.append(scores)
        return pd.Series(out)

    scores = sums.withColumn("_aic", aic("_xx", "_xy", "_yy", "_n"))
    return scores.select(by, F.posexplode("_aic").alias("_i", "aic")).select(
        by, (F.col("_i") + 1).cast("bigint").alias("order"), "aic"
    )


def best_order(orders: DataFrame, by="symbol") -> DataFrame:
    return orders.groupBy(by).agg(
        F.min_by("order", F.struct("aic", "order")).alias("order"), F.min("aic").alias("aic")
    )


def ar1(series: DataFrame, value="close", d: int = 1, **ordering) -> DataFrame:
    """AR(1) of the differenced series with built-in regression aggregates."""
    by = o.keys(ordering.get("by", "symbol"))
    lagged, _ = _ar_lags(series, 1, d, value, None, **ordering)
    return lagged.dropna(subset=["_y", "_y1"]).groupBy(*by).agg(
        F.regr_slope("_y", "_y1").alias("slope"),
        F.regr_intercept("_y", "_y1").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def recursive_forecast(df: DataFrame, steps: int, lags="lags", coefficients="coefficients") -> DataFrame:
    """Feed each prediction back as the newest lag.  ``lags`` is newest first, coefficients
    are (intercept, lag 1, lag 2, ...)."""
    b = F.col(coefficients)

    def step(state, _):
        weighted = F.zip_with(F.slice(b, 2, F.size(b) - 1), state["lags"], lambda c, x: c * x)
        y = F.aggregate(weighted, b[0], lambda a, x: a + x)
        return F.struct(
            F.slice(F.concat(F.array(y), state["lags"]), 1, F.size(b) - 1).alias("lags"),
            F.concat(state["out"], F.array(y)).alias("out"),
        )

    start = F.struct(
        F.col(lags).cast("array<double>").alias("lags"), F.array().cast("array<double>").alias("out")
    )
    return df.withColumn("predictions", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["out"]))


def prediction_record(df: DataFrame, model_name: str, horizon: str, as_of, price="current_price",
                      predicted="predicted_price", std: str | None = None, lower="lower_bound",
                      upper="upper_bound", steps: int = 1, default_confidence=0.75) -> DataFrame:
    """The stored prediction.  With a deviation over model draws the confidence is 1 - std and
    the bounds are the draws' percentiles; without, the default confidence and no bounds."""
    nothing = F.lit(None).cast("double")
    return df.select(
        instant(as_of).alias("prediction_time"),
        "symbol",
        F.lit(model_name).alias("model_name"),
        F.lit(horizon).alias("horizon"),
        F.col(price).alias("current_price"),
        F.col(predicted).alias("predicted_price"),
        (1.0 - F.col(std) if std else F.lit(default_confidence)).alias("confidence"),
        (F.col(lower) if std else nothing).alias("lower_bound"),
        (F.col(upper) if std else nothing).alias("upper_bound"),
        F.lit(steps).cast("bigint").alias("steps_ahead"),
    )


def baseline_interval(df: DataFrame, price="predicted_price", confidence="confidence", share=0.1) -> DataFrame:
    width = F.col(confidence) * share
    return df.withColumns(
        {"lower_bound": F.col(price) * (1.0 - width), "upper_bound": F.col(price) * (1.0 + width)}
    )


# Weights of the three base models.
ENSEMBLE_WEIGHTS = {"lstm": 0.4, "transformer": 0.4, "fundamental_dl": 0.2}


def ensemble(predictions: DataFrame, weights: dict[str, float] = ENSEMBLE_WEIGHTS, by=("symbol", "target_time"),
             model="model_name", value="predicted_price") -> DataFrame:
    """Weighted average over the models present; models without a weight are ignored."""
    pairs = [x for m, w in weights.items() for x in (F.lit(m), F.lit(float(w)))]
    weighted = predictions.withColumn("_w", F.try_element_at(F.create_map(*pairs), F.col(model))).filter(
        F.col("_w").isNotNull() & F.col(value).isNotNull()
    )
    return weighted.groupBy(*by).agg(
        F.try_divide(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias(value),
        F.count(F.lit(1)).alias("models"),
    )


def drift(reference: DataFrame, current: DataFrame, column: str, buckets: int = 10, threshold: float = 0.1,
          floor: float = 1e-6) -> DataFrame:
    """Population stability index of one column over the reference's quantile buckets."""
    probs = [i / buckets for i in range(1, buckets)]
    known = staged(reference.select(F.col(column).alias("_x")).where("_x IS NOT NULL"), "reference")
    cuts = exact_quantiles(known, "_x", probs).select(F.array(*[f"q_{i}" for i in range(len(probs))]).alias("_cuts"))
    cuts = staged(cuts, "cuts")  # one row, which both sides read

    def shares(values, name):
        cut = values.withColumn("_cuts", cuts.scalar())
        bucket = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
        counts = cut.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("_c"))
        # One row per bucket, so the total is a window over at most `buckets` rows.
        return counts.select("bucket", (F.col("_c") / F.sum("_c").over(W.partitionBy())).alias(name))

    now = current.select(F.col(column).alias("_x")).where("_x IS NOT NULL")
    both = shares(known, "_r").join(shares(now, "_q"), "bucket", "full")
    r, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(floor)) for c in ("_r", "_q"))
    return both.agg(F.sum((q - r) * F.ln(q / r)).alias("psi")).withColumn("drifted", F.col("psi") > threshold)


def news_sentiment(articles: DataFrame, days: int = 7, ts="ts", score="score") -> DataFrame:
    """Mean score of a symbol's articles over the trailing days, one row per symbol and day.

    Articles are reduced to a sum and count per day first, so the window runs over days.
    """
    daily = articles.filter(F.col(score).isNotNull()).groupBy("symbol", F.to_date(ts).alias("date")).agg(
        F.sum(score).alias("_s"), F.count(score).alias("_c")
    )
    day = F.unix_date("date")
    w = W.partitionBy("symbol").orderBy(day).rangeBetween(-(days - 1), 0)
    return daily.select(
        "symbol",
        "date",
        F.sum("_c").over(w).alias("articles"),
        (F.sum("_s").over(w) / F.sum("_c").over(w)).alias("sentiment"),
    )


def fundamental_ratios(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumns(
        {
            "pe_ratio": F.try_divide(c("price"), c("eps")),
            "pb_ratio": F.try_divide(c("price"), c("book_value_per_share")),
            "roe": F.try_divide(c("net_income"), c("equity")),
            "debt_to_equity": F.try_divide(c("debt"), c("equity")),
            "current_ratio": F.try_divide(c("current_assets"), c("current_liabilities")),
        }
    )


def fundamental_growth(quarters: DataFrame, columns=("revenue", "earnings", "fcf"), lag=4, **ordering) -> DataFrame:
    """Growth against the same quarter a year before."""
    def layer(df, w):
        return df.withColumns(
            {f"{x}_growth": F.try_divide(F.col(x), F.lag(x, lag).over(w)) - 1.0 for x in columns}
        )

    return o.ordered(quarters, layer, back=lag, **{"slot": "52 weeks", **ordering})

