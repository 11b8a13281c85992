"""Least squares as SQL text for the checks: normal equations solved by elimination, one common table per pivot."""

from __future__ import annotations

from collections.abc import Sequence

from barloom.plans import sql_views as v


def least_squares(name: str, source: str, xs: Sequence[str], y: str, ridge: float = 0.0) -> list[str]:
    """Common tables that end in ``name`` (symbol, n, b0, b1, ..., rss): regression of ``y`` on 1 and ``xs`` per symbol of ``source``."""
    columns = ["1.0::DOUBLE", *xs]
    k = len(columns)
    penalty = lambda i, j: f" + {ridge!r}::DOUBLE" if ridge and i == j and i else ""
    sums = [f"sum(({a}) * ({b})){penalty(i, j)} AS a{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns)]
    sums += [f"sum(({a}) * ({y})) AS a{i}_{k}, sum(({a}) * ({y})) AS r{i}" for i, a in enumerate(columns)]
    keep = "symbol, n, yy, " + ", ".join(f"r{i}" for i in range(k))
    out = [f"{name}_0 AS (SELECT symbol, count(*) AS n, sum(({y}) * ({y})) AS yy, {', '.join(sums)} FROM {source} GROUP BY symbol)"]
    for s in range(k):
        cells = [
            f"a{s}_{j} / a{s}_{s} AS a{s}_{j}" if i == s else f"a{i}_{j} - a{i}_{s} * a{s}_{j} / a{s}_{s} AS a{i}_{j}"
            for i in range(k) for j in range(s + 1, k + 1)
        ]
        left = [f"a{i}_{j}" for i in range(k) for j in range(s + 1)]  # columns that are done
        out.append(f"{name}_{s + 1} AS (SELECT {keep}, {', '.join(cells + left)} FROM {name}_{s})")
    found = ", ".join(f"a{i}_{k} AS b{i}" for i in range(k))
    rss = "yy" + "".join(f" - a{i}_{k} * r{i}" for i in range(k))
    out.append(f"{name} AS (SELECT symbol, n, {found}, {rss} AS rss FROM {name}_{k})")
    return out


def linear(xs: Sequence[str], b: str = "b") -> str:
    return " + ".join([f"{b}0", *(f"{b}{i} * ({x})" for i, x in enumerate(xs, start=1))])


FEATURES = ("close", "sma_5", "rsi", "volume")


def trained(fit_on: str = "train") -> list[str]:
    """``td`` (training data), ``sc`` (scaler) and ``fit`` with its penalty of 1e-6, over the four features."""
    rows = "WHERE i <= floor(n * 0.8::DOUBLE)" if fit_on == "train" else ""
    stats = ", ".join(f"avg({f}) AS {f}_m, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS {f}_s" for f in FEATURES)
    return [
        v.BARS, *v.ind_ctes(),
        f"""tr AS (SELECT ts, symbol, {", ".join(FEATURES)}, lead(close) OVER {v.over()} AS target, row_number() OVER {v.over()} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ind)""",
        f"sc AS (SELECT symbol, {stats} FROM tr WHERE target IS NOT NULL {rows.replace('WHERE', 'AND')} GROUP BY 1)",
        f"""td AS (SELECT ts, symbol, target, i, n, {", ".join(f"({f} - {f}_m) / {f}_s AS x{k}" for k, f in enumerate(FEATURES))} FROM tr JOIN sc USING (symbol) WHERE target IS NOT NULL)""",
        "fitted AS (SELECT * FROM td WHERE i <= floor(n * 0.8::DOUBLE))",
        *least_squares("fit", "fitted", [f"x{k}" for k in range(len(FEATURES))], "target", 1e-6),
        f"pr AS (SELECT td.*, {linear([f'x{k}' for k in range(len(FEATURES))])} AS predicted FROM td JOIN (SELECT * EXCLUDE (n) FROM fit) USING (symbol))",
    ]


TRAINED = """SELECT symbol, count(*) FILTER (i <= floor(n * 0.8::DOUBLE)) AS train_rows, count(*) FILTER (i > floor(n * 0.8::DOUBLE)) AS test_rows, 4::BIGINT AS n_features,
 avg(abs(target - predicted)) FILTER (i <= floor(n * 0.8::DOUBLE)) AS train_mae, avg(abs(target - predicted)) FILTER (i > floor(n * 0.8::DOUBLE)) AS test_mae FROM pr GROUP BY 1"""


def lagged(most: int, name: str = "lg") -> list[str]:
    """Differences ``y`` of the close with their lags ``y1``.. up to ``most``."""
    lags = "".join(f", lag(y, {k}) OVER {v.over()} AS y{k}" for k in range(1, most + 1))
    return [f"{name} AS (SELECT symbol, ts, close, y{lags} FROM (SELECT symbol, ts, close, close - lag(close) OVER {v.over()} AS y FROM bars))"]


def ar_forecast(lags: Sequence[int], steps: int) -> tuple[list[str], str]:
    """Autoregression of the differences, ``steps`` ahead, with bounds from the weights of shocks."""
    most = max(lags)
    ctes = [v.BARS, *lagged(most), f"kn AS (SELECT * FROM lg WHERE y{most} IS NOT NULL)", *least_squares("ar", "kn", [f"y{k}" for k in lags], "y")]
    ctes.append(f"s0 AS (SELECT lg.*, ar.* EXCLUDE (symbol), 1.0::DOUBLE AS w0, 1.0::DOUBLE AS m0 FROM lg JOIN ar USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)")
    for h in range(1, steps + 1):
        value = lambda k: f"f{h - k}" if h > k else "y" if h == k else f"y{k - h}"  # noqa: B023, E731
        ahead = linear([value(k) for k in lags])
        weight = " + ".join(f"b{i} * w{h - k}" for i, k in enumerate(lags, start=1) if h >= k) or "0"
        ctes.append(f"s{h} AS (SELECT *, {ahead} AS f{h}, {weight} AS w{h}, m{h - 1} + ({weight}) AS m{h} FROM s{h - 1})")
    parts = []
    for h in range(1, steps + 1):
        level = "close + " + " + ".join(f"f{j}" for j in range(1, h + 1))
        width = f"1.96 * sqrt(rss / n * ({' + '.join(f'm{j} * m{j}' for j in range(h))}))"
        parts.append(f"SELECT symbol, {h}::BIGINT AS step, {level} AS forecast, {level} - {width} AS lower_bound, {level} + {width} AS upper_bound FROM s{steps}")
    return ctes, " UNION ALL ".join(parts)


def ar_orders(most: int) -> tuple[list[str], str]:
    ctes = [v.BARS, *lagged(most), f"kn AS (SELECT * FROM lg WHERE y{most} IS NOT NULL)"]
    parts = []
    for k in range(1, most + 1):
        ctes += least_squares(f"ar{k}", "kn", [f"y{j}" for j in range(1, k + 1)], "y")
        parts.append(f'SELECT symbol, {k}::BIGINT AS "order", n * ln(rss / n) + 2 * ({k} + 1) AS aic FROM ar{k}')
    return ctes, " UNION ALL ".join(parts)


def stationarity(lags: int) -> tuple[list[str], str]:
    """KPSS statistics of the level and of its difference, from the running sums of what deviates from the mean."""
    ctes = [v.BARS]
    for d, y in ((0, "close"), (1, f"close - lag(close) OVER {v.over()}")):
        ctes += [
            f"d{d} AS (SELECT symbol, ts, y - avg(y) OVER (PARTITION BY symbol) AS u FROM (SELECT symbol, ts, {y} AS y FROM bars) WHERE y IS NOT NULL)",
            f"p{d} AS (SELECT symbol, u, sum(u) OVER {v.over('UNBOUNDED PRECEDING')} AS s{''.join(f', lag(u, {k}) OVER {v.over()} AS u{k}' for k in range(1, lags + 1))} FROM d{d})",
            f"k{d} AS (SELECT symbol, count(*) AS n, sum(s * s) / (count(*) * (sum(u * u){''.join(f' + 2 * (1 - {k} / {lags + 1}::DOUBLE) * sum(u * u{k})' for k in range(1, lags + 1))})) AS kpss_{d} FROM p{d} GROUP BY 1)",
        ]
    return ctes, "SELECT k0.symbol, k0.n, kpss_0, kpss_1, CASE WHEN kpss_0 <= 0.463 THEN 0 ELSE 1 END::INT AS d FROM k0 JOIN k1 USING (symbol)"


def arma(long: int, p: int, q: int) -> list[str]:
    """``kn``: differences with ``p`` lags and ``q`` lagged shocks of a long autoregression, where all are known; ``sh``: the same for every row."""
    return [
        v.BARS, *lagged(max(long, p)), f"lk AS (SELECT * FROM lg WHERE y{long} IS NOT NULL)", *least_squares("la", "lk", [f"y{k}" for k in range(1, long + 1)], "y"),
        f"er AS (SELECT lg.*, y - ({linear([f'y{k}' for k in range(1, long + 1)])}) AS e FROM lg JOIN la USING (symbol))",
        f"sh AS (SELECT *{''.join(f', lag(e, {k}) OVER {v.over()} AS e{k}' for k in range(1, q + 1))} FROM er)",
        f"kn AS (SELECT * FROM sh WHERE e{q} IS NOT NULL AND y{p} IS NOT NULL)",
    ]


def arma_orders(long: int, p: int, q: int) -> tuple[list[str], str]:
    ctes, parts = arma(long, p, q), []
    for i in range(p + 1):
        for j in range(q + 1):
            ctes += least_squares(f"m{i}_{j}", "kn", [*(f"y{k}" for k in range(1, i + 1)), *(f"e{k}" for k in range(1, j + 1))], "y")
            parts.append(f"SELECT symbol, {i}::INT AS p, {j}::INT AS q, n, b0 AS intercept, rss / n AS sigma2, n * ln(rss / n) + 2 * {1 + i + j} AS aic FROM m{i}_{j}")
    return ctes, " UNION ALL ".join(parts)


def arma_11(long: int, steps: int) -> tuple[list[str], str]:
    """One lag and one shock: the difference ahead, and the weights 1, b1 + b2, b1 (b1 + b2), ... added up."""
    ctes = [*arma(long, 1, 1), *least_squares("mo", "kn", ["y1", "e1"], "y")]
    ctes.append("s1 AS (SELECT sh.*, mo.* EXCLUDE (symbol), b0 + b1 * y + b2 * e AS f1, 1.0::DOUBLE AS m0, b1 + b2 AS w1, 1 + b1 + b2 AS m1 FROM sh JOIN mo USING (symbol) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1)")
    for h in range(2, steps + 1):
        ctes.append(f"s{h} AS (SELECT *, b0 + b1 * f{h - 1} AS f{h}, b1 * w{h - 1} AS w{h}, m{h - 1} + b1 * w{h - 1} AS m{h} FROM s{h - 1})")
    parts = []
    for h in range(1, steps + 1):
        level = "close + " + " + ".join(f"f{j}" for j in range(1, h + 1))
        width = f"1.96 * sqrt(rss / n * ({' + '.join(f'm{j} * m{j}' for j in range(h))}))"
        parts.append(f"SELECT symbol, {h}::INT AS step, {level} AS forecast, {level} - {width} AS lower_bound, {level} + {width} AS upper_bound FROM s{steps}")
    return ctes, " UNION ALL ".join(parts)
