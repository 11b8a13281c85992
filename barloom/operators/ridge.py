"""Ridge regression over a grid of penalties, chosen by cross-validation, from one pass of sums.

Every fold of every series comes down to X'X, X'y, y'y and its row count, reduced before the shuffle.  Training without
a fold is the total minus that fold, so no row is read once per fold; the whole path of penalties comes from one
eigen-decomposition of what is left; and the squared error on the fold follows from the fold's own sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import ordered as o
from barloom.operators.models import _gram, _symmetric, predict_per_symbol
from barloom.shipping import ship

ship(__name__)

#: Penalties added to the diagonal of the scaled X'X.
GRID = (0.0, 0.1, 1.0, 10.0, 100.0, 1_000.0)
# Fixed value: folds of the cross-validation.
FOLDS = 5


def chrono_folds(df: DataFrame, folds: int = FOLDS, train: float = 0.8, out: str = "fold", **ordering) -> DataFrame:
    """Number the runs of consecutive training rows 0..folds-1 in time order; test rows have a null fold.

    The earliest ``int(n * train)`` rows of a series are training rows, as in ``chrono_split``.
    """
    def layer(d, w):
        n_train, i = F.floor(o.series_length() * F.lit(train)), o.position(w)
        return d.withColumn(out, F.when(i <= n_train, F.floor((i - 1) * F.lit(folds) / n_train).cast("int")))

    return o.ordered(df, layer, **ordering)


def fold_sums(data: DataFrame, features: Sequence[str], target: str, by="symbol", fold: str = "fold") -> DataFrame:
    """Sums per (series, fold) over the rows that have a fold and no missing value."""
    x, y = [F.col(f).cast("double") for f in features], F.col(target).cast("double")
    whole = F.col(fold).isNotNull()
    for v in (*x, y):
        whole = whole & v.isNotNull() & ~F.isnan(v)
    return data.where(whole).groupBy(*o.keys(by), F.col(fold).cast("int").alias("_fold")).agg(*_gram(x, y))


class Moments:
    """Sums of one set of rows: ``xx`` with a leading 1, ``xy``, ``yy``; sets are added and taken away."""

    def __init__(self, xx: np.ndarray, xy: np.ndarray, yy: float):
        self.xx, self.xy, self.yy = xx, xy, yy

    @property
    def n(self) -> float:
        return self.xx[0, 0]

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.xx - other.xx, self.xy - other.xy, self.yy - other.yy)

    def path(self, grid: Sequence[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Means and population deviations of the features, and a column of scaled coefficients (intercept first) per penalty."""
        mean = self.xx[0, 1:] / self.n
        scatter = self.xx[1:, 1:] - self.n * np.outer(mean, mean)
        # What a constant feature leaves by rounding is no deviation.
        spread = np.diag(scatter) > 1e-13 * np.maximum(np.diag(self.xx)[1:], 1e-300)
        std = np.where(spread, np.sqrt(np.maximum(np.diag(scatter), 0) / self.n), 0.0)
        unit = np.where(std == 0, 1.0, std)
        scaled = np.where(np.outer(spread, spread), scatter / np.outer(unit, unit), 0.0)
        moment = np.where(spread, (self.xy[1:] - mean * self.xy[0]) / unit, 0.0)
        values, vectors = np.linalg.eigh(scaled)
        damped = values[:, None] + np.asarray(grid, dtype=float)[None, :]
        usable = damped > 1e-10 * max(float(values.max(initial=0.0)), 1e-300)
        weights = vectors @ (np.where(usable, (vectors.T @ moment)[:, None] / np.where(usable, damped, 1.0), 0.0))
        return mean, std, np.vstack([np.full(len(grid), self.xy[0] / self.n), weights])

    def squared_error(self, mean: np.ndarray, std: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Sum of squared errors on these rows of what ``path`` gave for others, per penalty."""
        slopes = weights[1:] / np.where(std == 0, 1.0, std)[:, None]
        raw = np.vstack([weights[0] - mean @ slopes, slopes])
        return np.maximum(self.yy - 2 * self.xy @ raw + np.einsum("ik,ij,jk->k", raw, self.xx, raw), 0.0)


FOLD = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("squared_errors", T.ArrayType(T.DoubleType()))])
FITTED = [
    T.StructField("train_rows", T.LongType()), T.StructField("folds", T.ArrayType(FOLD)), T.StructField("ridge", T.DoubleType()),
    T.StructField("validation_mse", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())),
]


def _fit(by: Sequence[str], features: Sequence[str], grid: Sequence[float], names: Sequence[str]):
    size = len(features) + 1

    def one(row) -> dict:
        parts = {f["_fold"]: Moments(_symmetric(f["_xx"], size), np.asarray(f["_xy"], dtype=float), f["_yy"]) for f in sorted(row["_folds"], key=lambda f: f["_fold"])}
        total = Moments(sum(p.xx for p in parts.values()), sum(p.xy for p in parts.values()), sum(p.yy for p in parts.values()))
        folds = []
        for k, part in parts.items():
            rest = total - part
            if rest.n >= 1:
                folds.append({"fold": k, "rows": int(part.n), "squared_errors": part.squared_error(*rest.path(grid)).tolist()})
        tested = sum(f["rows"] for f in folds)
        mse = np.sum([f["squared_errors"] for f in folds], axis=0) / tested if tested else np.full(len(grid), np.nan)
        best = min(range(len(grid)), key=lambda g: (mse[g], grid[g])) if tested else int(np.argmin(grid))
        mean, std, weights = total.path(grid)
        return {
            **{c: row[c] for c in by}, "train_rows": int(total.n), "folds": folds, "ridge": float(grid[best]),
            "validation_mse": float(mse[best]) if tested else None, "coefficients": weights[:, best].tolist(),
            **{f"{f}_mean": m for f, m in zip(features, mean.tolist(), strict=True)}, **{f"{f}_std": s for f, s in zip(features, std.tolist(), strict=True)},
        }

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([one(row) for row in frame.to_dict("records")], columns=list(names))

    return run


def ridge_path(data: DataFrame, features: Sequence[str], target: str = "target", grid: Sequence[float] = GRID, by="symbol", fold: str = "fold") -> DataFrame:
    """One model per series, its penalty chosen from ``grid`` by the error on folds left out; one pass over ``data``.

    Columns: the keys, train_rows, folds (per fold its rows and the squared error of every penalty), ridge, validation_mse,
    coefficients over scaled features (intercept first, not penalised) and the scaler, as ``predict_per_symbol`` reads them.
    Features are scaled by the rows trained on, so a fold is never seen by the fit it tests.  Rows without a fold
    (test rows) or with a missing value are not used; the smallest penalty wins a tie; a series of one fold gets the
    smallest penalty untested; a constant feature gets no weight.
    """
    keys = o.keys(by)
    if not grid:
        raise ValueError("the grid is empty")
    sums = fold_sums(data, features, target, by, fold).groupBy(*keys).agg(F.collect_list(F.struct("_fold", "_xx", "_xy", "_yy")).alias("_folds"))
    scaler = [T.StructField(f"{f}_{kind}", T.DoubleType()) for kind in ("mean", "std") for f in features]
    schema = T.StructType([*(data.schema[k] for k in keys), *FITTED, *scaler])
    return sums.mapInPandas(_fit(keys, list(features), [float(g) for g in grid], schema.names), schema)


def grid_errors(models: DataFrame, grid: Sequence[float], by="symbol") -> DataFrame:
    """(keys, fold, ridge, rows, squared_error): the error of every penalty on every fold left out."""
    penalties = F.array(*[F.lit(float(g)) for g in grid])
    per_fold = models.select(*o.keys(by), F.explode("folds").alias("_f")).select(*o.keys(by), "_f.fold", "_f.rows", F.posexplode("_f.squared_errors").alias("_g", "squared_error"))
    return per_fold.withColumn("ridge", F.element_at(penalties, F.col("_g") + 1)).drop("_g")


def train_grid(data: DataFrame, features: Sequence[str], target: str = "target", grid: Sequence[float] = GRID, by="symbol", fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(models, results) like ``train_per_symbol``, with the penalty of each series chosen from ``grid``.

    ``data`` is read twice: for the sums, and for the absolute errors of the chosen models, which sums do not give.
    """
    keys = o.keys(by)
    models = ridge_path(data, features, target, grid, by, fold)
    error, test = F.abs(F.col(target) - F.col("predicted")), F.col(fold).isNull()
    scored = predict_per_symbol(data, models.drop("folds", "ridge", "validation_mse"), features, by=by)
    errors = scored.groupBy(*keys).agg(
        F.count_if(~test).alias("train_rows"), F.count_if(test).alias("test_rows"), F.lit(len(features)).cast("bigint").alias("n_features"),
        F.avg(F.when(~test, error)).alias("train_mae"), F.avg(F.when(test, error)).alias("test_mae"),
    )
    return models, errors.join(models.select(*keys, "ridge", "validation_mse"), keys)
