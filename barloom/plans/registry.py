"""Named queries over the given tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AS_OF = "2024-01-30 00:00:00"


# Averages over 32 or 64 rows of two-decimal prices often end exactly halfway between two
# six-digit values, where the last bit of a sum decides.  Both sides shift that midpoint.
NUDGE = 2.3e-9


def _rounded(name: str, digits: int):
    """Rounding by floor: the same arithmetic in both engines, and cheap."""
    unit = 10.0**digits
    return (F.floor((F.col(name).cast("double") + NUDGE) * unit + 0.5) / unit).alias(name)


def _rounded_sql(name: str, digits: int) -> str:
    unit = f"{10.0**digits!r}::DOUBLE"
    return f"floor(({name}::DOUBLE + {NUDGE}::DOUBLE) * {unit} + 0.5::DOUBLE) / {unit} AS {name}"


def _plain(df: DataFrame, name: str):
    """Dates leave as text, which both engines print alike."""
    kind = dict(df.dtypes)[name]
    return F.col(name).cast("string").alias(name) if kind == "date" else F.col(name)


def add(
    name: str,
    fn: Callable[[SparkSession, str], DataFrame],
    exact: Sequence[str] = (),
    rounded: Sequence[str] = (),
    sql: str | None = None,
    ctes: Sequence[str] = (),
    digits: int = 6,
) -> None:
    """Register a query.  Result columns are ``exact`` as they are, ``rounded`` to ``digits``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        context = spark.sparkContext
        if not (spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()) and context.master.startswith("local"):
            # The operators demand a shared folder; only a local trial run of a query gets one of its own.
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='barloom-')}")
        df = fn(spark, sf_dir)
        return df.select(*[_plain(df, c) for c in exact], *[_rounded(c, digits) for c in rounded])

    QUERIES[name] = run
    if sql is not None:
        head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
        columns = ", ".join([*(f'"{c}"' for c in exact), *[_rounded_sql(c, digits) for c in rounded]])
        ORACLES[name] = f"{head}SELECT {columns} FROM ({sql}) AS result"
