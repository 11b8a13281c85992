"""Shared folder, staged tables and Python shipping for the operators of this subpackage."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARED = "spark.checkpoint.dir"


def ship(module: str) -> None:
    """Send this module's functions to the executors by value, so that they need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares.

    Only a local session without the setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get(SHARED, None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise ValueError(f"{SHARED} names no shared folder")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="barloom-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
