"""Where jobs keep checkpoints and intermediate tables, and how old partitions are removed."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import SparkSession

from barloom.sources.staging import shared_dir, staged  # noqa: F401
from barloom.sources.writers import _fs, partition_date, partitions_of

# Days kept per table.
RETENTION_DAYS = {"ticks": 7, "bars": 30, "quotes": 30, "indicators": 90, "greeks": 90, "predictions": 365, "signals": 365}


def drop_old_partitions(spark: SparkSession, path: str, as_of: date, keep_days: int) -> list[str]:
    """Delete ``date=...`` folders older than ``keep_days`` before ``as_of``; returns their names.

    Folder names are listed, no data is read.  Rows without a time have no age: their partition stays.
    """
    limit = as_of - timedelta(days=keep_days)
    old = [name for name in partitions_of(spark, path) if (day := partition_date(name)) is not None and day < limit]
    for name in old:
        fs, folder = _fs(spark, f"{path.rstrip('/')}/{name}")
        fs.delete(folder, True)
    return old
