"""Sinks: message envelopes, stream writers, keyed upsert, per-symbol files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.mathfn import first_key
from barloom.operators.lookup import instant


def _now(as_of):
    return F.current_timestamp() if as_of is None else instant(as_of)


# Per message kind the key column and the name of the payload field.
ENVELOPES = {
    "chain": ("symbol", "data"),
    "quote": ("options_ticker", "data"),
    "greeks": ("options_ticker", "greeks"),
    "price": ("symbol", "data"),
    "article": (None, "article"),
    "sentiment": ("symbol", "sentiment"),
}


def to_envelope(df: DataFrame, kind: str, payload: Sequence[str], as_of=None) -> DataFrame:
    """(key, value): the JSON message with the payload columns under the kind's field."""
    key, field = ENVELOPES[kind]
    body = F.struct(*payload).alias(field)
    stamp = F.date_format(_now(as_of), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp")
    if key is None:
        return df.select(first_key("id", "headline").alias("key"), F.to_json(F.struct(stamp, body)).alias("value"))
    return df.select(F.col(key).alias("key"), F.to_json(F.struct(key, stamp, body)).alias("value"))


def to_batch_messages(df: DataFrame) -> DataFrame:
    """Whole rows as messages, keyed by symbol, else by contract."""
    candidates = [F.col(c) for c in ("symbol", "options_ticker") if c in df.columns]
    return df.select(F.coalesce(*candidates).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def send_batch(df: DataFrame, fmt: str, options: dict, path: str | None = None, raw: bool = False) -> None:
    """Rows as messages to Kafka (connector needed), a message log or files; ``raw`` rows are messages (key, value) already."""
    writer = (df if raw else to_batch_messages(df)).write.format(fmt).options(**options).mode("append")
    writer.save(path) if path else writer.save()


def to_json_rows(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_stream_json(df: DataFrame, key: str, fmt: str, options: dict, checkpoint: str, path=None, trigger=None):
    """Key and JSON of all columns, appended to Kafka (connector needed) or to files."""
    w = to_json_rows(df, key).writeStream.format(fmt).outputMode("append").options(**options)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(**trigger) if trigger else w
    return w.start(path) if path else w.start()


def write_stream_parquet(df: DataFrame, path: str, checkpoint: str, partitions=("date", "symbol"), trigger=None):
    w = df.writeStream.format("parquet").outputMode("append").partitionBy(*partitions)
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(**trigger) if trigger else w
    return w.start(path)


def write_stream_console(df: DataFrame, checkpoint: str, trigger=None):
    w = df.writeStream.format("console").outputMode("append").option("checkpointLocation", checkpoint)
    return (w.trigger(**trigger) if trigger else w).start()


def newest_per_key(updates: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One update per key, the last in ``order``; reduced before the shuffle."""
    rest = [c for c in updates.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_u")
    return updates.groupBy(*keys).agg(newest).select(*keys, "_u.*").select(*updates.columns)


def merge_updates(target: DataFrame, updates: DataFrame, keys: Sequence[str],
                  update_cols: Sequence[str] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """The target after insert-or-update.  Columns outside ``update_cols`` keep the stored value; a null key equals a null key."""
    keys = list(keys)
    rest = [c for c in target.columns if c not in keys]
    changed = set(rest if update_cols is None else update_cols)
    incoming = newest_per_key(updates, keys, order or rest)
    t = target.select(F.struct(*keys).alias("_tk"), F.struct(*rest).alias("_t"))
    u = incoming.select(F.struct(*keys).alias("_uk"), F.struct(*rest).alias("_u"))
    same = [F.col("_tk")[k].eqNullSafe(F.col("_uk")[k]) for k in keys]
    both = t.join(u, reduce(lambda a, b: a & b, same), "full")
    has_old, has_new = F.col("_tk").isNotNull(), F.col("_uk").isNotNull()
    named = [F.when(has_new, F.col("_uk")[k]).otherwise(F.col("_tk")[k]).alias(k) for k in keys]
    values = [
        F.when(has_new if c in changed else ~has_old, F.col("_u")[c]).otherwise(F.col("_t")[c]).alias(c)
        for c in rest
    ]
    return both.select(*named, *values).select(*target.columns)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _marker(path: str) -> str:
    return f"{path.rstrip('/')}__commit"


def _put_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file at once: written beside its place and renamed."""
    fs, p = _fs(spark, path)
    beside = p.suffix(f".{uuid.uuid4().hex}")
    out = fs.create(beside)
    out.writeBytes(text)
    out.close()
    if not fs.rename(beside, p):
        fs.delete(beside, False)
        raise FileExistsError(f"another update of this table is under way: {path}")


def _committed(spark: SparkSession, path: str) -> str | None:
    """Where the partitions of a committed but unfinished update lie."""
    fs, marker = _fs(spark, _marker(path))
    return spark.sparkContext.wholeTextFiles(_marker(path)).first()[1] if fs.exists(marker) else None


def partitions_of(spark: SparkSession, path: str) -> list[str]:
    """Names of the ``date=...`` folders below a path; none if it does not exist."""
    fs, root = _fs(spark, path)
    names = [status.getPath().getName() for status in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(name for name in names if name.startswith("date="))


NULL_PARTITION = "date=__HIVE_DEFAULT_PARTITION__"


def partition_date(name: str) -> date | None:
    """The date of a ``date=...`` folder; None for the one that holds rows without a time."""
    return None if name == NULL_PARTITION else date.fromisoformat(name.removeprefix("date="))


def recover(spark: SparkSession, path: str) -> None:
    """Finish an update that a dead writer committed; for writers only.

    A marker beside the table names finished partitions that have yet to move in.  The old partition first moves aside,
    then the new one takes its place; what was moved aside is deleted last, when the marker is gone.  Whatever step
    was the last one, going on from it gives the same table.  Without a marker nothing was committed.
    """
    staging = _committed(spark, path)
    if staging is None:
        return
    fs, root = _fs(spark, path)
    fs.mkdirs(root)
    aside = _fs(spark, f"{staging}_replaced")[1]
    fs.mkdirs(aside)
    child = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for name in partitions_of(spark, staging):
        new, place, old = child(_fs(spark, staging)[1], name), child(root, name), child(aside, name)
        if fs.exists(place):
            if fs.exists(old):
                fs.delete(place, True)  # a move in that a store without atomic renames left half done
            elif not fs.rename(place, old):
                raise OSError(f"{place} could not be moved aside")
        if not fs.rename(new, place):
            raise OSError(f"{new} could not be moved into the table")
    fs.delete(_fs(spark, _marker(path))[1], False)
    fs.delete(aside.getParent(), True)


def upsert(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str],
           update_cols: Sequence[str] | None = None, order: Sequence[str] = (), ts: str = "ts",
           merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> str:
    """Insert-or-update a Parquet table kept as date partitions.

    Only partitions the updates touch are read and rewritten (``ts`` is part of the key, so
    a key never changes partition); rows without a time have a partition of their own.  The updates are evaluated once,
    reduced to one row per key, and staged.  The merged partitions are written beside the table; then a marker commits
    them; then they move in.  A failure before the marker leaves the table as it was, one after it is finished by the
    next upsert.  One job at a time may update a table: the caller sees to that, no lock is taken.
    ``merge(stored, updates)`` may say how the rows of the touched partitions come together; both have a ``date``.
    """
    recover(spark, path)
    fs, left = _fs(spark, f"{path.rstrip('/')}__staging_*")
    for status in fs.globStatus(left) or []:
        fs.delete(status.getPath(), True)  # of a writer that died before it committed
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    dated = updates.withColumn("date", F.to_date(ts))
    newest_per_key(dated, [*keys, "date"], order or [c for c in updates.columns if c not in keys]).write.parquet(f"{staging}/updates")
    dated = spark.read.schema(dated.schema).parquet(f"{staging}/updates")
    merged = dated
    if partitions_of(spark, path):
        target = spark.read.parquet(path)
        days = dated.select(F.col("date").alias("_day")).distinct()
        touched = target.join(days, F.col("date").eqNullSafe(F.col("_day")), "left_semi").select(*dated.columns)
        merged = merge(touched, dated) if merge else merge_updates(touched, dated, [*keys, "date"], update_cols, order)
    merged.write.partitionBy("date").parquet(f"{staging}/merged")
    if partitions_of(spark, f"{staging}/merged"):
        _put_text(spark, _marker(path), f"{staging}/merged")
        recover(spark, path)
    fs.delete(_fs(spark, staging)[1], True)
    return path


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table as last committed; reading changes nothing.

    If a committed update has not moved in yet, its partitions are read from where they lie, and the others from the
    table.  A reader that meets a partition on the move fails with a missing file and has to be run again.
    """
    staging = _committed(spark, path)
    waiting = partitions_of(spark, staging) if staging else []
    if not waiting:
        return spark.read.parquet(path)
    new = spark.read.parquet(staging)
    stored = set(partitions_of(spark, path)) - set(waiting)
    if not stored:
        return new
    replaced = [F.col("date").eqNullSafe(F.lit(partition_date(name)).cast("date")) for name in waiting]
    rest = spark.read.parquet(path).where(~reduce(lambda a, b: a | b, replaced))
    return rest.unionByName(new.withColumn("date", F.col("date").cast(rest.schema["date"].dataType)))


def write_symbol_files(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One directory per symbol; a large symbol is split over as many files as tasks wrote it."""
    w = df.write.partitionBy("symbol").mode("overwrite")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """Training results as CSV; one row per symbol."""
    results.write.mode("overwrite").option("header", True).csv(path)
