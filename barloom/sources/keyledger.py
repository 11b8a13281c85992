"""Keys seen so far, kept by date, with Bloom filters that say which dates have to be read.

A watermark forgets a key after its delay; this ledger keeps it.  Below ``path`` lie ``keys/date=.../batch=...``, the keys by
the date they were first seen with, and ``filters/date=.../batch=...``, a Bloom filter of each such set.  A filter is a table
of blocks of 32,768 bits: a key has one block, and all its bits are in it, so that probing is an equi-join on the block.  The
number of blocks grows with the keys.  Filters only choose which dates are read; the keys themselves decide.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.staging import staged
from barloom.sources.writers import partition_date, partitions_of, path_exists

#: Bits of a block, as ``bitmap_construct_agg`` makes them.
BLOCK_BITS = 32_768
#: Bits a key has room for, and bits it sets: about one key in 10,000 is suspected wrongly.
BITS_PER_KEY, HASHES = 32, 5
#: A filter has at least 2**4 blocks, so that a probe spreads over several tasks.
MIN_LEVEL = 4


def _hash(keys: Sequence[str], seed: int) -> Column:
    """A hash that tells null from every value."""
    parts = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    return F.xxhash64(*parts, F.lit(seed))


def _block(keys: Sequence[str], level: Column) -> Column:
    return F.hash(_hash(keys, 0)).cast("long").bitwiseAND(F.pow(F.lit(2), level).cast("long") - 1)


def _positions(keys: Sequence[str]) -> list[Column]:
    return [F.pmod(_hash(keys, i), F.lit(BLOCK_BITS)) for i in range(1, HASHES + 1)]


def build_filters(rows: DataFrame, keys: Sequence[str], by: Sequence[str] = ("date",)) -> DataFrame:
    """(by, level, block, bits): a Bloom filter per group, of 2**level blocks; reduced before the shuffle."""
    wanted = F.ceil(F.log2(F.greatest(F.count(F.lit(1)) * F.lit(BITS_PER_KEY) / F.lit(BLOCK_BITS), F.lit(1.0))))
    levels = rows.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.greatest(wanted, F.lit(MIN_LEVEL)).cast("int").alias("level"))
    same = reduce(lambda x, y: x & y, [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by])
    bits = rows.join(levels, same).select(*by, "level", _block(keys, F.col("level")).alias("block"), F.explode(F.array(*_positions(keys))).alias("_p"))
    return bits.groupBy(*by, "level", "block").agg(F.bitmap_construct_agg("_p").alias("bits"))


def _has(bits: str, position: str) -> Column:
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(F.col(position) / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", byte, F.pmod(F.col(position), F.lit(8)).cast("int")) == 1


def suspects(batch: DataFrame, filters: DataFrame, keys: Sequence[str], levels: Sequence[int]) -> DataFrame:
    """(keys, date): the dates under which a key may be stored.  ``levels`` are those that occur in ``filters``."""
    at = [f"_p{i}" for i in range(HASHES)]
    probes = batch.select(*keys, *[p.alias(n) for p, n in zip(_positions(keys), at, strict=True)], F.explode(F.array(*[F.lit(n) for n in levels])).alias("level"))
    probes = probes.withColumn("block", _block(keys, F.col("level")))
    stored = filters.select("date", F.col("level").alias("_level"), F.col("block").alias("_block"), "bits")
    found = probes.join(stored, (F.col("level") == F.col("_level")) & (F.col("block") == F.col("_block")) & reduce(lambda x, y: x & y, [_has("bits", n) for n in at]))
    return found.select(*keys, "date").distinct()


def admit(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], batch_id: int, ts: str = "ts", order: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """The rows of ``batch`` whose key was never seen, one per key, and how many dates were stored and read.

    Of rows with one key the first in ``order`` (``ts`` unless told otherwise) stays; null keys equal null keys; rows
    without a time are kept under a date of their own.  The keys let in are stored under ``batch_id``: a batch that is
    sent again after a failure does not meet its own keys and lets in the same rows.  Batches come one after the other.
    """
    keys = list(keys)
    rest = [c for c in batch.columns if c not in keys]
    first = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or (ts,)))).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
    rows = staged(first, "ledger-batch")
    dates = partitions_of(spark, f"{path}/keys")
    read: list = []
    fresh = rows
    if dates:
        earlier = F.col("batch") != batch_id
        filters = spark.read.parquet(f"{path}/filters").where(earlier)
        levels = sorted(r.level for r in filters.select("level").distinct().collect())
        if levels:
            found = staged(suspects(rows, filters, keys, levels), "ledger-suspects")
            read = [r.date for r in found.select("date").distinct().collect()]
            if read:
                stored = spark.read.parquet(f"{path}/keys").where(earlier & reduce(lambda x, y: x | y, [F.col("date").eqNullSafe(F.lit(d)) for d in read]))
                stored = stored.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("date").alias("_date"))
                same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "date"]])
                known = found.join(stored, same, "left_semi").select(*[F.col(k).alias(f"_{k}") for k in keys])
                fresh = staged(rows.join(known, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]), "left_anti"), "ledger-fresh")
    kept = fresh.select(*keys, F.to_date(ts).alias("date"), F.lit(batch_id).alias("batch"))
    for name, table in (("keys", kept), ("filters", build_filters(kept, keys, ("date", "batch")))):
        table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(f"{path}/{name}")
    return fresh, {"dates": len(dates), "read": len(read)}


def compact(spark: SparkSession, path: str, keys: Sequence[str], out: str, batch_id: int) -> str:
    """The ledger with one set of keys and one filter a date, as a new ledger at ``out``; ``batch_id`` is the last batch in it.

    The old one stays as it is until its owner points the job at the new one; the next batch has to be a later one.
    """
    stored = spark.read.parquet(f"{path}/keys").where(F.col("batch") <= batch_id).select(*keys, "date").withColumn("batch", F.lit(batch_id))
    for name, table in (("keys", stored), ("filters", build_filters(stored, keys, ("date", "batch")))):
        table.write.mode("overwrite").partitionBy("date", "batch").parquet(f"{out}/{name}")
    return out


def stored_dates(spark: SparkSession, path: str) -> list:
    """Dates that the ledger holds keys under; None stands for keys without a time."""
    return [partition_date(n) for n in partitions_of(spark, f"{path}/keys")] if path_exists(spark, path) else []
