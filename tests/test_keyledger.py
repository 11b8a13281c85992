"""Keys remembered beyond any watermark: repeats, restarts, nulls, and which dates are read."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.sources import keyledger as kl

START = pd.Timestamp("2024-01-01")


def rows(spark, ids, day=0, seconds=0):
    ids = list(ids)
    return spark.createDataFrame([(i, f"{START + pd.Timedelta(days=day, seconds=seconds)}") for i in ids], "id long, at string").select(
        "id", F.col("at").cast("timestamp").alias("ts"))


def let_in(df):
    return sorted((r.id for r in df.select("id").collect()), key=lambda x: (x is None, x))


def test_a_repeat_after_months_is_dropped_and_few_dates_are_read(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for day in range(6):
        fresh, figures = kl.admit(spark, path, rows(spark, range(100 * day, 100 * day + 100), day), ["id"], day)
        assert let_in(fresh) == list(range(100 * day, 100 * day + 100))
        assert figures["dates"] == day
    fresh, figures = kl.admit(spark, path, rows(spark, [5, 205, 9000], 200), ["id"], 6)
    assert let_in(fresh) == [9000]
    assert figures == {"dates": 6, "read": 2}
    # New keys alone read (nearly) nothing.
    fresh, figures = kl.admit(spark, path, rows(spark, range(10_000, 10_200), 201), ["id"], 7)
    assert let_in(fresh) == list(range(10_000, 10_200)) and figures["read"] <= 1


def test_a_batch_sent_again_lets_in_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "ledger")
    kl.admit(spark, path, rows(spark, [1, 2, 3]), ["id"], 0)
    batch = rows(spark, [3, 4, 5], 1)
    for _ in range(2):
        assert let_in(kl.admit(spark, path, batch, ["id"], 1)[0]) == [4, 5]
    assert spark.read.parquet(f"{path}/keys").count() == 5
    assert let_in(kl.admit(spark, path, batch, ["id"], 2)[0]) == []


def test_nulls_ties_repeats_and_rows_without_a_time(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batch = rows(spark, [None, 1, 1, None]).unionByName(rows(spark, [1], 0, 5)).unionByName(
        spark.createDataFrame([(7, None)], "id long, ts timestamp"))
    assert let_in(kl.admit(spark, path, batch, ["id"], 0)[0]) == [1, 7, None]
    assert None in kl.stored_dates(spark, path)
    assert let_in(kl.admit(spark, path, rows(spark, [None, 7, 1, 8], 3), ["id"], 1)[0]) == [8]
    assert let_in(kl.admit(spark, path, rows(spark, []), ["id"], 2)[0]) == []


def test_an_empty_ledger_and_two_key_columns(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert kl.admit(spark, path, rows(spark, []), ["id", "ts"], 0)[0].count() == 0
    batch = rows(spark, [1, 2])
    assert kl.admit(spark, path, batch, ["id", "ts"], 1)[0].count() == 2
    assert kl.admit(spark, path, batch.unionByName(rows(spark, [1], 0, 1)), ["id", "ts"], 2)[0].count() == 1


def test_filters_find_every_stored_key_and_little_else(spark):
    stored = spark.range(40_000).withColumn("date", F.lit("2024-01-01").cast("date"))
    filters = kl.build_filters(stored, ["id"]).cache()
    levels = [r.level for r in filters.select("level").distinct().collect()]
    assert levels == [6]  # 40,000 keys of 32 bits are 40 blocks, the next power of two is 64
    assert kl.suspects(spark.range(40_000), filters, ["id"], levels).count() == 40_000
    assert kl.suspects(spark.range(1_000_000, 1_040_000), filters, ["id"], levels).count() < 80


@pytest.mark.parametrize("last", [1])
def test_compaction_keeps_every_key(spark, tmp_path, last):
    path, out = str(tmp_path / "ledger"), str(tmp_path / "compact")
    for k in range(last + 1):
        kl.admit(spark, path, rows(spark, range(50 * k, 50 * k + 50)), ["id"], k)
    kl.compact(spark, path, ["id"], out, last)
    assert spark.read.parquet(f"{out}/filters").select("batch").distinct().count() == 1
    assert let_in(kl.admit(spark, out, rows(spark, [0, 60, 1000], 9), ["id"], last + 1)[0]) == [1000]
