"""Sinks and streaming: idempotent upserts, stream = batch over restarts, late rows, quarantine."""

import shutil
from datetime import date
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from helpers import by_key
from pyspark.sql import functions as F

from barloom.operators import indicators as ind
from barloom.sources import storage, writers
from barloom.streaming import jobs, state


def test_upsert_twice_changes_nothing(spark, bars, tmp_path):
    path = str(tmp_path / "table")
    keys = ["symbol", "ts"]
    writers.upsert(spark, path, bars, keys)
    changes = bars.filter("symbol = 'MID'").withColumns({"close": F.lit(1.0), "open": F.lit(2.0)})
    for _ in range(2):
        writers.upsert(spark, path, changes, keys, update_cols=["close"])
    got = spark.read.parquet(path)
    assert got.count() == bars.count()
    row = got.filter("symbol = 'MID'").agg(F.max("close"), F.max("open")).first()
    assert row[0] == 1.0 and row[1] != 2.0
    assert not list(tmp_path.glob("*staging*"))


def test_interrupted_upsert_is_finished_or_undone(spark, bars, tmp_path, monkeypatch):
    path, keys = str(tmp_path / "table"), ["symbol", "ts"]
    writers.upsert(spark, path, bars, keys)
    changes = bars.filter("symbol = 'BIG'").withColumn("close", F.lit(1.0))
    n, big = bars.count(), changes.count()

    def stop(*_):
        raise RuntimeError("stopped")

    ones = lambda: (writers.read_current(spark, path).count(), writers.read_current(spark, path).filter("close = 1.0").count())
    with monkeypatch.context() as m:
        m.setattr(writers, "_put_text", stop)
        with pytest.raises(RuntimeError):
            writers.upsert(spark, path, changes, keys)
    assert ones() == (n, 0)
    finish = writers.recover
    calls = []
    with monkeypatch.context() as m:
        m.setattr(writers, "recover", lambda *x: stop() if calls else calls.append(finish(*x)))
        with pytest.raises(RuntimeError):
            writers.upsert(spark, path, changes, keys)
    # One partition is already gone when the job dies; the marker still knows all.
    shutil.rmtree(sorted((tmp_path / "table").glob("date=*"))[0])
    assert ones() == (n, big)
    # Reading changed nothing: the update is still waiting, and the next writer finishes it.
    assert (tmp_path / "table__commit").exists() and list(tmp_path.glob("*staging*"))
    writers.upsert(spark, path, changes.limit(1), keys)
    assert ones() == (n, big) and not (tmp_path / "table__commit").exists() and not list(tmp_path.glob("*staging*"))


def test_reader_between_the_moves_of_a_writer(spark, bars, tmp_path, monkeypatch):
    """Read after every single step by which an update moves in: always the new table, and the update arrives whole."""
    path, keys = str(tmp_path / "table"), ["symbol", "ts"]
    first = bars.filter("symbol = 'MID' AND ts < TIMESTAMP '2024-01-04'")
    writers.upsert(spark, path, first, keys)
    changes = first.filter("ts < TIMESTAMP '2024-01-03'").withColumn("close", F.lit(1.0))
    n, changed, seen, real = first.count(), changes.count(), [], writers._fs

    class Spy:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            done = self.fs.rename(a, b)
            if (tmp_path / "table__commit").exists():
                with monkeypatch.context() as m:
                    m.setattr(writers, "_fs", real)
                    got = writers.read_current(spark, path)
                    seen.append((got.count(), got.filter("close = 1.0").count()))
            return done

        def __getattr__(self, name):
            return getattr(self.fs, name)

    with monkeypatch.context() as m:
        m.setattr(writers, "_fs", lambda *x: (lambda fs, p: (Spy(fs), p))(*real(*x)))
        writers.upsert(spark, path, changes, keys)
    assert len(seen) > 4 and set(seen) == {(n, changed)}
    got = spark.read.parquet(path)
    assert (got.count(), got.filter("close = 1.0").count()) == (n, changed)


def test_rows_without_a_time_survive_updates_and_retention(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [("a", None, 1.0), ("b", None, 2.0), (None, None, 3.0), ("c", pd.Timestamp("2020-01-01").to_pydatetime(), 4.0)]
    table = spark.createDataFrame(rows, "symbol string, ts timestamp, close double")
    writers.upsert(spark, path, table, ["symbol", "ts"])
    for _ in range(2):
        writers.upsert(spark, path, table.filter("symbol = 'a' OR symbol IS NULL").withColumn("close", F.lit(9.0)), ["symbol", "ts"])
    got = {r.symbol: r.close for r in writers.read_current(spark, path).collect()}
    assert got == {"a": 9.0, "b": 2.0, None: 9.0, "c": 4.0} and writers.read_current(spark, path).count() == 4
    writers.upsert(spark, path, table.limit(0), ["symbol", "ts"])
    assert storage.drop_old_partitions(spark, path, date(2024, 2, 1), 7) == ["date=2020-01-01"]
    assert writers.read_current(spark, path).count() == 3 and storage.drop_old_partitions(spark, str(tmp_path / "none"), date(2024, 2, 1), 7) == []


def test_shared_folder_is_required():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="checkpoint"):
        storage.shared_dir(unset, "x")


def test_retention(spark, bars, tmp_path):
    path = str(tmp_path / "t")
    bars.withColumn("date", F.to_date("ts")).write.partitionBy("date").parquet(path)
    storage.drop_old_partitions(spark, path, date(2024, 2, 1), 7)
    assert spark.read.parquet(path).agg(F.min("date")).first()[0] >= date(2024, 1, 25)


def test_stateful_indicators_equal_batch_after_restart(spark, bars, bars_pdf, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    edges = pd.to_datetime(["2024-01-01", "2024-01-15", "2024-02-20", "2030-01-01"])
    for lo, hi in zip(edges, edges[1:]):
        spark.createDataFrame(bars_pdf[(bars_pdf.ts >= lo) & (bars_pdf.ts < hi)]).coalesce(1).write.mode("append").parquet(src)
        made = state.streaming_indicators(spark.readStream.schema(bars.schema).parquet(src))
        jobs.finish(made.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out))
    got = by_key(spark.read.parquet(out), "symbol", "ts")
    want = by_key(ind.indicator_set(bars), "symbol", "ts")
    ema = by_key(ind.macd_ema(bars), "symbol", "ts")
    assert len(got) == len(want) and not got.late.any()
    for c in state.INDICATOR_FIELDS[:-2]:
        np.testing.assert_allclose(got[c], want[c], atol=1e-7, err_msg=c)
    np.testing.assert_allclose(got.macd_ema_signal, ema.macd_signal, atol=1e-7)
    # A bar from the past is set aside and changes nothing.
    spark.createDataFrame(bars_pdf[bars_pdf.symbol == "MID"].head(3)).coalesce(1).write.mode("append").parquet(src)
    made = state.streaming_indicators(spark.readStream.schema(bars.schema).parquet(src))
    jobs.finish(made.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out))
    again = spark.read.parquet(out)
    assert again.filter("late").count() == 3 and again.filter("NOT late").count() == len(want)


def test_quarantine_and_fan_out(spark, bars, tmp_path):
    src = str(tmp_path / "in")
    bars.withColumn("low", F.when(F.hour("ts") == 3, F.col("high") + 1).otherwise(F.col("low"))).write.parquet(src)
    live = spark.readStream.schema(bars.schema).parquet(src)
    ok, bad = str(tmp_path / "ok"), str(tmp_path / "bad")
    jobs.finish(jobs.validated_stream(live, "price", ok, bad, str(tmp_path / "c1"), jobs.AVAILABLE))
    n_bad = bars.filter(F.hour("ts") == 3).count()
    assert spark.read.parquet(bad).count() == n_bad and spark.read.parquet(ok).count() == bars.count() - n_bad
    seen = []
    jobs.finish(jobs.fan_out(live, [lambda b, i: seen.append(b.count()), lambda b, i: seen.append(b.count())], str(tmp_path / "c2"), jobs.AVAILABLE))
    assert seen == [bars.count()] * 2


def test_late_ticks_are_dropped(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "ts timestamp, symbol string, price double"
    batches = [[("2024-01-01 10:05", 1.0), ("2024-01-01 10:30", 2.0)], [("2024-01-01 12:00", 3.0)], [("2024-01-01 10:40", 99.0), ("2024-01-01 14:30", 4.0)]]
    for rows in batches:
        spark.createDataFrame([(pd.Timestamp(t).to_pydatetime(), "S", p) for t, p in rows], schema).coalesce(1).write.mode("append").parquet(src)
        live = jobs.event_time_bars(spark.readStream.schema(schema).parquet(src))
        jobs.finish(live.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out))
    got = by_key(spark.read.parquet(out), "ts")
    assert list(got.close) == [2.0, 3.0] and list(got.volume) == [2, 1]


def test_three_sinks(spark, bars, tmp_path):
    src, root = str(tmp_path / "in"), str(tmp_path / "sinks")
    bars.write.parquet(src)
    live = spark.readStream.schema(bars.schema).parquet(src).withColumn("date", F.to_date("ts"))
    jobs.finish(jobs.start_sinks(live, root, f"{root}/check", trigger=jobs.AVAILABLE, console=True))
    assert spark.read.parquet(f"{root}/table").count() == bars.count()
    assert spark.read.json(f"{root}/messages").count() == bars.count()


def test_sent_messages_are_small_files_that_read_back_whole(spark, monkeypatch):
    from urllib.parse import urlparse
    from pathlib import Path

    from barloom.plans import streams
    from barloom.sources import readers

    monkeypatch.setattr(streams, "FILE_ROWS", 700)
    made = spark.range(5_000).select(F.to_json(F.struct(F.concat(F.lit("S"), "id").alias("symbol"), F.lit("2024-01-01T00:00:00").alias("timestamp"),
                                                        F.struct((F.col("id") / 7).alias("open"), F.lit(1.5).alias("high")).alias("data"))).alias("value"))
    path = streams._sent(made, "sent")
    files = [f for f in Path(urlparse(path).path).iterdir() if f.name.startswith("part-")]
    assert len(files) >= 8 and sum(f.stat().st_size for f in files) < made.agg(F.sum(F.length("value"))).first()[0] / 3
    back = readers.parse_bars(readers.read_messages(spark, "text", {}, path, stream=False))
    wanted = readers.parse_bars(made)
    assert back.exceptAll(wanted).count() == wanted.exceptAll(back).count() == 0 and back.count() == 5_000
