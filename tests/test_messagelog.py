"""The message log: nothing lost and nothing repeated over restarts, failed tasks and repeated batches."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.sources import messagelog, readers, writers
from barloom.streaming import jobs


@pytest.fixture(scope="module")
def log_spark(spark):
    spark.dataSource.register(messagelog.MessageLog)
    return spark


def messages(spark, low, high):
    return spark.range(low, high).select((F.col("id") % 7).cast("string").alias("key"), F.concat(F.lit("m"), F.col("id")).alias("value"))


def options(tmp_path, **more):
    return {"path": f"file://{tmp_path}/log", "partitions": "3"} | more


def drain(spark, tmp_path, name="out"):
    live = spark.readStream.format("message_log").options(**options(tmp_path)).load()
    jobs.finish(live.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-check").trigger(availableNow=True).start(f"{tmp_path}/{name}"))
    return spark.read.schema("partition int, offset long, key string, value string").parquet(f"{tmp_path}/{name}")


def test_batch_and_stream_go_on_from_offsets(log_spark, tmp_path):
    send = lambda low, high: messages(log_spark, low, high).repartition(3).write.format("message_log").options(**options(tmp_path)).mode("append").save()
    send(0, 100)
    assert drain(log_spark, tmp_path).count() == 100
    send(100, 250)
    send(250, 251)
    got = drain(log_spark, tmp_path).collect()
    assert sorted(r.value for r in got) == sorted(f"m{i}" for i in range(251))
    read = log_spark.read.format("message_log").options(**options(tmp_path)).load().collect()
    assert sorted(map(tuple, read)) == sorted(map(tuple, got))
    for p in range(3):  # offsets of a partition have no gaps, and a key stays in its partition
        assert sorted(r.offset for r in got if r.partition == p) == list(range(sum(r.partition == p for r in got)))
    assert len({(r.key, r.partition) for r in got}) == 7


def test_failed_tasks_leave_nothing(log_spark, tmp_path):
    fail = F.when(F.col("value") == "m77", F.raise_error(F.lit("broken"))).otherwise(F.col("value"))
    with pytest.raises(Exception, match="broken"):
        messages(log_spark, 0, 100).repartition(4).withColumn("value", fail).write.format("message_log").options(**options(tmp_path)).mode("append").save()
    assert log_spark.read.format("message_log").options(**options(tmp_path)).load().count() == 0
    assert not list((tmp_path / "log").glob("commits/*.json"))


def test_repeated_batch_of_a_stream_is_taken_once(log_spark, tmp_path):
    """The query dies after the log's commit and before its own: it sends the same batch again."""
    messages(log_spark, 0, 50).coalesce(1).write.parquet(f"{tmp_path}/in")
    live = log_spark.readStream.schema("key string, value string").parquet(f"{tmp_path}/in")

    def send():
        jobs.finish(writers.write_stream_json(live, "key", "message_log", options(tmp_path, writer="job"), f"{tmp_path}/check", trigger=jobs.AVAILABLE))

    send()
    for done in ("0", ".0.crc"):
        (tmp_path / "check" / "commits" / done).unlink()
    send()
    stored = log_spark.read.format("message_log").options(**options(tmp_path)).load()
    assert stored.count() == 50 and len(list((tmp_path / "log" / "commits").glob("*.json"))) == 1
    assert len(list((tmp_path / "log" / "data").glob("*"))) == len(json.loads(next((tmp_path / "log" / "commits").glob("*.json")).read_text())["files"])
    messages(log_spark, 50, 60).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    send()
    assert stored.sparkSession.read.format("message_log").options(**options(tmp_path)).load().count() == 60


def test_bars_through_the_log(log_spark, bars, tmp_path):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp")
    envelope = bars.select("symbol", F.to_json(F.struct("symbol", stamp, F.struct("open", "high", "low", "close", "volume").alias("data"))).alias("value"))
    writers.send_batch(envelope.withColumnRenamed("symbol", "key").select("key", "value"), "message_log", options(tmp_path), raw=True)
    got = readers.parse_bars(readers.read_messages(log_spark, "message_log", options(tmp_path), stream=False))
    assert got.count() == bars.count() and got.agg(F.sum("close")).first()[0] == pytest.approx(bars.agg(F.sum("close")).first()[0])


def test_null_keys_and_options(log_spark, tmp_path):
    rows = log_spark.createDataFrame([(None, "a"), (None, None), ("k", None), ("", "")], "key string, value string")
    rows.write.format("message_log").options(**options(tmp_path)).mode("append").save()
    got = log_spark.read.format("message_log").options(**options(tmp_path)).load()
    assert sorted(((r.key, r.value) for r in got.collect()), key=str) == sorted([(None, "a"), (None, None), ("k", None), ("", "")], key=str)
    with pytest.raises(Exception, match="path"):
        log_spark.read.format("message_log").load().count()
