"""Payloads with fields that nobody named: kept, read by path, counted and sent out again."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.sources import openfields as of
from barloom.sources import payloads as pl
from barloom.sources import writers

CHAIN = {"symbol": "A", "data": {"status": "OK", "results": [
    {"strike_price": 5.5, "expiration_date": "2024-03-15", "contract_type": "call", "greeks": {"delta": 0.4, "seen": [1, 2]}, "odd 'name'": True},
    {"strike_price": "n/a", "expiration_date": None, "contract_type": "put", "Strike_Price": 1},
]}}
MESSAGES = [json.dumps(CHAIN), "no json", None, '{"symbol": "B", "data": {"results": []}}', '{"symbol": "C"}', '[1]']


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame([(m,) for m in MESSAGES], "value string")


def test_known_fields_are_those_of_the_plain_reader(spark, messages):
    plain = sorted(map(str, pl.explode_chain(messages.where("value LIKE '{%'")).collect()))
    rows = of.open_chain(messages.where("value LIKE '{%'")).drop("extra")
    assert sorted(map(str, rows.select("symbol", "strike", "expiration", "option_type").collect())) == plain


def test_unseen_fields_survive_storage_and_go_out_again(spark, messages, tmp_path):
    of.open_chain(messages).write.parquet(str(tmp_path / "chain"))
    stored = spark.read.parquet(str(tmp_path / "chain")).where("option_type IS NOT NULL")
    known = {k: x for k, x in of.CONTRACT.items() if k != "expiration"}
    back = [json.loads(r.o) for r in stored.orderBy("option_type").select(F.to_json(of.untyped(known)).alias("o")).collect()]
    wanted = [{k: x for k, x in c.items() if k != "expiration_date"} for c in CHAIN["data"]["results"]]
    assert back == wanted


def test_paths(spark, messages):
    rows = of.open_chain(messages).where("option_type IS NOT NULL").orderBy("option_type")
    got = rows.select(of.at("extra", "$.greeks.delta", "double"), of.at("extra", "$.greeks.seen[1]", "int"), of.at("extra", of._name("odd 'name'"), "boolean"),
                      of.present("extra", "$.greeks"), of.at("extra", "$.strike_price", "string"), of.at("extra", "$.greeks", "int")).collect()
    assert tuple(got[0]) == (0.4, 2, True, True, None, None)
    assert tuple(got[1]) == (None, None, None, False, "n/a", None)


def test_rows_without_contracts_stay_and_news_without_a_feed_do_not(spark, messages):
    assert of.open_chain(messages).count() == 7
    assert of.open_news(messages).count() == 0
    assert of.open_chain(messages.limit(0)).count() == 0
    feed = spark.createDataFrame([('{"feed": [{"id": 7, "headline": "h", "tone": 1.5}, {"headline": "long"}, null]}',)], "value string")
    rows = of.open_news(feed).orderBy(F.col("key").asc_nulls_last()).select("key", of.at("extra", "$.tone", "double").alias("tone")).collect()
    assert [tuple(r) for r in rows] == [("7", 1.5), ("long", None), (None, None)]


def test_census_counts_fields_and_types(spark, messages):
    got = {(r.field, r.kind): r.rows for r in of.census(of.open_chain(messages)).collect()}
    assert got[("Strike_Price", "BIGINT")] == 1 and got[("strike_price", "STRING")] == 1 and got[("odd 'name'", "BOOLEAN")] == 1
    assert sum(n for (f, _), n in got.items() if f == "greeks") == 1 and len(got) == 4


def test_metadata_is_updated_in_place(spark, tmp_path):
    path = str(tmp_path / "table")
    base = spark.sql("SELECT timestamp'2024-01-01' AS ts, id, 1.5D AS score, 'x' AS note FROM range(3)")
    writers.upsert(spark, path, of.as_metadata(base, ["score", "note"]), ["id", "ts"], order=["id"])
    newer = base.where("id = 1").drop("note").withColumn("deep", F.struct(F.array(F.lit(3)).alias("list")))
    writers.upsert(spark, path, of.as_metadata(newer, ["score", "deep"]), ["id", "ts"], order=["id"])
    stored = writers.read_current(spark, path)
    assert [r.id for r in stored.where(of.present("metadata", "$.deep")).collect()] == [1]
    assert stored.agg(F.sum(of.at("metadata", "$.score", "double")), F.max(of.at("metadata", "$.deep.list[0]", "int"))).first()[:] == (4.5, 3)


def test_sent_text_is_the_object_sent(spark, messages):
    rows = of.open_chain(messages).withColumn("expiration", F.col("expiration").cast("string"))
    got = rows.select(F.to_json(of.untyped(of.CONTRACT)).alias("o"), of.untyped_json(of.CONTRACT).alias("t")).collect()
    assert len(got) == 7 and [json.loads(r.t) for r in got] == [json.loads(r.o) for r in got]
    nested = spark.sql("SELECT array(1, 2) AS many, named_struct('a', 1) AS one, CAST(NULL AS MAP<STRING, INT>) AS none, parse_json('{\"x\": null}') AS extra")
    fields = {"many": ("many", "array<int>"), "one": ("One's", "struct<a:int>"), "none": ("none", "map<string,int>")}
    row = nested.select(F.to_json(of.untyped(fields)).alias("o"), of.untyped_json(fields).alias("t")).first()
    assert json.loads(row.t) == json.loads(row.o) == {"many": [1, 2], "One's": {"a": 1}, "x": None}


def test_a_value_is_read_once_and_the_rest_knows_it(spark, messages):
    plan = of.open_chain(messages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("$['strike_price']") == 1 and plan.count("$['expiration_date']") == 1


def test_census_of_a_map_is_that_of_the_object(spark, messages):
    loose = of.census(of.open_chain(messages, as_map=True))
    assert sorted(map(str, loose.collect())) == sorted(map(str, of.census(of.open_chain(messages)).collect())) and loose.count() == 4
    plan = loose._jdf.queryExecution().optimizedPlan().toString()
    assert "to_variant_object" not in plan and plan.count("map_filter(") == 1
