"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = ["s12_resample_hourly", "w16_fill_missing", "w18_sequences", "j05_underlying_as_of", "q03_q07_greeks", "q13_var_cvar",
          "q17_max_pain", "v05_outliers_iqr", "a11_ingest_report", "k04_merge_updates", "m04_forecast_one_step", "m10_drift",
          "r08_signals_short", "r11_strategy_legs", "r12_r14_expiry_strategies"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, con, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).fetchdf())


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
