import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # One session runs all tests: room for it, and few finished plans kept.
        .config("spark.driver.memory", "4g")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.ui.retainedJobs", "50")
        .config("spark.ui.retainedStages", "50")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars_pdf():
    """Three symbols of very different length, with gaps in time; one has a single bar."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(7)
    frames = []
    for symbol, n in (("BIG", 900), ("MID", 70), ("ONE", 1)):
        hours = np.sort(rng.choice(n * 3, n, replace=False))
        close = 100 + rng.normal(0, 1, n).cumsum()
        frames.append(pd.DataFrame({
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(hours, unit="h"), "symbol": symbol, "open": close + 0.1,
            "high": close + 1.0, "low": close - 1.0, "close": close, "volume": rng.integers(1, 100, n),
        }))
    return pd.concat(frames, ignore_index=True)


@pytest.fixture(scope="session")
def bars(spark, bars_pdf):
    return spark.createDataFrame(bars_pdf).cache()
