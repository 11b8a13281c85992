"""All operators where only the driver can import the package: their functions reach the executors by value."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate())
spark.sparkContext.setLogLevel("OFF")


def seen(_):
    import importlib.util
    return [importlib.util.find_spec("barloom") is not None]


assert spark.sparkContext.parallelize([0], 1).mapPartitions(seen).collect() == [False]
from barloom.llm import queries
for name, query in queries.QUERIES.items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
    print(name)
"""


def test_executors_need_no_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, str(ROOT), str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and len(done.stdout.split()) == 13, done.stderr[-3000:]
