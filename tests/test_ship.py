"""An application that finds the library only on the driver's path."""

import subprocess
import sys
from pathlib import Path

APP = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {tmp!r}).getOrCreate()
from millrace.ship import ship
from millrace.operators.rates import admit
ship(spark)
rows = spark.range(20).select("id", F.lit("u").alias("u"), F.timestamp_seconds("id").alias("ts"))
print("ADMITTED", admit(rows, "u", "ts", "id", 3, 100).where("admitted").count())
spark.stop()
"""


def test_executors_get_the_library(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    (tmp_path / "app.py").write_text(APP.format(repo=repo, tmp=str(tmp_path / "checkpoint")))
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, str(tmp_path / "app.py")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ADMITTED 3" in done.stdout, done.stderr[-2000:]
