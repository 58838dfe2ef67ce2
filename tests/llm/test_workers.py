"""Every query runs where the Python workers have no copy of this package."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
def absent(_):
    import importlib.util
    yield importlib.util.find_spec("vigil") is None
assert spark.sparkContext.range(1, numSlices=1).mapPartitions(absent).collect() == [True]
from vigil.llm import queries
for name, query in queries.QUERIES.items():
    assert query(spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in run.stdout, run.stderr[-3000:]
