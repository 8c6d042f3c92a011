"""The driver's entry in a process and a session of its own, built without any option of this repository."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
EVERY_QUERY = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[4]").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
assert entry.entry(spark).count() > 0
spark.conf.set("spark.sql.shuffle.partitions", "4")  # only to be quick
failed = {}
for name, query in entry.queries().items():
    try:
        columns = query(spark, sys.argv[1]).columns
        assert columns and len(set(columns)) == len(columns)
    except Exception as e:
        failed[name] = str(e)[:300]
assert not failed, failed
assert set(entry.oracle_sql()) <= set(entry.queries())
print("all queries ran")
"""


def test_every_query_runs_in_a_plain_session(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK", "PYSPARK"))} | {"PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", EVERY_QUERY, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1800)
    assert "all queries ran" in done.stdout, done.stderr[-3000:]
