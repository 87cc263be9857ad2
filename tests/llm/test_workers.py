"""Every operator where workers have no copy of the package: functions travel by value."""

import os
import subprocess
import sys

from tests.llm.test_edges import edges  # noqa: F401

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession
sys.path.insert(0, {repo!r})
import corpus_pipeline
from quarry.llm import queries
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).getOrCreate()
def probe(batches):
    import importlib.util, pandas as pd
    for b in batches:
        yield pd.DataFrame({{"found": [importlib.util.find_spec("quarry") is not None] * len(b)}})
import pyspark.cloudpickle
assert not spark.range(1).mapInPandas(probe, "found boolean").first().found
for name, query in {{**queries.QUERIES, "pipeline": corpus_pipeline.run}}.items():
    print(name, query(spark, {folder!r}).count(), flush=True)
print("all ran")
"""


def test_workers_without_the_package(edges, tmp_path):  # noqa: F811
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=REPO, folder=edges, shared=f"file://{tmp_path}/shared")
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in run.stdout, run.stdout[-500:] + run.stderr[-3000:]
