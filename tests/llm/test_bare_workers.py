"""Queries whose workers hold no copy of the package: what they need travels with the job."""

import os
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
from pyspark.sql import SparkSession, functions as F
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "2g").getOrCreate())
spark.sparkContext.setLogLevel("OFF")

@F.udf("boolean")
def held(_):
    import importlib.util
    return importlib.util.find_spec("varve") is not None

assert not spark.range(1).select(held("id")).first()[0], "the workers can import the package"
sys.path.insert(0, sys.argv[1])
import __spark_entry__
for name in sys.argv[2:]:
    print(name, __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [["op3_nearest", "op4_pieces", "op5_text_toxicity", "op7_repeated_passages", "op8_simhash_groups"],
                                   ["op11_whitening", "op12_centroids", "op13_isolation"]])
def test_workers_need_no_copy_of_the_package(tmp_path, names):
    script = tmp_path / "run.py"
    script.write_text(SCRIPT)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), REPO, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == names
