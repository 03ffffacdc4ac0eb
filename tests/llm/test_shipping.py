"""The operators run where workers find the package only by what the operators ship."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import corpus_pipeline
from loam.llm import _common, langid, queries
name = "spark.sql.execution.arrow.maxRecordsPerBatch"
before = spark.conf.get(name)
run = {{**queries.queries(), "pipeline": corpus_pipeline.run}}[sys.argv[1]]
assert run(spark, "/root/testdata/sf0.001").count() > 0
_common.restore(spark)
assert spark.conf.get(name) == before
shared = _common.shared_dir(spark).removeprefix("file://")
top = f"{{shared}}/loam/{{spark.sparkContext.applicationId}}"
print("left", top)
"""


def test_runs_without_pythonpath(tmp_path):
    """The pipeline and the scorers, and no intermediate table is left when the driver ends."""
    for name in ("pipeline", "op9_language_id", "op10_lm_score"):
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-B", "-c", CODE.format(repo=REPO), name], cwd=tmp_path, env=env, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr[-3000:]
        top = next(line for line in done.stdout.splitlines() if line.startswith("left ")).split(" ", 1)[1]
        assert not os.path.exists(top)
