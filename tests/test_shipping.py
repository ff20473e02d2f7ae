"""Functions that run in Python workers must not need this package there."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import functions as F
from corpuslab.functions.text import remove_accents
from corpuslab.operators.clustering import assign
from corpuslab.session import local_session
spark = local_session("away", 2)
df = spark.createDataFrame([("\\ufb01 x", [1.0])], "t string, v array<double>")
row = assign(df.withColumn("t", remove_accents(F.col("t"))), "v", [[0.0]]).first()
assert row.t == "fi x" and row.distance_sq == 1.0, row
"""


def test_workers_do_not_import_the_package(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
