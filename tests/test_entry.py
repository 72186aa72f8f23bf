"""The entry points, with the corpus operators and without them."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
USE = """
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0 and not any(n.startswith("op") or n == "pipeline" for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())
"""


@pytest.mark.parametrize("left_out", [("tapeweave/llm", "tests/llm"), ("tapeweave/llm", "tests/llm", "corpus_pipeline.py")])
def test_market_queries_do_without_the_corpus_operators(tmp_path, left_out):
    skip = shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda folder, names: skip(folder, names) | {n for n in names if str((Path(folder) / n).relative_to(ROOT)) in left_out})
    subprocess.run([sys.executable, "-c", USE], cwd=tmp_path / "copy", check=True, timeout=300)
