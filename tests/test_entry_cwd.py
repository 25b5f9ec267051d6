"""The driver loads the entry file by path from its own working directory:
queries with Python tasks must still find the package on the executors."""

import os
import subprocess
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(ROOT, '__spark_entry__.py')!r})
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4") \\
    .config("spark.ui.enabled", "false").getOrCreate()
print("ROWS", m.queries()["archive_entries"](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_entry_loaded_by_path_from_elsewhere():
    cwd = tempfile.mkdtemp(prefix="tallyfs-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]


HIDDEN = f"""
import importlib.util, sys, warnings
warnings.simplefilter("ignore")
sys.path.insert(0, {ROOT!r})
sys.modules[sys.argv[1]] = None   # importing it raises ImportError
import __spark_entry__ as m
from tallyfs.plans.catalog import QUERIES
assert set(QUERIES) <= set(m.queries()) and set(m.oracle_sql()) <= set(m.queries())
print("EXTRA", len(set(m.queries()) - set(QUERIES)), len(QUERIES))
"""


@pytest.mark.parametrize("missing", ["sentencepiece", "xxhash", "zstandard", "tallyfs.llm", "corpus_pipeline"])
def test_base_queries_stay_when_an_optional_module_is_missing(missing):
    out = subprocess.run([sys.executable, "-c", HIDDEN, missing], cwd=tempfile.mkdtemp(prefix="tallyfs-cwd-"),
                         capture_output=True, text=True, timeout=300)
    assert out.stdout.startswith("EXTRA 0 "), out.stderr[-2000:]
