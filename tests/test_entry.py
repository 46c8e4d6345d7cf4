"""The driver contract, run the way the driver runs it: another working
directory, a plain session, the entry module loaded from its path."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(REPO, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
df = m.entry(spark)
assert df.count() > 0 and df.columns[:2] == ["research_id", "citation_index"]
plain = set(m.QUERIES)
assert plain <= set(m.oracle_sql()) <= set(m.queries())
assert m.queries()["cache_ttl"](spark, "/root/testdata/sf0.001").count() > 0   # pandas task code
print("ENTRY-OK")
"""


def test_entry_from_another_directory():
    cwd = tempfile.mkdtemp(prefix="entry-", dir="/tmp")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ENTRY-OK" in out.stdout, out.stderr[-3000:]
