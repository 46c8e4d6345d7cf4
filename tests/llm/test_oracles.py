"""Queries with SQL against DuckDB, and the entry module with and without the
subpackage."""

import os
import shutil
import subprocess
import sys
import tempfile

import pytest

from citeline.llm.queries import ORACLE, QUERIES
from citeline.oracle_check import _norm_rows, duck

SF = "/root/testdata/sf0.001"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck(SF).sql(ORACLE[name]).df()
    assert _norm_rows(got) == _norm_rows(want)
    assert len(got)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("drop", [(), ("citeline/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_imports(drop):
    copy = tempfile.mkdtemp(prefix="entry-llm-", dir="/tmp")
    shutil.copytree(os.path.join(REPO, "citeline"), os.path.join(copy, "citeline"),
                    ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if "citeline/llm" in drop else [])))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in drop:
            shutil.copy(os.path.join(REPO, name), copy)
    code = "import __spark_entry__ as e; print('pipeline' in e.queries(), 'op4_ngram_join' in e.queries(), len(e.queries()) > 30)"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(not drop), str(not drop), "True"], out.stderr[-2000:]
