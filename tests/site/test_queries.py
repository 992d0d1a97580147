"""Registered queries against their DuckDB twins on the driver's smallest tables, and the entry point without the text operators."""

import math
import os
import shutil
import subprocess
import sys

import pandas as pd
import pytest

duckdb = pytest.importorskip("duckdb")
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

from sitescan.plans.queries import ORACLES, QUERIES  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 6) + 0.0 if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iufb" else str(x)

    return sorted(map(repr, (tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, name):
    assert canonical(QUERIES[name](spark, SF).toPandas()) == canonical(duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_rest_imports_without_text_operators(tmp_path):
    to = tmp_path / "r"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=to, env=os.environ | {"PYTHONPATH": str(to)}, capture_output=True, text=True, timeout=120)
    assert got.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], got.stderr
