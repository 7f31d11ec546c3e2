"""Every registered query against its SQL on the smallest tables."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (bool, str, bytes)):
        return repr(value)
    return f"{float(value):.6f}" if isinstance(value, (int, float)) or hasattr(value, "dtype") else repr(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(normal, r)) for r in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, str(DATA)).toPandas()) == rows(duck.execute(entry.oracle_sql()[name]).df())


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _entry_names(tmp_path, code):
    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "textloom", tmp_path / "textloom", ignore=shutil.ignore_patterns("llm", "__pycache__") if "None" not in code else shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if "None" in code else [])):
        shutil.copy(root / name, tmp_path / name)
    run = subprocess.run([sys.executable, "-c", f"{code}\nimport __spark_entry__ as e\nprint(*e.queries(), *e.oracle_sql())"], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
    return set(run.stdout.split())


@pytest.mark.parametrize("code", ["", "import sys; sys.modules['zstandard'] = None"])
def test_entry_without_the_training_data_operators(tmp_path, code):
    """Without their folders, or one of their libraries, all other queries are still offered."""
    names = _entry_names(tmp_path, code)
    assert "word_search" in names and "pipeline" not in names and not any(n.startswith("op1") for n in names)
