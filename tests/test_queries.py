import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from gossamer.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table, columns):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(str([plain(r[c]) for c in columns]) for r in table)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert sorted(got.columns) == sorted(want.column_names)
    assert rows([r.asDict(True) for r in got.collect()], sorted(got.columns)) == rows(want.to_pylist(), sorted(got.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert E.entry(spark).count() > 0 and set(E.oracle_sql()) <= set(E.queries())


def test_library_works_without_the_training_data_folders(tmp_path):
    """Both folders and the pipeline are deleted from a copy; the rest imports and its other tests pass."""
    root, copy = Path(E.__file__).parent, tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json", "spark-warehouse"))
    assert not list(copy.rglob("llm"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=copy, env=env).stdout.split()
    assert list(map(int, out)) == [len(QUERIES), len(ORACLES)]
    ran = subprocess.run([sys.executable, "-m", "pytest", "tests/test_columns.py", "tests/test_signals.py", "tests/test_graphs.py", "-q"], capture_output=True, text=True, cwd=copy, env=env)
    assert ran.returncode == 0, ran.stdout[-2000:]
