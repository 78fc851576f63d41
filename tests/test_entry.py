"""The driver's entry: every query with SQL agrees with it, and everything else works without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not here")


def plain(v):
    return "NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)


def names():
    from siltstone.plans import queries

    return sorted(queries.QUERIES)


@needs_data
@pytest.mark.parametrize("name", names())
def test_query_agrees_with_sql(spark, name):
    import duckdb

    from siltstone.plans import queries

    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in queries.SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.sql(queries.SQL[name])
    assert sorted(r.columns) == columns
    at = [r.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(row[i]) for i in at) for row in r.fetchall())


@needs_data
def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_entry_without_the_optional_parts(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", *gone, "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert 'search_content' in e.queries() and not any(k.startswith('op') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")})
