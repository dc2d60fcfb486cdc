"""Every query against its SQL on the smallest tables, and the entry point without the corpus operators."""

import math
import os
import subprocess
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import quern.queries as Q

ROOT = Path(__file__).resolve().parents[1]


def plain(v):
    if isinstance(v, float | Decimal):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 6)
    if isinstance(v, bytes | bytearray):
        return bytes(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(testdata):
    con = duckdb.connect()
    for p in Path(f"{testdata}/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, testdata, duck, name):
    df = Q.QUERIES[name](spark, f"{testdata}/sf0.001")
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in Q.ORACLE_SQL:
        assert rows
        return
    result = duck.execute(Q.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in result.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_corpus_operators(tmp_path):
    subprocess.run(["cp", "-r", "__spark_entry__.py", "quern", str(tmp_path)], cwd=ROOT, check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quern/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for p in ROOT.glob("quern/**/*.py"):
        if "llm" not in p.parts:
            assert "quern.llm" not in p.read_text()
