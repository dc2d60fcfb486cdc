"""The operators that SQL can express against DuckDB, odd rows included."""

from pathlib import Path

import duckdb
import pytest

from quern.llm.queries import ORACLE_SQL, QUERIES


def plain(v):
    return round(v, 9) if isinstance(v, float) else v


def same(spark, folder, name):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert rows == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    return len(rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql(spark, testdata, name):
    assert same(spark, f"{testdata}/sf0.001", name) > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_sql_on_odd_rows(spark, tmp_path, name):
    docs = [(i, t, "en", s, n) for i, (t, s, n) in enumerate([("a b c", "x", 5), ("a b c", "x", None), (None, "x", 1), ("", None, 0), ("word " * 4000, "y", 9), ("   ", "y", 3), ("é ü ß", None, 5)])]
    docs += [(None, "a b", "en", "x", 3), (None, "a b", "en", "x", 3), (3, None, None, None, None)]
    pages = [(16 * i if i % 2 else i, u, "") for i, u in enumerate([None, "", "https:///x", "http://a.org/" + "p" * 5000, "http://A.org:80/" + "p" * 5000 + "/", "a.org/?b=1&a=2", "www.a.org/?a=2&b=1", "a.org/?b=1&a=2"])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert same(spark, tmp_path, name) > 0
