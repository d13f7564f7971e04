"""Registered queries against their SQL on DuckDB."""

from pathlib import Path

import duckdb
import pytest

from prefixloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    got = sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())
    cur = con.execute(queries.SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in cur.fetchall())


def test_one_query_an_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
