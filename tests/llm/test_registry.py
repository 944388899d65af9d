"""Queries with SQL give what DuckDB gives on the smallest tables."""

import os

import pytest

from tallyweave.llm.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    expected = c.sql("select " + ", ".join(f'"{x}"' for x in cols) + f" from ({ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == sorted(expected, key=str)


def test_one_query_per_operator():
    assert [n for n in range(1, 14) if any(q.startswith(f"op{n}_") for q in QUERIES)] == list(range(1, 14))
