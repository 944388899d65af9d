"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def normal(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return round(v, 9) if isinstance(v, float) else v.isoformat()[:10] if hasattr(v, "isoformat") else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    sql = entry.oracle_sql()[name]
    assert sorted(duck.sql(sql).columns) == cols
    expected = duck.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({sql})").fetchall()
    assert normal(tuple(r) for r in df.select(*cols).collect()) == normal(expected)


@pytest.mark.parametrize("name", ["work_queue", "page_tilts"])
def test_rows(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["page_tilts"])
def test_tilts_are_those_printed(spark, name):
    """Most lines are found at the angle that their order by vec_id gave them, none at another sign."""
    rows = entry.queries()[name](spark, SF).collect()
    printed = [(r.degrees, r.vec_id % 13 - 6) for r in rows]
    assert sum(abs(found - angle) <= 0.6 for found, angle in printed) >= 0.8 * len(printed)
    assert all(found * angle >= 0 for found, angle in printed)


def test_entry(spark):
    assert entry.entry(spark).count() == 12
