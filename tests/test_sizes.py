"""Queries on tables with greater keys than the smallest tables have."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_queries import SF, normal, pytestmark  # noqa: F401


@pytest.mark.parametrize("name,table,key", [("vision_replies", "orders", "o_orderkey"), ("word_amounts", "lineitem", "l_orderkey")])
def test_great_keys(spark, tmp_path, name, table, key):
    """Amounts that are made of keys go beyond the limit of printed ones."""
    spark.read.parquet(f"{SF}/{table}.parquet").limit(200).withColumn(key, F.col(key) + 1_000_000).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    df, c = entry.queries()[name](spark, str(tmp_path)), duckdb.connect()
    c.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    expected = c.sql("select " + ", ".join(f'"{x}"' for x in df.columns) + f" from ({entry.oracle_sql()[name]})").fetchall()
    assert normal(tuple(r) for r in df.collect()) == normal(expected)


@pytest.mark.parametrize("name", ["locate_values", "locate_amounts"])
def test_nothing_is_broadcast(spark, name):
    """Printed lines are more than the files tell from which their size is guessed."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") == 1 and plan.count("Exchange hashpartitioning(o_orderkey") == 2


def test_maps_in_bounded_parts(spark):
    """A batch of many maps reaches the kernel in parts of bounded size, and each map's row is that of the map alone."""
    from tallyweave.operators import images

    t = spark.range(300).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(8191)), lambda i: F.when(i == F.col("id"), 1.0).otherwise(0.0)).alias("v"), F.lit(64).alias("w"))
    odd = spark.createDataFrame([(1000, None, 1), (1001, [1.0, None], 2), (1002, [1.0, 2.0, 3.0], 2), (1003, [], 1), (1004, [5.0], 1), (1005, [5.0], 0)], "k long, v array<double>, w int")
    found = images.on_maps(t.unionByName(odd).coalesce(1), "k", "v", "w", lambda m: [(int(x.argmax()), len(m)) for x in m], "at int, n int").collect()
    assert {r.k: r.at for r in found} == {**{k: k for k in range(300)}, 1004: 0}
    assert max(r.n for r in found) <= 129


@pytest.mark.parametrize("name", ["extract_roundtrip"])
def test_receipts_are_printed_once(spark, name):
    """What comes after the gathering, vendors too, reads what was written; no line is printed, matched or read again."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "o_orderkey" not in plan


def test_days_that_there_are(spark):
    from tallyweave.functions.dates import dates_in

    texts = ["2024-02-29", "2023-02-29", "2100-02-29", "2000-02-29", "2024-04-31", "31 Dec 2024", "13/31/2024", "0 Jan 2024", "no date 12.50", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", dates_in(F.col("t")).alias("d")).orderBy("k").collect()
    days = [None if r.d is None else [h.date.isoformat() for h in r.d] for r in rows]
    assert days == [["2024-02-29"], [], [], ["2000-02-29"], [], ["2024-12-31"], [], [], [], [], None]


@pytest.mark.parametrize("name", ["vision_fields"])
def test_replies_are_parsed_once(spark, name):
    """Filters and the look-up of vendors read fields that were written; no reply is cut out or parsed again."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "```" not in plan and "parse" not in plan.lower()


def test_near_spellings_by_letters(spark):
    """Which letters there are rules pairs out before edits are counted, and loses none; candidates are not shuffled."""
    import random

    from tallyweave.functions.text import full_fold
    from tallyweave.operators import identity

    rng, known = random.Random(8), identity.fuzzy_aliases(spark)
    folded = [(r.folded, r.name, r.category) for r in known.collect()]
    texts = [None, "", "ab"]
    for alias, *_ in folded:
        w = list(alias)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.sample("abcdefghijklmnopqrstuvwxyz2346", rng.randint(0, 1))
        texts.append("".join(w))
    lines = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    cands = {r.k: r.c for r in lines.select("k", full_fold(F.col("t")).alias("c")).collect() if r.c and len(r.c) >= 5}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
        return row[-1]

    expected = {}
    for k, c in cands.items():
        met = [(edits(c, f), -len(f), n, g) for f, n, g in folded if abs(len(f) - len(c)) <= 2]
        if met := [m for m in met if m[0] <= (1 if -m[1] <= 6 else 2)]:
            expected[k] = min(met)[2:]
    df = identity.fuzzy_lines(lines, "k", "t", known)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {r.k: (r.name, r.category) for r in df.collect()} == expected and len(expected) > 100
