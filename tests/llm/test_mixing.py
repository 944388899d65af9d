import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.llm import mixing as op
from tests.llm.helpers import none, odd_documents


def fill(sizes, weights=(1, 2, 3), cap=3.0):
    """Targets by sharing, capping and sharing the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        share = left / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > cap * sizes[s] + 1e-9}
        if not over:
            target |= {s: share * w[s] for s in open_}
            break
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def many(spark, n=900):
    source = F.when(F.col("id") % 3 == 0, "src0").when(F.col("id") % 7 == 0, None).when(F.col("id") % 101 == 0, "tiny").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string")))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") * 37 % 300).cast("int")).alias("text"), source.alias("source"), F.lit(1.0).alias("rate"))


def test_targets_and_rounding(spark):
    rows = op.mix_sizes(op.sized(many(spark)), "doc_id").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    expected = fill(sizes)
    assert len(rows) == 900
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, expected[r.source], rel_tol=1e-9, abs_tol=1e-6) and 0 <= r.copies <= 3
    for s, t in expected.items():
        taken = sum(r.copies * r.size for r in rows if r.source == s)
        assert abs(taken - t) <= max(0.001 * t, min(r["size"] for r in rows if r.source == s and r["size"]), 0.5)
    again = op.mix_sizes(op.sized(many(spark).repartition(7)), "doc_id").collect()
    assert {(r.doc_id, r.copies) for r in rows} == {(r.doc_id, r.copies) for r in again}


def test_few_large_documents_come_near(spark):
    """Sources whose words lie mostly in a few documents, ids repeated or null, are as near as any subset of copies can be, about."""
    rng = random.Random(4)
    rows = [(rng.choice((None, 7, k)), " ".join(["w"] * (rng.randint(1500, 3500) if k % 17 == 0 else rng.randint(1, 120)) + [str(k)]), f"s{k % 4}") for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = op.mix_sizes(op.sized(docs), "doc_id").collect()
    assert len(out) == 240
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= max(0.001 * mine[0].target, 1)
        assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) for r in mine)


def test_base_rates_meet_targets(spark):
    rows = op.sized(many(spark), base=F.when(F.col("doc_id") % 2 == 0, 0.4).otherwise(1.3))
    out = op.mix_sizes(rows, "doc_id").groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("mass"), F.first("target").alias("t"), F.first("source_size").alias("n")).collect()
    for r in out:
        assert r.mass == pytest.approx(r.t, rel=1e-6)


def test_overlapping_targets_are_solved_jointly(spark):
    """Targets by source and by language at once, against raking (scaling rows and columns in turn)."""
    rng = random.Random(2)
    sources, langs = ["a", "b", None, "c"], ["en", "de", None]
    rows = [(k, rng.choice(sources), rng.choice(langs), rng.randint(1, 400)) for k in range(600)]
    cells = {}
    for _, s, x, n in rows:
        cells[s, x] = cells.get((s, x), 0) + n
    tilted = {c: n * (1.3 if c[0] == "a" else 0.7) * (1.2 if c[1] == "en" else 0.9) for c, n in cells.items()}
    by_source = {s: sum(n for c, n in tilted.items() if c[0] == s) for s in sources}
    by_lang = {x: sum(n for c, n in tilted.items() if c[1] == x) for x in langs}
    raked = {c: float(n) for c, n in cells.items()}
    for _ in range(500):
        for place, goal in ((0, by_source), (1, by_lang)):
            now = {v: sum(n for c, n in raked.items() if c[place] == v) for v in goal}
            raked = {c: n * goal[c[place]] / now[c[place]] for c, n in raked.items()}
    targets = spark.createDataFrame([("source", s, t) for s, t in by_source.items()] + [("lang", x, t) for x, t in by_lang.items()], "column string, value string, target double")
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, size long").withColumn("base", F.lit(1.0))
    found = op.joint_rates(docs, ["source", "lang"], targets, cap=50).groupBy("source", "lang").agg(F.sum(F.col("rate") * F.col("size")).alias("mass")).collect()
    assert {(r.source, r.lang) for r in found} == set(cells)
    for r in found:
        assert r.mass == pytest.approx(raked[r.source, r.lang], rel=1e-6)


def test_targets_that_contradict_are_told(spark):
    docs = spark.createDataFrame([(1, "a", "en", 10), (2, "b", "de", 10)], "doc_id long, source string, lang string, size long").withColumn("base", F.lit(1.0))
    targets = spark.createDataFrame([("source", "a", 5.0), ("lang", "en", 15.0)], "column string, value string, target double")
    with pytest.warns(UserWarning, match="from their targets"):
        op.joint_rates(docs, ["source", "lang"], targets)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = op.mix_sizes(op.sized(docs), "doc_id").collect()
    assert len(rows) == docs.count() and all(r.copies == 0 for r in rows if r["size"] == 0)
    assert op.mix_sizes(op.sized(none(docs)), "doc_id").count() == 0
    empty = docs.withColumn("text", F.lit(""))
    assert {r.copies for r in op.mix_sizes(op.sized(empty), "doc_id").collect()} == {0}
