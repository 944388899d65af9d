import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")

from tallyweave.llm.common import materialize  # noqa: E402
from tests.llm.helpers import odd_documents, words  # noqa: E402


def test_stages(spark, tmp_path):
    import random

    rng = random.Random(1)
    item = words(rng, 30)
    base = words(rng, 100)
    rows = [(100 + k, " ".join(words(rng, 50)), "en", f"s{k % 3}", 1, 0.0) for k in range(40)]
    rows += [(200, " ".join(base), "en", "s0", 1, 0.0), (201, " ".join([*base[:-1], "zz"]), "en", "s1", 1, 0.0), (202, " ".join(base), "en", "s2", 1, 0.0)]
    rows += [(300, " ".join(words(rng, 20) + item), "en", "s0", 1, 0.0)]
    docs = odd_documents(spark, rows)
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = [f for _, f in pipeline.STAGES]
    a = materialize(stages[0](spark, docs, str(tmp_path)), "a")
    assert a.columns == docs.columns and a.where("text is null or trim(text) = ''").count() == 0
    b = materialize(stages[1](spark, a, str(tmp_path)), "b")
    assert b.columns == docs.columns and b.where("doc_id in (200, 201, 202)").count() == 1 and b.where("doc_id = 7").count() == 0 and b.where("doc_id = 6").count() == a.where("doc_id = 6").count()
    c = materialize(stages[2](spark, b, str(tmp_path)), "c")
    assert c.columns == docs.columns and c.where("doc_id = 300").count() == 0 and c.count() == b.count() - 1
    d = materialize(stages[3](spark, c, str(tmp_path)), "d")
    assert d.columns == docs.columns and d.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    e = stages[4](spark, d, str(tmp_path))
    assert e.count() == d.count() and e.agg(F.max(F.col("start") + F.col("n_tokens"))).first()[0] == e.agg(F.sum("n_tokens")).first()[0]
    assert pipeline.run(spark, str(tmp_path)).count() == e.count()


def test_near_copies_go_by_row(spark):
    """A row stays where another row of its id is a near copy; of linked rows of one id one stays."""
    import random

    rng = random.Random(3)
    base, other = words(rng, 100), words(rng, 100)
    rows = [(1, " ".join(base)), (2, " ".join([*base[:-1], "zz"])), (2, "alone " + " ".join(words(rng, 60)))]
    rows += [(3, " ".join(other)), (3, " ".join([*other[:-1], "yy"])), (4, None), (4, "once"), (4, "once"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(k, x, "en", "s", 1, 0.0) for k, x in rows], odd_documents(spark).schema)
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    left = [(r.doc_id, (r.text or "").split(" ")[0]) for r in kept.collect()]
    assert sorted(left, key=str) == sorted([(1, base[0]), (2, "alone"), (3, other[0]), (4, ""), (4, "once"), (None, "no"), (None, "no")], key=str)


def test_columns_of_any_name_and_empty_tables(spark, tmp_path):
    """Columns named like those that stages make for themselves are kept as they are."""
    import random

    rng = random.Random(6)
    extra = ("i", "s", "n", "copies", "copy", "_row", "doc", "own", "mixed", "component_id", "h", "size", "text_hash", "col", "strip", "place")
    base = words(rng, 60)
    rows = [(k, " ".join(words(rng, 40)), "en", f"s{k % 2}", 1, 0.0) for k in range(30)]
    rows += [(50, " ".join(base), "en", "s0", 1, 0.0), (51, " ".join([*base[:-1], "zz"]), "en", "s0", 1, 0.0), (51, " ".join(base), "en", "s0", 1, 0.0)]
    docs = odd_documents(spark, rows).select("*", *[F.concat(F.lit(f"{c}:"), "doc_id").alias(c) for c in extra])
    spark.createDataFrame([(1, "no such words in any of the texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for _, stage in pipeline.STAGES[:4]:
        now = materialize(stage(spark, now, str(tmp_path)), "named")
        assert now.columns == docs.columns and now.count() > 0
        assert now.where(F.concat(*[F.coalesce(f"`{c}`", F.lit(f"{c}:-")) for c in extra]) != F.concat(*[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in extra])).count() == 0
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
