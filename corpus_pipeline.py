"""The corpus pipeline: documents to token files in five stages, each a Parquet table for the next.

Each stage works on all rows its predecessor kept and returns the columns of `documents`, but for the last,
which returns the digest of the token files. Rows with a null doc_id are never taken for one another.
Extra columns are kept, whatever their names, but for names with dots, which Spark's mapInArrow refuses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import decontaminate, jaccard_join, language_id, mixing, token_orc
from tallyweave.llm.common import materialize, scratch, table, word_count

#: Near duplicates: five words, similarity of 0.8 or more.
NEAR = jaccard_join.Jaccard(percent=80, k=5)
#: The column that tells rows of one id apart.
ROW = "_row"


def whole(docs: DataFrame) -> Column:
    """All columns in one, `doc`, so that no name of theirs meets those of a join."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected: no text, no letters, or unlike every language learned."""
    return language_id.keep_accepted(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents keep that with the least id; of rows equal in id and text keep one.

    Rows are told apart by id and a 64-bit hash of their text, so a row goes only for its own text. The small side of
    each join is the one that is hashed, so texts move once and are not sorted."""
    row = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", F.xxhash64("text").alias("h")))
    found = materialize(jaccard_join.classes(docs.select(row.alias(ROW), "text"), NEAR, ROW), "classes")
    rows = docs.select(whole(docs), row.alias(ROW))
    others = found.where(F.col(ROW) != F.col("component_id")).select(ROW).distinct()
    kept = rows.join(others.hint("shuffle_hash"), ROW, "left_anti")
    again = materialize(found.where(F.col(ROW) == F.col("component_id")).groupBy(ROW).count().where("count > 1").select(ROW), "again")
    if again.isEmpty():
        return kept.select("doc.*")
    once = kept.join(again.hint("shuffle_hash"), ROW, "left_semi").select("doc", "doc.doc_id", "doc.text").dropDuplicates(["doc_id", "text"])
    return kept.join(again.hint("shuffle_hash"), ROW, "left_anti").select("doc").unionByName(once.select("doc")).select("doc.*")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources meet their target weights. Rows equal in id, source and text get
    equally many copies."""
    same = ["doc_id", "source", "text_hash"]
    mix = mixing.mix_sizes(mixing.sized(docs), "doc_id").groupBy(*same).agg(F.max("copies").alias("copies")).where("copies > 0")
    mix = mix.select(F.struct(*same).alias("mixed"), "copies")
    rows = docs.select(whole(docs), F.struct("doc_id", "source", F.xxhash64("text").alias("text_hash")).alias("own"))
    taken = rows.join(mix.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("mixed")))
    return taken.select("doc", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the mix into ORC files and return their digest, a row for each copy."""
    return token_orc.token_digest(token_orc.write_tokens(docs, scratch(spark, "tokens"), lean=True))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_passages),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_token_files),
]

#: Language models, fingerprints and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.split()[0])
    return docs
