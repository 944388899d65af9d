"""Documents with every case that an operator has to stand: nulls, empty and long texts, ties, repeated rows, a clashing
extra column."""

import random
import string

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 8))) for _ in range(n)]


def odd_documents(spark, more=()):
    rng = random.Random(5)
    long = " ".join(words(rng, 30_000))
    rows = [
        (1, None, None, None, None, None), (2, "", "en", "a", 0, 1.0), (3, " \n\t ", "en", "a", 3, 1.0), (4, "a", None, "a", 1, 0.0),
        (5, long, "en", "b", len(long), 0.0), (6, "same words here again and again", "en", None, 5, 0.0), (7, "same words here again and again", "en", "b", 5, 0.0),
        (7, "same words here again and again", "en", "b", 5, 0.0), (None, "no id at all", "en", "b", 5, 0.0), (8, "ünï cödé 日本語 𝒳 ß 12", "de", "é", 9, 0.0),
        *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def none(df):
    return df.where("false")
