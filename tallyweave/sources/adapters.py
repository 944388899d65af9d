"""Expense tables made from the sales tables: the same columns as the SQL in plans/oracles.py gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions.money import cents
from tallyweave.sources.dims import CATEGORIES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One receipt per order: id, batch_id, vendor, day, amount_cents, tax_cents, category, status, review_required,
    approved, currency, confidence, created_at. Nations and regions are fixed lists; customers are joined as Spark sees fit."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation")
    key = F.col("o_orderkey")
    amount = cents(F.col("o_totalprice") / 100)
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
    return rows.select(
        key.alias("id"),
        F.col("o_custkey").alias("batch_id"),
        F.when(key % 13 != 0, F.concat(F.when(key % 2 == 0, F.upper("n_name")).otherwise(F.col("n_name")), F.lit(" "))).alias("vendor"),
        F.when(key % 17 != 0, F.to_date("o_orderdate")).alias("day"),
        F.when(key % 29 == 0, 0).otherwise(amount).cast("long").alias("amount_cents"),
        F.floor(amount / 20).cast("long").alias("tax_cents"),
        F.element_at(F.array(*[F.lit(x) for x in CATEGORIES]), (key % 12 + 1).cast("int")).alias("category"),
        F.when(key % 19 == 0, "failed").when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("processing").alias("status"),
        (key % 3 == 0).alias("review_required"),
        (key % 9 == 0).alias("approved"),
        F.element_at(F.array(*[F.lit(x) for x in ("USD", "EUR", "GBP", "JPY", "CAD")]), F.col("n_regionkey") + 1).alias("currency"),
        (key % 101 / 100.0).alias("confidence"),
        key.alias("created_at"),
    )


def exportable(rows: DataFrame) -> DataFrame:
    """What reports contain: receipts that did not fail and have an amount."""
    return rows.where((F.col("status") != "failed") & (F.col("amount_cents") > 0))
