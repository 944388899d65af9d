"""What a receipt needs after it is read: a second reading, a paid model, a person; and what model calls cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.extract import REVIEW_BELOW
from tallyweave.operators.identity import ACCEPT, fuse

# The confidence of the text recognition, 0 to 100, below which a page is read again, and flags that a person must see.
WEAK_BELOW = 65
FORCING = ("total_suspect:warn", "vendor_unclear:warn")
AGREE = 0.5


def forces_review(flags: Column) -> Column:
    """An error, or a warning of those that a person must see; no flags and null flags force none."""
    return F.coalesce(F.exists(flags, lambda f: f.endswith(":error") | f.isin(*FORCING)), F.lit(False))


def unsure(confidence: Column, cents: Column) -> Column:
    """A low confidence or no amount; nulls are both."""
    return (F.coalesce(confidence, F.lit(0.0)) < REVIEW_BELOW) | (F.coalesce(cents, F.lit(0)) <= 0)


def routed(receipts: DataFrame, duplicates: DataFrame, assisted: bool) -> DataFrame:
    """(id, flags, review, assist): whether a person must look, and whether a model is asked before, if there is one.

    receipts: (id, confidence, amount_cents, flags); duplicates: (id, duplicate_of, via) at most once for an id, of which those told by
    details add a flag before all others and any asks for a person. A receipt whose id is null is no duplicate."""
    both = receipts.join(duplicates.select("id", "duplicate_of", "via"), "id", "left")
    none = F.array().cast("array<string>")
    flags = F.concat(F.when(F.col("via") == "details", F.array(F.lit("duplicate:warn"))).otherwise(none), F.coalesce("flags", none))
    low = unsure(F.col("confidence"), F.col("amount_cents"))
    return both.select("id", flags.alias("flags"), (forces_review(F.col("flags")) | F.col("duplicate_of").isNotNull() | low).alias("review"), (low & F.lit(assisted)).alias("assist"))


def weak_read(page_conf: Column, cents: Column, cached: Column) -> Column:
    """Whether a page is read again from a sharpened copy: no text from before, and poorly read or without an amount."""
    return ~F.coalesce(cached, F.lit(False)) & ((F.coalesce(page_conf, F.lit(0.0)) < WEAK_BELOW) | (F.coalesce(cents, F.lit(0)) <= 0))


def rescued(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of first, those of weak reads replaced by their second reading where that is safer: it has an amount where there was
    none, or the same amount with a higher confidence. Both: (id, vendor, mils, confidence, page_conf, cached); mils are tenths of
    a cent, so that amounts less than half a cent apart agree. At most one second reading for an id; one more column, `swapped`."""
    a, b = first.alias("a"), second.alias("b")
    had, has = F.coalesce("a.mils", F.lit(0)) > 0, F.coalesce("b.mils", F.lit(0)) > 0
    agree = F.abs(F.coalesce("a.mils", F.lit(0)) - F.coalesce("b.mils", F.lit(0))) < 5
    safer = (has & ~had) | (agree & (F.coalesce("b.confidence", F.lit(0.0)) > F.coalesce("a.confidence", F.lit(0.0))))
    swap = F.col("b.id").isNotNull() & weak_read(F.col("a.page_conf"), F.col("a.mils"), F.col("a.cached")) & safer
    take = [F.when(swap, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in ("vendor", "mils", "confidence", "page_conf")]
    return a.join(b, F.col("a.id") == F.col("b.id"), "left").select("a.id", *take, swap.alias("swapped"))


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with `cost`: their tokens (tokens_in, tokens_out; null: 0) by the model's price of a million tokens; unknown models cost nothing.
    prices: (model, price_in, price_out), one row for a model, joined as Spark sees fit."""
    rate = lambda tokens, price: F.coalesce(F.col(tokens), F.lit(0)) / F.lit(1e6) * F.coalesce(F.col(price), F.lit(0.0))
    cost = rate("tokens_in", "price_in") + rate("tokens_out", "price_out")
    return calls.join(prices, "model", "left").withColumn("cost", cost).drop("price_in", "price_out")


def identified(rows: DataFrame, ratio: Column) -> DataFrame:
    """rows (vendor, vendor_conf, text_name, text_via, logo, score) with their fused identity (name, confidence, source, mismatch); ratio tells how
    much alike vendor and logo are."""
    fused = fuse(F.col("vendor"), F.col("vendor_conf"), F.col("text_name"), F.col("text_via"), F.col("logo"), F.col("score"), ratio >= AGREE, ACCEPT)
    return rows.withColumn("fused", fused)
