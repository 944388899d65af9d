"""Receipt fields from models' loose JSON replies, as VARIANT values: any type may stand for any field.

A reply is parsed once, without its fence and the prose around it; what does not parse, or is no object, gives no row. Numbers count as
amounts as they are, texts as money is read on receipts, anything else as 0. A category that is none of the known ones is guessed
from the vendor. What is missing lowers the confidence, itself and by the flag that tells it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.money import bound, cents, parse_cents
from tallyweave.functions.text import category_by_rules, vision_json
from tallyweave.operators.extract import LARGE_CENTS, REVIEW_BELOW
from tallyweave.operators.identity import alias_hits, best_alias
from tallyweave.sources.dims import CATEGORIES, CURRENCY_CODES
from tallyweave.sources.scratch import written

# Confidence of a whole reply, what missing fields and flags of each severity cost, longest vendor, greatest amount in cents.
WHOLE, NO_AMOUNT, NO_DATE, NO_VENDOR, ERROR, WARN, LONGEST, MOST_CENTS = 0.92, 0.45, 0.15, 0.15, 0.15, 0.07, 80, 100_000_000


def _text(v: Column, field: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, f"$.{field}", "string"), F.lit("")))


def _amount(v: Column, field: str) -> Column:
    """Whole cents from 0 to the greatest amount; 0 where there is none."""
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), cents(F.try_variant_get(v, f"$.{field}", "double")))
    written = F.when(kind == "STRING", parse_cents(F.try_variant_get(v, f"$.{field}", "string")))
    found = F.coalesce(number, written, F.lit(0))
    return bound(found, lambda c: F.when((c > 0) & (c <= MOST_CENTS), c).otherwise(0).cast("long"))


def vision_fields(replies: DataFrame, key: str, reply: str, as_of: str, fallback_currency: str = "USD") -> DataFrame:
    """(key, vendor, day, amount_cents, tax_cents, currency, category, confidence, flags, review) of each reply that holds a JSON object; flags
    as code:severity in the order in which they are told."""
    # The parser stops after the first value, so that more than one is told by a list of them.
    parsed = bound(vision_json(F.col(reply)), lambda j: F.when(F.json_array_length(F.concat(F.lit("["), j, F.lit("]"))) == 1, F.try_parse_json(j)))

    def fields(v: Column) -> Column:
        day = bound(_text(v, "date"), lambda d: F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(d, "yyyy-MM-dd")))
        return F.struct(
            F.substring(_text(v, "vendor"), 1, LONGEST).alias("vendor"), _amount(v, "amount").alias("amount_cents"), _amount(v, "tax").alias("tax_cents"),
            day.alias("day"), F.upper(_text(v, "currency")).alias("code"), _text(v, "category").alias("told"),
        )

    # A reply is parsed in a generator, which filters do not repeat, and its fields are written, as they are used twice.
    objects = F.filter(F.array(parsed), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    t = written(replies.select(F.col(key), F.inline(F.transform(objects, fields))), "fields")
    sure = F.when(F.col("told").isin(*CATEGORIES), F.col("told"))
    # Vendors are looked up for the rest alone, each once.
    unsure = t.where(sure.isNull() & (F.col("vendor") != "")).select("vendor").distinct()
    known = best_alias(alias_hits(unsure, "vendor", "vendor"), "vendor").select("vendor", F.col("category").alias("guess"))
    t = t.join(known, "vendor", "left")
    found = F.coalesce(sure, "guess", category_by_rules(F.col("vendor")))
    now, flag = F.to_date(F.lit(as_of)), lambda condition, code: F.when(condition, code)
    nothing, undated, unnamed = F.col("amount_cents") <= 0, F.col("day").isNull(), F.col("vendor") == ""
    flags = F.array_compact(F.array(
        flag(nothing, "no_amount:error"), flag(undated, "no_date:warn"), flag(unnamed, "no_vendor:warn"), flag(found.isNull(), "uncategorized:info"),
        flag(F.col("amount_cents") > LARGE_CENTS, "large_amount:info"), flag(F.col("day") > F.date_add(now, 1), "future_date:warn"), flag(F.datediff(now, "day") > 120, "stale_date:info"),
    ))
    t = t.withColumn("flags", flags)
    lost = F.when(nothing, NO_AMOUNT).otherwise(0.0) + F.when(undated, NO_DATE).otherwise(0.0) + F.when(unnamed, NO_VENDOR).otherwise(0.0)
    lost = lost + ERROR * F.size(F.filter("flags", lambda f: f.endswith(":error"))) + WARN * F.size(F.filter("flags", lambda f: f.endswith(":warn")))
    t = t.withColumn("confidence", F.round(F.greatest(F.lit(0.0), WHOLE - lost), 9))
    low = F.col("confidence") < REVIEW_BELOW
    return t.select(
        key, F.nullif("vendor", F.lit("")).alias("vendor"), "day", "amount_cents", "tax_cents", F.when(F.col("code").isin(*CURRENCY_CODES), F.col("code")).otherwise(fallback_currency).alias("currency"),
        F.coalesce(found, F.lit("Other")).alias("category"), "confidence", F.when(low, F.array_append("flags", F.lit("low_confidence:info"))).otherwise(F.col("flags")).alias("flags"), (low | nothing).alias("review"),
    )
