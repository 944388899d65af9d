"""Amounts: rounding, guards, parsing and printing. Money inside the engine is whole cents (bigint)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.sources.dims import CURRENCY_CODES, CURRENCY_SYMBOLS

LIMIT = 1_000_000
#: The greatest amount whose cents a double holds one by one.
EXACT = 90_071_992_547_409


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cents(x: Column) -> Column:
    """Whole cents of a double, halves up on the binary product."""
    return F.floor(x * 100 + 0.5).cast("long")


def units(c: Column) -> Column:
    return c / F.lit(100.0)


def safe_cents(x: Column) -> Column:
    """Cents of an amount; 0 if it is missing, not finite, negative or over the limit."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x > LIMIT), 0).otherwise(cents(x)).cast("long")


def parse_cents(raw: Column, *, limit: int = LIMIT) -> Column:
    """Cents of a printed amount in US or European style, or null; an amount over the limit is none."""
    kept = F.regexp_replace(raw, r"[^0-9.,\-]", "")

    def read(kept: Column) -> Column:
        signed = lambda v: F.when(F.contains(kept, F.lit("-")), -v).otherwise(v)
        return bound(F.replace(kept, F.lit("-"), F.lit("")), lambda s: bound(_number(s), lambda v: F.when(s.rlike("[0-9]") & (F.abs(v) <= limit), cents(signed(v)))))

    return bound(kept, read)


def _number(s: Column) -> Column:
    """The double that digits, commas and points stand for, or null."""
    commas, dots = (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit(""))) for c in ",.")
    last = lambda c: F.length(s) - F.locate(c, F.reverse(s))
    no_comma, no_dot = F.replace(s, F.lit(","), F.lit("")), F.replace(s, F.lit("."), F.lit(""))
    decimal_comma = F.regexp_replace(F.regexp_replace(no_dot, ",", "."), r"^([^.]*\.[^.]*)\..*$", "$1")
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(last(",") > last("."), decimal_comma).otherwise(F.regexp_replace(no_comma, r"^([^.]*\.[^.]*)\..*$", "$1")))
        .when(commas > 0, F.when(s.rlike(r"^[0-9]+,[0-9]{1,2}$"), F.replace(s, F.lit(","), F.lit("."))).otherwise(no_comma))
        .when(dots > 1, no_dot)
        .otherwise(s)
    )
    return F.expr("0D") + plain.try_cast("double")


def currency(text: Column, fallback: str = "USD") -> Column:
    """A code printed as a word, else the first listed symbol that occurs, else the fallback."""
    code = F.regexp_extract(text, rf"\b({'|'.join(CURRENCY_CODES)})\b", 1)
    found = F.when(code != "", code)
    for symbol, name in CURRENCY_SYMBOLS:
        found = found.when(F.contains(text, F.lit(symbol)), name)
    return F.coalesce(found.otherwise(fallback), F.lit(fallback))


def money_text(c: Column, sign: str = "$") -> Column:
    """$1,234.50."""
    return F.concat(F.lit(sign), F.format_number((c / F.lit(100)).cast("decimal(20,2)"), 2))


def fixed_text(c: Column) -> Column:
    """1234.50."""
    return (c.cast("decimal(20,0)") / 100).cast("decimal(20,2)").cast("string")


def short_label(c: Column) -> Column:
    """$1.2k from a thousand on, else whole dollars."""
    dollars = c / F.lit(100.0)
    return F.when(c >= 100_000, F.concat(F.lit("$"), (F.floor(dollars / 100 + 0.5) / 10).cast("decimal(20,1)").cast("string"), F.lit("k"))).otherwise(F.concat(F.lit("$"), F.floor(dollars + 0.5).cast("long").cast("string")))


def per_diem_cents(enabled: Column, rate: Column, days: Column) -> Column:
    """Rate times days, days clamped to a leap year; 0 unless enabled."""
    d = F.when(days.isNull() | F.isnan(days) | (days <= 0), 0.0).otherwise(F.least(F.lit(366.0), F.floor(days * 100 + 0.5) / 100))
    return F.when(F.coalesce(enabled, F.lit(False)), safe_cents(cents(safe_cents(rate) / F.lit(100.0) * d) / F.lit(100.0))).otherwise(0).cast("long")


MONTH = r"^[0-9]{4}-(0[1-9]|1[0-2])$"
PHONE_CENTS = 6300


def months_of(months: Column) -> Column:
    """Valid, distinct, sorted YYYY-MM."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(months, F.array().cast("array<string>")), lambda m: m.rlike(MONTH))))


def phone_cents(enabled: Column, months: Column) -> Column:
    return F.when(F.coalesce(enabled, F.lit(False)), F.size(months_of(months)) * PHONE_CENTS).otherwise(0).cast("long")


def price_tokens(inputs: Column, outputs: Column, in_rate: Column, out_rate: Column) -> Column:
    """Cost of a model call from tokens and prices per million; unknown prices cost nothing."""
    return F.coalesce(inputs * in_rate / 1e6 + outputs * out_rate / 1e6, F.lit(0.0))
