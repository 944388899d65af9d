import datetime

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import dates, money, text


def column(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    "raw,cents",
    [("$1,234.56", 123456), ("1,000", 100000), ("1.234,56", 123456), ("12,00", 1200), ("3.499", 350), ("11.204", 1120), ("9999999999", None), ("1.234.567,89", None), ("USD 12.00", 1200), ("5.00-", -500), ("", None), ("abc", None), (None, None)],
)
def test_parse_amount(spark, raw, cents):
    assert column(spark, raw, money.parse_cents) == cents


@pytest.mark.parametrize("x,cents", [(float("nan"), 0), (float("inf"), 0), (-5.0, 0), (10.006, 1001), (None, 0), (1_000_001.0, 0)])
def test_safe_amount(spark, x, cents):
    assert column(spark, x, money.safe_cents, "double") == cents


@pytest.mark.parametrize("t,c", [("Total £10.00", "GBP"), ("EUR 5.00", "EUR"), ("nothing", "CAD"), ("C$ 5", "USD")])
def test_currency(spark, t, c):
    assert column(spark, t, lambda x: money.currency(x, "CAD")) == c


@pytest.mark.parametrize("rate,days,cents", [(75.0, 5.0, 37500), (0.1, 3.0, 30), (2_000_000.0, 1.0, 0), (1.0, 400.0, 36600), (1.0, -1.0, 0)])
def test_per_diem(spark, rate, days, cents):
    assert column(spark, rate, lambda x: money.per_diem_cents(F.lit(True), x, F.lit(days)), "double") == cents


@pytest.mark.parametrize(
    "line,day",
    [
        ("@2/01/2823", datetime.date(2023, 2, 1)), ("l2/O2/2@23", datetime.date(2023, 12, 2)), ("B2/08/2023", datetime.date(2023, 2, 8)), ("p2/01/2023", datetime.date(2023, 2, 1)),
        ("12/02/2B23", datetime.date(2023, 12, 2)), ("Datum 14.03.2026", datetime.date(2026, 3, 14)), ("Feburary 3rd, 2024", datetime.date(2024, 2, 3)), ("3 Mar 24", datetime.date(2024, 3, 3)), ("02/30/2024", None), ("", None),
    ],
)
def test_dates(spark, line, day):
    hits = column(spark, line, dates.dates_in)
    assert (hits[0].date if hits else None) == day


def test_folds(spark):
    assert column(spark, "5UBT0TA1", text.label_fold) == "subtotal"
    assert column(spark, "7-ELEUEN", text.glyph_fold) == text.glyphs("7-ELEVEN")
    assert column(spark, 'a "b", c', text.csv_field) == '"a ""b"", c"'
    assert column(spark, 'Sure ```json\n{"a": {"b": 1}}\n``` bye', text.vision_json) == '{"a": {"b": 1}}'
    assert column(spark, "no braces", text.vision_json) is None


@pytest.mark.parametrize("t,c", [("Dinner Club", None), ("Seaside Inn", "Lodging"), ("CAFÉ Rouge", "Meals"), ("price/gal 3", "Fuel")])
def test_category(spark, t, c):
    assert column(spark, t, text.category_by_rules) == c


def test_amounts_of_any_limit(spark):
    assert column(spark, "$1000001.50", lambda x: money.parse_cents(x, limit=money.EXACT)) == 100000150
    assert column(spark, "$" + "9" * 40, lambda x: money.parse_cents(x, limit=money.EXACT)) is None
