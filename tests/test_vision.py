import datetime

from tallyweave.operators.vision import vision_fields

DAY = datetime.date(2026, 3, 14)
REPLIES = {
    "clean": ('{"vendor": "Blue Bottle Coffee", "date": "2026-03-14", "amount": 8.99, "tax": 0.74, "currency": "usd", "category": "Meals"}', ("Blue Bottle Coffee", DAY, 899, 74, "USD", "Meals", 0.92, [], False)),
    "texts": ('{"vendor": "Shell", "date": "03/14/2026", "amount": "$42.10", "tax": "3.20", "category": "NotARealCategory"}', ("Shell", None, 4210, 320, "USD", "Fuel", 0.7, ["no_date:warn", "low_confidence:info"], True)),
    "no total": ('{"vendor": "Corner Store", "date": "2026-03-14", "amount": 0, "currency": "EUR", "category": "Other"}', ("Corner Store", DAY, 0, 0, "EUR", "Other", 0.32, ["no_amount:error", "low_confidence:info"], True)),
    "fenced": ('Sure!\n```json\n{ "vendor": "X", "amount": 1.5 }\n```\nHope that helps.', ("X", None, 150, 0, "USD", "Other", 0.7, ["no_date:warn", "uncategorized:info", "low_confidence:info"], True)),
    "odd types": ('{"vendor": 12, "date": 20260314, "amount": {"x": 1}, "tax": true, "currency": null, "category": ["Meals"]}', ("12", None, 0, 0, "USD", "Other", 0.1, ["no_amount:error", "no_date:warn", "uncategorized:info", "low_confidence:info"], True)),
    "nothing": ("{}", (None, None, 0, 0, "USD", "Other", 0.0, ["no_amount:error", "no_date:warn", "no_vendor:warn", "uncategorized:info", "low_confidence:info"], True)),
    "bad day": ('{"vendor": "Y", "date": "2026-02-30", "amount": -5, "category": "Fuel"}', ("Y", None, 0, 0, "USD", "Fuel", 0.1, ["no_amount:error", "no_date:warn", "low_confidence:info"], True)),
    "large": ('{"vendor": "Y", "date": "2025-01-30", "amount": 1500, "category": "Fuel"}', ("Y", datetime.date(2025, 1, 30), 150000, 0, "USD", "Fuel", 0.92, ["large_amount:info", "stale_date:info"], False)),
    "junk": ("no json here", None), "broken": ("{a", None), "list": ("[1]", None), "empty": ("", None), "null": (None, None), "two": ('{"a": 1} {"b": 2}', None),
}


def test_replies(spark):
    rows = spark.createDataFrame([(k, r) for k, (r, _) in REPLIES.items()], "k string, r string")
    found = {r.k: tuple(r)[1:] for r in vision_fields(rows, "k", "r", "2026-06-01").collect()}
    assert found == {k: e for k, (_, e) in REPLIES.items() if e}
    assert vision_fields(rows.where("false"), "k", "r", "2026-06-01").count() == 0
