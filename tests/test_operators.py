import datetime
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.operators import extract, identity, merge, similar

AS_OF = "2026-06-01"
RECEIPTS = {
    "restaurant": (["Joe's Diner", "2026-03-14", "Subtotal 8.25", "Tax 0.74", "TOTAL 8.99"], {"amount_cents": 899, "tax_cents": 74, "day": datetime.date(2026, 3, 14), "category": "Meals"}),
    "grand": (["Corner Store", "Subtotal 100.00", "Tax 8.00", "GRAND TOTAL 108.00"], {"amount_cents": 10800}),
    "european": (["Laden GmbH", "Datum 14.03.2026", "Summe 19,90 EUR"], {"amount_cents": 1990, "currency": "EUR", "day": datetime.date(2026, 3, 14)}),
    "cash": (["Corner Store", "TOTAL 42.00", "CASH 50.00", "CHANGE 8.00"], {"amount_cents": 4200}),
    "quantity": (["Shell", "GALLONS 11.204", "PRICE/GAL 3.499", "TOTAL 39.20"], {"amount_cents": 3920, "category": "Fuel", "vendor": "Shell"}),
    "pump": (["Mobil", "GALLONS 15.582", "PRICE/GAL 4.699", "FUEL SALE 73.22"], {"amount_cents": 7322}),
    "garbled": (["Mobil", "GALLONS 6.927", "PRICE/GAL 4.599", "FUEL SALE $3188.00"], {"amount_cents": 3186}),
    "footing": (["The Home Depot", "SUBTOTAL 229.85", "SALES TAX 18.96", "TOTAL $2,819.28", "VISA 248.81"], {"amount_cents": 24881, "vendor": "The Home Depot", "category": "Materials"}),
    "grocery": (["Green Market", "MILK 1 GAL 4.99", "SUBTOTAL 82.10", "TAX 5.13", "TOTAL 87.23"], {"amount_cents": 8723}),
    "tip": (["Joe's Diner", "SUBTOTAL 50.00", "TAX 4.00", "TIP 10.00", "TOTAL 64.00"], {"amount_cents": 6400}),
    "tip_window": (["Joe's Diner", "SUBTOTAL 20.00", "TIP 25.00", "TOTAL 45.00"], {"amount_cents": 4500, "review": True}),
    "label_only": (["Corner Store", "Coffee beans 4.50", "TOTAL", "05/01/2026"], {"amount_cents": 450}),
    "fuzzy": (["MOBTL", "TOTAL 10.00"], {"vendor": "Mobil"}),
    "fuzzy_two": (["FARMER 80YS", "TOTAL 10.00"], {"vendor": "Farmer Boys"}),
    "misread": (["AMERXICAN AIRXLINESX", "TOTAL 10.00"], {"vendor": "American Airlines"}),
    "nothing": (["???"], {"amount_cents": 0, "vendor": None, "review": True, "category": "Other"}),
}


def test_receipts(spark):
    lines = spark.createDataFrame([(k, i, t, 90.0) for k, (ts, _) in RECEIPTS.items() for i, t in enumerate(ts)], "receipt string, line_no int, text string, ocr_conf double")
    found = {r.receipt: r for r in extract.extract(lines, AS_OF).collect()}
    assert set(found) == set(RECEIPTS)
    for k, (_, expected) in RECEIPTS.items():
        assert {c: found[k][c] for c in expected} == expected, (k, found[k])
    assert "no_amount:error" in found["nothing"].flags and "total_mismatch:info" in found["garbled"].flags


@pytest.mark.parametrize(
    "t,name",
    [("HOME DEPOT #12", "The Home Depot"), ("AMAZON WEB SERVICES invoice, AMAZON", "Amazon Web Services"), ("SUBPRIME", None), ("$45.76", None), ("GROUPS", None), ("7-ELEUEN", "7-Eleven"), ("how doers get more done", "The Home Depot")],
)
def test_vendors(spark, t, name):
    rows = identity.match_vendors(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t").collect()
    assert [r.name for r in rows] == ([name] if name else [])


def fold(spark, edits):
    log = spark.createDataFrame([("u", k, *e) for k, e in enumerate(edits)], "user string, seq long, receipt string, field string, old string, new string")
    return [(r.receipt, r.field, r.old, r.new) for r in merge.folded_log(log).orderBy("seq").collect()]


def test_edit_log(spark):
    dates = ["", "0002-09-11", "0020-09-11", "2024-09-11"]
    assert fold(spark, [("r", "date", a, b) for a, b in zip(dates, dates[1:])]) == [("r", "date", "", "2024-09-11")]
    assert fold(spark, [("r", "date", "a", "b"), ("r", "date", "b", "a")]) == []
    assert fold(spark, [("r", "x", "a", "b"), ("q", "x", "a", "b"), ("r", "x", "b", "c")]) == [("r", "x", "a", "b"), ("q", "x", "a", "b"), ("r", "x", "b", "c")]


def test_edit_logs_are_streamed(spark):
    """Logs of many batches fold as by one stack per user, with nulls; no plan gathers a user's log into an array."""
    rng = random.Random(4)
    pick = lambda: rng.choice(("a", "b", None))
    rows = [(rng.choice(("u", "v", None)), k, rng.choice("rq"), "x", pick(), pick()) for k in range(9000)] + [("w", k, "r", "x", str(k), str(-k - 1)) for k in range(12_000)]
    expected = {}
    for u, *e in rows:
        left = expected.setdefault(u, [])
        last = left[-1] if left else None
        if last and None not in (last[4], e[3]) and (last[1], last[2], last[4]) == (e[1], e[2], e[3]):
            left.pop()
            if last[3] is None or last[3] != e[4]:
                left.append((*e[:3], last[3], e[4]))
        else:
            left.append(tuple(e))
    log = spark.createDataFrame(rows, "user string, seq long, receipt string, field string, old string, new string").repartition(7)
    folded = merge.folded_log(log)
    assert sorted(map(tuple, folded.collect()), key=str) == sorted(((u, *e) for u, left in expected.items() for e in left[-2000:]), key=str)
    assert "collect_list" not in folded._jdf.queryExecution().toString()
    assert merge.folded_log(log.where("false")).count() == 0


def test_month_runs(spark):
    rows = spark.createDataFrame([(1, ["2026-01", "2026-03", "2026-02", "2026-05", "junk", "2026-05"]), (2, ["2025-12", "2026-01"])], "k int, m array<string>")
    assert {r.k: r.months for r in merge.month_runs(rows, "k", "m").collect()} == {1: "Jan–Mar 2026, May 2026", 2: "Dec 2025–Jan 2026"}


def test_last_write_wins(spark):
    a = spark.createDataFrame([(1, "a", 5), (2, "a", 5)], "id int, v string, t int")
    b = spark.createDataFrame([(1, "b", 5), (2, "b", 6), (3, "b", 1)], "id int, v string, t int")
    assert {(r.id, r.v, r.from_remote) for r in merge.last_write_wins(a, b, "id", "t").collect()} == {(1, "a", False), (2, "b", True), (3, "b", True)}


def test_lcs():
    assert identity.lcs_ratio("abcd", "abxd") == 0.75 and identity.lcs_ratio("", "a") == 0 and identity.lcs_ratio("same", "same") == 1


def test_duplicates_keep_the_first(spark):
    rows = spark.createDataFrame([(3, 1, "k"), (1, 2, "k"), (2, 1, "k"), (4, 1, None)], "id int, created_at int, key string")
    assert {(r.id, r.duplicate_of) for r in merge.duplicates(rows, ["key"]).collect()} == {(3, 2), (1, 2)}
    assert rows.where(F.col("key").isNull()).count() == 1


def test_all_brands_are_compared(spark):
    """However many cells the brands are in, the result is that of one cell."""
    rng = random.Random(6)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(4)]
    brands = spark.createDataFrame([(b, vector()) for b in range(30)], "brand long, v array<float>")
    queries = spark.createDataFrame([(q, vector()) for q in range(100, 120)], "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, similar.nearest(queries, brands, 3, pivots=1).collect()))
    assert len(whole) == 60 and sorted(map(tuple, similar.nearest(queries, brands, 3, pivots=7).collect())) == whole


def test_likely_duplicates(spark):
    """The image decides first; details only where no image is the same; no key without an amount."""
    kind = "id long, batch_id long, image_hash string, vendor string, day date, amount_cents long, created_at long"
    d = datetime.date(2026, 1, 2)
    rows = [(1, 1, "a", "Shell", d, 100, 1), (2, 1, "a", "Other", d, 7, 2), (3, 1, "b", " SHELL ", d, 100, 3), (4, 1, "c", "Shell", d, 0, 4), (5, 1, "d", "Shell", d, 0, 5), (6, 2, "a", "Shell", d, 100, 6), (7, 1, None, None, None, 100, 7), (8, 1, None, "", None, 100, 8), (9, 1, "e", "Shell", d, 101, 9)]
    found = {r.id: (r.duplicate_of, r.via) for r in merge.likely_duplicates(spark.createDataFrame(rows, kind)).collect()}
    assert found == {2: (1, "image"), 3: (1, "details"), 8: (7, "details")}


def test_saved_jobs(spark):
    jobs = spark.createDataFrame([("North  Yard", "1", 1), ("South", "2", 2), ("", "", 3), (None, None, 4)], "name string, number string, saved_at long")
    changes = spark.createDataFrame([(" north yard ", "9", 10, False), ("SOUTH", None, 11, True), ("East", "", 12, False), ("Gone", "5", 13, False), ("gone", "", 14, True)], "name string, number string, saved_at long, removed boolean")
    kept = merge.saved_jobs(jobs, changes)
    assert sorted(map(tuple, kept.collect())) == [("East", "", 12), ("north yard", "9", 10)]
    typed = spark.createDataFrame([(1, " 9"), (2, ""), (3, None), (4, "2")], "k int, t string")
    assert {r.k: r.name for r in merge.look_up(typed, "t", kept, "number", "name").collect()} == {1: "north yard", 2: None, 3: None, 4: None}


def test_located_values(spark):
    """Half a cent off still counts, payments come last, a first word of three letters stands for a name, nulls and nothing find nothing."""
    lines = [(1, ["VISA 10.00", "the AB store", "Total 10.00", "3/4/2026 and Mar 9, 2026"]), (2, ["Total 10.01", "10.00 0.50"]), (3, [])]
    rows = spark.createDataFrame([(r, k, t) for r, ts in lines for k, t in enumerate(ts)], "receipt long, line_no int, text string")
    day = datetime.date(2026, 3, 9)
    wanted = [(1, 10004, " THE shop ", day), (2, 10005, "AB", datetime.date(2026, 3, 10)), (3, 5, None, None), (1, None, "ab Store", None), (1, -10000, "", None)]
    found = extract.located_values(rows, spark.createDataFrame(wanted, "receipt long, mils long, vendor string, day date"))
    assert sorted(map(tuple, found.collect())) == [(1, "amount", 2), (1, "date", 3), (1, "vendor", 1), (2, "amount", 0)]
