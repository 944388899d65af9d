import glob

from pyspark.sql import functions as F

from tallyweave.operators import review, words
from tallyweave.sources import files

LINE = "text string, box struct<x:double,y:double,w:double,h:double>, words array<struct<text:string,x:double,y:double,w:double,h:double>>"
BOX = (0.0, 0.1, 1.0, 0.1)


def word(text, x):
    return (text, x, 0.1, 0.2, 0.1)


def test_words(spark):
    rows = [
        ("2@19.28", BOX, [word("2@19.28", 0.5)]), ("5.00 6.00", BOX, [word("5.00", 0.9), word("6.00", 0.1)]), ("5.00 6.00", None, None), ("14.03.2026 14.03", BOX, []),
        ("USD$ 248. 81", BOX, None), ("TOTAL 9 05/10/2026 14:03", BOX, None), ("GAL 11.204", BOX, None), (None, None, None), ("", BOX, []), ("x" * 5000 + " 1.25", BOX, None), ("1.00 2.00", (0.2, 0.1, 0.0, 0.1), None),
    ]
    t = spark.createDataFrame(rows, LINE).coalesce(1)
    hits = lambda lenient: words.rightmost(words.money_hits(F.col("text"), F.col("box"), F.col("words"), lenient))
    found = t.select(hits(False).alias("a"), hits(True).alias("b")).collect()
    assert [r.a and r.a.cents for r in found] == [1928, 500, 600, 1403, 24881, None, None, None, None, 125, 200]
    assert [r.b and r.b.cents for r in found][5:7] == [900, 1120]
    assert (found[1].a.x, found[2].a.x, found[10].a.x, found[10].a.w) == (0.9, None, 0.2, 0.0)
    assert abs(found[3].a.x - 11 / 16) < 1e-12 and abs(found[3].a.w - 5 / 16) < 1e-12


def test_routes(spark):
    rows = [("a", 0.9, 100, []), ("b", 0.9, 0, []), ("c", 0.5, 100, None), ("d", 0.9, 100, ["total_suspect:warn"]), ("e", 0.9, 100, ["no_date:warn"]), ("f", 0.9, 100, ["x:error"]), ("g", 0.9, 100, []), ("h", None, None, []), (None, 0.9, 1, [])]
    t = spark.createDataFrame(rows, "id string, confidence double, amount_cents long, flags array<string>")
    twins = spark.createDataFrame([("g", "a", "details"), ("e", "a", "image")], "id string, duplicate_of string, via string")
    found = {r.id: (r.review, r.assist, r.flags) for r in review.routed(t, twins, True).collect()}
    assert {k for k, (seen, *_) in found.items() if seen} == {"b", "c", "d", "e", "f", "g", "h"}
    assert {k for k, (_, asked, _) in found.items() if asked} == {"b", "c", "h"}
    assert found["g"][2] == ["duplicate:warn"] and found["e"][2] == ["no_date:warn"]
    assert not any(r.assist for r in review.routed(t, twins, False).collect())


def test_rescue(spark):
    of = "id string, vendor string, mils long, confidence double, page_conf double, cached boolean"
    first = [("missed", "a", 0, 0.5, 90.0, False), ("other", "a", 1000, 0.1, 10.0, False), ("same", "a", 1000, 0.1, 10.0, False), ("worse", "a", 1000, 0.9, 10.0, False), ("sure", "a", 1000, 0.1, 65.0, False), ("cached", "a", 0, 0.1, 1.0, True), ("alone", "a", 0, 0.1, 1.0, False), ("null", "a", None, None, None, None)]
    second = [(k, "b", m, 0.8, 90.0, False) for k, m in [("missed", 500), ("other", 2000), ("same", 1004), ("worse", 1000), ("sure", 1000), ("cached", 5), ("null", 7)]]
    found = review.rescued(spark.createDataFrame(first, of), spark.createDataFrame(second, of)).collect()
    assert len(found) == 8 and {r.id for r in found if r.swapped} == {"missed", "same", "null"}
    assert all((r.vendor == "b") == r.swapped for r in found)


def test_identity_of_both_signals(spark):
    of = "k string, vendor string, vendor_conf double, text_name string, text_via string, logo string, score double, r double"
    rows = [("text", "Shel", 0.5, "Shell", "exact", "Mobil", 0.99, 0.1), ("blank", " ", 0.0, None, None, "Mobil", 0.9, 0.0), ("alike", "Mobl", 0.97, None, None, "Mobil", 0.8, 0.5), ("clash", "Target", 0.8, None, None, "Mobil", 0.9, 0.49), ("weak", "Target", 0.8, None, None, "Mobil", 0.77, 1.0), ("none", None, None, None, None, None, None, None)]
    found = {r.k: (r.fused.name, r.fused.confidence, r.fused.mismatch) for r in review.identified(spark.createDataFrame(rows, of), F.col("r")).collect()}
    assert found == {"text": ("Shell", 1.0, False), "blank": ("Mobil", 0.9, False), "alike": ("Mobil", 0.97, False), "clash": ("Target", 0.8, True), "weak": ("Target", 0.8, False), "none": (None, None, False)}


def test_costs(spark):
    calls = spark.createDataFrame([(1, "m", 1_000_000, 2_000_000), (2, "?", 5, 5), (3, "m", None, 1_000_000), (4, None, 1, 1)], "k int, model string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 1.0, 5.0)], "model string, price_in double, price_out double")
    assert {r.k: r.cost for r in review.priced(calls, prices).collect()} == {1: 11.0, 2: 0.0, 3: 5.0, 4: 0.0}


def test_intake(spark):
    of = "batch_id int, file_id long, name string, mime string, size long, at long"
    rows = [(1, k, f"/x/{k}.jpg", "", 10, 100 - k) for k in range(20)] + [(2, 50, "a.txt", "text/plain", 10, 1), (2, 51, "a.HEIC", None, 0, 1), (2, 52, "a", "image/png", files.MOST_BYTES + 1, 1), (2, 53, None, "image/png", files.MOST_BYTES, 1), (None, 54, "a.jpg", "", 1, 1), (3, 55, "a.jpg", "", 1, 1)]
    taken = spark.createDataFrame([(1, 3), (3, 8)], "batch_id int, n long")
    found = {r.file_id: (r.name, r.refused) for r in files.intake(spark.createDataFrame(rows, of), taken, 8).collect()}
    assert {k for k in range(20) if found[k][1] is None} == {15, 16, 17, 18, 19}
    assert [found[k][1] for k in range(50, 56)] == ["type", "empty", "size", None, "batch", "full"] and found[53][0] == "file" and found[3] == ("3.jpg", "full")
    assert files.intake(spark.createDataFrame([], of), taken).count() == 0


def test_report_file(spark, tmp_path):
    lines = spark.createDataFrame([(2, "2026-05-02", 'Meals,2026-05-02,"Butch\'s, ""Grinders""",18.50,USD,90,OK,'), (1, "2026-05-01", 'Fuel,2026-05-01,"two\r\nlines\n",45.20,USD,90,OK,"a; b"')], "id long, day string, line string")
    folder = str(tmp_path / "report")
    files.write_report(lines.withColumn("day", F.to_date("day")), folder)
    whole = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{folder}/part-*"))).decode()
    assert whole == "\ufeff" + ",".join(files.HEADERS) + "\r\n" + 'Fuel,2026-05-01,"two\r\nlines\n",45.20,USD,90,OK,"a; b"\r\nMeals,2026-05-02,"Butch\'s, ""Grinders""",18.50,USD,90,OK,\r\n'
    found = {tuple(r) for r in files.read_report(spark, folder).collect()}
    assert found == {("Fuel", "2026-05-01", "two\nlines\n", "45.20", "USD", "90", "OK", "a; b"), ("Meals", "2026-05-02", "Butch's, \"Grinders\"", "18.50", "USD", "90", "OK", "")}


def test_report_parts_that_begin_with_a_line_end_in_a_field(spark, tmp_path):
    (tmp_path / "part-0").write_bytes(b'Fuel,,"two\nlines",1.00,USD,90,OK,\r\nMeals,,x,2.00,USD,90,OK,"a\r\nb"\r\n')
    found = {tuple(r) for r in files.read_report(spark, str(tmp_path)).collect()}
    assert found == {("Fuel", "", "two\nlines", "1.00", "USD", "90", "OK", ""), ("Meals", "", "x", "2.00", "USD", "90", "OK", "a\nb")}


def test_words_over_the_limit(spark):
    t = spark.createDataFrame([("05/10/2026 1234567", BOX, None), ("$2,345,678.50", BOX, None), ("", BOX, [word("3000000.25", 0.5)])], LINE).coalesce(1)
    hits = lambda **limit: words.rightmost(words.money_hits(F.col("text"), F.col("box"), F.col("words"), True, **limit))["cents"]
    found = t.select(hits(limit=10**9).alias("a"), hits().alias("b")).collect()
    assert [r.a for r in found] == [123456700, 234567850, 300000025] and found[0].b is None
