import hashlib
import io

import pytest

from tallyweave.llm import warc as op
from tallyweave.llm.common import scratch

LONG = "<p>" + "x" * 2000 + "é</p>"
ROWS = [(1, "http://a/", LONG, 0.5), (9, "http://b/", LONG, 0.5), (4, None, LONG, 0.5), (2, "http://c/\r\nX: y", "short", 0.5), (3, "http://d/", "short", 0.5), (5, "http://e/", None, 0.5), (6, "http://f/", "", 0.5), (None, "http://g/", LONG + "!", 0.5), (7, "u", "a\r\n\r\nb" * 400, 0.5), (8, "u", "𝒳" * 40_000, 0.5), (9, "http://b/", LONG, 0.5)]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, offset double").repartition(3)


def test_round_trip(spark):
    rows = op.read_archives(op.write_archives(pages(spark), scratch(spark, "warc"))).collect()
    last = {}
    for i, _, h, _ in ROWS:
        if i is not None:
            last[h] = max(i, last.get(h, -1))
    expected = []
    for i, _, h, _ in ROWS:
        data = (h or "").encode()
        revisit = len(data) >= 1000 and h in last and last[h] != i
        expected.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", last[h] if revisit else None))
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(expected, key=str)


def test_empty(spark):
    assert op.read_archives(op.write_archives(pages(spark).where("false"), scratch(spark, "warc"))).count() == 0


def test_reader_in_small_pieces(monkeypatch):
    data = b"".join(op.member(op.record(k, f"http://h/{k}", b"y" * k * 50)) for k in range(20))
    monkeypatch.setattr(op, "CHUNK", 7)
    found = list(op.read_records(io.BytesIO(data)))
    assert [r.get("X-Page-Id") for r in found] == [str(k) for k in range(20)] and [len(r.payload) for r in found] == [k * 50 for k in range(20)]
    for r in found[1:]:
        assert data[r.offset : r.offset + 2] == b"\x1f\x8b"


@pytest.mark.parametrize("change", [lambda r: r.replace(b"yyy", b"yzy", 1), lambda r: r.replace(b"Content-Length: ", b"Content-Length: 1", 1), lambda r: r[:-3], lambda r: b"x" + r])
def test_damage_is_found(change):
    with pytest.raises(op.WarcError):
        list(op.read_records(io.BytesIO(op.member(change(op.record(1, "http://h/", b"yyyy"))))))


def test_cut_archive():
    data = op.member(op.record(1, "http://h/", b"y" * 5000))
    with pytest.raises(op.WarcError):
        list(op.read_records(io.BytesIO(data[:-4])))
