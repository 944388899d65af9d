import hashlib
import zlib

import pytest

from tallyweave.llm import matroska as op
from tests.llm.helpers import none, odd_documents


def test_round_trip(spark):
    docs = odd_documents(spark)
    rows = op.media_digest(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 if data else 576)
        media = op.encode(padded)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    assert op.media_digest(none(docs)).count() == 0


@pytest.mark.parametrize("lacing", [op.NO_LACING, op.XIPH, op.FIXED, op.EBML_LACING])
def test_lacing(lacing):
    frames = [b"a" * 300] if lacing == op.NO_LACING else [b"a" * 300] * 5 if lacing == op.FIXED else [b"a" * 300, b"", b"b" * 255, b"c" * 7000, b"d"]
    block = op.element(op.BLOCK_GROUP, op.element(op.BLOCK, op.block_body(1, 5, frames, lacing)))
    track = op.element(op.TRACKS, op.element(op.TRACK_ENTRY, op.uint(op.TRACK_NUMBER, 1) + op.uint(op.DEFAULT_DURATION, 10_000_000)))
    head = op.element(op.EBML, op.element(op.DOC_TYPE, b"matroska"))
    void = b"\xec\x83abc"
    data = head + op.element(op.SEGMENT, void + track + op.element(op.CLUSTER, op.uint(op.CLUSTER_TIMESTAMP, 100) + block))
    media = op.parse(data)
    assert [data[p[6] : p[6] + p[7]] for p in media.packets] == frames
    assert [p[1] for p in media.packets] == [105 + 10 * k for k in range(len(frames))]


def test_unknown_sizes():
    cluster = lambda t: b"\x1f\x43\xb6\x75\xff" + op.uint(op.CLUSTER_TIMESTAMP, t) + op.element(op.SIMPLE_BLOCK, op.block_body(1, 0, [b"x" * 10], op.NO_LACING))
    data = op.element(op.EBML, op.element(op.DOC_TYPE, b"webm")) + b"\x18\x53\x80\x67\x01" + b"\xff" * 7 + cluster(0) + cluster(70)
    media = op.parse(data)
    assert [(p[1], p[3], p[7]) for p in media.packets] == [(0, 0, 10), (70, 1, 10)]


def test_packet_table(spark):
    payload = op.pad(b"z" * 600_000)
    rows = [(1, op.encode(payload)), (2, b"junk"), (3, None), (4, op.encode(payload)[:-9])]
    found = op.packet_table(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    good = sorted((r for r in found if r.id == 1), key=lambda r: r.byte_offset)
    assert len(good) == len(payload) // 576 and b"".join(rows[0][1][r.byte_offset : r.byte_offset + r.byte_size] for r in good) == payload
    assert [r.timestamp_ms for r in good] == [72.0 * k for k in range(len(good))] and all(r.cue_ms <= r.timestamp_ms for r in good)
    assert {r.id for r in found if r.error} == {2, 3, 4}
