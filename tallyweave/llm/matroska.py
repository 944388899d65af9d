"""Media columns in Matroska: payloads stored as laced 8-bit PCM packets, and a parser that turns EBML
elements, clusters, lacing and cues into packet tables.

The work is one pass over the rows without a shuffle; memory is bounded by an Arrow batch and the media
of one row. Null text counts as empty text; empty text becomes one padding packet; repeated rows give
repeated, equal results; extra columns of the input are ignored. Media that is null or malformed yields
no packets and a non-null `error` in `packet_table`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import table

# Element ids of the public Matroska / EBML specification (RFC 8794, RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD = 0x1254C367, 0x1043A770, 0x1941A469, 0x114D9B74
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Elements that end a cluster or segment of unknown size.
TOP_LEVEL = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS, SEEK_HEAD, EBML}

PACKET, RATE = 576, 8000
PACKET_MS = PACKET * 1000 // RATE
PACKETS_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 32


def size_vint(n: int, width: int = 0) -> bytes:
    """An element size; the all-ones value of each width is kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def real(eid: int, x: float) -> bytes:
    return element(eid, struct.pack(">d", x))


def pad(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of the packet size."""
    return data + b"\xff" * (-len(data) % PACKET if data else PACKET)


def block_body(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """A (simple) block with the frames laced as asked."""
    head = size_vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing == NO_LACING:
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += size_vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def encode(payload: bytes) -> bytes:
    """A Matroska file with one 8-bit PCM track that holds the padded payload, packet by packet."""
    header = element(EBML, uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2))
    n = len(payload) // PACKET
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + real(DURATION, float(n * PACKET_MS)))
    audio = element(AUDIO, real(SAMPLING_FREQUENCY, float(RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, PACKET_MS * 1_000_000) + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    for first in range(0, n, PACKETS_PER_BLOCK * BLOCKS_PER_CLUSTER):
        base = first * PACKET_MS
        blocks = [uint(CLUSTER_TIMESTAMP, base)]
        for k in range(first, min(n, first + PACKETS_PER_BLOCK * BLOCKS_PER_CLUSTER), PACKETS_PER_BLOCK):
            frames = [payload[i * PACKET : (i + 1) * PACKET] for i in range(k, min(n, k + PACKETS_PER_BLOCK))]
            blocks.append(element(SIMPLE_BLOCK, block_body(1, k * PACKET_MS - base, frames, FIXED if len(frames) > 1 else NO_LACING)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return header + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    rate: float = 8000.0
    channels: int = 1
    bits: int = 0
    default_ns: int = 0


@dataclass
class Media:
    """Packets are (track, timestamp in ticks, keyframe, cluster, block, lace, offset, size)."""

    doc_type: str = ""
    scale: int = 1_000_000
    duration: float = 0.0
    tracks: list[Track] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    laced: int = 0
    blocks: int = 0


def vint(data: bytes, at: int, end: int, keep: bool = False) -> tuple[int | None, int]:
    """The number at `at` (marker kept for ids; None: unknown size) and the place after it."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise ValueError(f"cut off at byte {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int, ends: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start of body, end of body) of each child. An element of unknown size runs up to the next
    element that can't be its child, or to the end; `ends` are ids that stop this level."""
    while at < end:
        eid, body = vint(data, at, end, keep=True)
        if eid in ends:
            return
        n, body = vint(data, body, end)
        if n is None:
            if eid not in (SEGMENT, CLUSTER):
                raise ValueError(f"element {eid:#x} has no size")
            stop = end
            if eid == CLUSTER:
                stop = body
                for _, _, stop in elements(data, body, end, TOP_LEVEL):
                    pass
        else:
            stop = body + n
        if stop > end:
            raise ValueError(f"element {eid:#x} at byte {at} runs past its parent")
        yield eid, body, stop
        at = stop


def number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def floating(data: bytes, a: int, b: int) -> float:
    return struct.unpack({0: ">0s", 4: ">f", 8: ">d"}[b - a], data[a:b])[0] if b > a else 0.0


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a block's frames and the place of the first one."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise ValueError(f"lacing cut off at byte {at}")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        return [(end - at) // n] * n, at
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"lacing cut off at byte {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif n > 1:
        size, at = vint(data, at, end)
        sizes.append(size or 0)
        for _ in range(n - 2):
            start = at
            raw, at = vint(data, at, end)
            width = at - start
            raw = (1 << 7 * width) - 1 if raw is None else raw
            sizes.append(sizes[-1] + raw - ((1 << 7 * width - 1) - 1))
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced frames run past their block")
    return [*sizes, last], at


def parse(data: bytes) -> Media:
    """The tracks, packets, clusters and cues of a file. Unknown elements are skipped. ValueError if malformed."""
    media, by_number = Media(), {}
    for eid, a, b in elements(data, 0, len(data)):
        if eid == EBML:
            for x, c, d in elements(data, a, b):
                if x == DOC_TYPE:
                    media.doc_type = data[c:d].rstrip(b"\0").decode()
        elif eid == SEGMENT:
            for x, c, d in elements(data, a, b, {EBML, SEGMENT}):
                if x == INFO:
                    for y, e, f in elements(data, c, d):
                        if y == TIMESTAMP_SCALE:
                            media.scale = number(data, e, f)
                        elif y == DURATION:
                            media.duration = floating(data, e, f)
                elif x == TRACKS:
                    for y, e, f in elements(data, c, d):
                        if y == TRACK_ENTRY:
                            media.tracks.append(track := read_track(data, e, f))
                            by_number[track.number] = track
                elif x == CLUSTER:
                    media.clusters.append(c)
                    read_cluster(data, c, d, media, by_number)
                elif x == CUES:
                    for y, e, f in elements(data, c, d):
                        if y == CUE_POINT:
                            media.cues.append((*read_cue(data, e, f), a))
    if media.doc_type not in ("matroska", "webm"):
        raise ValueError("no Matroska header")
    return media


def read_track(data: bytes, a: int, b: int) -> Track:
    track = Track()
    for x, c, d in elements(data, a, b):
        if x == TRACK_NUMBER:
            track.number = number(data, c, d)
        elif x == TRACK_TYPE:
            track.kind = number(data, c, d)
        elif x == CODEC_ID:
            track.codec = data[c:d].rstrip(b"\0").decode()
        elif x == DEFAULT_DURATION:
            track.default_ns = number(data, c, d)
        elif x == AUDIO:
            for y, e, f in elements(data, c, d):
                if y == SAMPLING_FREQUENCY:
                    track.rate = floating(data, e, f)
                elif y == CHANNELS:
                    track.channels = number(data, e, f)
                elif y == BIT_DEPTH:
                    track.bits = number(data, e, f)
    return track


def read_cue(data: bytes, a: int, b: int) -> tuple[int, int, int]:
    time = track = position = 0
    for x, c, d in elements(data, a, b):
        if x == CUE_TIME:
            time = number(data, c, d)
        elif x == CUE_TRACK_POSITIONS:
            for y, e, f in elements(data, c, d):
                if y == CUE_TRACK:
                    track = number(data, e, f)
                elif y == CUE_CLUSTER_POSITION:
                    position = number(data, e, f)
    return time, track, position


def read_cluster(data: bytes, a: int, b: int, media: Media, tracks: dict[int, Track]) -> None:
    base = 0
    for x, c, d in elements(data, a, b, TOP_LEVEL):
        if x == CLUSTER_TIMESTAMP:
            base = number(data, c, d)
        elif x == SIMPLE_BLOCK:
            read_block(data, c, d, base, True, media, tracks)
        elif x == BLOCK_GROUP:
            for y, e, f in elements(data, c, d):
                if y == BLOCK:
                    read_block(data, e, f, base, False, media, tracks)


def read_block(data: bytes, a: int, b: int, base: int, simple: bool, media: Media, tracks: dict[int, Track]) -> None:
    track, at = vint(data, a, b)
    if at + 3 > b:
        raise ValueError(f"block cut off at byte {a}")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, b, lacing)
    step = tracks[track].default_ns // media.scale if track in tracks else 0
    media.laced += lacing != NO_LACING
    for lace, size in enumerate(sizes):
        media.packets.append((track, base + relative + lace * step, simple and bool(flags & 0x80), len(media.clusters) - 1, media.blocks, lace, at, size))
        at += size
    media.blocks += 1


def payload_of(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p[6] : p[6] + p[7]] for p in media.packets if p[0] == track)


def feature(data: bytes, media: Media, payload: bytes) -> str:
    """What the container says, how many cues lead to a cluster, and the mean of the samples read back."""
    t = media.tracks[0]
    places = (c[3] + c[2] for c in media.cues)
    seekable = sum(data[x : x + 4] == CLUSTER.to_bytes(4, "big") for x in places)
    return f"{t.codec};rate={t.rate:.0f};bits={t.bits};clusters={len(media.clusters)};blocks={media.blocks};laced={media.laced};packets={len(media.packets)};cues={len(media.cues)};seekable={seekable};ms={media.duration * media.scale / 1e6:.0f};mean={sum(payload) / len(payload):.4f}"


PACKETS = "track long, timestamp_ms double, keyframe boolean, cluster int, block int, lace int, byte_offset long, byte_size long, cue_ms double, error string"


def packet_table(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row per packet of each medium, with its byte range and the time of the last cue at or before it."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    m = parse(blob.as_py() or b"")
                except (ValueError, KeyError) as e:
                    rows.append((k, *[None] * 9, str(e)))
                    continue
                ms, cues = m.scale / 1e6, sorted({c[0] for c in m.cues})
                for track, t, keyframe, cluster, block, lace, at, size in m.packets:
                    cue = max((c for c in cues if c <= t), default=None)
                    rows.append((k, track, t * ms, keyframe, cluster, block, lace, at, size, None if cue is None else cue * ms, None))
            cols = list(zip(*rows)) or [[]] * 11
            kinds = [batch.schema[0].type, pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    names = [key, *(x.split()[0] for x in PACKETS.split(", "))]
    return df.select(key, media).mapInArrow(run, f"`{key}` {kind}, {PACKETS}")


def store(data: bytes) -> tuple[int, int, str, int, int, str, str]:
    """The digest of one text's bytes after a round trip through the container."""
    media = encode(pad(data))
    parsed = parse(media)
    back = payload_of(media, parsed)
    return len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(media, parsed, back)


def media_digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as a medium, read it back and describe what was read; one row per input row."""
    kind = df.schema[key].dataType.simpleString()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [store(x.as_py() or b"") for x in batch.column(1)]
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return df.select(F.col(key), F.encode(F.col(text), "UTF-8").alias("data")).mapInArrow(
        run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
