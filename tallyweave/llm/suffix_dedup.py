"""Substrings that documents share, found by sorting suffixes with hash comparisons, and their removal.

A byte goes if a string of `length` bytes covers it that also starts in a document with a smaller doc_id; strings are judged
on the input. Equal strings have equal anchors: the least hash of their `SEED`-byte substrings. So each document
is cut into pieces, runs of strings with one anchor, and only pieces with the same anchor can share a string.

1. `pieces`: per batch of documents, anchors and piece hashes by prefix polynomial hashes. Of equal pieces of a batch all but
   those of the least document are settled at once, so a hot passage sends one piece a batch, not one an occurrence.
2. `settled`: by anchor, pieces equal to one of a smaller document go whole; pieces of anchors that have several different
   pieces must be compared. Only hashes have moved so far.
3. `contents`: documents meet the verdicts by doc_id. Each is checked against the text's own hash, so rows that share an id are
   never taken for one another. Bytes of the pieces to compare go on; those of crowded anchors as single strings, dealt by their
   hash, again one a batch.
4. `compared`: suffixes of the pieces of an anchor are merge-sorted. Two are compared by their common extension, found by
   binary search on prefix hashes; neighbours that agree in `length` bytes are verified byte by byte, and
   sorted by bytes if a hash lied. Each class goes from all but its least document.

Defined results: a null text is empty; texts shorter than `length` stay whole; rows with a null doc_id stay whole and are no
source, as nothing is smaller than null or greater; rows that repeat a doc_id are judged alone, never by one another; an empty
table gives no rows; further columns are ignored. Pieces count as equal by 88 bits of hash; strings that differ in bytes are never merged in step 4.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import release, table

#: Bytes of a shared string.
LENGTH = 50
#: Bytes of an anchor.
SEED = 20
#: Bytes of text that share one table of verdicts, and that one pass of numpy works on.
BATCH, SLICE = 8 << 20, 1 << 17
#: Bytes of text for each bucket of anchors.
PER_BUCKET = 12 << 20
#: Different pieces of an anchor that one task compares as pieces; beyond, about as many single strings of theirs go to each shard.
CROWD, STRINGS = 1024, 16

_BASE = 0x9E3779B97F4A7C15
_UNDO = np.uint64(pow(_BASE, -1, 1 << 64))
#: A random odd number for each byte value.
_CODE = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Verdicts: strings at..at+n-1 of the document go, if they have this hash, or are to be compared under `key` in that many shards.
GO = np.dtype([("at", "<u4"), ("n", "u1"), ("hash", "u1", 6)])
COMPARE = np.dtype([*GO.descr, ("key", "<u8"), ("share", "<u4")])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]))
    return up, np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _UNDO)]))


class PrefixHashes:
    """Polynomial hashes of all substrings of a buffer from those of its prefixes, modulo 2**64, with random byte codes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self._up, self._undo = _powers(1 << max(12, int(len(data)).bit_length()))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * self._up[: len(data)], out=self._sums[1:])

    def __call__(self, at: np.ndarray, n) -> np.ndarray:
        """The hash of data[at : at + n]."""
        return (self._sums[at + n] - self._sums[at]) * self._undo[at]

    def every(self, n: int) -> np.ndarray:
        """The hash of n bytes from each position on."""
        return (self._sums[n:] - self._sums[:-n]) * self._undo[: len(self.data) - n + 1]

    def common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """How many of the first `most` bytes from a and from b on agree, by binary search."""
        found = np.zeros(len(a), np.int64)
        step = 1 << (most.bit_length() - 1)
        while step:
            n = found + step
            fits = n <= most
            n = np.where(fits, n, 0)
            found = np.where(fits & (self(a, n) == self(b, n)), n, found)
            step >>= 1
        return found

    def less(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Whether the string from a on is less than that from b on, of strings that differ within `most` bytes."""
        n = self.common(a, b, most - 1)
        return self.data[a + n] < self.data[b + n]


def sort_suffixes(hashes: PrefixHashes, at: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order the suffixes that start at `at`, cut at `length` bytes, within ascending groups: a merge sort of all groups at
    once, in which every suffix finds its place in the other half by binary search."""
    whole = hashes(at, length)
    size = np.bincount(group)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    width = 1
    order = np.arange(len(at))
    while len(size) and width < size.max():
        mine = np.flatnonzero(size[group] > width)
        rank = mine - start[group[mine]]
        run = rank // width
        left = run % 2 == 0
        low = np.minimum((run ^ 1) * width, size[group[mine]])
        high = np.minimum(low + width, size[group[mine]])
        first, begin = low.copy(), start[group[mine]]
        x = at[order[mine]]
        for _ in range(width.bit_length()):
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) // 2
            other = order[begin[open_] + middle]
            # Equal suffixes of the left half stay in front.
            less = ~left[open_]
            differ = np.flatnonzero(whole[other] != whole[order[mine[open_]]])
            less[differ] = hashes.less(at[other[differ]], x[open_[differ]], length)
            low[open_] = np.where(less, middle + 1, low[open_])
            high[open_] = np.where(less, high[open_], middle)
        place = begin + np.minimum(run, run ^ 1) * width + rank % width + (low - first)
        moved = order.copy()
        moved[place] = order[mine]
        order = moved
        width *= 2
    return order


def equal_classes(hashes: PrefixHashes, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions into `at` by group (any numbers) and suffix, and for each whether it starts a class of strings equal in all bytes."""
    data = hashes.data
    lead = np.ascontiguousarray(data[at[:, None] + np.arange(8)]).view(">u8").ravel()
    order = np.lexsort((lead, group))
    g, lead = group[order], lead[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (lead[1:] != lead[:-1])])
    fine = np.cumsum(new) - 1
    order = order[sort_suffixes(hashes, at[order], fine, length)]
    a, b = at[order[:-1]], at[order[1:]]
    same = np.flatnonzero((fine[1:] == fine[:-1]) & (hashes(a, length) == hashes(b, length)))
    alike = np.concatenate([(data[a[c, None] + np.arange(length)] == data[b[c, None] + np.arange(length)]).all(1) for c in np.array_split(same, len(same) // 65536 + 1)])
    if not alike.all():
        # A hash lied: sort the groups it is in by their bytes.
        for f in np.unique(fine[1:][same[~alike]]):
            part = np.flatnonzero(fine == f)
            order[part] = sorted(order[part], key=lambda i: data[at[i] : at[i] + length].tobytes())
        a, b = at[order[:-1]], at[order[1:]]
        same = np.flatnonzero(fine[1:] == fine[:-1])
        alike = (data[a[same, None] + np.arange(length)] == data[b[same, None] + np.arange(length)]).all(1)
    head = np.ones(len(order), bool)
    head[same[alike] + 1] = False
    return order, head


def _slices(texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of whole and of parts of texts, concatenated up to about SLICE; for each part its text and where it starts there.
    Parts of one text overlap by length - 1 bytes, so that each string is in one."""
    raw = texts.cast(pa.large_binary()).fill_null(b"")
    offset = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    parts, size = [], 0
    for i in range(len(raw)):
        n = int(offset[i + 1] - offset[i])
        for begin in range(0, max(n - length + 1, 0), SLICE):
            part = data[offset[i] + begin : min(offset[i] + begin + SLICE + length - 1, offset[i + 1])]
            parts.append((part, i, begin))
            size += len(part)
            if size >= SLICE:
                yield np.concatenate([p for p, _, _ in parts]), parts
                parts, size = [], 0
    if parts:
        yield np.concatenate([p for p, _, _ in parts]), parts


def cut(data: np.ndarray, bounds: np.ndarray, length: int, seed: int) -> dict[str, np.ndarray]:
    """Pieces of the texts data[bounds[i] : bounds[i + 1]]: text, first string, number of strings, the anchor's
    hash, and the hash of all its bytes."""
    hashes = PrefixHashes(data)
    least = _mixed(hashes.every(seed))
    where = np.arange(len(least), dtype=np.int32)
    span, width = 1, length - seed + 1
    anchors = least
    while span < width:
        step = min(span, width - span)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    strings = len(data) - length + 1
    inside = text[:strings] == text[length - 1 :]
    new = np.ones(strings, bool)
    new[1:] = (where[1:] != where[:-1]) | ~inside[:-1]
    at = np.flatnonzero(new & inside)
    ends = np.flatnonzero(new | ~inside)
    n = np.append(ends, strings)[np.searchsorted(ends, at, side="right")] - at
    # Least hashes are small numbers: spread them again.
    return {"text": text[at], "at": at - bounds[text[at]], "n": n, "anchor": _mixed(~anchors[where[at]]), "hash": piece_hash(hashes, at, n, length)}


def piece_hash(hashes: PrefixHashes, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    return _mixed(hashes(at, n + length - 1) ^ (n.astype(np.uint64) * np.uint64(_BASE)))


def _verdicts(doc: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """A row for each record."""
    ends = pa.py_buffer(np.arange(len(doc) + 1, dtype=np.int32) * records.itemsize)
    told = pa.Array.from_buffers(pa.binary(), len(doc), [None, ends, pa.py_buffer(np.ascontiguousarray(records).tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), told], schema=_VERDICTS)


def _records(parts: list[bytes] | None, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(p for p in parts or [] if len(p) == kind.itemsize), kind)


def _bytes_of(hashes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :6]


def _gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Batches together until `column` has `most` bytes."""
    held, size = [], 0
    for batch in batches:
        # A batch may be larger by itself: cut it by rows.
        while len(batch):
            lengths = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
            take = max(1, int(np.searchsorted(lengths, most - size, side="right")))
            held.append(batch.slice(0, take))
            size += int(lengths[min(take, len(batch)) - 1])
            batch = batch.slice(take)
            if size >= most or len(batch):
                yield pa.Table.from_batches(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


PIECES = "bucket int, sure int, doc binary, at binary, n binary, hash binary, key binary"


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that their many zeros lie together."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _from_planes(x: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _pieces(batches: Iterator[pa.RecordBatch], buckets: int, length: int, seed: int) -> Iterator[pa.RecordBatch]:
    for held in _gathered(batches, "text", BATCH):
        held = held.sort_by("doc_id").combine_chunks()
        ids = held.column("doc_id").to_numpy()
        found = []
        for data, parts in _slices(held.column("text").combine_chunks(), length):
            bounds = np.concatenate([[0], np.cumsum([len(p) for p, _, _ in parts])])
            p = cut(data, bounds, length, seed)
            p["at"] = (p["at"] + np.array([b for _, _, b in parts])[p["text"]]).astype(np.uint32)
            p["doc"] = ids[np.array([i for _, i, _ in parts])[p.pop("text")]]
            p["n"] = p["n"].astype(np.uint8)
            found.append(p)
        if not found:
            continue
        p = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
        p["hash"] &= np.uint64((1 << 56) - 1)
        same = p["anchor"] ^ p["hash"] * np.uint64(_BASE)
        order = np.argsort(same)
        new = np.concatenate([[True], np.diff(same[order]) != 0])
        least = np.minimum.reduceat(p["doc"][order], np.flatnonzero(new))
        sure = np.empty(len(order), bool)
        sure[order] = p["doc"][order] > least[np.cumsum(new) - 1]
        # Settled pieces move by document.
        where = np.where(sure, _mixed(p["doc"].astype(np.uint64)), p["anchor"])
        bucket = ((where >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(2 * bucket + sure, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        rows = []
        for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
            part = order[lo:hi]
            if len(part):
                gone = int(sure[part].sum())
                key = p["anchor"][part[: len(part) - gone]].astype("<u4")
                row = {"n": p["n"][part], "key": key}
                doc = np.diff(p["doc"][part], prepend=0)
                rows.append({"bucket": b, "sure": gone, "doc": _planes(doc), "at": _planes(p["at"][part]), "hash": _planes(p["hash"][part])[: 7 * len(part)]} | {k: v.tobytes() for k, v in row.items()})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("sure", pa.int32()), *[(c, pa.binary()) for c in ("doc", "at", "n", "hash", "key")]]))
    release()


VERDICTS = "doc_id long, verdict binary"
_VERDICTS = pa.schema([("doc_id", pa.int64()), ("verdict", pa.binary())])


def _settled(group: pa.Table) -> pa.Table:
    parts, done = [], []
    bucket = group.column("bucket")[0].as_py()
    for row in range(len(group)):
        gone, doc, at, n, hashes, key = (group.column(c)[row].as_py() for c in ("sure", "doc", "at", "n", "hash", "key"))
        p = {"doc": np.cumsum(_from_planes(doc, "<i8")), "at": _from_planes(at, "<u4"), "n": np.frombuffer(n, "u1"), "hash": _from_planes(hashes + bytes(len(n)), "<u8")}
        known = len(p["doc"]) - gone
        r = np.zeros(gone, GO)
        r["at"], r["n"], r["hash"] = p["at"][known:], p["n"][known:], _bytes_of(p["hash"][known:])
        done.append((p["doc"][known:], r))
        parts.append({k: v[:known] for k, v in p.items()} | {"key": np.frombuffer(key, "<u4")})
    p = {k: np.concatenate([x.pop(k) for x in parts]) for k in list(parts[0])}
    both = p["key"].astype(np.uint64) << np.uint64(32) | p["hash"] >> np.uint64(32)
    order = np.argsort(both)
    if ((np.diff(both[order]) == 0) & (np.diff(p["hash"][order]) != 0)).any():
        order = np.lexsort((p["hash"], p["key"]))
    p = {k: v[order] for k, v in p.items()}
    if len(order):
        anchor = np.concatenate([[True], np.diff(p["key"]) != 0])
        piece = anchor | np.concatenate([[True], np.diff(p["hash"]) != 0])
        which = np.cumsum(anchor) - 1
        start = np.flatnonzero(anchor)
        several = np.minimum.reduceat(p["doc"], start) != np.maximum.reduceat(p["doc"], start)
        kinds = np.add.reduceat(piece.astype(np.int64), start)
        gone = p["doc"] > np.minimum.reduceat(p["doc"], np.flatnonzero(piece))[np.cumsum(piece) - 1]
        compare = (several & (kinds > 1))[which] & ~gone
        for tell, kind in ((gone, GO), (compare, COMPARE)):
            r = np.zeros(int(tell.sum()), kind)
            r["at"], r["n"], r["hash"] = p["at"][tell], p["n"][tell], _bytes_of(p["hash"][tell])
            if kind is COMPARE:
                r["key"] = p["key"][tell].astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
                r["share"] = np.where(kinds > CROWD, -(-kinds * STRINGS // CROWD), 1)[which[tell]]
            done.append((p["doc"][tell], r))
    release()
    return pa.Table.from_batches([_verdicts(d, r) for d, r in done])


def _own(data: np.ndarray, records: np.ndarray, hashes: PrefixHashes, length: int) -> np.ndarray:
    """Records that hold for this text: those whose bytes have the hash that was judged."""
    fits = records["at"].astype(np.int64) + records["n"] + length - 1 <= len(data)
    r = records[fits]
    return r[(_bytes_of(piece_hash(hashes, r["at"].astype(np.int64), r["n"].astype(np.int64), length)) == r["hash"]).all(1)]


CONTENTS = "key long, shard int, doc_id long, at long, content binary, verdict binary"
_CONTENTS = pa.schema([("key", pa.int64()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int64()), ("content", pa.binary()), ("verdict", pa.binary())])


def _contents(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for held in _gathered(batches, "text", BATCH):
        rows: list[dict] = []
        single: dict[tuple, list] = {}
        for doc, text, parts in zip(*(held.column(c).to_pylist() for c in ("doc_id", "text", "verdicts"))):
            records = _records(parts, COMPARE)
            raw = (text or "").encode()
            if not len(records) or len(raw) < length:
                continue
            data = np.frombuffer(raw, np.uint8)
            hashes = PrefixHashes(data)
            for at, n, _, key, share in _own(data, records, hashes, length).tolist():
                if share == 1:
                    rows.append({"key": key, "shard": 0, "doc_id": doc, "at": at, "content": raw[at : at + n + length - 1], "verdict": None})
                    continue
                for i, h in enumerate(hashes(np.arange(at, at + n), length).tolist()):
                    one = raw[at + i : at + i + length]
                    single.setdefault((key, one), []).append((doc, at + i, int(_mixed(np.array([h], np.uint64))[0] % np.uint64(share))))
        for (key, one), found in single.items():
            least = min(found)[0]
            gone = [(d, at) for d, at, _ in found if d > least]
            rows += [{"key": key, "shard": s, "doc_id": d, "at": at, "content": one, "verdict": None} for d, at, s in found if d == least]
            if gone:
                r = np.zeros(len(gone), GO)
                r["at"], r["n"] = [at for _, at in gone], 1
                r["hash"] = _bytes_of(piece_hash(PrefixHashes(np.frombuffer(one, np.uint8)), np.zeros(1, np.int64), np.ones(1, np.int64), length))
                rows += [{"key": d, "shard": -1, "doc_id": d, "at": None, "content": None, "verdict": v.tobytes()} for (d, _), v in zip(gone, r)]
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_pylist(rows[i : i + 20_000], _CONTENTS)
    release()


def _compared(batches: Iterator[pa.RecordBatch], length: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Blocks of whole (key, shard) groups of the sorted stream, and what goes of each document."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        told = batch.filter(pc.is_valid(batch.column("verdict")))
        if len(told):
            yield pa.RecordBatch.from_arrays([told.column("doc_id"), told.column("verdict")], schema=_VERDICTS)
        batch = batch.filter(pc.is_valid(batch.column("content")))
        if not len(batch):
            continue
        held.append(batch)
        rows += len(batch)
        if rows >= 20_000:
            every = pa.Table.from_batches(held).combine_chunks()
            key, shard = every.column("key").to_numpy(), every.column("shard").to_numpy()
            whole = np.flatnonzero((key != key[-1]) | (shard != shard[-1]))
            upto = int(whole[-1]) + 1 if len(whole) else 0
            if upto:
                yield from _compared_block(every.slice(0, upto), length, seed)
            held, rows = every.slice(upto).combine_chunks().to_batches(), len(every) - upto
    if rows:
        yield from _compared_block(pa.Table.from_batches(held).combine_chunks(), length, seed)
    release()


def _compared_block(rows: pa.Table, length: int, seed: int) -> Iterator[pa.RecordBatch]:
    content = rows.column("content").to_pylist()
    data = np.frombuffer(b"".join(content), np.uint8)
    size = np.array([len(c) for c in content])
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    strings = size - length + 1
    row = np.repeat(np.arange(len(size)), strings)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(strings) - strings, strings)
    at = base[row] + inner
    key, shard = rows.column("key").to_numpy(), rows.column("shard").to_numpy()
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1])])
    # Equal strings have the anchor at the same place, so suffixes are sorted by anchor and its place.
    hashes = PrefixHashes(data)
    anchor = np.argmin(_mixed(hashes.every(seed))[base[:, None] + np.arange(length - seed + 1)], axis=1)
    order, head = equal_classes(hashes, at, (np.cumsum(new) - 1)[row] * (2 * length) + anchor[row] - inner, length)
    doc = rows.column("doc_id").to_numpy()[row]
    least = np.minimum.reduceat(doc[order], np.flatnonzero(head))[np.cumsum(head) - 1]
    gone = np.zeros(len(row), bool)
    gone[order] = doc[order] > least
    # Neighbouring strings of a piece go as one verdict.
    first = gone.copy()
    first[1:] &= ~(gone[:-1] & (row[1:] == row[:-1]))
    begin = np.flatnonzero(first)
    if len(begin):
        r = np.zeros(len(begin), GO)
        r["n"] = np.add.reduceat(gone.astype(np.int64), begin)
        r["at"] = rows.column("at").to_numpy()[row[begin]] + inner[begin]
        r["hash"] = _bytes_of(piece_hash(hashes, at[begin], r["n"].astype(np.int64), length))
        yield _verdicts(doc[begin], r)


def _removed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for held in _gathered(batches, "text", BATCH):
        kept, spans = [], []
        for text, parts in zip(held.column("text").to_pylist(), held.column("verdicts").to_pylist()):
            raw = (text or "").encode()
            runs: list[tuple[int, int]] = []
            if parts and len(raw) >= length:
                data = np.frombuffer(raw, np.uint8)
                r = _own(data, _records(parts, GO), PrefixHashes(data), length)
                change = np.zeros(len(raw) + 1, np.int64)
                np.add.at(change, r["at"].astype(np.int64), 1)
                np.add.at(change, r["at"].astype(np.int64) + r["n"] + length - 1, -1)
                out = np.cumsum(change)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], out, [False]]).astype(np.int8)))
                runs = list(zip(edge[::2].tolist(), edge[1::2].tolist()))
                raw = data[~out].tobytes()
            kept.append(raw)
            spans.append([{"start": a, "end": b} for a, b in runs])
        yield pa.RecordBatch.from_arrays([held.column("doc_id").combine_chunks(), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(span))], names=["doc_id", "kept", "spans"])
    release()


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, kept, spans): the bytes that remain of every row's text, and the runs of bytes removed (end exclusive)."""
    if not 8 <= seed < length <= 255:
        raise ValueError("8 <= seed < length <= 255")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(1 << 20, -(-total // PER_BUCKET)))
    pieces = known.mapInArrow(lambda b: _pieces(b, buckets, length, seed), PIECES)
    settled = _by_doc(pieces.groupBy("bucket").applyInArrow(_settled, VERDICTS))
    # Both joins read one exchange of the texts and one of the verdicts: the same rows and columns are in both.
    texts = known.repartition("doc_id")
    contents = texts.join(settled.hint("shuffle_hash"), "doc_id").mapInArrow(lambda b: _contents(b, length), CONTENTS)
    compared = contents.repartition("key", "shard").sortWithinPartitions("key", "shard").mapInArrow(lambda b: _compared(b, length, seed), VERDICTS)
    compared = _by_doc(compared).withColumnRenamed("verdicts", "more")
    every = texts.join(settled.hint("shuffle_hash"), "doc_id", "left").join(compared.hint("shuffle_hash"), "doc_id", "left")
    every = every.select("doc_id", "text", F.concat(*[F.coalesce(c, F.array()) for c in ("verdicts", "more")]).alias("verdicts"))
    schema = "doc_id long, kept binary, spans array<struct<start:long,end:long>>"
    rest = docs.where("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("kept"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    return every.mapInArrow(lambda b: _removed(b, length), schema).unionByName(rest)


def _by_doc(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("doc_id").agg(F.collect_list("verdict").alias("verdicts"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what is left of every document once strings of 50 bytes that a smaller document has are removed."""
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]), F.lit(0))
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("kept") + gone).cast("long").alias("n_bytes"), gone.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
