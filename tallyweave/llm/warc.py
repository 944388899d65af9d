"""WARC archives: a writer with one gzip member per record, and a sequential reader with incremental
decompression, content-length framing and digest verification.

Pages with equal payloads of REVISIT_LEAST bytes or more keep one response, that with the largest id; the
others become revisit records without payload that name it. Each task writes archives of its own in a
shared folder, under a name of its attempt, and reports them in a manifest: what lost or repeated tasks
leave behind is in no manifest and never read. Archives are rolled at ROLL_BYTES. Readers are dealt whole
archives and hold one record at a time.

Null html is an empty payload. Pages may repeat: rows that share the largest id of a payload are all
responses. A null id loses to any other, and is kept as null. An empty table writes no archive and reads
back no rows. Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize, scratch, table

REVISIT_LEAST, ROLL_BYTES, CHUNK = 1000, 256 << 20, 1 << 16
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


class WarcError(ValueError):
    pass


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def hexed(digest: str) -> str:
    """Bare lower-case hex of a labelled base-32 digest."""
    return base64.b32decode(digest.partition(":")[2]).hex()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def field_text(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record: a response with the payload, or a revisit of page refers_to without."""
    body = HTTP_HEAD % len(payload) + (b"" if refers_to is not None else payload)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": DATE,
        "WARC-Target-URI": field_text(url or ""),
        "WARC-Payload-Digest": sha1(payload),
        "WARC-Block-Digest": sha1(body),
        "Content-Type": "application/http; msgtype=response",
        "X-Page-Id": "" if page is None else str(page),
        "X-Payload-Length": str(len(payload)),
        "Content-Length": str(len(body)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-Id": str(refers_to)}
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in head.items())]
    return b"\r\n".join(lines) + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """data as one gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""

    def get(self, name: str) -> str:
        return self.headers.get(name.lower(), "")

    @property
    def payload(self) -> bytes:
        """What follows the HTTP head, if there is one."""
        if not self.get("Content-Type").startswith("application/http"):
            return self.body
        return self.body.partition(b"\r\n\r\n")[2]


def parse_record(data: bytes, offset: int) -> Record:
    """Frame a record by its Content-Length and verify its digests."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise WarcError(f"no WARC record at byte {offset}")
    rec = Record(offset)
    last = ""
    for line in lines[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and last:
            rec.headers[last] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        if not colon:
            raise WarcError(f"bad header line at byte {offset}")
        last = name.strip().lower()
        rec.headers[last] = value.strip()
    try:
        length = int(rec.get("Content-Length"))
    except ValueError:
        raise WarcError(f"no content length at byte {offset}") from None
    if length < 0 or len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"content length {length} doesn't frame the record at byte {offset}")
    rec.body = rest[:length]
    digest = rec.get("WARC-Block-Digest")
    if digest and digest != sha1(rec.body):
        raise WarcError(f"block digest differs at byte {offset}")
    digest = rec.get("WARC-Payload-Digest")
    if digest and rec.get("WARC-Type") == "response" and digest != sha1(rec.payload):
        raise WarcError(f"payload digest differs at byte {offset}")
    return rec


def read_records(stream: BinaryIO) -> Iterator[Record]:
    """The records of an archive in order. Each member is decompressed by pieces up to its own end."""
    pending, offset = b"", 0
    while True:
        pending = pending or stream.read(CHUNK)
        if not pending:
            return
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not pending:
                pending = stream.read(CHUNK)
                if not pending:
                    raise WarcError(f"archive ends within the member at byte {offset}")
            try:
                parts.append(z.decompress(pending))
            except zlib.error as e:
                raise WarcError(f"bad member at byte {offset}: {e}") from None
            used += len(pending) - len(z.unused_data)
            pending = z.unused_data
        yield parse_record(b"".join(parts), offset)
        offset += used


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder by its address, as executors open it too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ArchiveWriter:
    """Writes records into archives named after the task, and rolls them. Rows of the manifest: (archive, records, bytes)."""

    def __init__(self, folder: str, name: str):
        self.fs, self.root = file_system(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.folder, self.name, self.n, self.out = folder, name, 0, None
        self.done: list[tuple[str, int, int]] = []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.archive = f"{self.name}-{self.n}.warc.gz"
            self.out, self.records, self.size = self.fs.open_output_stream(f"{self.root}/{self.archive}", compression=None), 0, 0
            self.n += 1
        self.out.write(data)
        self.records += 1
        self.size += len(data)
        if self.size >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((f"{self.folder}/{self.archive}", self.records, self.size))
            self.out = None


def planned(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(page, url, data, refers_to) for every page; refers_to is null for responses. Only payloads that can be
    revisited look for their response. Pages move once, by payload digest, and copies of one payload are
    split among tasks by adaptive execution, as the digest's one row of the other side is."""
    rows = pages.select(F.col(key).cast("long").alias("page"), "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("data"))
    # Small payloads have keys of their own, so that they spread over all tasks.
    own = F.concat(F.lit("page "), F.coalesce(F.col("page").cast("string"), F.lit(""))).cast("binary")
    rows = rows.withColumn("digest", F.when(F.length("data") >= REVISIT_LEAST, F.unhex(F.sha1("data"))).otherwise(own))
    kept = rows.where(F.length("data") >= REVISIT_LEAST).groupBy("digest").agg(F.max("page").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(kept, "digest", "left").select("page", "url", "data", F.when(F.col("page").eqNullSafe(F.col("kept")), None).otherwise(F.col("kept")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, key: str = "page_id") -> DataFrame:
    """Write every page as a record and return the manifest (archive, records, bytes)."""

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        for batch in batches:
            for page, url, data, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                writer.write(member(record(page, url, data, refers_to)))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*writer.done), (pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return materialize(planned(pages, key).mapInArrow(run, "archive string, records long, bytes long"), "manifest")


ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long"


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives, from the records' own bytes."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def number(text: str) -> int | None:
        return int(text) if text else None

    def rows_of(archive: str) -> Iterator[tuple]:
        fs, path = file_system(archive)
        with fs.open_input_stream(path, compression=None) as stream:
            for r in read_records(stream):
                kind = r.get("WARC-Type")
                if kind in ("response", "revisit"):
                    size = len(r.payload) if kind == "response" else int(r.get("X-Payload-Length"))
                    yield number(r.get("X-Page-Id")), size, hexed(r.get("WARC-Payload-Digest")), kind, number(r.get("X-Refers-To-Page-Id")), archive, r.offset

    def run(batches):
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                found: list[tuple] = []
                for row in rows_of(archive):
                    found.append(row)
                    if len(found) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)
                        found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds)], names)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("archive").repartition(parts).mapInArrow(run, ROWS)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc"))).drop("archive", "offset")
