"""Secret scan over an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger, a folder of Parquet
files, has a row for each pair of blob and rule version that was scanned. A run scans only pairs it lacks,
one copy of each content, appends them, and joins findings back to all paths. Each reading task passes on
one copy of a content, so texts are shuffled by content without a hot key; the join back carries no texts.

Null text counts as empty text, which has no findings. Paths may repeat, as may contents: each row gets
the findings of its content. An empty table appends nothing. Extra columns are dropped. A lost executor
costs a rerun of its tasks; appending is atomic by Spark's commit, and a pair scanned twice by two runs
at once counts once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import scratch, table

KINDS = ("assign", "access", "hex")
# The base patterns, as the query's contract states them.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS, ASSIGN_LEAST = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Further kinds: name, pattern, and a part that each match has.
MORE = (
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?"), "PRIVATE KEY-----"),
    ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), "gh"),
    ("gitlab", re.compile(r"glpat-[A-Za-z0-9_-]{20,}"), "glpat-"),
    ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), "xox"),
    ("stripe", re.compile(r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"), "k_"),
    ("google", re.compile(r"AIza[A-Za-z0-9_-]{35}"), "AIza"),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), "eyJ"),
    ("url_login", re.compile(r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,100}:[^\s:/@]{1,100}@"), "://"),
)
ORDER = {kind: k for k, kind in enumerate((*KINDS, *(m[0] for m in MORE)))}
SPANS = "array<struct<kind:string,start:long,stop:long>>"


@dataclass(frozen=True)
class Rules:
    """What is searched for. The version names the rules: changed rules need another one."""

    version: str = "2"
    more: tuple = MORE

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, stop) in code points by start, then kind, then stop."""
        found: list[tuple[str, int, int]] = []
        low = text.encode("utf-8", "replace").lower()
        if any(w in low for w in ASSIGN_WORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [("access", *m.span()) for m in ACCESS.finditer(text)]
        found += [("hex", *m.span()) for m in HEX.finditer(text)]
        for kind, pattern, part in self.more:
            if part in text:
                found += [(kind, *m.span()) for m in pattern.finditer(text)]
        return sorted(found, key=lambda s: (s[1], ORDER.get(s[0], len(ORDER)), s[0], s[2]))


def content(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Ledger:
    """Findings by blob and rule version, in a folder that all executors see."""

    schema = f"blob binary, rule_version string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def exists(self) -> bool:
        jvm, jsc = self.spark._jvm, self.spark._jsc
        place = jvm.org.apache.hadoop.fs.Path(self.path)
        return place.getFileSystem(jsc.hadoopConfiguration()).exists(place)

    def rows(self, version: str) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).where(F.col("rule_version") == version)

    def scan(self, history: DataFrame, rules: Rules, text: str = "text") -> None:
        """Scan and append the contents of `history` that the ledger lacks under these rules."""
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

        def unseen(batch: pa.RecordBatch, seen: set[bytes]) -> pa.RecordBatch:
            """The rows whose content this task has not had."""
            keep = [not (b in seen or seen.add(b)) for b in batch.column(0).to_pylist()]
            return batch.filter(pa.array(keep, pa.bool_()))

        def distinct(batches):
            seen: set[bytes] = set()
            for batch in batches:
                yield unseen(batch, seen)

        def run(batches):
            seen: set[bytes] = set()
            for batch in batches:
                blobs, texts = unseen(batch, seen).columns
                spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in rules.spans(t)] for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([blobs, pa.array([rules.version] * len(spans), pa.string()), pa.array(spans, kind)], ["blob", "rule_version", "spans"])

        blobs = history.select(content(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        blobs = blobs.mapInArrow(distinct, "blob binary, text string").repartition("blob")
        if self.exists():
            # The ledger's side is the one that is hashed: texts are neither sorted nor kept.
            blobs = blobs.join(self.rows(rules.version).select("blob").hint("shuffle_hash"), "blob", "left_anti")
        blobs.mapInArrow(run, self.schema).write.mode("append").parquet(self.path)

    def findings(self, history: DataFrame, keys: list[str], rules: Rules, text: str = "text") -> DataFrame:
        """keys, blob and spans of every row of `history`; null spans where the content was not scanned."""
        known = self.rows(rules.version).dropDuplicates(["blob"]).select("blob", "spans")
        # Contents without findings need no partner: a hot content joins as any other, and few rows are moved.
        return history.select(*keys, content(F.col(text)).alias("blob")).join(known, "blob", "left").select(*keys, "blob", "spans")


def scan_history(history: DataFrame, keys: list[str], ledger_path: str, rules: Rules | None = None, text: str = "text") -> DataFrame:
    """Bring the ledger up to date with `history` and return the findings of all its rows."""
    rules = rules or Rules()
    ledger = Ledger(history.sparkSession, ledger_path)
    ledger.scan(history, rules, text)
    return ledger.findings(history, keys, rules, text)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_history(table(spark, sf_dir, "documents"), ["doc_id"], scratch(spark, "ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
