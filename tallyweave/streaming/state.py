"""Streams whose operators keep state of their own per key: the work queue and the edit log.

State lives in the checkpoint's store, so a query that is started again with the same checkpoint goes on where it was. Rows of
a micro-batch are taken in their order of time and id, micro-batches as they arrive. Timers are in event time: they fire when
the watermark passes them, never by the wall clock, so a replay gives the same rows.
"""

from __future__ import annotations

import contextlib
import heapq
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyweave.operators.merge import fold_edit
from tallyweave.sources.scratch import scratch

# Receipts at work at once, attempts at each, milliseconds until a lock is stale.
CONCURRENCY, ATTEMPTS, STALE_MS = 2, 2, 60_000
JOB = "job long, arrived long, attempts int, takes long, fate string"
OUTCOME = "job long, attempts int, outcome string, started long, finished long"
ENTRY = "seq long, receipt string, field string, old string, new string"
_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def stored(spark: SparkSession):
    """Streams started within keep state in RocksDB, on disk beside the executor, with its changes in the checkpoint."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


class Queue:
    """One queue: waiting jobs, oldest first, and those at work. An attempt ends done, failed, or lost: then the job's lock holds until it is
    stale. A job that is not done waits again in its old place until its attempts are used up."""

    def __init__(self, waiting: list[tuple] = (), working: list[tuple] = ()):
        #: (arrived, job, attempts, takes, fate)
        self.waiting = list(waiting)
        heapq.heapify(self.waiting)
        #: (end, job, started, arrived, attempts, takes, fate)
        self.working = list(working)
        heapq.heapify(self.working)

    def _claim(self, now: int) -> None:
        while self.waiting and len(self.working) < CONCURRENCY:
            arrived, job, attempts, takes, fate = heapq.heappop(self.waiting)
            length = STALE_MS if fate == "lost" else takes
            heapq.heappush(self.working, (now + length, job, now, arrived, attempts + 1, takes, fate))

    def advance(self, now: int) -> Iterator[tuple]:
        """Outcomes of the attempts that end up to now."""
        while self.working and self.working[0][0] <= now:
            end, job, started, arrived, attempts, takes, fate = heapq.heappop(self.working)
            if fate == "done" or attempts >= ATTEMPTS:
                yield job, attempts, fate, started, end
            else:
                # A worker is lost once at most; the second attempt runs to its end.
                heapq.heappush(self.waiting, (arrived, job, attempts, takes, "done" if fate == "lost" else fate))
            self._claim(end)

    def arrive(self, now: int, job: int, takes: int, fate: str) -> Iterator[tuple]:
        yield from self.advance(now)
        heapq.heappush(self.waiting, (now, job, 0, takes, fate))
        self._claim(now)

    def next_end(self) -> int | None:
        return self.working[0][0] if self.working else None


def _outcomes(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTCOME.split(", ")]
    return pd.DataFrame([(key[0], *r) for r in rows], columns=["queue", *names])


class QueueProcessor(StatefulProcessor):
    """Waiting and working jobs of a queue, each as one value of JSON, which is put and got at once and not job by job, and one timer: when
    the next attempt ends."""

    def init(self, handle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", "waiting string, working string")

    def _load(self) -> Queue:
        return Queue(*([tuple(r) for r in json.loads(rows)] for rows in self.jobs.get() or ("[]", "[]")))

    def _save(self, q: Queue) -> None:
        if q.waiting or q.working:
            self.jobs.update((json.dumps(q.waiting), json.dumps(q.working)))
        else:
            self.jobs.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        if q.next_end() is not None:
            self.handle.registerTimer(q.next_end())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows)).sort_values(["arrived", "job"])
        arrived = arrived[arrived.job.notna()]
        if key[0] is None or not len(arrived):
            return
        q, found = self._load(), []
        for at, job, takes, fate in zip(*(arrived[c].tolist() for c in ("arrived", "job", "takes", "fate"))):
            found += q.arrive(int(at), int(job), int(takes), fate)
        self._save(q)
        if found:
            yield _outcomes(key, found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        q = self._load()
        found = list(q.advance(timerValues.getCurrentWatermarkInMs()))
        self._save(q)
        if found:
            yield _outcomes(key, found)

    def close(self) -> None:
        pass


def stream_queue(arrivals: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """(queue, job, attempts, outcome, started, finished) of a stream (queue, at timestamp, job, takes, fate): outcomes of jobs
    once the watermark has passed their end. A row without a job only moves the watermark."""
    stamped = arrivals.withWatermark("at", delay).withColumn("arrived", F.unix_millis("at"))
    return stamped.groupBy("queue").transformWithStateInPandas(QueueProcessor(), f"queue long, {OUTCOME}", "Append", "EventTime")


def replayed_queue(arrivals: DataFrame) -> DataFrame:
    """The same of a table: each queue's arrivals pass one task in order, which holds the jobs that wait or are at work."""
    rows = arrivals.select("queue", F.unix_millis("at").alias("arrived"), "job", "takes", "fate").where("job is not null and queue is not null")
    rows = rows.repartition("queue").sortWithinPartitions("queue", "arrived", "job")
    end = 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q = None, Queue()
        for batch in batches:
            found = []
            for queue, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if queue != key:
                    found += [(key, *r) for r in q.advance(end)]
                    key, q = queue, Queue()
                found += [(key, *r) for r in q.arrive(*row)]
            yield _batch(found)
        yield _batch([(key, *r) for r in q.advance(end)])

    def _batch(found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 6, kinds)], names=["queue", "job", "attempts", "outcome", "started", "finished"])

    return rows.mapInArrow(run, f"queue long, {OUTCOME}")


class LogProcessor(StatefulProcessor):
    """The entries left of a user's edit log. Only the last entry can still change, so a batch touches what it pops and adds."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.left = handle.getListState("left", ENTRY)
        self.batches = handle.getValueState("batches", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        left = [tuple(r) for r in self.left.get()]
        new = pd.concat(list(rows)).sort_values(["seq", "receipt", "field", "old", "new"])
        new = new.astype(object).where(new.notna(), None)
        for e in zip(*(new[c] for c in ("seq", "receipt", "field", "old", "new"))):
            fold_edit(left, (int(e[0]), *e[1:]))
        left = left[-self.most :]
        self.left.put(left) if left else self.left.clear()
        n = (self.batches.get() or (0,))[0] + 1
        self.batches.update((n,))
        yield pd.DataFrame({"user": [key[0]], "version": [n], "entries": [[dict(zip(("seq", "receipt", "field", "old", "new"), e)) for e in left]]})

    def close(self) -> None:
        pass


def stream_folded_log(log: DataFrame, most: int = 2000) -> DataFrame:
    """(user, version, entries): each user's folded log after every micro-batch that has edits of theirs. Both the state and a row
    are bounded by `most` entries."""
    schema = "user long, version long, entries array<struct<seq:long,receipt:string,field:string,old:string,new:string>>"
    return log.select("user", F.col("seq").cast("long").alias("seq"), "receipt", "field", "old", "new").groupBy("user").transformWithStateInPandas(LogProcessor(most), schema, "Update", "None")


def write_versions(versions: DataFrame, out: str, checkpoint: str) -> None:
    """Append what is new to a table by batch; a batch that is repeated replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with stored(versions.sparkSession):
        versions.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def newest_log(spark: SparkSession, out: str) -> DataFrame:
    """The entries of each user's newest version. Versions are numbered by user, so this needs no batch number."""
    rows = spark.read.parquet(out)
    newest = rows.groupBy("user").agg(F.max_by("entries", "version").alias("entries"))
    return newest.select("user", F.inline("entries"))


def finished_jobs(spark: SparkSession, arrivals: DataFrame, checkpoint: str | None = None, out: str | None = None) -> DataFrame:
    """Run the queue over all that has arrived and read its outcomes."""
    out = out or scratch(spark, "outcomes")
    with stored(spark):
        writer = stream_queue(arrivals).writeStream.outputMode("append").format("parquet").option("path", out)
        writer.option("checkpointLocation", checkpoint or scratch(spark, "queue")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"queue long, {OUTCOME}").parquet(out)
