import random

import pytest

from tallyweave.operators import merge
from tallyweave.streaming import state

LOG = "user long, seq long, receipt string, field string, old string, new string"


def test_streamed_log_is_the_folded_log(spark, tmp_path):
    """In any number of files, and when the stream is started again after half of them."""
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, 3]), k, rng.choice("rq"), "x", rng.choice(["a", "b", None]), rng.choice(["a", "b", None])) for k in range(900)]
    expected = sorted(map(tuple, merge.folded_log(spark.createDataFrame(rows, LOG), most=40).collect()), key=str)
    for name, cuts in (("one", [0, 900]), ("many", [0, 1, 250, 251, 600, 900])):
        folder, out, check = (f"{tmp_path}/{name}-{x}" for x in ("in", "out", "check"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            spark.createDataFrame(rows[a:b], LOG).coalesce(1).write.mode("append").parquet(folder)
            if k % 2 == 1 or b == 900:
                stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)
                state.write_versions(state.stream_folded_log(stream, most=40), out, check)
        assert sorted(map(tuple, state.newest_log(spark, out).collect()), key=str) == expected


def brute(jobs):
    """Second by second: who is free takes the oldest job that is free."""
    open_, busy, done, now = [], [], [], 0
    todo = sorted(jobs)
    while todo or open_ or busy:
        for b in sorted(busy):
            if b[0] == now:
                busy.remove(b)
                _, job, started, arrived, attempts, takes, fate = b
                if fate == "done" or attempts == 2:
                    done.append((job, attempts, fate, started, now))
                else:
                    open_.append((arrived, job, attempts, takes, "done" if fate == "lost" else fate))
        while todo and todo[0][0] == now:
            arrived, job, takes, fate = todo.pop(0)
            open_.append((arrived, job, 0, takes, fate))
        open_.sort()
        while open_ and len(busy) < 2:
            arrived, job, attempts, takes, fate = open_.pop(0)
            busy.append((now + (60_000 if fate == "lost" else takes), job, now, arrived, attempts + 1, takes, fate))
        now += 1000
    return sorted(done)


@pytest.mark.parametrize("files", [1, 5])
def test_queue(spark, tmp_path, files):
    rng = random.Random(9)
    jobs = [(rng.randint(1, 3), 1000 * rng.randint(0, 400), k, 1000 * rng.randint(1, 90), rng.choice(["done", "done", "failed", "lost"])) for k in range(120)]
    jobs.sort(key=lambda j: j[1])
    expected = sorted((q, *r) for q in (1, 2, 3) for r in brute([j[1:] for j in jobs if j[0] == q]))
    kind = "queue long, at long, job long, takes long, fate string"
    table = spark.createDataFrame(jobs, kind).selectExpr("queue", "timestamp_millis(at) as at", "job", "takes", "fate")
    assert sorted(map(tuple, state.replayed_queue(table).collect())) == expected
    step = -(-len(jobs) // files)
    for k in range(0, len(jobs), step):
        spark.createDataFrame(jobs[k : k + step], kind).selectExpr("queue", "timestamp_millis(at) as at", "job", "takes", "fate").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(None, 10**12, None, None, None)], kind).selectExpr("queue", "timestamp_millis(at) as at", "job", "takes", "fate").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = state.finished_jobs(spark, stream)
    assert sorted(map(tuple, found.collect())) == expected
    assert state.replayed_queue(table.where("false")).count() == 0


def test_queue_state_is_put_at_once():
    """However many jobs wait, a batch puts one value and gets one, and the jobs come back as they were."""

    class Value:
        kept, puts = None, 0

        def get(self):
            return self.kept

        def update(self, value):
            self.kept, self.puts = value, self.puts + 1

        def clear(self):
            self.kept = None

    class Handle:
        value = Value()

        def getValueState(self, *_):
            return self.value

        def listTimers(self):
            return iter(())

        def registerTimer(self, at):
            self.at = at

    p = state.QueueProcessor()
    p.init(Handle())
    q = state.Queue([(k, k, 0, 1000, 'lo"st' if k % 2 else "done") for k in range(500)], [(7, 1, 0, 0, 1, 5, "done")])
    p._save(q)
    again = p._load()
    assert Handle.value.puts == 1 and p.handle.at == 7
    assert sorted(again.waiting) == sorted(q.waiting) and again.working == q.working
    p._save(state.Queue())
    assert Handle.value.kept is None and p._load().waiting == []
