"""Streams of receipt events: the latest state of each job, first-seen receipts, and upserts by last write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators.merge import last_write_wins
from tallyweave.sources.scratch import scratch


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a folder or file of events."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)


def run(query_writer, spark: SparkSession) -> None:
    query_writer.option("checkpointLocation", scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each user by time, then id. State holds one row per user."""
    last = F.max_by(F.struct("event_type", "ts"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("l"), F.count("*").alias("events")).select("user_id", F.col("l.event_type").alias("state"), F.col("l.ts").alias("since"), "events")


def first_seen(events: DataFrame, delay: str = "365 days") -> DataFrame:
    """The first arrival of each (user, event type, day); state older than the watermark is dropped."""
    stamped = events.withColumn("at", F.col("ts").cast(T.TimestampType())).withWatermark("at", delay).withColumn("day", F.to_date("ts"))
    return stamped.dropDuplicatesWithinWatermark(["user_id", "event_type", "day"]).select("user_id", "event_type", "day")


def stream_latest_state(spark: SparkSession, path: str) -> DataFrame:
    out = scratch(spark, "states")
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    run(latest_state(read_events(spark, path)).writeStream.outputMode("complete").foreachBatch(write), spark)
    return spark.read.parquet(out)


def stream_first_seen(spark: SparkSession, path: str) -> DataFrame:
    out = scratch(spark, "seen")
    run(first_seen(read_events(spark, path)).writeStream.outputMode("append").format("parquet").option("path", out), spark)
    return spark.read.parquet(out)


def upsert_batches(spark: SparkSession, changes: DataFrame, start: DataFrame, key: str, stamp: str) -> DataFrame:
    """Apply a stream of row versions to a table by last write. Each micro-batch writes a new version of the table, so a batch
    that is repeated after a failure changes nothing."""
    versions = [scratch(spark, "table")]
    start.write.parquet(versions[0])

    def apply(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), F.struct(stamp, *[c for c in batch.columns if c != stamp])).alias("r")).select("r.*")
        path = scratch(spark, f"table-{number}")
        last_write_wins(spark.read.parquet(versions[-1]), newest, key, stamp).drop("from_remote").write.parquet(path)
        versions.append(path)

    run(changes.writeStream.foreachBatch(apply), spark)
    return spark.read.parquet(versions[-1])
