"""Files on the way in and out: which uploads a batch takes, and the report as CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The intake's limits and types, and the heads of the report's columns.
MOST_FILES, MOST_BYTES = 200, 25 * 1024 * 1024
TYPES = ("image/jpeg", "image/png", "image/webp", "image/heic", "image/heif", "application/pdf")
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp", ".heic", ".heif", ".pdf")
HEADERS = ("Category", "Date", "Vendor", "Amount", "Currency", "Confidence", "Status", "Notes")
BOM = "\ufeff"


def base_name(name: Column) -> Column:
    """A file's name without folders and control characters; `file` if nothing is left."""
    last = F.regexp_replace(F.coalesce(name, F.lit("")), r"^.*[/\\]", "")
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(last, r"[\x00-\x1f\x7f]", "")), F.lit("")), F.lit("file"))


def refusal(name: Column, mime: Column, size: Column) -> Column:
    """Why a file is refused, or null: neither its type nor its extension is one that is read; it is empty; it is too large."""
    typed = F.lower(F.coalesce(mime, F.lit(""))).isin(*TYPES) | F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"\.[^.]*$", 0).isin(*EXTENSIONS)
    return F.when(~typed, "type").when(F.coalesce(size, F.lit(0)) <= 0, "empty").when(size > MOST_BYTES, "size")


def intake(files: DataFrame, taken: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """files (batch_id, file_id, name, mime, size, at) with their base name and `refused`: type, empty, size, full, or null for those taken.

    A batch takes `most` files with those it has (taken: batch_id, n), in the order of arrival; refused files take no place. The
    last place of each batch is found by a limited ranking, which keeps `most` rows of a batch before the shuffle, and all
    files are held against it by a join, so a batch of any size is no group in one task. Files of no batch are refused as such."""
    checked = files.withColumn("refused", F.when(F.col("batch_id").isNull(), "batch").otherwise(refusal(F.col("name"), F.col("mime"), F.col("size"))))
    checked = checked.withColumn("arrival", F.struct("at", "file_id"))
    place = F.row_number().over(Window.partitionBy("batch_id").orderBy("at", "file_id"))
    first = checked.where("refused is null").select("batch_id", "at", "file_id", "arrival").withColumn("place", place).where(F.col("place") <= most)
    free = first.join(taken.groupBy("batch_id").agg(F.max("n").alias("n")), "batch_id", "left").where(F.col("place") <= F.lit(most) - F.coalesce("n", F.lit(0)))
    last = free.groupBy("batch_id").agg(F.max("arrival").alias("last"))
    held = checked.join(last, "batch_id", "left")
    full = F.col("refused").isNull() & (F.col("last").isNull() | (F.col("arrival") > F.col("last")))
    return held.withColumn("refused", F.when(full, "full").otherwise(F.col("refused"))).withColumn("name", base_name(F.col("name"))).drop("arrival", "last")


def write_report(lines: DataFrame, folder: str) -> None:
    """Lines (id, day, line) as a CSV file in parts that are read one after the other: by day, nulls first, then id; a byte order mark and the
    heads come first, every line ends with CR LF. Spark's committer keeps one copy of each part, however often its task runs."""
    head = lines.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit(None).cast("date").alias("day"), F.lit(None).cast("long").alias("id"), F.lit(BOM + ",".join(HEADERS)).alias("line"))
    rows = head.unionByName(lines.select(F.lit(1).alias("rank"), "day", F.col("id").cast("long").alias("id"), "line"))
    rows.orderBy("rank", "day", "id").select("line").write.option("lineSep", "\r\n").text(folder)


def read_report(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of report files, what is empty as an empty text: quoted fields may hold commas, quotes and line ends, of which CR LF is read
    as LF. Heads and byte order marks are left out. A part is read by one task, as its line ends can't be told from those in fields. What ends
    a row is stated: the reader would guess it from the first line end of each part, which may be one in a field."""
    schema = ", ".join(f"`{h.lower()}` string" for h in HEADERS)
    rows = spark.read.schema(schema).csv(folder, multiLine=True, lineSep="\r\n", escape='"', quote='"', emptyValue="")
    rows = rows.select(*[F.coalesce(F.replace(h.lower(), F.lit("\r\n"), F.lit("\n")), F.lit("")).alias(h.lower()) for h in HEADERS])
    first = F.ltrim(F.translate(F.col("category"), BOM, ""))
    return rows.where(~((first == HEADERS[0]) & (F.col("notes") == HEADERS[-1])))
