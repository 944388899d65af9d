"""Duplicates, merges, lookups and the edit log. Orders that the input has only by position are made explicit by
(created_at, id)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.dates import month_index
from tallyweave.functions.money import fixed_text, months_of

FIELDS = ("vendor", "day", "amount", "tax", "category")
#: Rows of folded logs that are handed on at once, about.
ROWS = 4096


def semantic_key(vendor: Column, day: Column, cents: Column) -> Column:
    """vendor|date|amount, or null without an amount."""
    return F.when(cents > 0, F.concat_ws("|", F.lower(F.trim(F.coalesce(vendor, F.lit("")))), F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit("")), fixed_text(cents)))


def first_of(rows: DataFrame, keys: list[str], value: str = "id", order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """rows with `first`: the value of the first row with the same keys. Partial sums, then a join that splits hot keys."""
    first = rows.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("first"))
    return rows.join(first, keys, "left")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(id, duplicate_of): rows that have an earlier sibling with the same keys."""
    return first_of(rows, keys).where("first <> id").select("id", F.col("first").alias("duplicate_of"))


def likely_duplicates(rows: DataFrame) -> DataFrame:
    """(id, duplicate_of, via): receipts of which an earlier one of their batch has the same image, or, only where none has, the same vendor,
    day and whole amount in cents. rows: (id, batch_id, image_hash, vendor, day, amount_cents, created_at)."""
    keyed = rows.withColumn("key", semantic_key(F.col("vendor"), F.col("day"), F.col("amount_cents")))
    image = first_of(keyed, ["batch_id", "image_hash"]).withColumnRenamed("first", "by_image")
    both = first_of(image, ["batch_id", "key"])
    seen, alike = F.when(F.col("by_image") != F.col("id"), F.col("by_image")), F.when(F.col("first") != F.col("id"), F.col("first"))
    found = both.select("id", F.coalesce(seen, alike).alias("duplicate_of"), F.when(seen.isNotNull(), "image").otherwise("details").alias("via"))
    return found.where("duplicate_of is not null")


def last_write_wins(local: DataFrame, remote: DataFrame, key: str, stamp: str) -> DataFrame:
    """The local rows, but where the remote row is newer or there is none."""
    a, b = local.alias("a"), remote.alias("b")
    take = F.col(f"a.{key}").isNull() | (F.col(f"b.{stamp}") > F.col(f"a.{stamp}"))
    pick = [F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in local.columns]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(*pick, F.coalesce(take, F.lit(False)).alias("from_remote"))


def insert_only(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    """The local rows and the remote rows of other keys."""
    return local.unionByName(remote.join(local.select(key), key, "left_anti"))


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.join(present, key, "left_anti")


def fold_name(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def look_up(rows: DataFrame, typed: str, jobs: DataFrame, by: str = "name", give: str = "number") -> DataFrame:
    """rows with the number of the newest saved job of a typed name, or the name of a typed number; blank texts find none. jobs: (name,
    number, saved_at), of which the newest of each name or number count, however many there are: an equality join that
    Spark broadcasts if it is small."""
    newest = jobs.withColumn("_typed", fold_name(F.col(by))).where("_typed <> ''").groupBy("_typed").agg(F.max_by(give, "saved_at").alias(give))
    return rows.withColumn("_typed", fold_name(F.col(typed))).join(newest, "_typed", "left").drop("_typed")


def saved_jobs(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Saved jobs (name, number, saved_at) after changes (name, number, saved_at, removed): of each name, by letters of any case and blanks
    of any number, the latest change or else the job; names that were removed last are gone, and what has neither name nor number is no job.
    The latest are found by partial sums, so a name that changes often is no group in one task."""
    tidy = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")).alias(c)
    every = jobs.withColumn("removed", F.lit(False)).unionByName(changes)
    every = every.select(tidy("name"), tidy("number"), "saved_at", "removed").where("removed or name <> '' or number <> ''")
    latest = F.max_by(F.struct("name", "number", "saved_at", "removed"), F.struct("saved_at", "removed", "name", "number"))
    return every.groupBy(F.lower("name")).agg(latest.alias("j")).where("not j.removed").select("j.name", "j.number", "j.saved_at")


def corrections(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """A row (key, field, old, new) for each of the reviewed fields that changed."""
    text = lambda side, f: F.coalesce(F.col(f"{side}.{f}").cast("string"), F.lit(""))
    changes = F.array(*[F.struct(F.lit(f).alias("field"), text("a", f).alias("old"), text("b", f).alias("new")) for f in FIELDS])
    both = before.alias("a").join(after.alias("b"), key)
    return both.select(key, F.explode(changes).alias("c")).select(key, "c.*").where("old <> new")


def fold_edit(left: list[tuple], e: tuple) -> None:
    """Add an edit (seq, receipt, field, old, new) to the entries left."""
    seq, *place, old, new = e
    if not left or None in (*place, old) or (*left[-1][1:3], left[-1][4]) != (*place, old):
        left.append(e)
        return
    first = left.pop()[3]
    if first is None or first != new:
        left.append((seq, *place, first, new))


def folded_log(log: DataFrame, user: str = "user", most: int = 2000) -> DataFrame:
    """The edit log of each user with runs of edits of one field made one, and edits taken back left out. An edit is only ever
    compared with the last entry left. Rows are (user, seq, receipt, field, old, new); only the latest `most` entries
    stay. A user's edits pass one task in order, a batch at a time; it holds the entries left, not the log."""
    entry = [F.col("seq").cast("long").alias("seq"), F.col("receipt").cast("string").alias("receipt"), "field", "old", "new"]
    rows = log.select(user, *entry).repartition(user).sortWithinPartitions(user, "seq", "receipt", "field", "old", "new")

    def run(batches):
        who, left, out, schema = None, [], [], None
        for batch in batches:
            schema = batch.schema
            for u, *e in zip(*(c.to_pylist() for c in batch.columns)):
                if u != who and (u == u or who == who):
                    out += [(who, *x) for x in left[-most:]]
                    who, left = u, []
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                        out = []
                fold_edit(left, tuple(e))
        out += [(who, *x) for x in left[-most:]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.mapInArrow(run, rows.schema)


def month_runs(rows: DataFrame, key: str, months: str) -> DataFrame:
    """The months of each row as text, with runs of consecutive months as one span."""
    t = rows.select(key, F.explode(months_of(F.col(months))).alias("m")).withColumn("i", month_index(F.col("m")))
    t = t.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    runs = t.groupBy(key, "run").agg(F.min("m").alias("a"), F.max("m").alias("b"))
    day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    full = lambda c: F.date_format(day(F.col(c)), "MMM yyyy")
    same = F.substring("a", 1, 4) == F.substring("b", 1, 4)
    text = F.when(F.col("a") == F.col("b"), full("a")).otherwise(F.concat(F.when(same, F.date_format(day(F.col("a")), "MMM")).otherwise(full("a")), F.lit("–"), full("b")))
    spans = F.array_sort(F.collect_list(F.struct("a", text.alias("text"))))
    return runs.groupBy(key).agg(F.array_join(F.transform(spans, lambda s: s["text"]), ", ").alias("months"))


def unique_names(rows: DataFrame, group: str, name: str) -> DataFrame:
    """Names made unique within a group: the second of a name gets _2, and so on."""
    k = F.row_number().over(Window.partitionBy(group, name).orderBy("created_at", "id"))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(\.[^.]*)?$", 0)
    return rows.withColumn("k", k).withColumn("unique_name", F.when(F.col("k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("k").cast("string"), ext))).drop("k")


def merged_vendors(curated: DataFrame, extra: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """Vendors (name, category, aliases) of both tables by name: the curated name and category win, aliases are joined, unknown
    categories are Other."""
    a, b = (t.withColumn("k", F.lower("name")).groupBy("k").agg(F.first("name").alias(f"{s}n"), F.first("category").alias(f"{s}c"), F.array_distinct(F.flatten(F.collect_list("aliases"))).alias(f"{s}a")) for t, s in ((curated, "a"), (extra, "b")))
    none = F.array().cast("array<string>")
    category = F.coalesce("ac", "bc")
    return a.join(b, "k", "full").select(
        F.coalesce("an", "bn").alias("name"),
        F.when(category.isin(*categories), category).otherwise("Other").alias("category"),
        F.array_sort(F.array_union(F.coalesce("aa", none), F.coalesce("ba", none))).alias("aliases"),
    )
