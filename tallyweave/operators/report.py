"""Reports over receipts. Rows are those of `expenses`; money is in whole cents until it is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.dates import day_text
from tallyweave.functions.money import fixed_text, short_label, units
from tallyweave.functions.text import csv_field, display_category, export_status
from tallyweave.sources.dims import CATEGORIES, STATUSES


def is_open() -> Column:
    return F.col("review_required") & ~F.col("approved")


def taxonomy(category: Column) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), category).cast("int")


def by_category(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"), units(F.sum("amount_cents")).alias("total")).withColumn("place", taxonomy(F.col("category")))


def headline(rows: DataFrame) -> DataFrame:
    n, total = F.count("*"), F.sum("amount_cents")
    return rows.agg(
        n.alias("n"),
        units(F.coalesce(total, F.lit(0))).alias("total"),
        units(F.coalesce(F.sum("tax_cents"), F.lit(0))).alias("tax"),
        F.when(n > 0, units(F.floor(total / n + 0.5))).otherwise(0.0).alias("average"),
        units(F.coalesce(F.max("amount_cents"), F.lit(0))).alias("largest"),
        F.count_if(is_open()).alias("flagged"),
        F.count_distinct(F.when(F.col("amount_cents") > 0, F.col("category"))).alias("categories"),
    )


def top_vendors(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k vendors of highest totals, whatever the case of their names; the first spelling is shown."""
    name = F.coalesce(F.nullif(F.trim("vendor"), F.lit("")), F.lit("—"))
    t = rows.withColumn("name", name).groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("created_at", "id")).alias("vendor"), F.count("*").alias("n"), F.sum("amount_cents").alias("c"))
    top = t.orderBy(F.desc("c"), F.desc("n"), "vendor").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("c"), F.desc("n"), "vendor"))
    return top.select(place.alias("place"), "vendor", "n", units(F.col("c")).alias("total"))


def timeline(rows: DataFrame) -> DataFrame:
    return rows.where("day is not null").groupBy("day").agg(F.count("*").alias("n"), F.sum("amount_cents").alias("c"))


def daily(rows: DataFrame) -> DataFrame:
    return timeline(rows).select("day", "n", units(F.col("c")).alias("total"))


def cumulative(rows: DataFrame) -> DataFrame:
    """Running spend by day: one row per day goes through the single ordering."""
    so_far = F.sum("c").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0))
    return timeline(rows).select("day", units(so_far).alias("so_far"))


def period(rows: DataFrame) -> DataFrame:
    a, b = F.min("day"), F.max("day")
    t = rows.agg(a.alias("a"), b.alias("b"))
    return t.select(F.when(F.col("a").isNull(), "").when(F.col("a") == F.col("b"), day_text(F.col("a"))).otherwise(F.concat(day_text(F.col("a")), F.lit(" – "), day_text(F.col("b")))).alias("period"))


def buckets(rows: DataFrame) -> DataFrame:
    """Spend by month if the days span several years, else by day, with the labels of the chart."""
    days = timeline(rows)
    years = days.agg((F.count_distinct(F.year("day")) > 1).alias("monthly"))
    t = days.join(F.broadcast(years))
    start = F.when(F.col("monthly"), F.trunc("day", "month")).otherwise(F.col("day"))
    t = t.groupBy(start.alias("start"), "monthly").agg(F.sum("c").alias("c"))
    label = F.when(F.col("monthly"), F.concat(F.date_format("start", "MMM"), F.lit(" '"), F.date_format("start", "yy"))).otherwise(F.date_format("start", "MM-dd"))
    return t.select("start", label.alias("label"), units(F.col("c")).alias("total"), short_label(F.col("c")).alias("value_label"))


def share(rows: DataFrame, k: int = 7) -> DataFrame:
    """Whole percents of the k largest categories, of what these have together."""
    t = rows.groupBy("category").agg(F.sum("amount_cents").alias("c")).where("c > 0").orderBy(F.desc("c"), taxonomy(F.col("category"))).limit(k)
    return t.select("category", F.floor(F.col("c") * 100.0 / F.sum("c").over(Window.partitionBy()) + 0.5).cast("long").alias("percent"))


def status_counts(rows: DataFrame) -> DataFrame:
    """One row for each of the statuses, with 0 where there are none."""
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in STATUSES])).alias("status"))
    return every.join(rows.groupBy("status").agg(F.count("*").alias("k")), "status", "left").select("status", F.coalesce("k", F.lit(0)).cast("long").alias("n"))


def main_currency(rows: DataFrame, by: str = "category") -> DataFrame:
    """The most frequent currency of each group; of equally frequent ones that seen first."""
    t = rows.groupBy(by, "currency").agg(F.count("*").alias("n"), F.min(F.struct("created_at", "id")).alias("seen"))
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "seen"))
    return t.withColumn("r", first).where("r = 1").select(by, "currency")


def summary(rows: DataFrame, allowances: DataFrame) -> DataFrame:
    """Subtotals by category, allowances (label, cents), and TOTAL."""
    t = rows.rollup("category").agg(F.sum("amount_cents").alias("c"), F.grouping("category").alias("g"))
    extra = F.coalesce(allowances.agg(F.sum("cents").alias("x")).select("x").scalar(), F.lit(0))
    whole = t.select(F.when(F.col("g") == 1, "TOTAL").otherwise(display_category(F.col("category"))).alias("label"), (F.coalesce("c", F.lit(0)) + F.when(F.col("g") == 1, extra).otherwise(0)).alias("c"))
    return whole.unionByName(allowances.select("label", F.col("cents").alias("c"))).select("label", units(F.col("c")).alias("total"))


def summary_lines(rows: DataFrame) -> DataFrame:
    """Numbered lines of each batch's sections, in the order of days."""
    number = F.row_number().over(Window.partitionBy("batch_id", "category").orderBy(F.col("day").asc_nulls_first(), "created_at", "id"))
    return rows.select("batch_id", taxonomy(F.col("category")).alias("section"), "category", number.alias("line"), "id", "day", units(F.col("amount_cents")).alias("amount"))


def csv_lines(rows: DataFrame) -> DataFrame:
    """The text of each row of the CSV export, with its sort key."""
    fields = (
        display_category(F.col("category")),
        F.coalesce(F.date_format("day", "yyyy-MM-dd"), F.lit("")),
        F.col("vendor"),
        fixed_text(F.col("amount_cents")),
        F.col("currency"),
        F.floor(F.col("confidence") * 100 + 0.5).cast("int").cast("string"),
        export_status(F.col("status"), F.col("review_required"), F.col("approved")),
        F.when(is_open(), "Low confidence — please review.").otherwise(""),
    )
    return rows.select("id", F.concat_ws(",", *[csv_field(f) for f in fields]).alias("line"))


def open_next(rows: DataFrame) -> DataFrame:
    """For each receipt the next of its batch that needs review, from the start again after the last."""
    w = Window.partitionBy("batch_id").orderBy("created_at", "id")
    mark = F.when(is_open(), F.col("id"))
    after = F.first(mark, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    start = F.first(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("batch_id", "id", F.coalesce(after, start).alias("next_open"))


def lanes(rows: DataFrame) -> DataFrame:
    """Receipts by lane of the board; the lanes of work and failures are left out if empty, as groups are."""
    lane = F.when(F.col("status").isin("queued", "processing"), "working").when(F.col("status") == "needs_review", "review").otherwise(F.col("status"))
    return rows.groupBy(lane.alias("lane")).agg(F.count("*").alias("n"))


def within_budget(rows: DataFrame, cap_cents: int) -> DataFrame:
    """Which receipts of a batch, in order, still fit under the cap with all before them."""
    so_far = F.sum("amount_cents").over(Window.partitionBy("batch_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", ((F.lit(cap_cents) <= 0) | (so_far <= cap_cents)).alias("fits"))


def sheet_rows(rows: DataFrame, height: int = 4) -> DataFrame:
    """The sheet row at which each receipt's block begins: heights of all blocks before it in its batch and category."""
    w = Window.partitionBy("batch_id", "category").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select("id", (F.coalesce(F.sum(F.lit(height)).over(w), F.lit(0)) + 3).cast("long").alias("sheet_row"))


def needs_review(rows: DataFrame) -> DataFrame:
    return rows.select("id", ((F.col("confidence") < 0.8) | (F.col("amount_cents") <= 0)).alias("review"))
