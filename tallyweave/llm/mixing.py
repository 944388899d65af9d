"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Documents start from base rates (1, or a column). The mix nearest to them in token-weighted relative
entropy that meets every source's token target tilts the rates exponentially: a document of source s is
taken min(cap, base * exp(lambda_s)) times. The dual is convex; one row per source holds lambda, and each
Newton iteration evaluates all sources at once over token sums per (source, base rate), which documents
are reduced to beforehand. Targets on several columns (say source and language) overlap: a document's rate is tilted
by the sum of its columns' lambdas, and `joint_tilts` solves them together, with the whole Hessian, over token sums
per cell of the columns. Rates are rounded into whole copies by systematic rounding: within a source,
documents stand by descending size and the running sum of the rates' fractions decides who gets one more.
Large sources are cut into strips by a hash of the document's key and text, so no task orders a whole source; of a few
starting points of the running sum the pair that comes nearest to the source's target is kept. What is then left of
the gap is closed by changing FLIPS documents at most: the largest, and some of all sizes, of the source's first strip,
each by one copy between its rate's two whole neighbours. All subsets of either half of them are summed, and the two sums that
together come nearest to the gap (fewest changes first) are found by one ordering of both lists.

Null text has size 0, as has empty text; null is a source of its own, last in order. Rows of size 0 are
taken 0 words. Repeated rows count each time. An empty table gives no rows. Reruns agree. Extra columns
are kept by `mix` and ignored by the query.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import hash64, materialize, table, word_count

CAP = 3
WEIGHTS = (1, 2, 3)
#: Rows of a source that are ordered in one strip, about.
STRIP_ROWS = 50_000
#: Starting points tried for the running sum, evenly spread over [0, 1): for the largest documents of each
#: strip and for the others, each with each.
STARTS, HEAD_ROWS = 32, 8
#: Documents of a source that may be changed after rounding, in two halves.
FLIPS = 20
TOLERANCE, MAX_ITERATIONS = 1e-12, 50
#: Constraints that are solved jointly: the driver solves a system of as many unknowns.
MOST_JOINT, JOINT_TOLERANCE = 2000, 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, n_rows, source_size, target) from rows (source, size): all words shared by weight, no target
    above cap times its source, the excess reshared by weight. The one ordering of all sources
    handles one row per source."""
    s = sizes.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    s = s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("most", F.col("source_size") * float(cap))
    # Filling water: in the order of most / weight, sources are capped until the level fits the rest.
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("place", F.row_number().over(order))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("place", "level"))
    s = s.withColumn("level", F.min(fits).over(everything)["level"])
    return s.select("source", "n_rows", "source_size", F.coalesce(F.least("most", F.col("level") * F.col("weight")), F.col("most")).alias("target"))


def tilts(groups: DataFrame, targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, n_rows, source_size, target, tilt): the dual solution. groups: (source, base, tokens), one row
    for each base rate of a source."""
    state = targets.withColumn("tilt", F.lit(0.0))
    for _ in range(MAX_ITERATIONS):
        at = groups.join(state.select(F.col("source").alias("s"), "tilt"), F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", F.col("base") * F.exp("tilt"))
        now = at.groupBy("s").agg(
            F.sum(F.col("tokens") * F.least("rate", F.lit(float(cap)))).alias("value"),
            F.sum(F.when(F.col("rate") < cap, F.col("tokens") * F.col("rate")).otherwise(0.0)).alias("slope"),
        )
        gap = F.log(F.col("target")) - F.log(F.col("value"))
        can = (F.col("target") > 0) & (F.col("value") > 0) & (F.col("slope") > 0) & (F.abs(gap) > TOLERANCE)
        # Newton on the logarithm of the dual's gradient, with steps of 2 at most.
        move = F.when(can, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), gap * F.col("value") / F.col("slope")))).otherwise(0.0)
        state = materialize(state.join(now, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("tilt", F.col("tilt") + move).withColumn("moved", F.abs(move)).drop("s", "value", "slope"), "tilts")
        most = state.agg(F.max("moved")).first()[0]
        state = state.drop("moved")
        if not most or most < TOLERANCE:
            break
    else:
        warnings.warn(f"the tilts of sources still move by {most:g} after {MAX_ITERATIONS} iterations", stacklevel=2)
    return state


def joint_tilts(cells: DataFrame, columns: list[str], targets: DataFrame, cap: float = CAP) -> DataFrame:
    """(column, value, target, tilt): the dual solution for targets on several columns. cells: (columns, base, tokens), one
    row for each combination; targets: (column, value, target), value as text or null, for as many values as are
    to be met. Each iteration sums the tilted tokens by constraint and by pair of constraints on the executors; only
    these sums, for MOST_JOINT constraints at most, are on the driver, which takes the Newton step, halved while the dual
    does not fall. Constraints that follow from others are no harm. Targets that contradict each other have no
    solution: a warning names the gap that is left."""
    spark = cells.sparkSession
    rows = targets.select("column", F.col("value").cast("string").alias("value"), F.col("target").cast("double").alias("target")).distinct().limit(MOST_JOINT + 1).collect()
    if len(rows) > MOST_JOINT:
        raise ValueError(f"more than {MOST_JOINT} constraints")
    number = {(r["column"], r["value"]): k for k, r in enumerate(sorted(rows, key=lambda r: (r["column"], r["value"] is None, r["value"] or "")))}
    goal = np.zeros(len(number))
    for r in rows:
        goal[number[r["column"], r["value"]]] = r["target"]
    names = spark.createDataFrame([(c, v, k) for (c, v), k in number.items()], "column string, value string, k int")
    at = cells
    for c in columns:
        of = names.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("k").alias(f"_k_{c}"))
        at = at.join(F.broadcast(of), F.col(c).cast("string").eqNullSafe(F.col("_v")), "left").drop("_v")
    keys = F.array_compact(F.array(*[f"_k_{c}" for c in columns]))
    at = materialize(at.select(keys.alias("keys"), "base", "tokens").groupBy("keys", "base").agg(F.sum("tokens").alias("tokens")), "cells")

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The dual, the tilted tokens by constraint, and their slopes by pair of constraints."""
        tilts = F.array(*[F.lit(float(v)) for v in x])
        s = F.aggregate("keys", F.lit(0.0), lambda a, k: a + F.get(tilts, k))
        t = at.withColumn("s", s).withColumn("rate", F.col("base") * F.exp("s")).withColumn("edge", F.log(F.lit(float(cap)) / F.col("base")))
        free = F.col("rate") < cap
        potential = F.when(free, F.col("rate")).otherwise(cap * (1 + F.col("s") - F.col("edge")))
        t = t.select("keys", (F.col("tokens") * potential).alias("p"), (F.col("tokens") * F.least("rate", F.lit(float(cap)))).alias("g"), F.when(free, F.col("tokens") * F.col("rate")).otherwise(0.0).alias("h"))
        pairs = F.flatten(F.transform("keys", lambda i: F.transform("keys", lambda j: F.struct(i.alias("i"), j.alias("j")))))
        sums = t.select("p", "g", "h", F.explode(F.concat(F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j"))), pairs)).alias("ij")).groupBy("ij.i", "ij.j").agg(F.sum("p").alias("p"), F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        gradient, hessian, dual = np.zeros(len(goal)), np.zeros((len(goal), len(goal))), 0.0
        for r in sums:
            if r["i"] < 0:
                dual = r["p"]
            else:
                hessian[r["i"], r["j"]] = r["h"]
                if r["i"] == r["j"]:
                    gradient[r["i"]] = r["g"]
        return dual - float(goal @ x), gradient, hessian

    x, scale = np.zeros(len(goal)), max(1.0, float(np.abs(goal).max(initial=0.0)))
    dual, value, slope = evaluate(x)
    for _ in range(MAX_ITERATIONS):
        gap = goal - value
        if np.abs(gap).max(initial=0.0) <= JOINT_TOLERANCE * scale:
            break
        step = np.linalg.lstsq(slope + np.eye(len(goal)) * scale * 1e-12, gap, rcond=1e-10)[0]
        step *= min(1.0, 2.0 / max(1e-300, float(np.abs(step).max())))
        for _ in range(30):
            lower, *rest = evaluate(x + step)
            if lower <= dual + 1e-12 * abs(dual):
                break
            step /= 2
        x, dual, (value, slope) = x + step, lower, rest
    else:
        warnings.warn(f"the tilted tokens are still {np.abs(goal - value).max():g} from their targets after {MAX_ITERATIONS} iterations", stacklevel=2)
    return spark.createDataFrame([(c, v, float(goal[k]), float(x[k])) for (c, v), k in number.items()], "column string, value string, target double, tilt double")


def joint_rates(rows: DataFrame, columns: list[str], targets: DataFrame, cap: float = CAP) -> DataFrame:
    """rows (columns, size, base, ...) with `rate`, so that the tokens of each value in targets (column, value, target) sum to
    its target. A value without a target is not tilted. At most MOST_JOINT rows are broadcast."""
    cells = rows.where("size > 0").groupBy(*columns, "base").agg(F.sum("size").cast("double").alias("tokens"))
    found = materialize(joint_tilts(cells, columns, targets, cap), "joint")
    for c in columns:
        of = found.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("tilt").alias(f"_tilt_{c}"))
        rows = rows.join(F.broadcast(of), F.col(c).cast("string").eqNullSafe(F.col("_v")), "left").drop("_v")
    tilt = reduce(add, [F.coalesce(f"_tilt_{c}", F.lit(0.0)) for c in columns])
    return rows.withColumn("rate", F.least(F.col("base") * F.exp(tilt), F.lit(float(cap)))).drop(*[f"_tilt_{c}" for c in columns])


def copies_for(rate: Column, before: Column, start: Column) -> Column:
    """Whole copies of a document whose strip has a running fraction of `before` ahead of it."""
    part = rate - F.floor(rate)
    return F.floor(rate) + F.floor(before + part + start) - F.floor(before + start)


def mix_sizes(rows: DataFrame, key: str, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """rows (key, source, size, base, text_hash) with source_size, target and copies."""
    targets = materialize(source_targets(rows, weights, cap), "targets")
    groups = materialize(rows.where("size > 0").groupBy("source", "base").agg(F.sum("size").cast("double").alias("tokens")), "groups")
    solved = tilts(groups, targets, cap)
    t = solved.withColumnRenamed("source", "s")
    r = rows.join(t, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    r = r.withColumn("strip", F.pmod(hash64(F.col(key), F.col("text_hash")), F.ceil(F.col("n_rows") / STRIP_ROWS)))
    # Rates a hair off a whole number by the exponential are that number.
    rate = F.least(F.col("base") * F.exp("tilt"), F.lit(float(cap)))
    r = r.withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-9, F.round(rate)).otherwise(rate))
    strip = Window.partitionBy("source", "strip")
    order = strip.orderBy(F.col("size").desc(), key, "text_hash")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("before", F.coalesce(F.sum(F.col("rate") - F.floor("rate")).over(so_far), F.lit(0.0)))
    r = r.withColumn("place", F.row_number().over(order)).withColumn("step", F.ceil(F.count("*").over(strip) / (FLIPS - HEAD_ROWS)))
    r = materialize(r.withColumn("head", F.col("place") <= HEAD_ROWS), "rates")
    starts = [k / STARTS for k in range(STARTS)]

    def words(which: Column, start: float) -> Column:
        return F.coalesce(F.sum(F.when(which, copies_for(F.col("rate"), F.col("before"), F.lit(start)) * F.col("size"))), F.lit(0))

    heads, rests = (F.array(*[F.struct(words(which, x).alias("words"), F.lit(x).alias("start")) for x in starts]) for which in (F.col("head"), ~F.col("head")))
    taken = r.groupBy("source").agg(F.first("target").alias("t"), heads.alias("heads"), rests.alias("rests"))

    def pair(h: Column, x: Column) -> Column:
        gap = F.col("t") - h["words"] - x["words"]
        return F.struct(F.abs(gap).alias("off"), h["start"].alias("head_start"), x["start"].alias("rest_start"), gap.alias("gap"))

    pairs = F.flatten(F.transform("heads", lambda h: F.transform("rests", lambda x: pair(h, x))))
    best = materialize(taken.select(F.col("source").alias("s"), F.array_min(pairs).alias("best")), "starts")
    out = r.join(best, F.col("source").eqNullSafe(F.col("s")))
    start = F.when(F.col("head"), F.col("best.head_start")).otherwise(F.col("best.rest_start"))
    most = int(math.floor(cap))
    copies = F.when(F.col("size") > 0, copies_for(F.col("rate"), F.col("before"), start)).otherwise(0)
    out = out.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    changed = materialize(changes(out, most), "changes")
    out = out.drop("s").join(changed, F.col("source").eqNullSafe(F.col("s")), "left")
    mine = (F.col("strip") == F.col("at")) & F.array_contains("places", F.col("place"))
    change = F.when(mine, one_copy(most)).otherwise(0)
    return out.select(key, "source", "size", "source_size", "target", "rate", "text_hash", (F.col("copies") + change).alias("copies"))


def one_copy(most: int) -> Column:
    """+1 or -1 for a document that may go to its rate's other whole neighbour, else 0."""
    low = F.floor("rate")
    may = (F.col("size") > 0) & (F.col("rate") > low)
    return F.when(may & (F.col("copies") > low), -1).when(may & (F.col("copies") < most), 1).otherwise(0)


def changes(out: DataFrame, most: int) -> DataFrame:
    """(s, at, places): of each source whose words miss the target, the strip and places of the documents to change by
    one copy. Only FLIPS documents of a source and 2 ** (FLIPS / 2) sums of either half are ever in one group."""
    half = FLIPS // 2
    some = out.where((F.col("best.off") >= 0.5) & (F.col("head") | (F.col("place") % F.col("step") == 0)))
    some = some.withColumn("change", one_copy(most) * F.col("size")).where("change <> 0")
    item = F.struct("place", "change")
    # The least strip that has any; within it the places are few and stand in order.
    by_strip = some.groupBy("source", "strip", F.col("best.gap").alias("gap")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    lists = by_strip.groupBy("source", "gap").agg(F.min(F.struct("strip", "items")).alias("one")).select("source", "gap", F.col("one.strip").alias("at"), F.slice("one.items", 1, FLIPS).alias("items"))
    # Large and small documents alternate between the halves.
    lists = materialize(lists.withColumn("a", F.filter("items", lambda x, i: i % 2 == 0)).withColumn("b", F.filter("items", lambda x, i: i % 2 == 1)), "flips")

    def sums(name: str) -> DataFrame:
        masks = F.sequence(F.lit(0), F.shiftleft(F.lit(1), half) - 1)
        of = lists.select("source", "gap", name, F.explode(F.filter(masks, lambda m: m < F.pow(F.lit(2), F.size(name)))).alias("mask"))
        total = F.aggregate(F.transform(name, lambda x, i: x["change"] * F.getbit("mask", i).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
        return of.select("source", "gap", total.cast("double").alias("total"), F.struct(F.bit_count("mask").alias("n"), F.col("mask").alias("m")).alias("mask"))

    # Of equal sums the fewest changes; then each sum of one half meets the nearest of the other on either side.
    least = [sums(name).groupBy("source", "gap", "total").agg(F.min("mask").alias("mask")) for name in ("a", "b")]
    nothing = F.lit(None).cast(least[0].schema["mask"].dataType)
    a = least[0].select("source", "gap", F.col("total").alias("v"), F.col("mask").alias("a"), nothing.alias("b"))
    b = least[1].select("source", "gap", (F.col("gap") - F.col("total")).alias("v"), nothing.alias("a"), F.col("mask").alias("b"))
    by = Window.partitionBy("source").orderBy("v", F.col("a").isNotNull())
    at = F.when(F.col("b").isNotNull(), F.struct("v", "b"))
    both = a.unionByName(b).withColumn("below", F.last(at, ignorenulls=True).over(by)).withColumn("above", F.first(at, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing)))
    near = both.where("a is not null").select("source", "gap", "a", "v", F.explode(F.array_compact(F.array("below", "above"))).alias("other"))
    off = F.abs(F.col("v") - F.col("other.v"))
    found = near.select("source", "gap", F.struct(off.alias("off"), (F.col("a.n") + F.col("other.b.n")).alias("n"), F.col("a.m").alias("a"), F.col("other.b.m").alias("b")).alias("found"))
    found = found.groupBy("source", "gap").agg(F.min("found").alias("found")).where(F.col("found.off") < F.abs("gap"))
    chosen = F.concat(F.filter("a", lambda x, i: F.getbit("found.a", i) == 1), F.filter("b", lambda x, i: F.getbit("found.b", i) == 1))
    halves = lists.select(F.col("source").alias("s"), "at", "a", "b")
    return found.join(halves, F.col("source").eqNullSafe(F.col("s"))).select("s", "at", F.transform(chosen, lambda x: x["place"]).alias("places"))


def sized(docs: DataFrame, key: str = "doc_id", base: Column | None = None) -> DataFrame:
    return materialize(docs.select(key, "source", word_count(F.col("text")).alias("size"), (F.lit(1.0) if base is None else base.cast("double")).alias("base"), F.xxhash64("text").alias("text_hash")), "sizes")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = mix_sizes(sized(table(spark, sf_dir, "documents")), "doc_id")
    return r.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
