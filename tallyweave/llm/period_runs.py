"""Runs: maximal stretches of words that repeat with a period, by Crochemore's partition refinement.

At level l two positions are in one class if their factors of l words are equal. Classes of level l + 1 come from those of level l
by splitting off the predecessors of the classes that were split off last, each time leaving out the largest part of
a class (the smaller-half strategy: a position is in a part that is used O(log n) times). Every position knows the next one of its class.
Where that is l words on at level l, the 2 l words from there are a square whose half is no repetition; squares of one period at
neighbouring places are one run.

All texts of a batch are refined together, level by level, on arrays: a text's last position, an end mark, is a class of its
own, so equal factors never cross texts. One text is never cut; memory is in proportion to the batch's words or the largest text.

Defined results: words are `[^\\x20\\x09-\\x0D]+`, compared by bytes. A null or empty text has no words and no runs; rows are
judged alone, whatever their ids or repetitions; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import SPACE, release, table, word_count

#: Least length of a run, in words.
LEAST = 12
#: Bytes of texts that are refined together.
BATCH = 12 << 20


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + size[0] - 1, start[1] .. and so on."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in any key."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


class Refinement:
    """Classes of equal factors of a batch of sequences, and the squares found while they are refined."""

    def __init__(self, symbol: np.ndarray, text: np.ndarray):
        """Symbols and texts by position; the last position of each text has a symbol that is nowhere else in it."""
        n = len(symbol)
        self.text = text
        self.level = 1
        self.member = np.lexsort((symbol, text))  # positions by class: those of a class lie together
        new = _starts(text[self.member], symbol[self.member])
        first = np.flatnonzero(new)
        self.classes = len(first)
        self.of = np.empty(n, np.int64)
        self.of[self.member] = np.cumsum(new) - 1
        self.slot = np.empty(n, np.int64)
        self.slot[self.member] = np.arange(n)
        self.first = np.zeros(n + 1, np.int64)
        self.first[: len(first)] = first
        self.size = np.zeros(n + 1, np.int64)
        self.size[: len(first)] = np.diff(np.append(first, n))
        self.next = np.full(n, -1, np.int64)
        self.before = np.full(n, -1, np.int64)
        inner = ~new[1:]
        a, b = self.member[:-1][inner], self.member[1:][inner]
        self.next[a], self.before[b] = b, a
        #: The level from which on `next` is what it is.
        self.since = np.ones(n, np.int64)
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []
        classes = np.arange(self.classes)
        self.small = self._all_but_largest(text[self.member[first]], classes)

    def _all_but_largest(self, whole: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """Of parts sorted by the whole that they are of, all but a largest of each."""
        order = np.lexsort((self.size[parts], whole))
        whole, parts = whole[order], parts[order]
        return parts[np.append(whole[1:] == whole[:-1], False)] if len(parts) else parts

    def _moved_on(self, at: np.ndarray, to: np.ndarray) -> None:
        """The next position of `at`'s class is another one from this level on."""
        gap = self.next[at] - at
        found = (self.since[at] <= gap) & (gap < self.level)
        if found.any():
            self.squares.append((at[found], gap[found]))
        self.next[at] = to
        self.since[at] = self.level

    def refine(self) -> bool:
        """Go on by a level; false if no class changes any more."""
        size = self.size[self.small]
        split = self.member[self.first[self.small] if size.max(initial=0) == 1 else _ranges(self.first[self.small], size)]
        split = split[split > 0]
        at = split - 1
        fit = (self.text[at] == self.text[split]) & (self.size[self.of[at]] > 1)
        at, by = at[fit], self.of[split[fit]]
        if not len(at):
            return False
        old = self.of[at]
        order = np.lexsort((at, old))
        at, by, old = at[order], by[order], old[order]
        self.level += 1
        if (old[1:] != old[:-1]).all():
            self._split_off(at, old)
            return True
        # Classes that go as a whole to one part stay as they are.
        head = np.flatnonzero(_starts(old))
        count = np.diff(np.append(head, len(old)))
        whole = (count == self.size[old[head]]) & (np.minimum.reduceat(by, head) == np.maximum.reduceat(by, head))
        if whole.any():
            stay = np.repeat(whole, count)
            at, by, old = at[~stay], by[~stay], old[~stay]
            if not len(at):
                self.small = self.small[:0]
                return False
            head = np.flatnonzero(_starts(old))
            count = np.diff(np.append(head, len(old)))
        touched = old[head]
        # Take the positions out of their old lists: stretches of neighbours at once.
        loose = np.ones(len(at), bool)
        loose[1:] = (old[1:] != old[:-1]) | (self.next[at[:-1]] != at[1:])
        begin = np.flatnonzero(loose)
        left, right = self.before[at[begin]], self.next[at[np.append(begin[1:], len(at)) - 1]]
        self._moved_on(left[left >= 0], right[left >= 0])
        self.before[right[right >= 0]] = left[right >= 0]
        # Put them into the lists of their new classes.
        order = np.lexsort((at, by, old))
        at, by, old = at[order], by[order], old[order]
        new = _starts(old, by)
        after = np.full(len(at), -1, np.int64)
        after[:-1][~new[1:]] = at[1:][~new[1:]]
        change = self.next[at] != after
        self._moved_on(at[change], after[change])
        ahead = np.full(len(at), -1, np.int64)
        ahead[1:][~new[1:]] = at[:-1][~new[1:]]
        self.before[at] = ahead
        # They take the last slots of their old class; who was there takes the slots that they leave.
        target = _ranges(self.first[touched] + self.size[touched] - count, count)
        free = self.slot[at]
        taken = np.zeros(len(at), bool)
        low = np.repeat(self.first[touched] + self.size[touched] - count, count)
        inside = free >= low
        taken[(np.repeat(np.cumsum(count) - count, count) + free - low)[inside]] = True
        out = self.member[target[~taken]]
        left_slot = free[~inside]
        self.member[left_slot], self.slot[out] = out, left_slot
        self.member[target], self.slot[at] = at, target
        # Number the new classes. If nothing is left of the old one, its number goes to the first of them.
        begin = np.flatnonzero(new)
        part_size = np.diff(np.append(begin, len(at)))
        part_of = old[begin]
        emptied = _starts(part_of) & (np.repeat(count == self.size[touched], np.diff(np.append(np.flatnonzero(_starts(part_of)), len(part_of)))))
        number = np.where(emptied, part_of, self.classes + np.cumsum(~emptied) - 1)
        self.classes += int((~emptied).sum())
        rest = self.size[touched] - count
        self.size[touched] = rest
        self.first[number] = target[begin]
        self.size[number] = part_size
        self.of[at] = np.repeat(number, part_size)
        some = rest > 0
        self.small = self._all_but_largest(np.concatenate([part_of, touched[some]]), np.concatenate([number, touched[some]]))
        return True

    def _split_off(self, at: np.ndarray, old: np.ndarray) -> None:
        """Each position leaves its class of two or more alone, at most one from each: nearly all of the high levels."""
        left, right = self.before[at], self.next[at]
        changed, to = np.concatenate([left, at]), np.concatenate([right, np.full(len(at), -1)])
        some = changed >= 0
        changed, to = changed[some], to[some]
        some = self.next[changed] != to
        self._moved_on(changed[some], to[some])
        self.before[right[right >= 0]] = left[right >= 0]
        self.before[at] = -1
        size = self.size[old] - 1
        last, free = self.first[old] + size, self.slot[at]
        out = self.member[last]
        self.member[free], self.slot[out] = out, free
        self.member[last], self.slot[at] = at, last
        self.size[old] = size
        self.small = np.arange(self.classes, self.classes + len(at))
        self.classes += len(at)
        self.first[self.small], self.size[self.small], self.of[at] = last, 1, self.small


def find_runs(symbol: np.ndarray, text: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of `least` or more symbols, by start, then period."""
    if not len(symbol):
        return (np.zeros(0, np.int64),) * 3
    r = Refinement(symbol, text)
    most = int(np.bincount(text).max()) // 2
    # A square of period q is known once level q has passed.
    while r.level <= most and r.refine():
        pass
    gap = r.next - np.arange(len(symbol))
    rest = np.flatnonzero((r.since <= gap) & (gap <= r.level))
    squares = [*r.squares, (rest, r.next[rest] - rest)]
    at, period = (np.concatenate([s[i] for s in squares]) for i in (0, 1))
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    head = np.flatnonzero(new)
    start, period = at[head], period[head]
    length = np.diff(np.append(head, len(at))) - 1 + 2 * period
    keep = length >= least
    start, length, period = start[keep], length[keep], period[keep]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _batch(texts: pa.Array, least: int) -> tuple[pa.Array, pa.Array]:
    # A blank in front makes the first piece of every text empty: it becomes the end mark of the text before.
    words = pc.ascii_split_whitespace(pc.binary_join_element_wise(" ", texts.fill_null(""), " ", ""))
    flat = words.flatten().dictionary_encode()
    vocabulary = np.array(flat.dictionary.to_pylist(), object)
    kind = flat.indices.to_numpy()
    filled = np.array([bool(w) for w in vocabulary], bool)[kind] if len(kind) else np.zeros(0, bool)
    offset = words.offsets.to_numpy() - words.offsets[0].as_py()
    count = np.diff(np.concatenate([[0], np.cumsum(filled)])[offset])
    kind = kind[filled]
    # Positions: each text's words and an end mark.
    text = np.repeat(np.arange(len(count)), count + 1)
    base = np.concatenate([[0], np.cumsum(count + 1)])
    is_word = np.ones(len(text), bool)
    is_word[base[1:] - 1] = False
    symbol = np.full(len(text), len(vocabulary), np.int64)
    symbol[is_word] = kind
    start, length, period = find_runs(symbol, text, least)
    drop = np.zeros(len(text) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    kept = (np.cumsum(drop)[:-1] == 0) & is_word
    edge = np.searchsorted(start, base)
    run = pa.StructArray.from_arrays([pa.array(start - base[text[start]]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), run)
    collapsed = [" ".join(vocabulary[symbol[a:b][kept[a:b]]]) for a, b in zip(base[:-1], base[1:])]
    return runs, pa.array(collapsed, pa.string())


def _runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + BATCH, side="right")))
            part = batch.slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *_batch(part.column("text"), least)], names=["doc_id", "runs", "collapsed"])
            begin = end
    release()


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): every row's runs by start, then period, and its words without those that a run contains after its
    first period, joined by one space. Nothing is shuffled."""
    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _runs(b, least), schema)


def damaged(docs: DataFrame) -> DataFrame:
    """Texts, every tenth of them by its id made periodic from some word on. A null id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string"))
    n = word_count(F.col("text"))
    words = F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "")
    a, g = F.col("a"), F.col("g")
    shape = docs.select("doc_id", "text", n.alias("n"), F.floor(h / 10).alias("g"), ((h % 10 == 0) & (n > 0)).alias("hit"))
    shape = shape.select("*", F.when(F.col("hit"), F.col("g") % F.col("n")).alias("a")).select("*", F.when(F.col("hit"), 1 + F.floor((F.col("n") - a) / (3 + g % 8))).alias("p"))

    def repeated(w: Column) -> Column:
        tail = F.slice(w, (a + 1).cast("int"), F.col("p").cast("int"))
        # Whole periods, and what is left of one.
        rest = F.slice(tail, F.lit(1), ((F.col("n") - a) % F.col("p")).cast("int"))
        return F.concat(F.slice(w, F.lit(1), a.cast("int")), F.flatten(F.array_repeat(tail, F.floor((F.col("n") - a) / F.col("p")).cast("int"))), rest)

    return shape.select("doc_id", F.when(F.col("hit"), F.array_join(repeated(words), " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the runs of every document, some made periodic."""
    found = runs(damaged(table(spark, sf_dir, "documents")))
    # The greatest length, then the smallest start, then the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = found.select("doc_id", "collapsed", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"))
    start, period = -F.col("best.s"), -F.col("best.p")
    return told.select(
        "doc_id", "n_runs", start.alias("start"), F.col("best.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("best.length") / period).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
