"""Benchmark decontamination by SimHash of item-sized windows, Hamming blocks and exact weighted-shingle similarity.

A gate comes first: items' word shingles are in an index, from shingle to items, and only texts that share enough
weight of shingles with an item have windows to look at, those as long as the item that hold one of its shingles.
These windows are fingerprinted (SimHash of 64 bits, by prefix sums over the shingles' weighted bits) and looked up in a
multi-index of the items of that length: a fingerprint within RADIUS bits of an item's agrees with it, but for at most
RADIUS // BLOCKS bits, in one of BLOCKS blocks of 16 bits, so all items within the radius are found. Each candidate is
verified on the shingles themselves: the weighted Jaccard similarity of the two multisets must reach SIMILARITY. A
shingle weighs as much as its words have bytes.

Windows of similarity 0.8 may be further apart than RADIUS, most of all where a shingle repeats. So an exact arm adds what
the lookup leaves: windows that are no candidates get an upper bound of what they have in common with the item, the weight
of their shingles that it has, by prefix sums, and are verified if the bound allows SIMILARITY. The bound is
never below the common weight, so nothing is lost. `n_far` counts the windows that only this arm found:
1 - n_far / n_windows, over all rows, is the recall of the lookup. `distance` is that of the best window's SimHash.

Documents are read once, without a shuffle. Items go to the executors in blocks of BLOCK_ITEMS, one pass over
the documents per block, so what is broadcast is bounded whatever the benchmark's size.

Items without words match nothing; items of fewer words than a shingle are one shingle of all their words. A document
shorter than an item is one window. Null and empty texts have no windows. Repeated rows and repeated items give
repeated rows; windows of equal similarity tie by their place. Empty tables give no rows. Extra columns are
dropped by `matches` and kept by `clean`.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import forget, release, table
from tallyweave.llm.shingles import shingles, word_table

K, SIMILARITY, RADIUS = 5, 0.8, 15
BLOCKS, BLOCK_BITS, BLOCK_ITEMS = 4, 16, 1000
#: Rows that are hashed at once, windows that are fingerprinted at once, bits of the first test of a shingle, what sums of
#: weights may be off by.
ROWS, WINDOWS, TEST_BITS, SLACK = 2000, 4000, 20, 1e-9
BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def weights(sizes: np.ndarray, k: int) -> np.ndarray:
    """Bytes of the words of each shingle."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    return (total[k:] - total[:-k]).astype(np.float64)


def sign_bits(shingle: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle."""
    return ((shingle[:, None] & BITS) != 0) * 2.0 - 1.0


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0) * BITS).sum(axis=1, dtype=np.uint64)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def multiset(shingle: np.ndarray, weight: np.ndarray) -> dict[int, float]:
    """The weight of each distinct shingle, by how often it occurs."""
    kinds, at = np.unique(shingle, return_inverse=True)
    return dict(zip(kinds.tolist(), np.bincount(at, weight).tolist()))


def similarity(a: dict[int, float], b: dict[int, float]) -> float:
    """Weighted Jaccard similarity."""
    common = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return common / (sum(a.values()) + sum(b.values()) - common)


@dataclass
class Length:
    """The items of one number of words."""

    words: int
    width: int
    items: np.ndarray
    prints: np.ndarray


class Benchmark:
    """One block of items, with the index of their fingerprints."""

    def __init__(self, ids: list, texts: list[str | None]):
        words, sizes, at = word_table(pa.array(texts, pa.string()))
        self.ids, self.sets, prints = ids, [], np.zeros(len(ids), np.uint64)
        by_words: dict[int, list[int]] = {}
        known: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, (a, b) in enumerate(zip(at[:-1], at[1:])):
            if a == b:
                self.sets.append({})
                continue
            width = min(K, b - a)
            s, w = shingles(words[a:b], width), weights(sizes[a:b], width)
            self.sets.append(multiset(s, w))
            prints[k] = fingerprints((sign_bits(s) * w[:, None]).sum(axis=0)[None])[0]
            by_words.setdefault(int(b - a), []).append(k)
            kinds = np.unique(s)
            known.setdefault(int(width), []).append((kinds, np.full(len(kinds), k)))
        # Of each width: shingles in order, where each one's items begin (and the last ends), and the items.
        self.known, self.holders = {}, {}
        for width, some in known.items():
            s, k = (np.concatenate(x) for x in zip(*some))
            order = np.argsort(s, kind="stable")
            self.known[width], first = np.unique(s[order], return_index=True)
            self.holders[width] = np.append(first, len(s)), k[order]
        self.sizes = np.array([sum(x.values()) for x in self.sets])
        self.words = np.diff(at)
        self.lengths = [Length(n, min(K, n), np.array(items), prints[items]) for n, items in sorted(by_words.items())]
        self.prints = prints
        # Of each item: the number of its length, and its place among the items of the length.
        self.length_of, self.place_of = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for n, x in enumerate(self.lengths):
            self.length_of[x.items], self.place_of[x.items] = n, np.arange(len(x.items))

    @cached_property
    def index(self) -> list:
        """Of each length and block: values in order, and the item that each is near to."""
        near = [sum(1 << b for b in bits) for r in range(RADIUS // BLOCKS + 1) for bits in itertools.combinations(range(BLOCK_BITS), r)]
        near = np.array(near, np.uint16)
        return [[self.near_values(x, j, near) for j in range(BLOCKS)] for x in self.lengths]

    def near_values(self, x: Length, block: int, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (self.block(x.prints, block)[:, None] ^ near).ravel()
        owner = np.repeat(np.arange(len(x.items), dtype=np.int32), len(near))
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    @staticmethod
    def block(prints: np.ndarray, j: int) -> np.ndarray:
        return (prints >> np.uint64(BLOCK_BITS * j)).astype(np.uint16)

    def candidates(self, k: int, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item of the length) of all pairs at RADIUS bits or fewer."""
        x, found = self.lengths[k], set()
        for j, (values, owner) in enumerate(self.index[k]):
            part = self.block(prints, j)
            a, b = np.searchsorted(values, part), np.searchsorted(values, part, "right")
            some = np.flatnonzero(b > a)
            if not len(some):
                continue
            n = (b - a)[some]
            window = np.repeat(some, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[some], n)
            item = owner[place]
            close = distance(prints[window], x.prints[item]) <= RADIUS
            found.update(zip(window[close].tolist(), item[close].tolist()))
        return sorted(found)

    def hits(self, words: np.ndarray, at: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By width of shingle: all shingles, and the places, within texts, and numbers of those that some item has."""
        out = {}
        for width, known in self.known.items():
            s = shingles(words, width)
            test = np.zeros(1 << TEST_BITS, bool)
            mask = np.uint64((1 << TEST_BITS) - 1)
            test[known & mask] = True
            place = np.flatnonzero(test[s & mask])
            found = np.searchsorted(known, s[place])
            same = known[np.minimum(found, len(known) - 1)] == s[place]
            place, found = place[same], found[same]
            inside = place + width <= at[np.searchsorted(at, place, "right")]
            out[width] = s, place[inside], found[inside]
        return out

    def search(self, texts: pa.Array) -> list[tuple]:
        """(row, item, similarity, start, words, distance, windows, far windows) of every text and item with a verified
        window, the best of them by similarity and place."""
        words, sizes, at = word_table(texts)
        best: dict[tuple[int, int], list] = {}
        for width, (s, places, kinds) in self.hits(words, at).items():
            if not len(places):
                continue
            w = weights(sizes, width)
            total = np.concatenate([[0.0], np.cumsum(w)])
            row = np.searchsorted(at, places, "right") - 1
            # A line for each hit and item that has it, by row, item and place.
            first, holders = self.holders[width]
            n = first[kinds + 1] - first[kinds]
            item = holders[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[kinds], n)]
            row, place = np.repeat(row, n), np.repeat(places, n)
            order = np.lexsort((place, item, row))
            row, item, place = row[order], item[order], place[order]
            begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1])]))
            # What all windows together can have in common with the item is too little for most.
            hit = np.add.reduceat(w[place], begins)
            for i in np.flatnonzero(hit >= self.least(item[begins], 0.0) - SLACK):
                r, k = int(row[begins[i]]), int(item[begins[i]])
                own = place[begins[i] : begins[i + 1] if i + 1 < len(begins) else len(place)]
                self.verify(k, width, own, r, int(at[r]), int(at[r + 1]), s, w, total, best)
        return [(row, item, *v) for (row, item), v in sorted(best.items())]

    def least(self, item, window):
        """The common weight that a window of a weight needs with an item to be similar enough."""
        return SIMILARITY / (1 + SIMILARITY) * (self.sizes[item] + window)

    def verify(self, k: int, width: int, own: np.ndarray, row: int, a: int, b: int, s: np.ndarray, w: np.ndarray, total: np.ndarray, best: dict) -> None:
        """Windows of the text from a to b that are similar to item k, whose shingles are at the places own: those whose
        fingerprints the multi-index brings to the item, then those that only the bound leaves."""
        length = int(self.words[k])
        last = max(a, b - length)
        # Starts whose windows hold a hit, as runs that don't meet.
        lo, hi = np.maximum(own + width - length, a), np.minimum(own, last)
        cuts = np.flatnonzero(lo[1:] > hi[:-1] + 1) + 1
        runs = zip(lo[np.concatenate([[0], cuts])], hi[np.concatenate([cuts - 1, [len(hi) - 1]])])
        common = np.concatenate([[0.0], np.cumsum(w[own])])
        for x, y in runs:
            for first in range(int(x), int(y) + 1, WINDOWS):
                starts = np.arange(first, min(first + WINDOWS, int(y) + 1))
                stops = np.minimum(starts + length, b) - width + 1
                prints = window_prints(s, w, starts, stops)
                close = np.zeros(len(starts), bool)
                close[[window for window, item in self.candidates(self.length_of[k], prints) if item == self.place_of[k]]] = True
                bound = common[np.searchsorted(own, stops)] - common[np.searchsorted(own, starts)]
                far = ~close & (bound >= self.least(k, total[stops] - total[starts]) - SLACK)
                for i in np.flatnonzero(close | far).tolist():
                    begin, end = int(starts[i]), int(stops[i])
                    like = similarity(multiset(s[begin:end], w[begin:end]), self.sets[k])
                    if like < SIMILARITY:
                        continue
                    old = best.get((row, k), (-1.0, 0, 0, 0, 0, 0))
                    now = old[:4] if like <= old[0] else (like, begin - a, min(begin + length, b) - begin, int(distance(prints[i], self.prints[k])))
                    best[row, k] = (*now, old[4] + 1, old[5] + int(far[i]))


def window_prints(s: np.ndarray, w: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """SimHashes of the windows of shingles from starts to stops, both ascending and close together."""
    a, b = int(starts[0]), int(stops[-1])
    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(sign_bits(s[a:b]) * w[a:b, None], axis=0)])
    return fingerprints(sums[stops - a] - sums[starts - a])


def blocks(benchmark: DataFrame, item: str, text: str):
    """The items, at most about BLOCK_ITEMS at a time."""
    items = benchmark.where(F.col(text).isNotNull())
    n = -(-items.count() // BLOCK_ITEMS)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64(item, text), F.lit(n)) == k).orderBy(item, text).select(item, text).collect()
        yield Benchmark([r[0] for r in rows], [r[1] for r in rows])


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for every document and item that it holds: the most similar window, and how many windows are similar enough."""
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item}` {item_kind}, similarity double, start_word long, n_words long, distance int, n_windows long, n_far long"
    names = [key, item, "similarity", "start_word", "n_words", "distance", "n_windows", "n_far"]

    def search(block: Benchmark) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        item_type = pa.array(block.ids).type

        def run(batches):
            for big in batches:
                for start in range(0, big.num_rows, ROWS):
                    batch = big.slice(start, ROWS)
                    found = shared.value.search(batch.column(1))
                    if found:
                        row, items, *rest = zip(*found)
                        ids = pa.array([shared.value.ids[k] for k in items], item_type)
                        kinds = [pa.float64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), ids, *(pa.array(c, t) for c, t in zip(rest, kinds))], names)

        return docs.select(key, text).mapInArrow(run, schema)

    found = None
    for block in blocks(benchmark, item, item_text):
        rows = search(block)
        found = rows if found is None else found.unionByName(rows)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns."""
    at = docs.columns.index(text)
    for block in blocks(benchmark, item, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            forget()
            for big in batches:
                for start in range(0, big.num_rows, ROWS):
                    batch = big.slice(start, ROWS)
                    keep = np.ones(batch.num_rows, bool)
                    keep[[f[0] for f in shared.value.search(batch.column(at))]] = False
                    yield batch.filter(pa.array(keep))
            big = batch = None
            release()

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
