"""Similarity self-join of documents' shingle sets by Jaccard, with PartEnum signatures, up to components.

Sets are grouped into bands of sizes such that linked sets lie in one band or in neighbouring ones. In a
band the Jaccard threshold bounds the Hamming distance by k. The feature domain, which hashing makes uniform, is
cut into n1 parts of n2 pieces; some part differs in at most k2 places, and there some n2 - k2 pieces agree
whole. A signature is a hash of what a set has in such a subset of pieces, so linked sets share one.
Signatures of empty pieces would be shared by strangers; with spare parts they are only needed for
the few sets in which more parts than the spare ones have empty pieces.

Linked sets mostly share far more than one signature: a set's size bounds how far any partner can differ from
it, and each feature in which they differ spoils one piece, so they share all other pieces: its need. So each set leaves
out as many signatures less one as it needs. About half of those, the greatest, are never sent: two sets that leave out
the greatest of their own lose no more of those they share than the one that leaves out more. The other half are those
with the most sets; of any that are shared the rarest is left to both. Passages that many documents share make
signatures with many sets, which are the ones that go.

Equal sets are one node (a 64-bit hash of the set). In each group of nodes with a common signature the
node that meets most others is compared with all of them, exactly; groups are first formed within a batch of a
reader and only one node of each goes on to the shuffle of signatures, so no key brings more rows to a task
than there are batches. Where these links leave more than one component, `across` finds the pairs across
components that are linked all the same, from how both differ from the node they were compared with. Pairs within a component can't change it, and pairs in no common group can't be linked, so no
link between components is lost.

Null and empty texts, and texts of white space, have an empty set: n_shingles 0, linked with nothing, their
own component. Repeated rows are links of one node. Rows with a null id take part, but a component's id is
the least id that is not null. An empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import discard, forget, materialize, release, table
from tallyweave.llm.graph import components
from tallyweave.llm.shingles import by_text, mix

#: Rows of a batch in which groups are formed, and of those whose words are held at once.
ROWS, TEXTS = 4000, 400
#: Elements that the first elements of two difference sets must share, where they must share as many at all.
MATCHES = 4
#: Elements of the differences in a block of a lead's nodes, about, and what is met or looked up at once in a cell of two blocks.
BLOCK, AT_ONCE = 1 << 19, 1 << 20
#: Documents that set the order of features, about, and the size of the table of their frequencies.
ORDER_SAMPLE, ORDER_SLOTS = 20_000, 1 << 20
#: Bits of the filter on documents whose sets are needed again, for each of them, and in all: 128 MB, sent to all
#: executors. Beyond some hundred million such documents it lets more others through, which are dropped by a join.
FILTER_BITS, MOST_FILTER_BITS = 16, 1 << 30
#: Bits of one of Spark's bitmaps.
BITMAP = 1 << 15


@dataclass(frozen=True)
class Scheme:
    """How the sets of one band are cut: n1 parts of n2 pieces, any n2 - k2 of which make a signature."""

    n1: int
    n2: int
    k2: int
    spare: int

    @classmethod
    def of(cls, k: int) -> Scheme:
        """For sets at a Hamming distance of k at most."""
        if k <= 3:
            return cls(1, (1, 3, 5, 6)[k], k, 0)
        spare = 1 if k < 16 else 2 + k // 32
        return cls(k // 2 + 1 + spare, 2, 1, spare)

    def signatures(self, features: np.ndarray, salt: int) -> tuple[np.ndarray, int]:
        """Of one sorted set of uniform 64-bit features; the lowest bit is that of salt. Also how many pieces linked sets may
        agree in that give no signature to both, being empty."""
        pieces = self.n1 * self.n2
        piece = (features >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)
        cuts = np.searchsorted(piece, np.arange(pieces + 1, dtype=np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(features ^ np.uint64(0x5851F42D4C957F2D)))])
        sums, count = np.diff(sums[cuts]).reshape(self.n1, self.n2), np.diff(cuts).reshape(self.n1, self.n2)
        if self.n2 - self.k2 > 1:
            subsets = np.array(list(itertools.combinations(range(self.n2), self.n2 - self.k2)))
            sums, count = sums[:, subsets].sum(axis=2, dtype=np.uint64), count[:, subsets].sum(axis=2)
        slots = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape) + np.uint64(salt << 32)
        found = mix(sums + mix(slots + np.uint64(1)))
        found = (found & ~np.uint64(1)) | np.uint64(salt & 1)
        empty = count == 0
        parts = int(empty.any(axis=1).sum())
        if 0 < parts <= self.spare:
            return found[~empty], int(empty.sum())
        return found.ravel(), self.n2 * min(parts, self.spare)

    def need(self, differ: int, lost: int) -> int:
        """How many signatures two sets share at least that differ in `differ` features at most: one for each piece, if pieces are
        signatures. Where there is one part, one."""
        return max(1, self.n1 * self.n2 - differ - lost) if self.n1 > 1 else 1


@dataclass(frozen=True)
class Jaccard:
    """Links: 100 * |intersection| >= percent * |union|, over sets of k-word shingles."""

    percent: int = 80
    k: int = 5

    @cache
    def bands(self) -> tuple[list[int], list[Scheme]]:
        """The least size of each band and its scheme. A band is as wide as two steps of the threshold."""
        starts, schemes, low = [], [], 1
        while low < 1 << 40:
            high = max(low, low * 10_000 // self.percent**2)
            starts.append(low)
            schemes.append(Scheme.of((100 - self.percent) * 2 * high // (100 + self.percent)))
            low = high + 1
        return starts, schemes

    def signatures(self, features: np.ndarray) -> np.ndarray:
        return self.signed_up(features)[0]

    def signed_up(self, features: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Signatures for the set's own band, and for the next where that can hold a partner, less the greatest that it can spare;
        for even and for odd ones, how many a linked set of that band still shares at least. Links of sets of two bands are
        found in the upper."""
        starts, schemes = self.bands()
        size = len(features)
        t = int(np.searchsorted(starts, size, "right")) - 1
        every, needs = [], [1, 1]
        for band in (t, t + 1):
            if band == t or (band < len(starts) and 100 * size >= self.percent * starts[band]):
                found, lost = schemes[band].signatures(features, band)
                largest = 100 * size // self.percent
                if band + 1 < len(starts):
                    largest = min(largest, starts[band + 1] - 1)
                need = schemes[band].need((100 - self.percent) * (size + largest) // (100 + self.percent), lost)
                every.append(np.sort(found)[: len(found) - need // 2])
                needs[band & 1] = need - need // 2
        return np.concatenate(every), needs


def node_of(features: np.ndarray) -> np.ndarray:
    """The hash of a set."""
    return mix(np.cumsum(mix(features + np.uint64(1)))[-1:] + np.uint64(len(features)))[0]


def first_of_runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, as a mask."""
    first = np.ones(len(x), bool)
    first[1:] = x[1:] != x[:-1]
    return first


def grouped(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (signature, node) rows in order, whether the row stands for its group, and whether the group has
    other rows. The row that stands for it is that of the node that meets most others in all groups."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    own = first_of_runs(sigs) | first_of_runs(nodes)
    sigs, nodes = sigs[own], nodes[own]
    del order, own
    heads = first_of_runs(sigs)
    group = np.cumsum(heads, dtype=np.int32) - 1
    size = np.bincount(group)[group].astype(np.int32) if len(group) else group
    del group
    kinds = np.unique(nodes)
    at = np.searchsorted(kinds, nodes).astype(np.int32)
    # Nodes in the order of their place, most met first: a node's rank is the same in all groups.
    met = np.bincount(at, size - 1, minlength=len(kinds))
    rank = np.empty(len(kinds), np.int32)
    rank[np.lexsort((kinds, -met))] = np.arange(len(kinds), dtype=np.int32)
    rank = rank[at]
    del at
    least = np.minimum.reduceat(rank, np.flatnonzero(heads)) if len(rank) else rank
    first = rank == np.repeat(least, size[heads])
    return sigs, nodes, first, size > 1


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def rows_of(nodes: np.ndarray, place: dict[int, int]) -> np.ndarray:
    """place of every node, without a Python number for each."""
    known, row = (np.fromiter(x, np.int64, len(place)) for x in (place.keys(), place.values()))
    order = np.argsort(known)
    return row[order].astype(np.int32)[np.searchsorted(known, nodes, sorter=order)]


def feature_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted features of each text, TEXTS at a time."""
    for start in range(0, len(texts), TEXTS):
        for _, s in by_text(texts.slice(start, TEXTS), k):
            yield np.unique(s)


def describe(docs: DataFrame, rule: Jaccard, key: str, text: str) -> DataFrame:
    """(key, n_shingles, node, sigs, shared, even, odd) of every row. sigs: signatures for which this row stands for all of its
    batch; shared: signatures that other nodes of the batch have too; even, odd: how many signatures with such a lowest bit
    linked sets share."""
    kind = docs.schema[key].dataType.simpleString()

    def lists(owner: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
        """values by owner, which is in order."""
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))

    def run(batches):
        forget()
        for big in batches:
            for start in range(0, big.num_rows, ROWS):
                batch = big.slice(start, ROWS)
                n = batch.num_rows
                sizes, nodes, needs = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones((n, 2), np.int32)
                every, owner, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], {}
                for k, features in enumerate(feature_sets(batch.column(1), rule.k)):
                    if len(features):
                        sizes[k], nodes[k] = len(features), signed(node_of(features)[None])[0]
                        if nodes[k] not in place:
                            place[nodes[k]] = k
                            found, needs[k] = rule.signed_up(features)
                            every.append(signed(found))
                            owner.append(np.full(len(every[-1]), nodes[k]))
                every, owner = np.concatenate(every), np.concatenate(owner)
                sigs, own, first, many = grouped(every, owner)
                del every, owner
                row = rows_of(own, place)
                del own
                order = np.argsort(row, kind="stable")
                sigs, first, many, row = sigs[order], first[order], many[order], row[order]
                del order
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes), pa.array(nodes, mask=sizes == 0), lists(row[first], n, sigs[first]), lists(row[many], n, sigs[many]), pa.array(needs[:, 0]), pa.array(needs[:, 1])],
                    [key, "n_shingles", "node", "sigs", "shared", "even", "odd"],
                )
                del sigs, first, many, row
                release()
        big = batch = None
        release()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles long, node long, sigs array<long>, shared array<long>, even int, odd int")


def global_groups(rows: DataFrame) -> DataFrame:
    """The rows (sig, node, ...) whose signature has several nodes. Rows are sorted by signature and read as a stream, whatever
    a group's size; what follows the node is a property of both and comes along."""

    def run(batches):
        forget()
        before = None  # the row before
        alone = False  # whether its signature has had one node so far
        for batch in batches:
            if not batch.num_rows:
                continue
            # The row before comes again: its group may go on.
            rows = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks()
            sigs, nodes = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            new = first_of_runs(sigs) | first_of_runs(nodes)
            group = np.cumsum(first_of_runs(sigs)) - 1
            many = np.bincount(group, new)[group] > 1
            done = before is not None and not alone
            keep = new & (many | (group == 0 if done else np.zeros(len(sigs), bool)))
            if done:
                keep[0] = False
            yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()
            alone = not many[-1] and not (done and group[-1] == 0)
            before = pa.RecordBatch.from_arrays([c.take([0]) for c in batch.slice(batch.num_rows - 1).columns], schema=batch.schema)

    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, rows.schema)


def rarest(groups: DataFrame) -> DataFrame:
    """The rows (sig, node) that are left if each node leaves out its need less one, those of the largest groups. One order
    holds for all, so of the signatures that linked sets share, at least as many as either needs, both keep the last in
    it. A node's rows are bounded by its set, whatever the size of groups."""
    sizes = groups.groupBy("sig").agg(F.count("*").alias("n"))
    order = Window.partitionBy("node", F.col("sig").bitwiseAND(1)).orderBy(F.desc("n"), "sig")
    rows = groups.join(sizes, "sig").withColumn("place", F.row_number().over(order))
    return rows.where("place >= need").select("sig", "node")


def leads(groups: DataFrame) -> DataFrame:
    """(sig, lead, node) of all rows of groups; the lead is the node that meets most others in all groups. Of copies
    that differ from one text in places of their own, it is that text, which is most like each of them."""
    sizes = groups.groupBy("sig").agg(F.count("*").alias("n")).where("n > 1")
    met = groups.join(sizes, "sig").groupBy("node").agg(F.sum("n").alias("met"))
    rows = groups.join(met, "node")
    first = rows.groupBy("sig").agg(F.max(F.struct("met", "node")).alias("first"))
    return groups.join(first, "sig").select("sig", F.col("first.node").alias("lead"), "node")


def rarity(docs: DataFrame, rule: Jaccard, key: str, text: str) -> np.ndarray:
    """How often features occur, by slots of their hashes, in a sample of about ORDER_SAMPLE documents. It only sets the order
    in which features are looked at, on which results don't depend."""
    share = max(1, docs.count() // ORDER_SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(F.col(key), F.lit("order")), F.lit(share)) == 0)

    def run(batches):
        forget()
        for batch in batches:
            n = np.zeros(ORDER_SLOTS, np.int64)
            for features in feature_sets(batch.column(0), rule.k):
                # Features are distinct, but slots may not be.
                np.add.at(n, slots(features), 1)
            place = np.flatnonzero(n > 1)
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(n[place])], ["slot", "n"])
            del n, place
            release()
        batch = None
        release()

    found = some.select(text).mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(ORDER_SLOTS, np.int32)
    table[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 1 << 30)
    return table


def slots(features: np.ndarray) -> np.ndarray:
    return (features & np.uint64(ORDER_SLOTS - 1)).astype(np.int64)


def sets_of(docs: DataFrame, features: DataFrame, pairs: DataFrame, rule: Jaccard, key: str, text: str) -> DataFrame:
    """(node, features) of all nodes in pairs, rare features first. Ids of documents to be read again pass a filter of
    fixed size."""
    needed = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
    bits = max(BITMAP, min(MOST_FILTER_BITS, 1 << (FILTER_BITS * needed.count() - 1).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    ids = features.join(needed, "node", "left_semi").groupBy("node").agg(F.min(key).alias(key)).select((slot(F.col(key)) + 1).alias("slot"))
    filled = np.zeros((bits // BITMAP, BITMAP // 8), np.uint8)
    for at, part in ids.groupBy(F.bitmap_bucket_number("slot").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot"))).toLocalIterator():
        filled[at - 1] = np.frombuffer(part, np.uint8)
    context = docs.sparkSession.sparkContext
    shared, often = context.broadcast(filled.ravel()), context.broadcast(rarity(docs, rule, key, text))

    def run(batches):
        forget()
        filled, order = shared.value, often.value
        for big in batches:
            for start in range(0, big.num_rows, ROWS):
                batch = big.slice(start, ROWS)
                at = batch.column(0).to_numpy()
                texts = batch.column(1).filter(pa.array((filled[at >> 3] >> (at & 7).astype(np.uint8) & 1).view(bool)))
                found = {}
                for features in feature_sets(texts, rule.k):
                    if len(features):
                        node = signed(node_of(features)[None])[0]
                        if node not in found:
                            found[node] = features[np.argsort(order[slots(features)], kind="stable")]
                at = np.concatenate([[0], np.cumsum([len(f) for f in found.values()])]).astype(np.int32)
                flat = signed(np.concatenate([np.zeros(0, np.uint64), *found.values()]))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["node", "features"])
                del found, flat, texts, at
                release()
        big = batch = None
        release()

    again = docs.select(slot(F.col(key)).alias("slot"), text).mapInArrow(run, "node long, features array<long>")
    sets = materialize(again.join(needed.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.first("features").alias("features")), "sets")
    discard(needed)
    return sets


def compared(sets: DataFrame, pairs: DataFrame, rule: Jaccard) -> DataFrame:
    """pairs (a, b) with whether they are linked, by their whole sets, the sizes of both and the elements that only b has (`more`), rare
    ones first; those of a that b lacks (`part`, `lacking`), or those that it has, if they are fewer and b differs by so much
    that none of the others is looked up."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("features").alias("fa")), "a").join(sets.select(F.col("node").alias("b"), F.col("features").alias("fb")), "b")
    both = both.withColumn("na", F.size("fa")).withColumn("nb", F.size("fb")).withColumn("more", F.array_except("fb", "fa")).withColumn("common", F.col("nb") - F.size("more"))
    both = both.withColumn("linked", 100 * F.col("common") >= rule.percent * (F.col("na") + F.col("nb") - F.col("common")))
    far = F.size("more") > F.floor((100 - rule.percent) * F.col("nb") / rule.percent)
    both = both.withColumn("lacking", F.col("linked") | ~far | (2 * F.col("common") >= F.col("na")))
    return both.select("a", "b", "linked", "na", "nb", "more", F.when(F.col("lacking"), F.array_except("fa", "fb")).otherwise(F.array_intersect("fa", "fb")).alias("part"), "lacking")


def first_elements(need: np.ndarray, more: np.ndarray, less: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many elements of a difference are looked up, of those that only b has and of those that only a has, if `need` of its elements are
    to be in common; and how many must be of the first kind, as the second can't make up for them."""
    beyond = np.maximum(1, need - less)
    return np.clip(more - beyond + MATCHES, 0, more), np.where(need <= less, np.minimum(less, less - need + MATCHES), 0), beyond


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def pieces(size: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive stretches of at most `most` in all, or of one member."""
    at, ends = 0, np.cumsum(size)
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, most + (ends[at - 1] if at else 0), "right")))
        yield slice(at, to)
        at = to


class Family:
    """Nodes compared with one lead, of several cells: `cell` of each row, in which rows of unlike `side` meet, or all if `within`."""

    def __init__(self, rows: pa.Table, rule: Jaccard):
        self.rule = rule
        self.node, self.within, self.side, self.linked = (rows.column(c).to_numpy() for c in ("b", "within", "side", "linked"))
        self.lead, self.size = (rows.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
        self.lacking = rows.column("lacking").to_numpy()
        self.cell = np.cumsum(cell_starts(rows)) - 1
        _, self.component = np.unique(rows.column("cb").to_numpy(), return_inverse=True)
        lists = [rows.column(c).combine_chunks() for c in ("more", "part")]
        more, self.part = (np.diff(x.offsets.to_numpy()).astype(np.int64) for x in lists)
        self.less = np.where(self.lacking, self.part, self.lead - self.part)
        self.differ = more + self.less
        p, q = 100 - rule.percent, 100 + rule.percent
        # How many of the difference a link leaves in common, by how far linked sets can differ, and by how far y does at least.
        always = np.maximum(1, self.differ - p * self.size // rule.percent)
        least = np.maximum(1, (self.differ * q + p * (self.lead - self.size)) // (2 * q) + 1)
        self.need = {"short": np.where(self.linked, least, np.maximum(least, always)), "long": always}
        first = {part: first_elements(need, more, self.less) for part, need in self.need.items()}
        self.beyond = {part: x[2] for part, x in first.items()}
        rows_of_all = np.concatenate([np.repeat(np.arange(len(n), dtype=np.int32), n) for n in (more, self.part)])
        place = np.concatenate([ranges(np.zeros(len(n), np.int64), n) for n in (more, self.part)])
        kind = np.repeat(np.array([0, 1], np.int8), [more.sum(), self.part.sum()])
        elements = np.concatenate([x.flatten().to_numpy() for x in lists])
        order = np.lexsort((elements, self.cell[rows_of_all]))
        new = first_of_runs(elements[order]) | first_of_runs(self.cell[rows_of_all[order]])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        del elements, order, new
        # What one row alone has is never in common.
        shared = np.flatnonzero(np.bincount(number)[number] > 1) if len(number) else np.zeros(0, np.int64)
        shared = shared[np.lexsort((number[shared], rows_of_all[shared]))]
        self.row, self.element, self.kind, place = rows_of_all[shared], number[shared], kind[shared], place[shared]
        self.elements = int(number.max(initial=-1)) + 1
        self.start = np.searchsorted(self.row, np.arange(len(self.node) + 1))
        self.key = self.row * np.int64(self.elements) + self.element
        self.listed = {part: place < np.where(self.kind == 0, x[0][self.row], x[1][self.row]) for part, x in first.items()}
        self.label = np.arange(self.component.max(initial=-1) + 1)

    def fits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether components and sides differ, and sizes alone, of sets and of differences, leave a link possible."""
        percent, nx, ny = self.rule.percent, self.size[x], self.size[y]
        near = (100 * np.minimum(nx, ny) >= percent * np.maximum(nx, ny)) & ((100 + percent) * np.abs(self.differ[x] - self.differ[y]) <= (100 - percent) * (nx + ny))
        return near & (self.label[self.component[x]] != self.label[self.component[y]]) & (self.within[x] | (self.side[x] != self.side[y]))

    def candidates(self, linked: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (x, y) with as many elements in common as their first ones must have; y is not linked, x is or not."""
        part = "long" if linked else "short"
        asks = np.flatnonzero(self.listed["short"] & (self.linked[self.row] == linked))
        held = np.flatnonzero(self.listed[part] & ~self.linked[self.row])
        held = held[np.argsort(self.element[held], kind="stable")]
        count = np.bincount(self.element[held], minlength=self.elements)
        start = (np.cumsum(count) - count)[self.element[asks]]
        count = count[self.element[asks]]
        heads = np.flatnonzero(first_of_runs(self.row[asks]))
        for of in pieces(np.add.reduceat(count, heads) if len(heads) else heads, AT_ONCE):
            some = slice(heads[of.start], heads[of.stop] if of.stop < len(heads) else len(asks))
            x, kind = np.repeat(self.row[asks[some]], count[some]), np.repeat(self.kind[asks[some]], count[some])
            y = self.row[held[ranges(start[some], count[some])]]
            keep = np.flatnonzero(self.fits(x, y) & (linked | (x < y)))
            pairs, of_pair = np.unique(x[keep] * np.int64(len(self.node)) + y[keep], return_inverse=True)
            n = [np.bincount(of_pair, kind[keep] == k, len(pairs)) for k in (0, 1)]
            x, y = np.divmod(pairs, len(self.node))
            need = [np.maximum(table["short"][x], table[part][y]) for table in (self.beyond, self.need)]
            enough = np.logical_or(*[m >= np.minimum(MATCHES, least) for m, least in zip(n, need)])
            yield x[enough], y[enough]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many elements the differences of x and y share, whole: what neither has of the lead's is told from what is listed of it."""
        found = np.zeros((2, len(x)), np.int64)
        size = self.start[1:] - self.start[:-1]
        for some in pieces(size[y], AT_ONCE):
            of_pair = np.repeat(np.arange(some.start, min(some.stop, len(y))), size[y[some]])
            own = ranges(self.start[y[some]], size[y[some]])
            wanted = x[of_pair] * np.int64(self.elements) + self.element[own]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            for kind in (0, 1):
                found[kind] += np.bincount(of_pair, (self.key[at] == wanted) & (self.kind[own] == kind), len(x)).astype(np.int64)
        more, part = found
        neither = np.select(
            [self.lacking[x] & self.lacking[y], self.lacking[x], self.lacking[y]], [part, self.part[x] - part, self.part[y] - part], self.lead[x] - self.part[x] - self.part[y] + part
        )
        return more + neither

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs that join components, none that joins what others here have joined already."""
        found = []
        for linked in (False, True):
            for x, y in self.candidates(linked):
                both = self.size[x] + self.size[y]
                same = (both - self.differ[x] - self.differ[y]) // 2 + self.common(x, y)
                right = 100 * same >= self.rule.percent * (both - same)
                for i, j in zip(x[right], y[right]):
                    one, other = self.label[self.component[[i, j]]]
                    if one != other:
                        self.label[self.label == other] = one
                        found.append(sorted((self.node[i], self.node[j])))
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def cell_starts(rows: pa.Table) -> np.ndarray:
    """Where each cell (a, i, j) of sorted rows begins, as a mask."""
    return np.logical_or.reduce([first_of_runs(rows.column(c).to_numpy()) for c in ("a", "i", "j")])


def across(done: DataFrame, found: DataFrame, rule: Jaccard) -> DataFrame:
    """Linked pairs that join components, among nodes compared with one lead but in different components.

    Let X and Y be where x and y differ from their lead b. Then x and y differ in |X| + |Y| - 2 |X & Y| features, so a link
    needs |X & Y| above a bound, and two sets with so great a part in common share MATCHES (or all, if fewer) of their first
    elements in any order, so rare ones come first. As at least one of the two, say y, is not linked to b, the bound for
    x is (|X| + c (|b| - |x|)) / 2 with c = (1 - s) / (1 + s) for threshold s: `short`. For y it is |Y| less the most that
    linked sets can differ in, whatever x is: `long`, and `short` if x isn't linked to b either and that is more. Texts
    changed in places of their own share hardly any of these.

    Pairs are many where a lead has many nodes near the threshold, so none is written that isn't linked: the nodes of a lead are cut into
    blocks of about BLOCK elements, each two blocks, or one, are a cell that a task reads as a stream, and what X and Y share, which
    tells whether x and y are linked, is counted there. Only a lead of several blocks has its rows copied, once for each."""
    c = lambda node, name: found.select(F.col("node").alias(node), F.col("component").alias(name))
    rows = done.select("a", "b", (F.size("more") + F.size("part")).alias("n")).join(c("b", "cb"), "b", "left").join(c("a", "ca"), "a", "left")
    rows = materialize(rows.select("a", "b", "n", F.coalesce("cb", "b").alias("cb"), F.coalesce("ca", "a").alias("ca")), "members")
    blocks = rows.groupBy("a").agg(F.sum("n").alias("all"), F.bool_or(F.col("ca") != F.col("cb")).alias("split")).where("split")
    blocks = blocks.select("a", F.ceil((F.col("all") + 1) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("own")
    cells = rows.join(blocks, "a").select("a", "b", "cb", own, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select("a", "b", "cb", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), (F.col("own") == F.col("other")).alias("within"))
    cells = done.join(cells.hint("shuffle_hash"), ["a", "b"]).repartition("a", "i", "j").sortWithinPartitions("a", "i", "j")

    def links(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        """Of whole cells, a few at a time."""
        starts = np.append(np.flatnonzero(cell_starts(rows)), rows.num_rows)
        sizes = np.add.reduceat(differences(rows), starts[:-1])
        for some in pieces(sizes, 2 * BLOCK):
            part = rows.slice(starts[some.start], starts[min(some.stop, len(sizes))] - starts[some.start]).combine_chunks()
            if part.num_rows > 1:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in Family(part, rule).links()], ["a", "b"])

    def differences(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        return sum(pc.list_value_length(rows.column(c)).to_numpy(zero_copy_only=False) for c in ("more", "part")).astype(np.int64) if rows.num_rows else np.zeros(0, np.int64)

    def run(batches):
        forget()
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += int(differences(batch).sum())
            if size >= 2 * BLOCK:
                rows = pa.Table.from_batches(held).combine_chunks()
                last = int(np.flatnonzero(cell_starts(rows))[-1])
                if last:
                    yield from links(rows.slice(0, last))
                # The last cell may go on.
                held, size = rows.slice(last).combine_chunks().to_batches(), int(differences(rows.slice(last)).sum())
                del rows
                release()
        batch = None
        if held and (rows := pa.Table.from_batches(held).combine_chunks()).num_rows:
            yield from links(rows)
        held = rows = None
        release()

    more = materialize(cells.mapInArrow(run, "a long, b long").distinct(), "more")
    discard(rows)
    return more


def similar(docs: DataFrame, rule: Jaccard, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, n_shingles, node) of every row, and (node, component) of the nodes that have links."""
    described = materialize(describe(docs, rule, key, text), "described")
    features = materialize(described.select(key, "n_shingles", "node"), "features")
    need = F.when(F.col("sig").bitwiseAND(1) == 0, F.col("even")).otherwise(F.col("odd")).alias("need")
    listed = lambda sigs: described.select(F.explode(sigs).alias("sig"), "node", "even", "odd").select("sig", "node", need)
    groups = materialize(listed("shared").unionByName(global_groups(listed("sigs"))).distinct(), "groups")
    discard(described)
    kept = materialize(rarest(groups), "kept")
    discard(groups)
    pairs = materialize(leads(kept).where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    discard(kept)
    sets = sets_of(docs, features, pairs, rule, key, text)
    done = materialize(compared(sets, pairs, rule), "compared")
    discard(pairs)
    found = components(done.where("linked"))
    discard(sets)
    more = across(done, found, rule)
    if not more.isEmpty():
        discard(found)
        found = components(done.where("linked").select("a", "b").unionByName(more))
    discard(more, done)
    return features, found


def classes(docs: DataFrame, rule: Jaccard, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) of every row."""
    features, found = similar(docs, rule, key, text)
    rows = materialize(features.join(found, "node", "left").select(key, "n_shingles", F.coalesce("component", "node").alias("component")), "rows")
    discard(features, found)
    least = rows.where("component is not null").groupBy("component").agg(F.min(key).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(least, "component", "left").select(key, "n_shingles", F.coalesce("least", key).alias("component_id"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), Jaccard(85, 4))
