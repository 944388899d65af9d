"""Repair of conversations: the cheapest edits that turn a row sequence into `(s?(ua)+)?` by role initials.

Rows are dealt by the hash of their conversation and sorted there, so one shuffle serves the search for repeated rows, the
neighbours' faults and the edits. Each task takes its sorted stream in blocks and hands a block's row kinds to DuckDB, whose
recursive query advances one row of all conversations of the block at a time and keeps, for each grammar state, the
least cost and of equal costs the least audit. (Two audits of one cost that reach a state in the same rows never are a
prefix of one another, so the least audit so far is part of the least audit.)

A conversation may be longer than a block: it is cut into stretches, for which the query is asked from every grammar state, and
their answers are put together in order. A task holds one block, and of a conversation its audits and a digest per state.

Defined results: a null role or text is one space, as is a null id or turn in the damage's key. Rows go by turn, nulls first; rows
of one turn by role, then text. A role is known by its first character; an empty or other role fits no state and can be changed
or deleted. A null conv_id is a conversation of its own. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import SPACE, release, table

#: Rows that a task hands to DuckDB at once, bytes of text among them, and rows of a stretch.
BLOCK, BLOCK_BYTES, STRETCH = 20_000, 16 << 20, 64

#: Grammar states: nothing yet, after a system row, after a user row, after an assistant row. All but 1 and 2 may end.
STATES, ENDS = range(4), (0, 3)
#: State after a row of this initial.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The one role other than system that may follow a state.
FOLLOWS = {0: "user", 1: "user", 2: "assistant", 3: "user"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Kinds of rows: sound, to be deleted, truncated.
SOUND, GONE, CUT = range(3)


def _inserted(state: int) -> list[tuple[int, int, str]]:
    """States that none, one or two inserted rows lead to; more only lead back."""
    found = [(state, 0, "")]
    for n in (1, 2):
        last = NEXT[found[-1][0], FOLLOWS[found[-1][0]][0]]
        if last not in [s for s, _, _ in found]:
            found.append((last, n * INSERT, "I" * n))
    return found


def moves() -> pa.Table:
    """What a row of each initial and kind can do in each state, rows inserted before it included."""
    rows = []
    for state, initial, kind in itertools.product(STATES, "sua-", (SOUND, GONE, CUT)):
        for s, cost, edit in _inserted(state):
            rows.append((state, initial, kind, s, cost + DELETE, edit + "D"))
            more = cost + (TRUNCATED if kind == CUT else 0)
            if kind != GONE and (s, initial) in NEXT:
                rows.append((state, initial, kind, NEXT[s, initial], more, edit + "K"))
            if kind != GONE:
                rows.append((state, initial, kind, NEXT[s, FOLLOWS[s][0]], more + REROLE, edit + "R"))
    return pa.Table.from_pylist([dict(zip(("state", "initial", "kind", "reached", "cost", "edit"), r)) for r in rows])


#: Least (cost, audit) of each stretch, from each state that it may begin in, to each state that it may end in.
ADVANCE = """WITH RECURSIVE step AS (
    SELECT stretch, entry, entry AS state, 0::BIGINT AS pos, 0::BIGINT AS cost, '' AS audit
      FROM stretches, (SELECT unnest([0, 1, 2, 3]) AS entry) WHERE later OR entry = 0
  UNION ALL
    SELECT stretch, entry, reached, pos + 1, best.cost, best.audit FROM (
      SELECT s.stretch, s.entry, m.reached, s.pos, min({'cost': s.cost + m.cost, 'audit': s.audit || m.edit}) AS best
        FROM step s JOIN rows r ON r.stretch = s.stretch AND r.pos = s.pos
        JOIN moves m ON m.state = s.state AND m.initial = r.initial AND m.kind = r.kind
        GROUP BY s.stretch, s.entry, m.reached, s.pos))
  SELECT step.stretch, entry, state, cost, audit FROM step JOIN stretches USING (stretch) WHERE pos = size ORDER BY 1, 2, 3"""


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after damage by the crc32 of `conv_id:turn`; dropped rows stay, marked, so that no conversation is lost."""
    blank = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("damage", F.crc32(key) % 20).withColumn("dropped", F.col("damage") == 0)
    text = F.when(F.col("damage") <= 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), "dropped", F.explode(F.array_repeat(F.lit(1), F.when(F.col("damage") == 3, 2).otherwise(1))).alias("one"))
    return rows.drop("one")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation and turn, each with its first fault, whether its turn is new, and whether its role may not follow the
    one before. Rows marked `dropped` come last in their conversation and count for nothing."""
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    before = Window.partitionBy("conv_id", "dropped").orderBy(F.col("turn").asc_nulls_first(), "role", "text", "nth")
    rows = rows.repartition("conv_id").withColumn("nth", F.row_number().over(same))

    def initial(role: Column) -> Column:
        return F.substring(role, 1, 1)

    fault = (
        F.when(F.col("dropped"), None).when(~F.col("text").rlike(f"[^{SPACE}]"), "blank").when(F.col("nth") > 1, "duplicate")
        .when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), "truncated")
    )
    last = F.lag("role").over(before)
    illegal = last.isNotNull() & ~F.concat(initial(last), initial(F.col("role"))).isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.lag("turn").over(before))
    found = rows.select("conv_id", "turn", "role", "text", "dropped", fault.alias("fault"), "nth", (illegal & ~F.col("dropped")).alias("illegal"), (new_turn & ~F.col("dropped")).alias("new_turn"))
    # Of equal rows the first is no duplicate.
    return found.sortWithinPartitions("conv_id", "dropped", F.col("turn").asc_nulls_first(), "role", "text", "nth")


REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


class _Conversation:
    """What is known of a conversation whose stretches have been read up to here."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.turns, self.first, self.last = 0, None, None
        #: state: (cost, audit, digest of the repaired rows, whether there are any)
        self.states = {0: (0, "", hashlib.sha256(), False)}

    def count(self, counts: dict, turns: int, first, last) -> None:
        for k in _COUNTS:
            self.counts[k] += counts[k]
        self.turns += turns
        if first is not None:
            self.first = first if self.first is None else min(self.first, first)
            self.last = last if self.last is None else max(self.last, last)

    def advance(self, ways: dict, rows: list[tuple[str, str]], ended: bool) -> None:
        """Put a stretch's ways behind those so far: for each state the least cost, then audit. At the end only the best is kept."""
        found: dict[int, tuple] = {}
        for (entry, state), (cost, edits) in ways.items():
            if entry in self.states:
                before = self.states[entry]
                way = (before[0] + cost, before[1] + edits, entry, edits)
                found[state] = min(found.get(state, way), way)
        if ended:
            best = min((c + more, audit + tail, s, tail) for s, (c, audit, _, _) in found.items() for end, more, tail in _inserted(s) if end in ENDS)
            cost, audit, state, tail = best
            self.states = {3: (cost, audit, *self._repaired(found[state], rows, tail))}
        else:
            self.states = {s: (way[0], way[1], *self._repaired(way, rows, "")) for s, way in found.items()}

    def _repaired(self, way: tuple, rows: list[tuple[str, str]], tail: str):
        _, _, state, edits = way
        _, _, digest, some = self.states[state]
        digest = digest.copy()
        at = 0
        for e in edits + tail:
            role, text = rows[at] if e != "I" else ("", "")
            at += e != "I"
            if e == "D":
                continue
            role = role if e == "K" else FOLLOWS[state]
            state = NEXT[state, role[0]]
            digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
            some = True
        return digest, some

    def row(self) -> dict:
        cost, audit, digest, _ = min(self.states.values(), key=lambda s: s[:2])
        gaps = self.last - self.first + 1 - self.turns if self.first is not None else 0
        return {"conv_id": self.conv_id, "gaps": gaps, **self.counts, "cost": cost, "audit": audit, "repaired_sha256": digest.hexdigest()}


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Slices of the stream, and whether the next one goes on with the last conversation."""
    held = None
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
        begin = 0
        while begin < len(batch):
            end = min(begin + BLOCK, max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + BLOCK_BYTES, side="right"))))
            part = batch.slice(begin, end - begin)
            if held is not None:
                yield held, held.column("conv_id")[-1].as_py() == part.column("conv_id")[0].as_py()
            held, begin = part, end
    if held is not None:
        yield held, False


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", *_COUNTS, "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    con.register("moves", moves())
    current: _Conversation | None = None
    for block, goes_on in _blocks(batches):
        kept = ~block.column("dropped").to_numpy(zero_copy_only=False)
        ids = block.column("conv_id").to_pylist()
        change = np.array([True] + [a != b for a, b in zip(ids[1:], ids[:-1])])
        conv = np.cumsum(change) - 1
        begins = np.flatnonzero(change)
        rank = np.arange(len(ids)) - begins[conv]
        new = change | (rank % STRETCH == 0)
        stretch = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        end = np.append(head[1:], len(ids))
        opened = current is not None
        # Dropped rows are the last of their conversation, so positions among the rest have no holes.
        later = ~change[head]
        later[0] |= opened
        roles, texts = block.column("role").to_pylist(), block.column("text").to_pylist()
        faults = block.column("fault").to_pylist()
        kind = np.array([{None: SOUND, "truncated": CUT}.get(f, GONE) for f in faults], np.int8)
        rows = pa.table({
            "stretch": stretch[kept], "pos": (np.arange(len(ids)) - head[stretch])[kept], "kind": kind[kept],
            "initial": [r[:1] if r[:1] in ("s", "u", "a") else "-" for r, k in zip(roles, kept) if k],
        })
        sizes = np.add.reduceat(kept.astype(np.int64), head)
        con.register("rows", rows)
        con.register("stretches", pa.table({"stretch": np.arange(len(head)), "later": later, "size": sizes}))
        ways: list[dict] = [{} for _ in head]
        for s, entry, state, cost, audit in con.execute(ADVANCE).fetchall():
            ways[s][entry, state] = cost, audit
        turns = np.add.reduceat(block.column("new_turn").to_numpy(zero_copy_only=False).astype(np.int64), head)
        illegal = np.add.reduceat(block.column("illegal").to_numpy(zero_copy_only=False).astype(np.int64), head)
        turn = block.column("turn").to_pylist()
        done = []
        for i, (a, b) in enumerate(zip(head.tolist(), end.tolist())):
            if change[a] and not (i == 0 and opened):
                current = _Conversation(ids[a])
            live = [t for t, k in zip(turn[a:b], kept[a:b]) if k and t is not None]
            counts = {k: faults[a:b].count(k) for k in _COUNTS[:3]} | {"illegal": int(illegal[i])}
            current.count(counts, int(turns[i]), min(live, default=None), max(live, default=None))
            ended = not goes_on if i == len(head) - 1 else bool(change[b])
            current.advance(ways[i], [(roles[j], texts[j]) for j in range(a, b) if kept[j]], ended)
            if ended:
                done.append(current.row())
                current = None
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    con.close()
    release()


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repaired rows, for every conversation of rows (conv_id, turn, role, text, dropped)."""
    return with_faults(rows).mapInArrow(_repair, REPAIRED)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation once its rows are damaged."""
    return repair(damaged(table(spark, sf_dir, "conversations")))
