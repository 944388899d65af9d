import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyweave.llm import conversation_repair
from tallyweave.llm.conversation_repair import op11_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, damage string, nth long"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def damage(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        role = "user" if d == 4 else role
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        found.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def cheapest(rows, kinds):
    """Try all edits: at most two inserted rows before each row and at the end, every edit of every row."""
    best = None

    def go(i, cost, audit, made):
        nonlocal best
        initials = "".join(r[:1] or "?" for r, _ in made)
        if not re.match(r"(s|s?(ua)*u?)\Z", initials) or (best and cost > best[0]):
            return
        for n in range(3):
            extra = []
            last = initials[-1:]
            for _ in range(n):
                role = "assistant" if last == "u" else "user"
                extra.append((role, ""))
                last = role[0]
            c, a, m = cost + 5 * n, audit + "I" * n, made + extra
            if i == len(rows):
                if GRAMMAR.match("".join(r[:1] or "?" for r, _ in m)) and (best is None or (c, a) < best[:2]):
                    best = (c, a, m)
                continue
            role, text = rows[i][2:]
            go(i + 1, c + 2, a + "D", m)
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] == "truncated" else 0
                go(i + 1, c + more, a + "K", [*m, (role, text)])
                for r in ("user", "assistant"):
                    go(i + 1, c + more + 1, a + "R", [*m, (r, text)])

    go(0, 0, "", [])
    return best


def brute(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = damage([r for r in rows if r[0] == conv])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        kinds = faults(mine)
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, made = cheapest(mine, kinds)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        found[conv] = (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return found


def conversations(n):
    rng = random.Random(n)
    rows = [(None, 1, "user", "No id."), (None, None, None, None), (7, None, "user", "No turn."), (7, None, "assistant", "No turn."), (8, 5, "tool", "Other role."), (8, 6, "", "None.")]
    for conv in range(100, 100 + n):
        for turn in range(rng.randint(1, 6)):
            text = rng.choice(["Yes.", "No!", "why", "Well? ", " ", "", "so\n.\x0b", f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn + rng.randint(0, 3), None]), rng.choice(["system", "user", "assistant", "user", "assistant", None, "tool"]), text))
    return [(*r, "x", 1) for r in rows]


@pytest.mark.parametrize("stretch,block", [(256, 20_000), (2, 20_000), (3, 5)])
def test_as_all_edits_would(spark, tmp_path, monkeypatch, stretch, block):
    rows = conversations(150)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    monkeypatch.setattr(conversation_repair, "STRETCH", stretch)
    monkeypatch.setattr(conversation_repair, "BLOCK", block)
    rows_in = conversation_repair.with_faults(conversation_repair.damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet"))).coalesce(1).toArrow().to_batches()
    found = {r["conv_id"]: tuple(r.values())[1:] for b in conversation_repair._repair(iter(rows_in)) for r in b.to_pylist()}
    assert found == brute(rows)
    if block > 5:
        again = op11_conversation_repair(spark, str(tmp_path)).collect()
        assert {r.conv_id: tuple(r)[1:] for r in again} == found and len(again) == len(found)


def test_one_long_conversation(spark, tmp_path):
    """Stretches and blocks of a conversation that is longer than both fit together: 30,000 sound rows need little but what damage did."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Row {i}.") for i in range(30_000)] + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Ho.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in op11_conversation_repair(spark, str(tmp_path)).collect()}
    mine = damage(rows[:30_000])
    kinds = faults(mine)
    r = found[1]
    assert (r.blank, r.duplicate, r.truncated) == tuple(kinds.count(k) for k in ("blank", "duplicate", "truncated"))
    assert len(r.audit.replace("I", "")) == len(mine)
    made, state, cost, at = [], 0, 0, 0
    for e in r.audit:
        cost += {"K": 0, "R": 1, "D": 2, "I": 5}[e]
        if e == "I":
            role, text = "assistant" if state else "user", ""
        else:
            _, _, role, text = mine[at]
            cost += 5 * (kinds[at] == "truncated" and e != "D")
            at += 1
            if e == "D":
                continue
            role = role if e == "K" else "assistant" if state else "user"
        assert role == ("assistant" if state else "user")
        state = 1 - state
        made.append(f"{role}:{text}")
    assert cost == r.cost and not state
    assert hashlib.sha256("\n".join(made).encode()).hexdigest() == r.repaired_sha256


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert op11_conversation_repair(spark, str(tmp_path)).collect() == []
