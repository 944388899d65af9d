import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import jaccard_join as op
from tallyweave.llm.jaccard_join import Jaccard
from tests.llm.helpers import none, odd_documents, words

SPACE = re.compile("[^\x20\x09-\x0d]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def sets(rows, k):
    out = []
    for _, text in rows:
        w = SPACE.findall((text or "").translate(UPPER))
        out.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    return out


def brute(rows, rule):
    """n_shingles and the set of linked rows of every row, by comparing all pairs."""
    s, up = sets(rows, rule.k), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(s[i] & s[j])
            if s[i] and s[j] and 100 * common >= rule.percent * (len(s[i]) + len(s[j]) - common):
                up[top(i)] = top(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(top(i), []).append(rows[i][0])
    least = {t: min((x for x in ids if x is not None), default=None) for t, ids in groups.items()}
    return sorted(((rows[i][0], len(s[i]), least[top(i)]) for i in range(len(rows))), key=str)


def families():
    """Texts with few and with many changes, of all sizes, some around texts that many share."""
    rng, rows = random.Random(11), []
    shared = words(rng, 60)
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 12, 15, 20, 27, 40, 90, 300, 1000):
        base = words(rng, size)
        for changes in (0, 0, 1, 1, 2, 3, 5, 8, 13, 30):
            w = list(base)
            for _ in range(min(changes, size)):
                at = rng.randrange(len(w))
                kind = rng.random()
                if kind < 0.5:
                    w[at] = words(rng, 1)[0]
                elif kind < 0.75:
                    w.insert(at, words(rng, 1)[0])
                elif len(w) > 1:
                    del w[at]
            rows.append((len(rows) * 7 % 1000, " ".join(w) if rng.random() < 0.7 else "  ".join(w).upper()))
    for _ in range(40):
        rows.append((len(rows) * 7 % 1000, " ".join(shared[: rng.randint(40, 60)] + words(rng, rng.randint(0, 40)))))
    base = words(rng, 200)
    for _ in range(60):  # changed in places of their own, on both sides of the threshold
        w = list(base)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((len(rows) * 7 % 1000, " ".join(w)))
    return rows


@pytest.mark.parametrize("rule", [Jaccard(85, 4), Jaccard(80, 5)])
def test_against_all_pairs(spark, rule):
    rows = families()
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in op.classes(docs, rule).collect()), key=str) == brute(rows, rule)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((tuple(r) for r in op.classes(docs, Jaccard(85, 4)).collect()), key=str) == brute(rows, Jaccard(85, 4))
    assert op.classes(none(docs), Jaccard(85, 4)).count() == 0


def test_linked_sets_share_a_signature():
    import numpy as np

    rng, rule = np.random.default_rng(2), Jaccard(85, 4)
    for size in (*range(1, 60), 100, 250, 777, 3000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        for _ in range(4):
            gone = rng.integers(0, size + 1)
            new = rng.integers(0, max(1, size // 4) + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[: size - min(gone, size // 6)], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= 85 * (len(a) + len(b) - common):
                assert np.intersect1d(rule.signatures(a), rule.signatures(b)).size


def test_streamed_groups_do_not_depend_on_batches(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 40), rng.randint(0, 6)) for _ in range(300)]
    by = {}
    for s, n in set(rows):
        by.setdefault(s, set()).add(n)
    expected = sorted((s, n) for s, ns in by.items() if len(ns) > 1 for n in ns)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (1, 2, 3, 7, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
            assert sorted(tuple(r) for r in op.global_groups(spark.createDataFrame(rows, "sig long, node long")).collect()) == expected
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_of_nodes():
    place = {np.int64(7): 0, np.int64(-3): 2, np.int64(5): 3}
    assert op.rows_of(np.array([5, 5, -3, 7]), place).tolist() == [3, 3, 2, 0]
    assert op.rows_of(np.zeros(0, np.int64), {}).tolist() == []


def near_threshold():
    """Copies of a text of which most are not linked to it, some to one another alone."""
    rng, rows = random.Random(23), []
    base = words(rng, 150)
    for _ in range(8):
        middle = list(base)
        for at in range(5, 150, 21 + rng.randint(-2, 3)):
            middle[at] = words(rng, 1)[0]
        for _ in range(9):
            w = list(middle)
            for _ in range(rng.randint(0, 5)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((len(rows), " ".join(w)))
    return [(500, " ".join(base)), *rows, *[(600 + k, " ".join([*base[:130], *words(rng, k)])) for k in range(0, 60, 4)]]


@pytest.mark.parametrize("block", [None, 1500])
def test_no_pair_is_written_that_is_not_linked(spark, monkeypatch, block):
    """Near the threshold most pairs aren't linked; they are ruled out where they meet, in one cell or in those of several blocks."""
    found, across, rule, rows = [], op.across, Jaccard(80, 5), near_threshold()
    monkeypatch.setattr(op, "across", lambda done, *more: found.append((across(done, *more), {(r.a, r.b) for r in done.where("linked").collect()})) or found[-1][0])
    monkeypatch.setattr(op, "discard", lambda *frames: None)
    if block:
        monkeypatch.setattr(op, "BLOCK", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    features, _ = op.similar(docs, rule)
    of = dict(zip([r[0] for r in rows], sets(rows, rule.k)))
    text = {r.node: of[r.doc_id] for r in features.collect()}
    pairs = {(r.a, r.b) for r in found[0][0].collect()}
    assert all(100 * len(text[a] & text[b]) >= rule.percent * len(text[a] | text[b]) for a, b in pairs) and not pairs & found[0][1]
    assert sorted((tuple(r) for r in op.classes(docs, rule).collect()), key=str) == brute(rows, rule)


def test_what_two_differences_share(spark):
    """Whole differences give the similarity of two nodes exactly, whether what a node lacks of the lead is listed or what it has."""
    rng, rule = np.random.default_rng(9), Jaccard(80, 5)
    lead = rng.permutation(400)[:200]
    members = [np.union1d(rng.permutation(lead)[: rng.integers(1, 200)], rng.integers(400, 600, rng.integers(0, 150))) for _ in range(40)]
    members += [np.union1d(np.setdiff1d(m, m[:2]), [700 + k]) for k, m in enumerate(members)]
    nodes = spark.createDataFrame([(-1, lead.tolist()), *[(k, m.tolist()) for k, m in enumerate(members)]], "node long, features array<long>")
    done = op.compared(nodes, spark.createDataFrame([(-1, k) for k in range(len(members))], "a long, b long"), rule)
    t = done.selectExpr("*", "if(linked, -1, b) as cb", "0 as i", "0 as j", "false as side", "true as within").orderBy("b").toArrow()
    assert len(set(t.column("lacking").to_pylist())) == 2
    family = op.Family(t, rule)
    x, y = np.nonzero(~np.eye(80, dtype=bool))
    differ = family.differ[x] + family.differ[y] - 2 * family.common(x, y)
    assert differ.tolist() == [len(np.setxor1d(members[a], members[b])) for a, b in zip(x, y)]
    up = t.column("cb").to_pylist()
    for a, b in zip(*family.links()):
        up = [up[a] if u == up[b] else u for u in up]
    for a in range(80):
        for b in range(a):
            same = len(np.intersect1d(members[a], members[b]))
            if 100 * same >= 80 * (len(members[a]) + len(members[b]) - same):
                assert up[a] == up[b]
