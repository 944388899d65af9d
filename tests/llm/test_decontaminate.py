import random

import numpy as np
import pyarrow as pa

from tallyweave.llm import decontaminate as op
from tests.llm.helpers import none, odd_documents, words


def plant(spark):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, n))) for k, n in enumerate((3, 5, 8, 15, 30, 30, 59))] + [(90, None), (91, ""), (92, "a"), (5, None)]
    rows, truth = [], set()
    for k in range(120):
        w = words(rng, rng.randint(0, 120))
        doc = 1000 + k
        if k % 2:
            item = rng.choice([i for i in items if i[1] and i[0] < 90])
            part = item[1].split()
            if k % 3 == 0 and len(part) >= 30:
                part[rng.choice((0, -1))] += "!"  # one shingle differs
            at = rng.randint(0, len(w))
            w[at:at] = [p.upper() if k % 5 == 0 else p for p in part]
            truth.add((doc, item[0]))
        elif k % 4 == 0:
            w += items[6][1].split()[:20]  # a third of an item is none
        rows.append((doc, rng.choice(("\n", " ", "\t ")).join(w), "en", "s", 1, 0.0))
    return odd_documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"), truth


def test_planted_passages(spark):
    docs, benchmark, truth = plant(spark)
    rows = op.matches(docs, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows if r.item_id != 92} == truth and all(r.similarity >= op.SIMILARITY and r.distance <= op.RADIUS for r in rows)
    assert {r.doc_id for r in rows if r.item_id == 92} == {4}
    kept = op.clean(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in truth} - {4}


def test_blocks_do_not_matter(spark, monkeypatch):
    docs, benchmark, _ = plant(spark)
    one = {tuple(r) for r in op.matches(docs, benchmark).collect()}
    monkeypatch.setattr(op, "BLOCK_ITEMS", 3)
    assert {tuple(r) for r in op.matches(docs, benchmark).collect()} == one


def test_empty(spark):
    docs, benchmark, _ = plant(spark)
    assert op.matches(none(docs), benchmark).count() == 0 and op.matches(docs, none(benchmark)).count() == 0
    assert op.clean(docs, none(benchmark)).count() == docs.count()


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**9, 20)) for _ in range(50)]
    block = op.Benchmark(list(range(50)), texts)
    prints = np.concatenate([block.lengths[0].prints ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, r, replace=False))) for r in range(20)])
    found = set(block.candidates(0, prints))
    near = op.distance(prints[:, None], block.lengths[0].prints[None]) <= op.RADIUS
    assert found == set(zip(*(x.tolist() for x in np.nonzero(near))))


def test_prefilter_loses_nothing():
    """Windows by brute force, without the test for a common shingle, find no more."""
    rng = random.Random(2)
    item = words(rng, 20)
    text = words(rng, 50) + item[:-1] + ["zz"] + words(rng, 40)
    block = op.Benchmark([0], [" ".join(item)])
    (found,) = block.search(pa.array([" ".join(text)]))
    w, sizes, _ = op.word_table(pa.array([" ".join(text)]))
    s, weight = op.shingles(w, 5), op.weights(sizes, 5)
    best = max((op.similarity(op.multiset(s[k : k + 16], weight[k : k + 16]), block.sets[0]), -k) for k in range(len(text) - 19))
    assert (found[2], -found[3]) == best


def brute_force(block, text):
    """(item, similarity, start, windows) by the similarity of every window with every item."""
    w, sizes, _ = op.word_table(pa.array([text]))
    out = []
    for k, (own, length) in enumerate(zip(block.sets, block.words)):
        width = min(op.K, int(length))
        s, weight = op.shingles(w, width), op.weights(sizes, width)
        n = int(length) - width + 1
        like = [op.similarity(op.multiset(s[i : i + n], weight[i : i + n]), own) for i in range(max(1, len(w) - int(length) + 1))]
        if max(like) >= op.SIMILARITY:
            out.append((k, max(like), like.index(max(like)), sum(x >= op.SIMILARITY for x in like)))
    return out


def test_recall_near_the_threshold():
    """Edits that leave a similarity near 0.8 are found as by brute force, also where a shingle repeats."""
    rng = random.Random(3)
    items = [words(rng, n) for n in (30, 55, 100)]
    block = op.Benchmark([0, 1, 2], [" ".join(x) for x in items])
    found, expected, apart = [], [], []
    for trial in range(150):
        part = list(items[trial % 3])
        if trial % 2:  # a repeated phrase at the end
            n = len(part) // 8
            part[-n:] = words(rng, 1) * n
        else:
            for _ in range(len(part) // 30):
                part[rng.randrange(len(part))] = "edited"
        text = " ".join(words(rng, 20) + part + words(rng, 20))
        expected += [(trial, *x) for x in brute_force(block, text)]
        rows = block.search(pa.array([text]))
        found += [(trial, item, like, start, n) for _, item, like, start, _, _, n, _ in rows]
        apart += [r[5] for r in rows]
    assert found == expected and sum(x[2] < 0.83 for x in expected) >= 10
    assert max(apart) > op.RADIUS  # SimHashes within the radius would not do


def test_the_multi_index_finds_nearly_all_by_itself():
    """Over planted edits down to 0.8, repeated shingles included, the lookup within RADIUS finds at least 0.9 of the windows."""
    rng = random.Random(8)
    items = [words(rng, n) for n in (12, 30, 55, 100)]
    block = op.Benchmark([0, 1, 2, 3], [" ".join(x) for x in items])
    found = []
    for trial in range(400):
        part = list(items[trial % 4])
        if trial % 5 == 0:
            n = max(1, len(part) // 10)
            part[-n:] = words(rng, 1) * n
        else:
            for _ in range(rng.randint(0, max(1, len(part) // 30))):
                part[rng.randrange(len(part))] = "edited"
        found += block.search(pa.array([" ".join(words(rng, 15) + part + words(rng, 15))]))
    windows, far = sum(r[6] for r in found), sum(r[7] for r in found)
    assert windows > 300 and any(r[2] < 0.85 for r in found) and 1 - far / windows >= 0.9


def test_window_prints_are_those_of_each_window():
    rng = np.random.default_rng(3)
    s, w = rng.integers(0, 2**63, 80).astype(np.uint64), rng.integers(1, 60, 80).astype(float)
    starts = np.arange(5, 60)
    stops = np.minimum(starts + 26, 78)
    alone = [op.fingerprints((op.sign_bits(s[a:b]) * w[a:b, None]).sum(axis=0)[None])[0] for a, b in zip(starts, stops)]
    assert op.window_prints(s, w, starts, stops).tolist() == alone


def test_a_whole_table_as_by_brute_force(spark):
    """Repeated rows and items, several lengths, repeated phrases: all pairs with similarity, place and count."""
    rng = random.Random(12)
    items = [words(rng, n) for n in (4, 9, 20, 20, 45)]
    benchmark = [(k, " ".join(x)) for k, x in enumerate(items)] + [(2, " ".join(items[2])), (None, " ".join(items[4]))]
    rows = []
    for k in range(40):
        part = list(rng.choice(items))
        if k % 3 == 0:
            part[rng.randrange(len(part))] = "edited"
        rows.append((k % 30, " ".join(words(rng, rng.randint(0, 40)) + part * (1 + k % 2) + words(rng, rng.randint(0, 40)))))
    rows += [rows[0], (None, rows[1][1]), (99, None), (98, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    block = op.Benchmark([i for i, _ in benchmark], [x for _, x in benchmark])
    expected = [(doc, block.ids[item], like, start, n) for doc, text in rows if text for item, like, start, n in brute_force(block, text)]
    found = [(r.doc_id, r.item_id, r.similarity, r.start_word, r.n_windows) for r in op.matches(docs, bench).collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)
