import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import period_runs
from tallyweave.llm.period_runs import damaged, find_runs, op12_periodic_runs, runs

from .helpers import none, odd_documents


def brute(words, least=12):
    """Every period's maximal stretches, kept if no smaller period holds in them."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 2 * q) and not any(all(words[x] == words[x + d] for x in range(i, j + q - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def damage(doc_id, words):
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def text_of(rng, size, letters):
    parts = []
    while len(parts) < size:
        piece = [rng.choice(letters) for _ in range(rng.randint(1, 9))]
        parts += piece * rng.choice([1, 1, 2, 3, 7])
    return parts[:size]


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_random_sequences(least):
    rng = random.Random(least)
    texts = [text_of(rng, rng.randint(0, 60), "abc"[: rng.randint(1, 3)]) for _ in range(400)]
    symbol, text = [], []
    for i, t in enumerate(texts):
        symbol += [ord(c) for c in t] + [0]
        text += [i] * (len(t) + 1)
    start, length, period = find_runs(np.array(symbol), np.array(text), least)
    base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    found = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()):
        found[text[s]].append((s - base[text[s]], n, q))
    for t, f in zip(texts, found):
        assert f == brute(t, least)


def test_whole_results_of_odd_and_periodic_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(text_of(rng, rng.randint(0, 200), ["ab", "c", "ß", "日本"]))) for i in range(100, 400)]
    docs = odd_documents(spark, [(i, t, "en", "a", 1, 0.0) for i, t in rows] + [(900, "x " * 5000, None, None, None, None), (901, "a b " * 20, None, None, None, None)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {}
    for r in op12_periodic_runs(spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, []).append(tuple(r)[1:])
    expected = {}
    for r in docs.collect():
        if r.doc_id == 5:
            continue
        words = damage(r.doc_id, re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        f = brute(words) if len(words) < 4000 else [(0, 5000, 1)]
        best = min(f, key=lambda x: (-x[1], x[0], x[2])) if f else None
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in f), collapsed(words, f))]
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        expected.setdefault(r.doc_id, []).append((len(f), *four, *digest))
    found.pop(5)
    assert found == expected
    assert sum(x[0] > 0 for v in expected.values() for x in v) > 50


def test_damage_is_as_written(spark):
    docs = odd_documents(spark)
    found = sorted((str(r.doc_id), (r.text or "").split()) for r in damaged(docs).collect())
    assert found == sorted((str(r.doc_id), damage(r.doc_id, (r.text or "").split())) for r in docs.collect())


def test_batches_do_not_matter(spark, monkeypatch):
    """Texts are cut into batches by size, never within; an empty table has no rows."""
    texts = [f"{'a b c ' * i} x{i}" for i in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    one = sorted(map(str, runs(docs).collect()))
    batch = docs.toArrow().to_batches()
    monkeypatch.setattr(period_runs, "BATCH", 100)
    small = [r for b in period_runs._runs(iter(batch), 12) for r in b.to_pylist()]
    monkeypatch.setattr(period_runs, "BATCH", 1)
    assert small == [r for b in period_runs._runs(iter(batch), 12) for r in b.to_pylist()]
    assert len(one) == len(small)
    assert runs(none(odd_documents(spark))).count() == 0
    assert damaged(none(docs)).where(F.col("text").isNotNull()).count() == 0
