import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyweave.llm import suffix_dedup
from tallyweave.llm.suffix_dedup import PrefixHashes, equal_classes, op13_suffix_dedup, remove_repeats, sort_suffixes

from .helpers import none, odd_documents, words


def brute(rows, length=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for k in range(len(b) - length + 1) if i is not None else ():
            w = b[k : k + length]
            least[w] = min(i, least.get(w, i))
    found = []
    for i, b in raw:
        out = bytearray(len(b))
        for k in range(len(b) - length + 1) if i is not None else ():
            if least[b[k : k + length]] < i:
                out[k : k + length] = b"\1" * length
        kept = bytes(c for c, o in zip(b, out) if not o)
        found.append((i, len(b), sum(out), len(re.findall(b"\1+", bytes(out))), hashlib.sha256(kept).hexdigest()))
    return Counter(found)


def shared(n=300):
    """Documents that share passages whole, at their edges, within a repeated row, and by one common passage in varied surroundings."""
    rng = random.Random(8)
    pool = [" ".join(words(rng, rng.randint(5, 60))) for _ in range(40)]
    common = " ".join(words(rng, 13))
    rows = []
    for i in range(1000, 1000 + n):
        parts = [" ".join(words(rng, rng.randint(0, 20))), rng.choice(pool), " ".join(words(rng, rng.randint(0, 9))), common if i % 3 == 0 else "", rng.choice(pool)[rng.randint(0, 30) :]]
        rows.append((i if i % 50 else 1001, rng.choice([" ", "\n", ""]).join(parts), "en", "a", 1, 0.0))
    rows += [(500, "ab" * 300, "en", "a", 1, 0.0), (501, "x" * 49, "en", "a", 1, 0.0), (502, "x" * 49, "en", "a", 1, 0.0), (503, "ab" * 40 + "c", "en", "a", 1, 0.0), (-4, "é" * 60, "en", "a", 1, 0.0), (504, "zé" + "é" * 40, "en", "a", 1, 0.0)]
    return [*rows, *rows[:20]]


@pytest.mark.parametrize("crowd,batch,cut", [(4096, 24 << 20, 1 << 17), (3, 24 << 20, 1 << 17), (3, 2000, 200)])
def test_as_a_table_of_all_strings_would(spark, tmp_path, monkeypatch, crowd, batch, cut):
    """Whatever the sizes of batches and slices are, and with crowded anchors."""
    for name, value in (("CROWD", crowd), ("BATCH", batch), ("SLICE", cut)):
        monkeypatch.setattr(suffix_dedup, name, value)
    # Workers may have imported the module before: hand the sizes over with the functions.
    def with_sizes(real):
        def sized(first, *more):
            from tallyweave.llm import suffix_dedup as m

            m.CROWD, m.BATCH, m.SLICE = crowd, batch, cut
            return real(first, *more)

        return sized

    for f in ("_pieces", "_contents"):
        monkeypatch.setattr(suffix_dedup, f, with_sizes(getattr(suffix_dedup, f)))
    settled = with_sizes(suffix_dedup._settled)
    monkeypatch.setattr(suffix_dedup, "_settled", lambda group: settled(group))
    docs = odd_documents(spark, shared())
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = Counter(tuple(r) for r in op13_suffix_dedup(spark, str(tmp_path)).collect())
    assert found == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(n for x, n in found.items() if x[2]) > 200


def test_other_lengths_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox jumps over"), (2, "a quick brown fox, and"), (3, "brown fox jumps")], "doc_id long, text string")
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in remove_repeats(docs, 12, 8).collect()}
    assert got == {1: (b"the quick brown fox jumps over", []), 2: (b"a, and", [(1, 17)]), 3: (b"", [(0, 15)])}
    assert remove_repeats(none(odd_documents(spark))).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(docs, 8, 8)


def test_suffixes_are_sorted_by_bytes():
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)) + b"c" * 60, np.uint8)
    at = np.array(rng.sample(range(3000), 2000))
    group = np.sort(np.array([rng.randrange(5) for _ in at]))
    order = sort_suffixes(PrefixHashes(data), at, group, 50)
    assert (group[order] == group).all()
    key = [(g, data[a : a + 50].tobytes()) for g, a in zip(group, at[order])]
    assert key == sorted(key)


def test_collisions_are_told_apart(monkeypatch):
    """With a hash that knows nothing but the first byte, classes are still those of equal bytes."""
    data = np.frombuffer(b"".join(bytes([65 + i % 2]) * 8 + bytes([97 + i % 3]) * 12 for i in range(60)), np.uint8)
    at = np.arange(60) * 20

    class Liar(PrefixHashes):
        def __call__(self, at, n):
            return self.data[at].astype(np.uint64)

    order, head = equal_classes(Liar(data), at, np.zeros(60, np.int64), 20)
    strings = [data[a : a + 20].tobytes() for a in at[order]]
    assert head.sum() == len(set(strings)) == 6
    assert all(h == (i == 0 or strings[i] != strings[i - 1]) for i, h in enumerate(head))
