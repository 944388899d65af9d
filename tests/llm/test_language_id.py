import math
import random
from collections import Counter

import numpy as np

from tallyweave.llm import language_id as op
from tests.llm.helpers import none, odd_documents

ENDS = {"aa": "tion ing the of and".split(), "bb": "keit ung der die sch".split(), "cc": "ción mente de los que".split()}


def corpus(spark):
    rng = random.Random(3)
    rows = []
    for k in range(360):
        lang = sorted(ENDS)[k % 3]
        text = " ".join(rng.choice(ENDS[lang]) + rng.choice(["", rng.choice(ENDS[lang])]) for _ in range(60))
        rows.append((k, text, lang if k % 10 else None, "s", len(text), 0.0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")


def test_held_out_accuracy_and_rejection(spark):
    docs = corpus(spark)
    model = op.train(docs)
    truth = {r.doc_id: sorted(ENDS)[r.doc_id % 3] for r in docs.select("doc_id").collect()}
    rows = op.predict(docs, model).collect()
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.accepted for r in rows) == len(rows)
    lang, score, ok = model.decide(["ψηφιακά ελληνικά γράμματα και λόγια πολλά ακόμη", None, "", "123 !?", "the of and ing tion the"])
    assert not ok[0] and lang[1:4] == ["und"] * 3 and not ok[1:4].any() and score[1:4].tolist() == [0, 0, 0] and (lang[4], bool(ok[4])) == ("aa", True)


def test_batches_do_not_matter(spark):
    docs = corpus(spark)
    model = op.train(docs)
    texts = [r.text for r in docs.limit(30).collect()] + ["x", "ab", "abc"]
    alone = [model.decide([t]) for t in texts]
    together = model.decide(texts)
    assert [a[0][0] for a in alone] == together[0] and [a[1][0] for a in alone] == together[1].tolist()


def test_probabilities_sum_to_one(spark):
    model = op.train(corpus(spark))
    context = np.uint64(1 << 2 * op.BITS | 2 << op.BITS | 3)
    symbols = np.append(np.arange(model.alphabet.size - 1, dtype=np.uint64), np.uint64(op.OTHER))
    keys = (context << np.uint64(op.BITS)) + symbols
    assert np.allclose(np.exp2(model.log2(keys).astype(float)).sum(axis=0), 1, atol=1e-3)


def brute_log2(texts, letters):
    """Interpolated Kneser-Ney by its definition, with dictionaries: log2 of the probability of a symbol after three."""
    counts = {op.ORDER: Counter()}
    for t in texts:
        ids = []
        for c in t.lower() + "\n":  # a text ends in a gap
            if c.isalpha():
                ids.append(letters.index(c) + 1)
            elif ids and ids[-1]:
                ids.append(0)
        ids = [None] * (op.ORDER - 1) + ids
        counts[op.ORDER].update(tuple(0 if x is None else x for x in ids[k - op.ORDER + 1 : k + 1]) for k in range(op.ORDER - 1, len(ids)))
    for o in range(op.ORDER - 1, 0, -1):
        counts[o] = Counter(g[1:] for g in counts[o + 1])
    def off(o):
        ones, twos = (sum(n == k for n in counts[o].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5
    def p(g):
        o, c = len(g), counts[len(g)]
        if o == 1:
            total = sum(c.values())
            return max(c[g] - off(1), 0) / total + off(1) * len(c) / total / (len(letters) + 2)
        after = {k: n for k, n in c.items() if k[:-1] == g[:-1]}
        if not after:
            return p(g[1:])
        return max(c[g] - off(o), 0) / sum(after.values()) + off(o) * len(after) / sum(after.values()) * p(g[1:])
    return lambda g: math.log2(p(g))


def test_against_kneser_ney_by_definition():
    rng = random.Random(8)
    letters = list("abcdé日本")
    texts = ["".join(rng.choice("aab bcd,é日本 ") for _ in range(60)).strip() for _ in range(12)]
    alphabet = op.Alphabet.of(letters)
    keys, n = np.unique(alphabet.grams(texts)[0], return_counts=True)
    model = op.kneser_ney(alphabet, {"x": (keys, n)})
    expected = brute_log2(texts, letters)
    for _ in range(500):
        g = tuple(rng.randrange(len(letters) + 1) for _ in range(op.ORDER))
        key = np.array([sum(x << op.BITS * (op.ORDER - 1 - k) for k, x in enumerate(g))], np.uint64)
        assert math.isclose(model.log2(key)[0, 0], expected(g), abs_tol=1e-4), g


def test_many_letters_and_small_languages(spark):
    """Each of thousands of letters counts; a language of a few documents is measured by its halves."""
    rng = random.Random(4)
    hanzi, kana = [chr(0x4E00 + k) for k in range(3000)], [chr(0x3041 + k) for k in range(80)]
    rows = [(k, "".join(rng.choice(hanzi if k % 2 else hanzi[:300] + kana * 20) for _ in range(200)), "zh" if k % 2 else "ja") for k in range(40)]
    model = op.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.alphabet.letters > 2000 and np.isfinite(model.limit) and np.isfinite(model.mean).all()
    lang, _, ok = model.decide([t for _, t, _ in rows])
    assert lang == [x for *_, x in rows] and ok.all()


def test_odd_rows_and_nothing_to_learn(spark):
    docs = odd_documents(spark)
    rows = op.predict(docs, op.train(docs)).collect()
    assert len(rows) == docs.count() and {r.lang_pred for r in rows if r.doc_id in (1, 2, 3)} == {"und"}
    empty = op.train(none(docs))
    assert {(r.lang_pred, r.score) for r in op.predict(docs, empty).collect()} == {("und", 0.0)}
    kept = op.keep_accepted(docs, op.train(docs))
    assert kept.columns == docs.columns and kept.where("text is null or trim(text) = ''").count() == 0
