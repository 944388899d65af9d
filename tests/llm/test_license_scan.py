import random
import re
from re import _constants as sre
from re import _parser as sre_parser

from tallyweave.llm import license_scan as op
from tests.llm.helpers import none, odd_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {i: i + 32 for i in range(65, 91)}
TEXTS = {
    100: "MIT license MIT License mit, LICENSE", 101: "Released under the MIT License. GNU General\nPublic-License general public license",
    102: "Licensed under the Apache License, Version 2.0.", 103: "Licensed under CC BY-NC 4.0.", 104: "SPDX-License-Identifier: GPL-3.0-or-later", 105: "commit license permit licenses",
    106: "é mit license é", 107: "license", 108: "This work is licensed under the GNU General Public License, version 3.", 109: "mit license " * 300,
}
LABELS = {102: {"apache-2.0"}, 103: {"cc-by-nc"}, 104: {"gpl-3.0"}, 108: {"gpl-3.0"}, 105: set(), 107: set()}


def brute(text):
    w = WORD.findall((text or "").translate(UPPER))
    at = [(k, label) for phrase, label in op.BASE for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    places = [k for k, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_and_labels(spark):
    docs = odd_documents(spark, [(k, t, "en", "s", 1, 0.0) for k, t in TEXTS.items()])
    rows = op.scan(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(texts[r.doc_id])
        labels = set(r.labels.split(",")) - {""}
        assert set(r.base_labels.split(",")) - {""} <= labels and 0 <= r.score <= 1 and (r.score > 0) >= bool(labels)
        if r.doc_id in LABELS:
            assert LABELS[r.doc_id] <= labels and (labels or not LABELS[r.doc_id])


def test_containment(spark):
    """Of detections within others only those of higher rank stand."""
    docs = spark.createDataFrame([(1, "licensed under the apache license version 2 0 license and public domain")], "doc_id long, text string")
    spans = op.scan(docs).first().stands
    for a in spans:
        for b in spans:
            inside = b.start <= a.start and b.stop >= a.stop
            assert not (inside and (b.priority > a.priority or (b.priority == a.priority and b.stop - b.start > a.stop - a.start)))
    assert {"apache-2.0", "public-domain"} <= {s.label for s in spans}


def test_empty(spark):
    assert op.scan(none(odd_documents(spark))).count() == 0


def test_rules():
    """Each stands for itself: no two patterns or priorities out of range, and keywords are words."""
    assert len({pattern for _, pattern, *_ in op.RULES}) == len(op.RULES) >= 200
    assert all(p in op.PRIORITIES and 0 < c <= 1 and WORD.findall(k.replace("|", " ")) == k.replace("|", " ").split() for *_, k, p, c in op.RULES)


def samples(parsed):
    """Strings that the pattern matches, with each of its alternatives and options taken and left at least once."""
    parts = []
    for kind, arg in parsed:
        if kind is sre.LITERAL:
            parts.append([chr(arg)])
        elif kind is sre.BRANCH:
            parts.append([x for option in arg[1] for x in samples(option)])
        elif kind is sre.SUBPATTERN:
            parts.append(samples(arg[3]))
        elif kind is sre.MAX_REPEAT and arg[1] == 1:
            parts.append(["", *samples(arg[2])])
        else:
            digit = kind is sre.IN and arg[0][0] is sre.CATEGORY
            parts.append(["3"] if digit else [chr(x) for _, x in arg] if kind is sre.IN else ["zz"])
    first = [p[0] for p in parts]
    return list(dict.fromkeys("".join(first[:k] + [x] + first[k + 1 :]) for k, p in enumerate(parts) for x in p))


def unfiltered(text):
    """Labels and score by all rules, without keywords."""
    spans = [(m.start(), m.end(), priority, confidence, label) for label, pattern, _, priority, confidence in op.RULES for m in re.finditer(f"(?<= )(?:{pattern})(?= )", f" {text} ")]
    stand = [a for a in spans if not any(b[0] <= a[0] and b[1] >= a[1] and (b[2], b[1] - b[0]) > (a[2], a[1] - a[0]) for b in spans)]
    return {a[4] for a in stand}, max((a[3] for a in stand), default=0.0)


def test_every_alternative_is_found(spark):
    """A text that is nothing but a match gets what all rules without keywords find in it."""
    texts = sorted({x for _, pattern, *_ in op.RULES for x in samples(sre_parser.parse(pattern))})
    assert all(any(re.fullmatch(pattern, x) for x in texts) for _, pattern, *_ in op.RULES)
    rows = op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        labels, score = unfiltered(texts[r.doc_id])
        base = set(r.base_labels.split(",")) - {""}
        assert labels and (set(r.labels.split(",")) - {""}, r.score) == (labels | base, score), texts[r.doc_id]


def test_labels_and_score_of_mixed_texts(spark):
    """Several notices in one text, one within another, against all rules without keywords."""
    rng = random.Random(6)
    every = [x for _, pattern, *_ in op.RULES for x in samples(sre_parser.parse(pattern))[:2]]
    texts = [" ".join(x for _ in range(rng.randint(1, 6)) for x in (rng.choice(every), rng.choice(["and", "mit license", "", "version 2"]))) for _ in range(400)]
    texts = [" ".join(t.split()) for t in texts]
    for r in op.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        labels, score = unfiltered(texts[r.doc_id])
        assert (set(r.labels.split(",")) - {""}, r.score) == (labels | set(r.base_labels.split(",")) - {""}, score), texts[r.doc_id]


def test_many_places(spark):
    n = 16_000
    r = op.scan(spark.createDataFrame([(1, "Licensed under the MIT license. " * n)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (5 * n, n, 3, 5 * n - 2, "mit", "mit", 0.97)
    assert len(r.stands) == n and r.stands[n - 1].start == 32 * (n - 1) - (n - 1) + 1
