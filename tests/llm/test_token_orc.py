import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyweave.llm import token_orc as op
from tallyweave.llm.common import scratch
from tests.llm.helpers import none, odd_documents

P = pytest.importorskip("public_tokenizers")


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(op.TOKENIZER))
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip(spark):
    docs = odd_documents(spark, [(20, "It'll <|endoftext|> x1y2 don't... A\x1cB", "en", "a", 1, 0.0), (21, "a\x85b c\xa0d İx ΣΑΣ  — “q”", "en", "a", 1, 0.0)])
    path = scratch(spark, "t")
    tokens = op.write_tokens(docs, path)
    found = [tuple(r) for r in op.token_digest(tokens).orderBy("start").collect()]
    assert found == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert [r.doc_id for r in op.lookup(spark, path, [7]).collect()] == [7, 7]


def test_empty_table(spark):
    assert op.token_digest(op.write_tokens(none(odd_documents(spark)), scratch(spark, "t"))).count() == 0


def test_encoder_equals_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(op.TOKENIZER))
    texts = ["Reed*** reed### don't", None, "", "É école Straße ŉ Ǆ áb", "naïve.,.; (Foo)-bar baz-", "x" * 500]
    ids, n = op.WordEncoder(op.tokenizer_json(None)).encode(pa.array(texts))
    each = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert n.tolist() == [len(e) for e in each] and ids.tolist() == [i for e in each for i in e]


def test_lean_files_hold_the_same(spark):
    docs = odd_documents(spark)
    plain, lean = (op.token_digest(op.write_tokens(docs, scratch(spark, "t"), lean=x)).collect() for x in (False, True))
    assert sorted(map(tuple, lean), key=str) == sorted(map(tuple, plain), key=str)


def test_words_are_learned_in_parts(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(op, "NEW_WORDS", 3)
    text = "The cat, the Dog. x1y2 don't café CAFÉ! plain words and More words, ünï 日本語"
    encoder, most = op.WordEncoder(op.tokenizer_json(None), lean=True), []
    whole = encoder.whole
    monkeypatch.setattr(encoder, "whole", lambda words: most.append(len(words)) or whole(words))
    ids, n = encoder.encode(pa.array([text, None]))
    assert ids.tolist() == Tokenizer.from_file(P.path(op.TOKENIZER)).encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids), 0]
    assert max(most) <= 6


def test_another_operators_task_drops_the_tokenizer(spark):
    """As in a worker: what the token stage has kept is gone when a task of the join has begun."""
    from tallyweave.llm import common, jaccard_join

    op.encoder(op.tokenizer_json(None))
    assert common._KEPT
    runs = []

    class Docs:
        schema = spark.range(0).schema
        select = lambda self, *columns: self
        mapInArrow = lambda self, run, schema: runs.append(run)

    jaccard_join.describe(Docs(), jaccard_join.Jaccard(), "id", "text")
    assert list(runs[0](iter(()))) == [] and not common._KEPT
