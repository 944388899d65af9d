"""Language identification by interpolated Kneser-Ney models over characters, one per language.

Letters become numbers of 16 bits and runs of anything else one gap. An n-gram's hash is its four numbers in
64 bits; hashes stand sorted in one array per order, beside them each language's log-probability, worked out
down to the lowest order, so that one binary search serves all languages and only n-grams that no language
has seen go on to shorter ones. A text gets the language of lowest cross-entropy per character; it is
rejected if that is far above what the language's own documents have, as measured on documents kept out
of the counts; those of languages too small for that are counted in halves, and each half is measured by the other.

Models come from a bounded sample: about TRAIN_DOCS and CALIBRATE_DOCS documents of each language, picked
by a hash of the id. Counting and scoring run on the executors; the driver gets n-gram counts of the sample.
Scoring is one pass without a shuffle, in pieces of PIECE characters. A longer text is scored in several,
each beginning with an empty context.

Null text, empty text and text without a letter are `und`, rejected, with score 0; so is everything if nothing
can be learned. Languages tie by name. Repeated rows repeat; a null id is not held out and not learned
from. Extra columns are dropped by `predict` and kept by `keep_accepted`, which needs no column of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import forget, release, table

ORDER = 4
#: Bits of a letter. All letters of a sample have a number, the commonest first; LETTERS is far more than a sample has.
BITS = 16
OTHER, LETTERS = (1 << BITS) - 1, (1 << BITS) - 2
TRAIN_DOCS, CALIBRATE_DOCS = 500, 250
#: Languages with fewer documents are counted whole, and measured by halves.
LEAST_KEPT_OUT, KEPT_OUT = 30, -1
FOLDS = 5
PIECE = 1 << 20
#: Characters that are scored at once, about, but for longer pieces; it has no influence on results.
SCORED = 1 << 18
#: Cross-entropy above the language's mean, over 1/sqrt(length) + SLACK, may be MARGIN times the QUANTILE of the
#: documents kept out, and LEAST in any case.
QUANTILE, MARGIN, SLACK, LEAST = 0.999, 2.5, 0.05, 15.0
UND = "und"


def fold(key: str) -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(FOLDS))


@dataclass
class Alphabet:
    """Numbers of code points: 0 for what is no letter, OTHER for letters without a number of their own."""

    number: np.ndarray
    letters: int = 0

    @property
    def size(self) -> int:
        """How many symbols there are: the gap, the letters, and one for all others."""
        return self.letters + 2

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Rows of tables by symbol."""
        return np.minimum(numbers, np.uint64(self.letters + 1)).astype(np.int64)

    @classmethod
    def of(cls, letters: list[str]) -> Alphabet:
        number = np.zeros(0x110000, np.uint16)
        number[[c for c in range(0x110000) if chr(c).isalpha()]] = OTHER
        for k, c in enumerate(letters[:LETTERS]):
            for x in {c, c.upper(), c.title()}:
                if len(x) == 1:
                    number[ord(x)] = k + 1
        return cls(number, len(letters[:LETTERS]))

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the n-gram that ends at each letter or gap; where each text begins; which have letters."""
        if not texts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "replace"), np.uint32)
        ids = self.number[points]
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        # Letters, and the first of what follows a letter: a text has no gap before its first letter.
        keep = ids != 0
        keep[1:] |= ids[:-1] != 0
        at = np.concatenate([[0], np.cumsum(keep)])
        ids, starts = ids[keep], at[starts]
        ends = np.append(starts[1:], len(ids))
        key = ids.astype(np.uint64)
        for k in range(1, ORDER):
            older = np.zeros(len(ids), np.uint64)
            older[k:] = ids[:-k]
            for j in range(k):
                place = starts + j
                older[place[place < ends]] = 0
            key |= older << np.uint64(BITS * k)
        return key, starts, ends > starts


@dataclass
class Model:
    """languages, and for each order the sorted hashes with log2-probabilities (one column a language);
    for contexts of each length the sorted hashes with log2 of the weight left to the shorter context."""

    languages: list[str]
    alphabet: Alphabet
    hashes: dict[int, np.ndarray]
    logp: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    left: dict[int, np.ndarray]
    mean: np.ndarray | None = None
    limit: float = np.inf

    def log2(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        if order == 1:
            return self.logp[1][self.alphabet.place(keys)]
        known = self.hashes[order]
        at = np.searchsorted(known, keys)
        at[at == len(known)] = 0
        out = self.logp[order][at]
        miss = np.flatnonzero(known[at] != keys)
        if len(miss):
            few = keys[miss]
            out[miss] = self.log2(few & np.uint64((1 << BITS * (order - 1)) - 1), order - 1)
            context = few >> np.uint64(BITS)
            known = self.contexts[order - 1]
            at = np.searchsorted(known, context)
            at[at == len(known)] = 0
            seen = known[at] == context
            out[miss[seen]] += self.left[order - 1][at[seen]]
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character by text and language, and the number of characters scored (0: no letter)."""
        bits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        todo: list[tuple[int, str]] = []
        size = 0
        for k, t in enumerate([*texts, None]):
            for piece in [t[i : i + PIECE] for i in range(0, len(t), PIECE)] if t else []:
                todo.append((k, piece))
                size += len(piece)
            if todo and (size >= SCORED or k == len(texts)):
                keys, starts, some = self.alphabet.grams([p for _, p in todo])
                if len(keys):
                    sums = np.add.reduceat(self.log2(keys), starts[some], axis=0, dtype=np.float64)
                    owner = np.array([k for k, _ in todo])[some]
                    np.add.at(bits, owner, -sums)
                    np.add.at(n, owner, np.diff(np.append(starts[some], len(keys))))
                todo, size = [], 0
        return bits / np.maximum(n, 1)[:, None], n

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether accepted. The score weighs each language by its likelihood over 200
        characters at most, so that long texts don't all get 1."""
        if not self.languages:
            return [UND] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        lowest = h[np.arange(len(h)), best]
        odds = np.exp2((lowest[:, None] - h) * np.minimum(n, 200)[:, None] / 4).sum(axis=1)
        ok = n > 0
        above = (lowest - self.mean[best]) / (1 / np.sqrt(np.maximum(n, 1)) + SLACK)
        return [self.languages[b] if k else UND for b, k in zip(best, ok)], np.where(ok, 1 / np.maximum(odds, 1), 0.0), ok & (above <= self.limit)


def lookup(known: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float = 0.0) -> np.ndarray:
    if not len(known):
        return np.full(len(keys), default)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, values[at], default)


def kneser_ney(alphabet: Alphabet, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """From each language's n-grams of the highest order and their counts."""
    languages = sorted(counts)
    cut = lambda keys, order: keys & np.uint64((1 << BITS * order) - 1)
    tables: dict[str, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
    for lang, (keys, n) in counts.items():
        levels = {ORDER: (keys, n.astype(float))}
        for order in range(ORDER - 1, 0, -1):
            # How many longer n-grams an n-gram ends.
            short, many = np.unique(cut(levels[order + 1][0], order), return_counts=True)
            levels[order] = (short, many.astype(float))
        tables[lang] = levels
    hashes = {o: np.unique(np.concatenate([tables[x][o][0] for x in languages])) for o in range(2, ORDER + 1)}
    contexts = {o - 1: np.unique(hashes[o] >> np.uint64(BITS)) for o in range(2, ORDER + 1)}
    logp = {o: np.zeros((len(h), len(languages)), np.float32) for o, h in hashes.items()} | {1: np.zeros((alphabet.size, len(languages)), np.float32)}
    left = {o: np.zeros((len(c), len(languages)), np.float32) for o, c in contexts.items()}
    for j, lang in enumerate(languages):
        p = None  # of the order below, for all its hashes
        for order in range(1, ORDER + 1):
            keys, n = tables[lang][order]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            d = ones / (ones + 2 * twos) if ones and twos else 0.5
            if order == 1:
                p = np.full(alphabet.size, d * len(n) / n.sum() / alphabet.size)
                p[alphabet.place(keys)] += (n - d) / n.sum()
                logp[1][:, j] = np.log2(p)
                continue
            context = keys >> np.uint64(BITS)
            seen, at = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at).astype(float)
            weight = d * kinds / total
            every = hashes[order]
            shorter = cut(every, order - 1)
            below = p[alphabet.place(shorter)] if order == 2 else p[np.searchsorted(hashes[order - 1], shorter)]
            over = every >> np.uint64(BITS)
            own = np.maximum(lookup(keys, n, every) - d, 0) / lookup(seen, total, over, 1.0)
            p = own + lookup(seen, weight, over, 1.0) * below
            logp[order][:, j] = np.log2(p)
            left[order - 1][:, j] = np.log2(lookup(seen, weight, contexts[order - 1], 1.0))
    return Model(languages, alphabet, hashes, logp, contexts, left)


def sample(docs: DataFrame, key: str, lang: str, text: str) -> DataFrame | None:
    """(lang, text, part): about TRAIN_DOCS + CALIBRATE_DOCS learnable documents of each language. part is 0 for those that are
    counted, KEPT_OUT for those that are not, and 1 or 2 for the halves of a language too small for that."""
    learnable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (fold(key) != 0))
    n = {r[0]: r[1] for r in learnable.groupBy(lang).count().collect()}
    if not n:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(n.items()) for x in (k, min(1.0, (TRAIN_DOCS + CALIBRATE_DOCS) / v))]), F.col(lang))
    u = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    kept_out = F.pmod(F.xxhash64(F.col(key), F.lit("calibrate")), F.lit(TRAIN_DOCS + CALIBRATE_DOCS)) < CALIBRATE_DOCS
    enough = F.col(lang).isin(*[k for k, v in n.items() if v >= LEAST_KEPT_OUT])
    half = F.pmod(F.xxhash64(F.col(key), F.lit("half")), F.lit(2)) + 1
    part = F.when(~enough, half).when(kept_out, KEPT_OUT).otherwise(0).cast("int")
    return learnable.where(u < share).select(F.col(lang).alias("lang"), F.col(text).alias("text"), part.alias("part"))


def train(docs: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> Model:
    nothing = Model([], Alphabet(np.zeros(0, np.uint8)), {}, {}, {}, {})
    rows = sample(docs, key, lang, text)
    if rows is None:
        return nothing
    rows = rows.persist()
    try:
        letters = rows.where(F.col("part") != KEPT_OUT).select(F.explode(F.split(F.lower("text"), "")).alias("c")).groupBy("c").count().collect()
        common = sorted((r for r in letters if len(r["c"]) == 1 and r["c"].isalpha()), key=lambda r: (-r["count"], r["c"]))
        alphabet = Alphabet.of([r["c"] for r in common])

        def count(batches):
            for batch in batches:
                kinds = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()))
                texts = batch.column(1).to_pylist()
                for x in sorted(set(kinds)):
                    keys, n = np.unique(alphabet.grams([t[i : i + PIECE] for t, y in zip(texts, kinds) if y == x for i in range(0, len(t), PIECE)])[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([x[0]] * len(keys)), pa.array([x[1]] * len(keys), pa.int32()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["lang", "part", "key", "n"])

        grams = rows.where(F.col("part") != KEPT_OUT).select("lang", "text", "part").mapInArrow(count, "lang string, part int, key long, n long").groupBy("lang", "part", "key").agg(F.sum("n").alias("n")).toArrow()
        langs, parts, keys, n = (grams.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "part", "key", "n"))

        def model_of(rows: np.ndarray) -> Model:
            counts = {}
            for x in sorted(set(langs[rows])):
                own = rows & (langs == x)
                kinds, at = np.unique(keys[own].view(np.uint64), return_inverse=True)
                counts[x] = (kinds, np.bincount(at, n[own]).astype(np.int64))
            return kneser_ney(alphabet, counts)

        if not len(langs):
            return nothing
        model = model_of(parts == parts)
        measured = {KEPT_OUT: model} | {h: model_of(parts != h) for h in (1, 2) if (parts == h).any() and (parts != h).any()}
        calibrate(model, rows, measured)
        return model
    finally:
        rows.unpersist()


def calibrate(model: Model, rows: DataFrame, measured: dict[int, Model]) -> None:
    """Set each language's mean and the limit from documents that the model which measures them has not counted: measured has
    that model for each part. Only where there are none is the model held against what it has counted."""

    def measure(models: dict[int, Model]):
        def run(batches):
            for batch in batches:
                langs, texts, parts = (batch.column(k).to_pylist() for k in range(3))
                for part, by in models.items():
                    own = [k for k, p in enumerate(parts) if p == part and langs[k] in by.languages]
                    if own:
                        h, n = by.entropies([texts[k] for k in own])
                        best = [model.languages.index(by.languages[j]) for j in h.argmin(axis=1)]
                        yield pa.RecordBatch.from_arrays([pa.array(best, pa.int32()), pa.array(h.min(axis=1)), pa.array(n)], ["best", "h", "n"])

        return rows.select("lang", "text", "part").mapInArrow(run, "best int, h double, n long").where("n > 0").toPandas()

    found = measure(measured)
    if not len(found):
        found = measure({part: model for part in (0, 1, 2)})
    h, n, best = found.h.to_numpy(float), found.n.to_numpy(float), found.best.to_numpy()
    every = (h * n).sum() / n.sum() if len(n) else np.inf
    model.mean = np.array([(h * n)[best == j].sum() / n[best == j].sum() if (best == j).any() else every for j in range(len(model.languages))])
    above = (h - model.mean[best]) / (1 / np.sqrt(n) + SLACK) if len(n) else np.zeros(0)
    model.limit = max(MARGIN * np.quantile(above, QUANTILE), LEAST) if len(n) else np.inf


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score, accepted) for every row."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        for big in batches:
            for k in range(0, big.num_rows, 1000):
                batch = big.slice(k, 1000)
                lang, score, accepted = shared.value.decide(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)], [key, "lang_pred", "score", "accepted"])
        big = batch = None
        release()

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text is accepted, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        forget()
        for big in batches:
            for k in range(0, big.num_rows, 1000):
                batch = big.slice(k, 1000)
                accepted = shared.value.decide(batch.column(at).to_pylist())[2]
                yield batch.filter(pa.array(accepted))
        big = batch = None
        release()

    at = docs.columns.index(text)
    return docs.mapInArrow(run, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
