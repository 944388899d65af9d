"""Token ids in ORC: stripes with run-length encoded integers, row indexes, and Bloom filters on document ids.

`write_tokens` range-partitions the documents by id, encodes each range in order and writes one file per
range. A row holds a document's ids and its place in its file, so that many stripes can be read at once
and no file depends on another. `token_offsets` turns places in files into places in the whole corpus: it
reads two narrow columns, sums them by file and adds a running total over files.
`lookup` prunes stripes and row groups by file statistics, row indexes and Bloom filters.

Null text counts as empty and has the end id alone. Rows with a null doc_id come first. Repeated rows
each keep their ids; equal doc_ids stand beside each other, the order among them being that of their texts.
An empty table writes no rows and reads back as none. Extra columns of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import kept, release, scratch, table

TOKENIZER, END_ID = "word_bpe_49k.json", 1
SCHEMA = "doc_id long, n_tokens long, part int, part_start long, ids array<int>"
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": "2000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
#: Words in the memory of one Python worker.
CACHE_WORDS = 600_000
#: Control marks that the cutting into words takes for white space and the tokenizer does not.
ODD_SPACE = "[\x1c-\x1f]"
#: Rows that are encoded at once.
ROWS = 2000
#: Rows and words where memory matters more than time, and new words that are then learned at once: what the tokenizer returns
#: is many times as large as ids.
LEAN_ROWS, LEAN_WORDS, NEW_WORDS = 1000, 200_000, 50_000
#: Marks that the tokenizer's pattern never joins to the letter or digit before them.
TAIL = ".,*#$%&!?;:|)]}-"
#: Words of letters whose lower case is one letter, and that are in composed form.
LATIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"


class WordEncoder:
    """Encodes texts word by word, remembering words: the tokenizer drops white space and no token spans it,
    so a text's ids are those of its words in a row. Texts with the four control marks that only one of
    the two sides takes for white space are encoded whole, with the rows around them. Ids come as little-endian unsigned 32-bit bytes.

    A new word of Latin letters, maybe with marks behind, is cut where the tokenizer's own pattern cuts it.
    Its letters, lower-cased as the tokenizer does, go through the same merges without the other steps;
    other words go through the whole tokenizer."""

    def __init__(self, json: str, lean: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.known, self.lean = Tokenizer.from_str(json), {}, lean
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words of letters, each of which ends with the one token that ends a word."""
        lines = self.merges.encode_batch_fast([" ".join(words[i : i + 100]) for i in range(0, len(words), 100)], add_special_tokens=False)
        ids = np.array([i for e in lines for i in e.ids], "<u4")
        ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
        if len(ends) != len(words):
            return self.whole(words)
        data, cuts = ids.tobytes(), ends.tolist()
        return [data[a:b] for a, b in zip([0, *cuts], cuts)]

    def learn(self, words: list[str]) -> None:
        """Remember words that are not known."""
        known = self.known
        column = pa.array(words, pa.string())
        cores = pc.utf8_rtrim(column, TAIL)
        cut = pc.match_substring_regex(cores, LATIN)
        rest = set(column.filter(pc.invert(cut)).to_pylist())
        column, cores = column.filter(cut), cores.filter(cut)
        lows = pc.utf8_lower(cores)
        same = pc.equal(column, lows)
        other = pc.invert(same)
        new = column.filter(same).to_pylist()
        words, lows, size = column.filter(other).to_pylist(), lows.filter(other).to_pylist(), pc.utf8_length(cores.filter(other)).to_pylist()
        tails = [w[n:] for w, n in zip(words, size)]
        rest.update(x for x in set(tails) if x and x not in known)
        known.update(zip(rest, self.whole(list(rest))))
        known.update(zip(new, self.letters(new)))
        more = [x for x in set(lows) if x not in known]
        known.update(zip(more, self.letters(more)))
        known.update((w, known[low] + known[t] if t else known[low]) for w, low, t in zip(words, lows, tails))

    def ids_of(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.known.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            part = NEW_WORDS if self.lean else len(missing)
            for k in range(0, len(missing), part):
                self.learn([words[j] for j in missing[k : k + part]])
            for k in missing:
                ids[k] = self.known[words[k]]
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and their number by text (null: none)."""
        if len(self.known) > (LEAN_WORDS if self.lean else CACHE_WORDS):
            self.known.clear()
        texts = texts.fill_null("")
        if pc.any(pc.match_substring_regex(texts, ODD_SPACE)).as_py():
            each = self.whole(texts.to_pylist())
            return np.frombuffer(b"".join(each), "<u4"), np.array([len(x) // 4 for x in each], np.int64)
        words = pc.utf8_split_whitespace(texts)
        kinds = words.flatten().dictionary_encode()
        each = self.ids_of(kinds.dictionary.to_pylist())
        size = np.array([len(x) // 4 for x in each], np.int64)
        at = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        lists = pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(each), "<u4")))
        ids = lists.take(kinds.indices).flatten().to_numpy()
        total = np.concatenate([[0], np.cumsum(size[kinds.indices.to_numpy()])])
        cuts = words.offsets.to_numpy() - words.offsets[0].as_py()
        return ids, np.diff(total[cuts])


def encoder(json: str, lean: bool = False) -> WordEncoder:
    """One per Python worker and tokenizer."""
    return kept(("tokenizer", hash(json), lean), lambda: WordEncoder(json, lean))


def tokenizer_json(path: str | None) -> str:
    """The tokenizer's file as read by the driver (a few MB whatever the corpus)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


def write_tokens(df: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, lean: bool = False) -> DataFrame:
    """Write df(doc_id, text) to `out` in ascending doc_id order and return the files as a DataFrame. lean: with less memory in
    more time; the files hold the same."""
    spark = df.sparkSession
    json = spark.sparkContext.broadcast(tokenizer_json(tokenizer))
    rows = LEAN_ROWS if lean else ROWS

    def run(batches):
        from pyspark import TaskContext

        part, at, enc = TaskContext.get().partitionId(), 0, encoder(json.value, lean)
        for big in batches:
            for k in range(0, big.num_rows, rows):
                batch = big.slice(k, rows)
                ids, n = enc.encode(batch.column(1))
                offsets = np.concatenate([[0], np.cumsum(n + 1)])
                every = np.full(offsets[-1], end_id, np.int32)
                own = np.ones(len(every), bool)
                own[offsets[1:] - 1] = False
                every[own] = ids
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(every))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n + 1), pa.array(np.full(len(n), part, np.int32)), pa.array(at + offsets[:-1]), lists], names)
                at += int(offsets[-1])
                if lean:
                    del ids, every, own, lists
                    release()
        big = batch = None
        release()

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    ordered = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SCHEMA).write.options(**ORC_OPTIONS).orc(out)
    return read_tokens(spark, out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of a few documents; the filter reaches the files' indexes and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def token_offsets(tokens: DataFrame) -> DataFrame:
    """(part, before): ids in all files before each file. One row per file."""
    sums = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def token_digest(tokens: DataFrame) -> DataFrame:
    """Start, length and checksum of every document, from the files."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, at = ids.values.to_numpy(zero_copy_only=False).view("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(at).astype("int64")), pa.array(crc, pa.int64())], ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])
        batch = ids = flat = None
        release()

    rows = tokens.select("doc_id", "part", "part_start", "ids").mapInArrow(run, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return rows.join(token_offsets(tokens), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
