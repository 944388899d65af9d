"""Word shingles as 64-bit hashes, for columns of texts.

Words are runs of anything but ASCII white space, with A-Z lower-cased. Sets compare by hash: two
different shingles share one with a probability of 2**-64."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_table(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths in bytes of all words, one text after another, and where each text's begin (and the last ends)."""
    if not len(texts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    # A blank in front makes the first piece of every text empty, so that each has one.
    padded = pc.binary_join_element_wise(" ", pc.ascii_lower(texts.fill_null("")), "")
    words = pc.ascii_split_whitespace(padded)
    kinds = words.flatten().dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, kinds.dictionary.to_pylist()), np.uint64, len(kinds.dictionary))
    size = np.array(pc.binary_length(kinds.dictionary), np.int64)
    index = kinds.indices.to_numpy()
    keep = size[index] > 0
    at = np.concatenate([[0], np.cumsum(keep)])
    index = index[keep]
    return h[index], size[index], at[words.offsets.to_numpy() - words.offsets[0].as_py()]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """One hash per k consecutive words; position i has that of words i to i + k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, np.uint64(k))
    for j in range(k):
        h = (h + words[j : n + j]) * (_SEED + np.uint64(2 * j))
        h ^= h >> np.uint64(29)
    return mix(h)


def by_text(texts: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its word hashes and its shingles in order: of fewer than k words, one for the whole
    sequence; without words, none."""
    words, _, at = word_table(texts)
    every = shingles(words, k)
    for a, b in zip(at[:-1], at[1:]):
        yield words[a:b], (every[a : b - k + 1] if b - a >= k else shingles(words[a:b], b - a) if b > a else words[a:b])
