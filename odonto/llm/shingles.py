"""Hashed words and word windows of whole batches of texts, in numpy, and a
fixed-size filter for 64-bit keys."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import ship_by_value

ship_by_value(__name__)

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Mix 64-bit numbers (an invertible multiply-and-shift finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of each word (bytes), computed once per distinct word."""

    def __init__(self, most: int = 1 << 18):
        super().__init__()
        import xxhash
        self.hash, self.most = xxhash.xxh3_64_intdigest, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.hash(word)
        return h

    def of_words(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position; the last positions,
    which have too few words after them, are left out."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = codes[:n].copy()
    for j in range(1, length):
        out *= _FACTOR
        out += codes[j:n + j]
    return mix64(out)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost minimum of each run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = values[:n].copy(), np.arange(n)
    for j in range(1, width):
        less = values[j:n + j] < best
        best = np.where(less, values[j:n + j], best)
        at[less] = np.flatnonzero(less) + j
    return at


#: Bits of 64-bit keys in words of 64, and how many bits there are. Plain
#: arrays, so that a worker reads a broadcast one without this package.
KeyFilter = tuple[np.ndarray, int]


def has_keys(found: KeyFilter, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter: false only for keys that it was not
    built from."""
    words, bits = found
    at = mix64(keys) & np.uint64(bits - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def key_filter(keys: DataFrame, column: str, per_key: int = 32, most_bits: int = 1 << 30) -> KeyFilter:
    """A filter of a staged table's distinct keys, ``per_key`` bits each.

    Never more than ``most_bits`` (128 MB): with more keys it lets more others
    pass, and what follows must be exact on its own. Bits are combined on
    Spark into 64-bit words; only words that have any reach the driver.
    """
    bits = 1 << 16
    n = keys.count()
    while bits < per_key * n and bits < most_bits:
        bits *= 2

    def place(batches):
        import pandas as pd
        for pdf in batches:
            at = mix64(pdf["k"].to_numpy().view(np.uint64)) & np.uint64(bits - 1)
            word, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            yield pd.DataFrame({"word": word, "bit": bit.view(np.int64)})

    found = (keys.select(keys[column].alias("k")).mapInPandas(place, "word long, bit long")
             .groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow())
    words = np.zeros(bits >> 6, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words, bits
