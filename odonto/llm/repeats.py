"""Operator 4: substring dedup by seed and extend.

A repeat is a window of ``length`` consecutive words that also starts in a
document with a smaller id. Every window holds exactly one winnowed anchor:
the least hash among its ``seed``-word runs. Equal windows have equal anchors,
so only windows on anchors that two documents share can repeat.

1. Seed: anchors of all documents are counted. A filter of the shared ones
   (bounded in size; a larger corpus only makes it less selective) goes back
   to the scan.
2. Extend: around each shared anchor, the windows that own it are hashed
   whole, which extends the match to both sides of the anchor up to the
   window. A grouped minimum gives the first document of each window, and
   windows of later documents are repeats. Adjacent ones merge into maximal
   repeated passages.
3. Documents with repeats meet their window starts; all others pass from the
   scan as they are.

No step forms pairs of documents: a window or anchor that a third of all
documents share is one row of a grouped minimum, and a skewed join elsewhere.
Words and windows are compared by 64-bit hashes.

Defined results: a null or blank text has no words, and the hash of the empty
text; a document with fewer than ``length`` words loses nothing; null ids sort
after all others; rows that share an id are never each other's repeats, and
each has its own row in the result; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.llm.bitmaps import key_bitmap
from odonto.llm.common import ship_by_value, stage
from odonto.llm.shingles import KeyFilter, WordHashes, has_keys, key_filter, sliding_argmin, windows

ship_by_value(__name__)

LENGTH = 13
SEED_WORDS = 5
LAST_ID = (1 << 63) - 1
#: Words hashed at once in a task.
BATCH_WORDS = 1 << 18


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, version, text): version tells rows that share an id apart, by a
    64-bit hash of their text; it is 0 for ids of one row (and null in no
    row), so that it takes no room."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.coalesce(F.col(id_col), F.lit(LAST_ID)).cast("long").alias("doc"), text.alias("text"))
    several = stage(d.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc"), "shared-ids")
    # The bitmap may let other ids pass too: any version does for them.
    shared = key_bitmap(several, "doc")(F.col("doc"))
    return d.select("doc", F.when(shared, F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("version"), "text")


def hashed(batches: Iterator[pd.DataFrame], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, doc, version, position, is a window's start) of the words of
    many texts laid end to end."""
    of = WordHashes().of_words

    def joined(ids: list[tuple[int, int]], parts: list[np.ndarray]):
        n = np.array([len(p) for p in parts])
        doc, version = np.repeat(np.array(ids, np.int64), n, axis=0).T
        end = np.repeat(np.cumsum(n), n)
        codes = np.concatenate(parts)
        at = np.arange(len(codes))
        return codes, doc, version, at - np.repeat(np.cumsum(n) - n, n), at + length <= end

    for pdf in batches:
        ids, parts, words = [], [], 0
        for i, v, text in zip(pdf["doc"], pdf["version"], pdf["text"], strict=True):
            w = text.split()
            if len(w) >= length:
                ids.append((i, v))
                parts.append(of(w))
                words += len(w)
            if words >= BATCH_WORDS:
                yield joined(ids, parts)
                ids, parts, words = [], [], 0
        if parts:
            yield joined(ids, parts)


def anchors(codes: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all seeds, position of the anchor of each window)."""
    seeds = windows(codes, seed)
    return seeds, sliding_argmin(seeds, length - seed + 1)


def shared_anchors(docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """(anchor): anchors in two documents or more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for codes, doc, _, _, start in hashed(batches, length):
            seeds, at = anchors(codes, length, seed)
            at = at[start[:len(at)]]
            at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
            a, d = seeds[at], doc[at]
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            new = np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])] if len(a) else np.zeros(0, bool)
            a = a[new]              # once per document and anchor
            first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
            yield pd.DataFrame({"anchor": a[first].view(np.int64), "n": np.diff(np.r_[first, len(a)])})

    return docs.mapInPandas(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def candidate_windows(docs: DataFrame, shared: KeyFilter, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """(window, doc, version, start) of the windows on anchors that pass the
    filter."""
    common = docs.sparkSession.sparkContext.broadcast(shared)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passing = common.value
        for codes, doc, version, position, start in hashed(batches, length):
            seeds, at = anchors(codes, length, seed)
            begin = np.flatnonzero(start[:len(at)])
            begin = begin[has_keys(passing, seeds[at[begin]])]
            yield pd.DataFrame({"window": windows(codes, length)[begin].view(np.int64), "doc": doc[begin],
                                "version": version[begin], "start": position[begin].astype(np.int32)})

    return docs.mapInPandas(run, "window long, doc long, version long, start int")


def covered(n_words: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which words lie in a window at any of the starts."""
    edge = np.zeros(n_words + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:-1]) > 0


def passages(mask: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of the maximal runs of covered words."""
    edge = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def repeat_starts(docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS) -> DataFrame:
    """(doc, version, starts): where the repeated windows of a document begin."""
    shared = stage(shared_anchors(docs, length, seed), "anchors")
    found = stage(candidate_windows(docs, key_filter(shared, "anchor"), length, seed), "windows")
    first = found.groupBy("window").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    later = found.join(first.select("window", "first"), "window").filter("doc > first")
    return later.groupBy("doc", "version").agg(F.array_distinct(F.collect_list("start")).alias("starts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED_WORDS, id_col: str = "doc_id",
                   text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, passages) of every row;
    passages are the removed word ranges. ``with_text`` adds the kept text."""
    d = _ids(docs, id_col, text_col)
    starts = stage(repeat_starts(d, length, seed), "repeats")
    repeating = d.sparkSession.sparkContext.broadcast(key_filter(starts, "doc"))

    @F.pandas_udf("boolean")
    def may_repeat(doc: pd.Series) -> pd.Series:
        return pd.Series(has_keys(repeating.value, doc.to_numpy().view(np.uint64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc, text, at in zip(pdf["doc"], pdf["text"], pdf["starts"], strict=True):
                words = text.split()
                n, gone = len(words), []
                if at is not None and len(at):
                    mask = covered(n, np.asarray(at, np.int64), length)
                    gone = passages(mask)
                    words = [w for w, m in zip(words, mask, strict=True) if not m]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), [list(x) for x in gone],
                            kept.decode())[:6 if with_text else 5])
            yield pd.DataFrame(out, columns=["doc", "n_words", "n_removed", "kept_sha256", "passages", "kept_text"][:6 if with_text else 5])

    marked = d.withColumn("_may", may_repeat("doc"))
    some = marked.filter("_may").select("doc", "version", "text").join(starts, ["doc", "version"], "left").select("doc", "text", "starts")
    none = marked.filter("not _may").select("doc", "text", F.lit(None).cast("array<int>").alias("starts"))
    found = some.unionByName(none).mapInPandas(run, "doc long, n_words long, n_removed long, kept_sha256 string, passages array<array<int>>"
                                               + (", kept_text string" if with_text else ""))
    doc_id: Column = F.when(F.col("doc") != LAST_ID, F.col("doc")).alias("doc_id")
    return found.select(doc_id, *found.columns[1:])
