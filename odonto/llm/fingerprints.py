"""Operator 2: I-Match document fingerprints over randomised lexicons.

The lexicon keeps the terms whose document frequency over the whole corpus
lies in a band. A document's distinct lexicon terms are sorted, and the terms
that fall into each of several random subsets of the lexicon are hashed: two
documents agree on a subset if none of the terms they differ in lies in it.
Subsets come at rates of 1/2, 1/4, 1/8, ... of the lexicon; a fingerprint
holds the rates at which about one of its terms is left, so that likeness is
graded for short and long texts alike. Likeness is the share of subsets with
equal hashes among those that hold a term of either text, at the rates both
fingerprints have.

A text without any lexicon term is fingerprinted by all its terms.

The lexicon's size is bounded: a document frequency of at least ``LOW`` * N
in N documents of T distinct terms on average leaves at most T / LOW terms.

Defined results: a null or blank text has the fingerprint "-", which is like
itself only (1) and nothing else (0). Null ids sort before all others. Rows
that share an id stand in a fixed order; repeated rows follow each other. The
next document of the last is the first; a single document is its own next.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import ship_by_value, task_count

ship_by_value(__name__)

LOW, HIGH = 1 / 2000, 1 / 4       # the band, as shares of all documents
SUBSETS = 20
RATES = 3                         # neighbouring rates that a fingerprint holds
HASH_BYTES = 3
SEED = 11
#: Terms of one task that wait to be summed; beyond, they are sent on.
TERM_ROWS = 1 << 19
ROWS_PER_RANGE = 1000

#: Punctuation that ends or opens a word counts as a space.
_SPACED = bytes.maketrans(b".,;:!?\"()[]{}<>|", b"                ")


def terms_of(text: bytes) -> set[bytes]:
    return set(text.lower().translate(_SPACED).split())


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term binary, n): documents with each term, summed within a task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                sums.update(terms_of(text))
                if len(sums) > TERM_ROWS:
                    yield pd.DataFrame({"term": list(sums), "n": list(sums.values())})
                    sums.clear()
        yield pd.DataFrame({"term": list(sums), "n": list(sums.values())})

    return (docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
            .mapInPandas(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, text_col: str = "text") -> list[bytes]:
    """The terms in the band, sorted. At most (mean distinct terms) / low."""
    n = docs.count()
    band = document_frequencies(docs, text_col).filter((F.col("n") >= low * n) & (F.col("n") <= max(high * n, 1.0)))
    return sorted(bytes(r["term"]) for r in band.toLocalIterator())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Fingerprinter:
    """Fingerprints of texts under one lexicon (sorted terms)."""

    def __init__(self, terms: list[bytes], subsets: int = SUBSETS, rates: int = RATES, seed: int = SEED):
        import xxhash
        self.hash = xxhash.xxh3_64_intdigest
        self.known = set(terms)
        self.rates = rates
        self.keys = _mix(np.arange(1, subsets + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))

    def __call__(self, text: bytes) -> str:
        found = terms_of(text)
        if not found:
            return "-"
        kept = sorted(found & self.known or found)
        code = np.fromiter(map(self.hash, kept), np.uint64, len(kept))
        # The number of leading zero bits of a term's key in a subset: the
        # term is left at rate 2**-r where it has r of them or more.
        draw = _mix(code[:, None] ^ self.keys[None, :])
        depth = 63 - np.floor(np.log2(np.maximum(draw >> np.uint64(1), np.uint64(1)).astype(np.float64))).astype(int) - 1
        first = max(int(np.log2(len(kept))) - 1, 0)
        out = bytearray([first])
        for rate in range(first, first + self.rates):
            left = depth >= rate
            for j in range(left.shape[1]):
                at = left[:, j]
                digest = self.hash(code[at].tobytes()) % ((1 << 8 * HASH_BYTES) - 1) + 1 if at.any() else 0
                out += digest.to_bytes(HASH_BYTES, "little")
        return base64.b64encode(bytes(out)).decode()


def likeness(a: str, b: str, subsets: int = SUBSETS, rates: int = RATES) -> float:
    """Share of equal subset hashes, 0 to 1."""
    if a == b:
        return 1.0
    if "-" in (a, b):
        return 0.0
    x, y = base64.b64decode(a), base64.b64decode(b)
    step, same, some = subsets * HASH_BYTES, 0, 0
    for rate in range(max(x[0], y[0]), min(x[0], y[0]) + rates):
        i, j = 1 + (rate - x[0]) * step, 1 + (rate - y[0]) * step
        for k in range(0, step, HASH_BYTES):
            p, q = x[i + k:i + k + HASH_BYTES], y[j + k:j + k + HASH_BYTES]
            if any(p) or any(q):
                some += 1
                same += p == q
    return same / some if some else 0.0


def fingerprint(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = Fingerprinter(shared.value)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fingerprint": [of(t) for t in pdf["text"]]})

    return (docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
            .mapInPandas(run, "doc_id string, fingerprint string").select(F.col("doc_id").cast("long").alias("doc_id"), "fingerprint"))


def edit(text: str, following: str) -> str:
    """The text with its last half replaced by the start of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def with_neighbours(docs: DataFrame, terms: list[bytes], id_col: str = "doc_id", text_col: str = "text",
                    rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to
    each other and to the next document's.

    Ids alone are range-partitioned first; each partition's smallest id is a
    fence. Texts (compressed) then move once, to their range; the document at
    a fence also goes to the range before it, the very first one to the last
    range, so every range finds the successor of its last document.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    ids = docs.select(F.coalesce(F.col(id_col), F.lit(least)).cast("long").alias("id"))

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [int(pdf["id"].min()) for pdf in batches if len(pdf)]
        yield pd.DataFrame({"id": [min(found)] if found else []}, dtype="int64")

    ranges = task_count(spark, docs.count(), rows_per_range)
    fences = sorted(r["id"] for r in ids.repartitionByRange(ranges, "id").mapInPandas(smallest, "id long").collect())   # one id per range
    last = len(fences) - 1

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"], strict=True):
                at, data = bisect.bisect_right(fences, i) - 1, squeeze(text)
                rows.append((at, 0, i, data))
                if i == fences[at]:
                    rows.append((at - 1 if at else last, 1, i, data))
            yield pd.DataFrame(rows, columns=["range", "guest", "id", "data"])

    dealt = (docs.select(F.coalesce(F.col(id_col), F.lit(least)).cast("long").alias("id"),
                         F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
             .mapInPandas(deal, "range int, guest int, id long, data binary")
             .repartition(ranges, "range").sortWithinPartitions("range", "guest", "id", "data"))
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        expand = zstandard.ZstdDecompressor().decompress
        of = Fingerprinter(shared.value)
        own = None                     # (range, id, text, fingerprint) that waits for its next
        for pdf in batches:
            out = []
            for at, guest, i, data in zip(pdf["range"], pdf["guest"], pdf["id"], pdf["data"], strict=True):
                if guest and (own is None or own[0] != at):
                    continue           # further rows at the same fence
                text = expand(data).decode()
                mark = of(text.encode())
                if own is not None and own[0] == at:
                    edited = edit(own[2], text).encode()
                    after = of(edited)
                    out.append((own[1], len(own[2]), hashlib.sha256(edited).hexdigest(), own[3], after,
                                likeness(own[3], after), likeness(own[3], mark)))
                own = None if guest else (at, i, text, mark)
            yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    found = dealt.mapInPandas(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
                                   "near_edited double, near_next double")
    return found.select(F.when(F.col("id") != least, F.col("id")).alias("doc_id"), *found.columns[1:])
