"""Operator 13: filter interaction audit with wide packed counters.

Five filters are judged on every document; what each of the 120 orders of
them would do follows from five failure bits. Every mask (failure bits and
two labels) maps to one big integer whose fields hold its outcomes at all 600
steps: kept, removed, redundant, removed good, removed toxic. The integers of
a part are added up, and the sum is unpacked into rows. A field is as wide as
the part's document count needs, so no field can overflow into the next.

1. A task reads a text once: failure bits of A to D and a digest of the text.
2. Filter E joins the least id of each digest that several rows have.
3. Documents are counted per (part, mask), partial sums first, so adding
   n times a mask's integer adds up at most 128 rows per part, whatever the
   corpus. Sums of one part meet in one task as 128 numbers, no documents.

Failure conditions. A: under 200 words; B: 100 * distinct words < 50 * words;
C: 100 * capitals A-Z > 3 * code points; D: holds any of ``#$%&*|``; E: equal
to the text of a smaller id. Texts are compared by SHA-256.

Defined results: null text counts as empty; a null part is the empty one; null
ids sort after all others and have no labels; rows of one id and text are not
copies of each other, and each counts; of several labels of one id the larger
counts; null labels and missing ones are neither good nor toxic; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import ship_by_value, stage

ship_by_value(__name__)

#: Fixed by the contract.
FILTERS = "ABCDE"
LEAST_WORDS = 200
MARKS = b"#$%&*|"

MEASURES = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
SCHEMA = ("part string, filter_order string, step int, filter string, kept long, removed long, redundant long, "
          "unique_fails long, good_lost long, toxic_lost long, shapley long")

_CAPITALS = bytes(range(65, 91))
_INNER = bytes(range(128, 192))        # bytes that continue a code point


def failures(text: bytes) -> int:
    """Failure bits of filters A to D for a UTF-8 text."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INNER))
    return ((n < LEAST_WORDS) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2
            | (len(text.translate(None, MARKS)) < len(text)) << 3)


def outcomes(mask: int) -> Iterator[tuple[int, int, int, int, int]]:
    """The measures of one document with this mask at each step, order by
    order: 0 or 1 each."""
    good, toxic = bool(mask & GOOD), bool(mask & TOXIC)
    for order in ORDERS:
        here = 1
        for name in order:
            fails = mask >> FILTERS.index(name) & 1
            removed = here & fails
            here -= removed
            yield here, removed, fails - removed, removed & good, removed & toxic


def packed(mask: int, width: int) -> int:
    """One integer of all outcomes, the first in the lowest ``width`` bits."""
    out = at = 0
    for step in outcomes(mask):
        for bit in step:
            out |= bit << at
            at += width
    return out


def unpacked(total: int, width: int) -> list[tuple[int, ...]]:
    """The sums of the measures at each step."""
    n, most = len(MEASURES), (1 << width) - 1
    raw = total.to_bytes((len(ORDERS) * len(FILTERS) * n * width + 7) // 8, "little")
    # Read a step at a time: shifting the whole integer would be quadratic.
    out = []
    for i in range(len(ORDERS) * len(FILTERS)):
        first = i * n * width
        step = int.from_bytes(raw[first // 8:(first + n * width + 7) // 8], "little") >> first % 8
        out.append(tuple(step >> j * width & most for j in range(n)))
    return out


def tally(part: str, counts: dict[int, int]) -> pd.DataFrame:
    """The rows of one part from its documents per mask."""
    width = sum(counts.values()).bit_length()
    total = sum(n * packed(mask, width) for mask, n in counts.items())
    steps = unpacked(total, width)
    names = [name for order in ORDERS for name in order]
    all_removed = dict.fromkeys(FILTERS, 0)
    only = {name: sum(n for mask, n in counts.items() if mask & (GOOD - 1) == 1 << i) for i, name in enumerate(FILTERS)}
    for name, step in zip(names, steps, strict=True):
        all_removed[name] += step[1]
    rows = [(part, ORDERS[i // len(FILTERS)], i % len(FILTERS) + 1, name, *step[:3], only[name], *step[3:], all_removed[name])
            for i, (name, step) in enumerate(zip(names, steps, strict=True))]
    return pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc, part, fail_bits) of every row, all five filters judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("part"), pa.array(map(failures, texts), pa.int32()),
                 pa.array((sha256(t).digest() for t in texts), pa.binary())], ["doc", "part", "bits", "digest"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    read = stage(texts.mapInArrow(run, "doc long, part string, bits int, digest binary"), "judged")
    shared = stage(read.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("first"))
                   .filter("n > 1 and first is not null").select("digest", "first"), "shared")
    copy = F.col("first").isNotNull() & (F.col("doc").isNull() | (F.col("doc") > F.col("first")))
    bit = 1 << FILTERS.index("E")
    return (read.join(shared, "digest", "left")
            .select("doc", "part", (F.col("bits") + F.when(copy, bit).otherwise(0)).alias("fail_bits")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
          good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley): 600 rows per part."""
    is_one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    label = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc"))
             .agg(is_one(good_col).alias("good"), is_one(toxic_col).alias("toxic")))
    mask = F.col("fail_bits") + F.coalesce("good", F.lit(0)) * GOOD + F.coalesce("toxic", F.lit(0)) * TOXIC
    counts = (judge(docs, id_col, text_col, part_col).join(label, "doc", "left")
              .groupBy("part", mask.cast("int").alias("mask")).agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("part").applyInPandas(
        lambda pdf: tally(pdf["part"].iloc[0], dict(zip(map(int, pdf["mask"]), map(int, pdf["n"]), strict=True))), SCHEMA)
