"""A filter of 64-bit keys made of DataFrame functions only: one row that
holds an array of 64-bit words, used through a scalar subquery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.llm.common import stage


def _at(key: Column, bits: int) -> Column:
    return F.xxhash64(F.lit(17), key).bitwiseAND(bits - 1)


def key_bitmap(keys: DataFrame, column: str, per_key: int = 32, most_bits: int = 1 << 27) -> Callable[[Column], Column]:
    """Condition that holds for every key of a staged table and few others.

    ``per_key`` bits each, never more than ``most_bits`` (16 MB): with more
    keys it lets more others pass, so what follows must be exact on its own.
    """
    bits, n = 1 << 16, keys.count()
    while bits < per_key * n and bits < most_bits:
        bits *= 2
    at = _at(F.col(column), bits)
    set_ = keys.select(F.shiftright(at, 6).alias("id"), F.expr("shiftleft(1L, 0)").alias("one"), at.bitwiseAND(63).cast("int").alias("bit"))
    words = set_.groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("word"))
    # At most most_bits / 64 rows in the one array, whatever the corpus.
    row = (keys.sparkSession.range(bits >> 6).join(words, "id", "left")
           .agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))).alias("w"))
           .select(F.transform("w", lambda x: x["word"]).alias("w")))
    kept = stage(row, "bitmap").scalar()

    def passes(key: Column) -> Column:
        here = _at(key, bits)
        word = F.get(kept, F.shiftright(here, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, here.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return passes
