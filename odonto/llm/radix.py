"""Operator 11: exact dedup by distributed MSD radix partitioning.

All texts start in one group. Every round splits each open group by the next
slice of its texts' bytes (most significant first): texts stay together while
their slices are the same bytes. A group of one text is done, and so is a
group whose texts have ended, which are then equal: every byte of them has
been compared and no digest decides. Slices grow by ``GROWTH`` each round, so
the rounds are logarithmic in the longest text that has a twin so far.

1. The first slices are counted over the whole table. Rows whose first slice
   nobody shares are single; a bitmap of bounded size finds them in the scan.
   It only lets too many pass, never too few.
2. The others are staged with a row number and split round by round. Sizes of
   groups are partial sums per task before they are shuffled, and rows learn
   their group by a join on (group, slice) with one row per group, in which
   Spark splits a group that holds a third of all rows.
3. Rows that are done drop their text; the others go on without the bytes
   they have used up.

Of equal texts the row with the largest id stays; of rows equal in both, one.

Defined results: null text counts as empty and equals it; null ids are smaller
than all others (a null id stays only where no row of its group has another);
repeated rows are one group; very long texts take more rounds; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.llm.bitmaps import key_bitmap
from odonto.llm.common import stage

#: Bytes of the first slice, and how much wider each next one is.
FIRST = 128
GROWTH = 32
#: Spark's longest binary value.
MOST = (1 << 31) - 1


def _split(rows: DataFrame, width: int) -> DataFrame:
    """The rows (group, text, row_id, doc, ...) after one round: n and top
    (doc and row_id of the row that would stay) of a shared slice's group,
    whether the row is done, and what is left of its text if it isn't."""
    keyed = rows.withColumns({"slice": F.substring("text", 1, width), "text": F.substring("text", width + 1, MOST)})
    shared = stage(keyed.groupBy("group", "slice").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc", "row_id")).alias("top"))
                   .filter("n > 1"), "slices")
    done = F.col("n").isNull() | (F.length("slice") < width)
    return stage(keyed.join(shared, ["group", "slice"], "left").withColumn("done", done)
                 .withColumn("text", F.when(~F.col("done"), F.col("text"))).drop("group", "slice"), "split")


def equal_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
                first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row, and the
    input columns named in ``keep`` as a struct ``row``.

    keep_id: id of the row of its group of equal texts that stays; group_size:
    rows of the group; kept: whether this row stays.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(None)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.cast("binary").alias("text"), row.alias("row"))
    if not keep:
        rows = rows.drop("row")
    more = ["row"] if keep else []
    head = F.substring("text", 1, first)
    heads = rows.select(head.alias("head")).groupBy("head").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    passes = key_bitmap(stage(heads.select("head"), "heads"), "head")(head)

    digest = F.sha2("text", 256).alias("digest")
    found = [_result(rows.filter(~passes).withColumns({"digest": digest, "n": F.lit(None).cast("long")}), F.col("doc"), F.lit(True), more)]
    open_ = stage(rows.filter(passes).select(F.monotonically_increasing_id().alias("row_id"), "doc", "text", digest,
                                             F.lit(0).cast("long").alias("group"), *more), "candidates")
    width = first
    while not open_.isEmpty():
        level = _split(open_, width)
        alone = F.col("n").isNull()
        found.append(_result(level.filter("done"), F.when(alone, F.col("doc")).otherwise(F.col("top.doc")),
                             alone | (F.col("row_id") == F.col("top.row_id")), more))
        open_ = level.filter("not done").select("row_id", "doc", "text", "digest", F.col("top.row_id").alias("group"), *more)
        width *= growth
    return reduce(DataFrame.unionByName, found)


def _result(rows: DataFrame, keep_id: Column, kept: Column, more: list[str]) -> DataFrame:
    return rows.select(F.col("doc").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
                       kept.alias("kept"), F.col("digest").alias("text_sha256"), *more)


def distinct_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows that stay, with all of the input's columns."""
    return equal_texts(docs, keep=docs.columns, **options).filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
