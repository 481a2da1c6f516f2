"""O-ID1: dense, arrival-ordered id assignment without a one-partition window.

A global ``row_number() OVER (ORDER BY seq)`` moves every row into a single
task. Instead rows are grouped into buckets of ``bucket_size`` consecutive
``seq`` values and ``row_number()`` runs inside a bucket (bounded, because
``seq`` is unique). Each bucket's starting offset is a prefix sum of bucket
counts, computed over a fixed hierarchy of buckets of buckets, so every
window in it is bounded too: by ``bucket_size`` keys per parent, and at the
top by the few distinct values a 64-bit key has left after the divisions.
Sparse ``seq`` values therefore never build one large window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_BUCKET = 1 << 16


def _offsets(counts: DataFrame, key: str, n: str, bucket_size: int, levels: int) -> DataFrame:
    """(key, _offset): sum of ``n`` over all smaller keys; ``key`` is unique."""
    if levels == 0:
        # Top level: keys are seq / bucket_size**(levels + 1), at most
        # bucket_size of them for any non-negative 64-bit seq.
        w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(key, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("_offset"))
    parent = f"{key}_p"
    c = counts.withColumn(parent, F.floor(F.col(key) / F.lit(bucket_size)).cast("long"))
    parents = c.groupBy(parent).agg(F.sum(n).alias(f"{n}_p"))
    up = _offsets(parents, parent, f"{n}_p", bucket_size, levels - 1).withColumnRenamed("_offset", "_up")
    within = F.sum(n).over(Window.partitionBy(parent).orderBy(key).rowsBetween(Window.unboundedPreceding, -1))
    return (c.join(up, parent)
            .select(key, (F.col("_up") + F.coalesce(within, F.lit(0))).alias("_offset")))


def assign_ids(df: DataFrame, id_col: str, base: Column | int = 0, order_col: str = "seq",
               bucket_size: int = DEFAULT_BUCKET) -> DataFrame:
    """Add ``id_col`` = base + 1, base + 2, ... in ``order_col`` order.

    ``order_col`` must be unique. ``base`` is typically the current maximum
    id of the target table (a scalar subquery), as AUTO_INCREMENT would give.
    """
    levels = 0          # until the top window has at most bucket_size keys of any 64-bit seq
    while bucket_size ** (levels + 2) < 1 << 63:
        levels += 1
    base_col = base if isinstance(base, Column) else F.lit(base)
    b = df.withColumn("_bucket", F.floor(F.col(order_col) / F.lit(bucket_size)).cast("long"))
    counts = b.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, "_bucket", "_n", bucket_size, levels)
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(order_col))
    return (b.join(offsets, "_bucket")
            .withColumn(id_col, (base_col + F.col("_offset") + within).cast("long"))
            .drop("_bucket", "_offset"))


def max_id(table: DataFrame, col: str) -> Column:
    """Current maximum id of a table as a scalar subquery (0 when empty)."""
    return table.agg(F.coalesce(F.max(col), F.lit(0)).cast("long")).scalar()
