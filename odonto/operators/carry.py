"""Previous value per key in arrival order, for audit rows of chained updates.

When several accepted updates hit one key in a batch, each audit row needs
the value the key held just before that update: the last one set by an earlier
update, or else the stored one. Updates are dealt into buckets of consecutive
order numbers. Windows run inside one (key, bucket) and over a key's buckets,
so a key with a third of all updates spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def previous_values(updates: DataFrame, key: str, value: str, sets: str, base: DataFrame,
                    base_value: str, order_col: str = "seq", bucket: int = BUCKET) -> DataFrame:
    """Add ``prev_value`` / ``next_value`` (string) to each update row.

    ``updates``: one row per accepted update with ``key``, ``order_col``, the
    new ``value`` and a boolean ``sets`` (whether this update writes it).
    ``base``: the snapshot before the batch, with ``key`` and ``base_value``.
    """
    # A struct tells a NULL that was set from nothing set.
    u = updates.select(F.col(key).alias("_k"), F.col(order_col).alias("seq"), F.floor(F.col(order_col) / bucket).alias("_b"),
                       F.when(F.col(sets), F.struct(F.col(value).cast("string").alias("v"))).alias("_set"))
    ends = u.groupBy("_k", "_b").agg(F.max_by("_set", F.when(F.col("_set").isNotNull(), F.col("seq"))).alias("_end"))
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = ends.select("_k", "_b", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    stored = base.select(F.col(key).alias("_k"), F.struct(F.col(base_value).cast("string").alias("v")).alias("_base"))
    inside = Window.partitionBy("_k", "_b").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    v = (u.withColumn("_before", F.last("_set", ignorenulls=True).over(inside))
         .join(start, ["_k", "_b"]).join(stored, "_k", "left")
         .withColumn("_prev", F.coalesce("_before", "_carried", "_base"))
         .select("seq", F.col("_prev.v").alias("prev_value"), F.coalesce("_set", "_prev")["v"].alias("next_value")))
    return updates.join(v.withColumnRenamed("seq", order_col), order_col)
