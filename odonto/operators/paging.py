"""O7 by fences: pages of a sorted list at any offset.

The rows are written once, sorted into ranges of about ``rows_per_range`` rows, each a
folder. The driver holds one count per range; a page is cut from the ranges that its
offsets fall in, so a deep page reads no more than the first one. The order must be
total (end it with the key), or pages of tied rows could overlap.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SortedPages:
    """Pages of the rows under ``path``, as ``write`` left them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.order = [r.name for r in spark.read.parquet(f"{self.path}/order").orderBy("at").collect()]
        self.schema = spark.read.parquet(f"{self.path}/columns").schema
        rows = spark.read.schema(T.StructType([*self.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(f"{self.path}/rows")
        counts = sorted(map(tuple, rows.groupBy("_range").count().collect()))
        self.ranges = [r for r, _ in counts]
        # The offset of each range's first row, and the end of the last.
        self.starts = [0, *accumulate(n for _, n in counts)]

    @classmethod
    def write(cls, df: DataFrame, order: list[str], path: str, rows_per_range: int = 1_000_000) -> "SortedPages":
        """``df`` is read twice (counted, then sorted): hand over a stored table."""
        spark, path = df.sparkSession, path.rstrip("/")
        ranges = max(1, -(-df.count() // rows_per_range))
        (df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *order)
         .write.partitionBy("_range").parquet(f"{path}/rows"))
        # An empty table still has its columns.
        spark.createDataFrame([], df.schema).coalesce(1).write.parquet(f"{path}/columns")
        spark.createDataFrame(list(enumerate(order)), "at int, name string").coalesce(1).write.parquet(f"{path}/order")
        return cls(spark, path)

    def __len__(self) -> int:
        return self.starts[-1]

    def page(self, offset: int, size: int) -> DataFrame:
        """Rows ``offset`` to ``offset + size`` of the sorted list, in order."""
        end = min(offset + size, len(self))
        if offset >= end:
            return self.spark.createDataFrame([], self.schema)
        first, last = bisect_right(self.starts, offset) - 1, bisect_right(self.starts, end - 1) - 1
        folders = [f"{self.path}/rows/_range={r}" for r in self.ranges[first:last + 1]]
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        return rows.orderBy(*self.order).offset(offset - self.starts[first]).limit(end - offset)
