"""Rows without a key must not meet in one task."""
from collections import Counter

from pyspark.sql import functions as F

from odonto.plans.jobs import _exists


def test_rows_without_a_key_are_dealt_out(spark):
    rows = spark.range(4000).select(F.col("id").alias("seq"), F.when(F.col("id") % 8 == 0, F.col("id")).alias("key"))
    probe = spark.range(2000).withColumnRenamed("id", "k")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        out = _exists(rows, "key", probe, "k", "ok")
        found = out.select("seq", "ok", F.spark_partition_id().alias("part")).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert max(Counter(r["part"] for r in found).values()) < 2 * 4000 / 8
    assert {(r["seq"], r["ok"]) for r in found} == {(i, i % 8 == 0 and i < 2000) for i in range(4000)}
