"""What a job leaves on disk: staged batches and the shuffles that made them."""
import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from odonto.plans.jobs import add_payments
from odonto.session import ensure_checkpoint_dir, stage, stage_files, staged_within
from odonto.streaming.audits import empty_source, write_row_changes

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def size(path, name=""):
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, files in os.walk(path.removeprefix("file:")) for f in files if f.startswith(name))


def shuffle_bytes(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return sum(size(str(d), "shuffle_") for d in env.blockManager().diskBlockManager().localDirsString())


def assert_dropped(spark, made):
    for _ in range(50):
        if (left := shuffle_bytes(spark)) <= made:
            break
        time.sleep(0.1)
    assert left <= made


def rows(spark):
    return spark.range(200_000).select(F.col("id").alias("seq"), (F.col("id") % 5000).alias("bill_id"),
                                       F.lit("cash").alias("payment_method"), F.lit(None).cast("string").alias("notes"))


@pytest.mark.parametrize("how", [stage, stage_files])
def test_a_staged_batch_leaves_no_shuffle_files(spark, how):
    before = spark.conf.get(CLEANUP)
    made = shuffle_bytes(spark)
    out = how(rows(spark).repartition(8, F.xxhash64("seq")))
    assert_dropped(spark, made)
    assert spark.conf.get(CLEANUP) == before
    assert out.agg(F.count(F.lit(1)), F.sum("seq"), F.count("notes")).first()[:] == (200_000, 200_000 * 199_999 // 2, 0)


def test_staged_files_are_a_fraction_of_a_checkpoint(spark):
    path = ensure_checkpoint_dir(spark)
    sizes = [size(path)]
    for how in (stage, stage_files):
        kept = how(rows(spark))
        sizes.append(size(path))
    assert kept.dtypes == rows(spark).dtypes
    assert 3 * (sizes[2] - sizes[1]) < sizes[1] - sizes[0]


def test_a_bill_held_twice_answers_twice(spark, seed):
    bill = seed.bills.select("bill_id").first()[0]
    t = seed.replace(bills=seed.bills.unionByName(seed.bills.filter(F.col("bill_id") == bill)))
    req = spark.createDataFrame([(1, "1", "OWNER", str(bill), "none"), (2, "1", "CUSTOMER", str(bill), "1"), (3, "1", "OWNER", "999999", "1"),
                                 (4, "1", "OWNER", None, "1"), (5, "1", "OWNER", str(bill), "99999999")],
                                "seq long, caller_id string, caller_role string, bill_id string, paid_amount string")
    req = req.withColumn("payment_method", F.lit("cash")).withColumn("notes", F.lit(None).cast("string"))
    found = add_payments(t, req, dt.datetime(2024, 1, 15)).outcome
    # The last one gets each of its two rows with each of its two answers.
    assert sorted((r["seq"], r["status_code"]) for r in found.collect()) == [
        (1, 400), (1, 400), (2, 403), (2, 403), (3, 404), (4, 400), *[(5, 400)] * 4]


def test_what_a_caller_does_not_keep_is_gone(spark):
    path = ensure_checkpoint_dir(spark)
    before = size(path)
    with staged_within(spark) as keep:
        part = stage_files(rows(spark))
        kept = keep(part.filter("bill_id < 10"))
        assert part.count() == 200_000
    assert kept.count() == 400
    assert 0 < size(path) - before < 20_000
    outside = stage_files(kept)
    assert outside.count() == 400


def test_change_files_leave_no_shuffle_files(spark, driver_t, tmp_path):
    new = driver_t.replace(patients=driver_t.patients.withColumn("name", F.concat("name", F.lit("?"))))
    empty_source(spark, str(tmp_path))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    made = shuffle_bytes(spark)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        write_row_changes(driver_t, new, str(tmp_path), 1, dt.datetime(2024, 1, 15))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert_dropped(spark, made)
    assert spark.read.parquet(f"{tmp_path}/patients").count() == driver_t.patients.count() > 0
