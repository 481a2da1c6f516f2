"""Copy-on-write versions: only touched buckets are written, a failed write changes nothing."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from odonto.operators.patch import apply_patch, merge_patches
from odonto.schemas import SCHEMAS
from odonto.sources.versions import VersionedTables

AT = dt.datetime(2024, 1, 15, 12)


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def store(spark, seed, tmp_path):
    many = spark.range(200).join(seed.patients.filter("patient_id = 1").drop("patient_id")).select(
        F.col("id").alias("patient_id"), *[c for c in SCHEMAS["patients"].names if c != "patient_id"])
    return VersionedTables.create(spark, str(tmp_path / "store"), {"patients": many, "bills": seed.bills}, buckets=16)


def test_patches_write_touched_buckets_only(spark, store):
    before, base = files(store.path), rows(store.table("patients"))
    assert len(base) == 200
    patches = spark.createDataFrame([(3, 1, "A", True), (3, 2, "B", True), (50, 3, "C", True), (50, 4, None, False), (999, 5, "D", True)],
                                    "patient_id long, seq long, name string, has_name boolean")
    new = store.patch("patients", patches, ["name"], stamp=("updated_at", F.lit(AT)))
    want = apply_patch(store.table("patients"), merge_patches(patches, "patient_id", ["name"]), "patient_id", ["name"],
                       stamp=("updated_at", F.lit(AT))).select(SCHEMAS["patients"].names)
    assert rows(new.table("patients")) == rows(want)
    touched = store.touched("patients", patches)
    assert len(files(store.path) - before) == len(touched) <= 3 and before <= files(store.path)
    assert rows(VersionedTables(spark, store.path, 0).table("patients")) == base        # the older version stands
    assert VersionedTables(spark, store.path).version == 1
    assert rows(new.rows_of("patients", patches).select("patient_id", "name")) == [(3, "B"), (50, "C")]


def test_upsert_delete_and_several_tables_in_one_version(spark, seed, store):
    bill = seed.bills.filter("bill_id = 1")
    new = store.upsert("bills", bill.withColumn("status", F.lit("PAID")).unionByName(bill.withColumn("bill_id", F.lit(77).cast("long"))))
    assert new.table("bills").count() == seed.bills.count() + 1
    assert new.table("bills").filter("bill_id = 1").first().status == "PAID"
    gone = spark.range(200).withColumnRenamed("id", "patient_id")
    empty = new.delete("patients", gone)                                                 # buckets without rows
    assert empty.table("patients").count() == 0 and empty.table("bills").count() == new.table("bills").count()
    back = empty.change({"patients": (gone, lambda base: base.unionByName(new.table("patients"))),
                         "bills": (bill, lambda base: base.filter("bill_id <> 1"))})
    assert back.version == 3 and back.table("patients").count() == 200 and back.table("bills").filter("bill_id = 1").count() == 0
    assert back.delete("patients", gone.limit(0)).table("patients").count() == 200       # no keys: nothing is touched


def test_failed_writes_leave_the_old_version(spark, store):
    base = rows(store.table("patients"))
    keys = spark.createDataFrame([(3,)], "patient_id long")
    fails = F.when(F.col("patient_id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("name"))
    with pytest.raises(Exception, match="lost"):
        store.change({"bills": (store.table("bills").select("bill_id"), lambda b: b.limit(0)),
                      "patients": (keys, lambda b: b.withColumn("name", fails))})
    with pytest.raises(ValueError, match="outside"):
        store.change({"patients": (keys, lambda b: store.table("patients"))})
    now = VersionedTables(spark, store.path)
    assert now.version == 0 and rows(now.table("patients")) == base and now.table("bills").count() > 0
    assert store.delete("patients", keys).version == 1
    with pytest.raises(Exception, match="(?i)already.exists"):                           # a second writer of version 1
        store.delete("patients", keys)
