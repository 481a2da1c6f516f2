"""Live audits: after-images in any cut give the triggers' rows."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clinic_constants import AS_OF
from odonto.plans import feeds
from odonto.schemas import SCHEMAS
from odonto.streaming.audits import CHANGE_FIELDS, empty_source, start_audits, stream_audit_feed

AT = dt.datetime(2024, 1, 15, 12)
KEYS = {"patients": "patient_id", "appointments": "appointment_id", "bills": "bill_id", "payments": "payment_id"}
SHOWN = ["action_type", "table_name", "record_id", "old_value", "new_value", "user_id"]


def fold(images, changes, changed_only):
    """The triggers one change at a time, over plain dicts of whole rows."""
    rows, seen, out = dict(images), {}, []
    for table, row in sorted(changes, key=lambda x: x[1]["version"]):
        key = (table, row[KEYS[table]])
        if row["version"] <= seen.get(key, 0):
            continue
        seen[key] = row["version"]
        now = {k: v for k, v in row.items() if k not in ("version", "removed", "changed_at")}
        was, rows[key] = rows.get(key), None if row["removed"] else now
        if row["removed"]:
            continue
        if was is None:
            if table == "patients":
                out.append(("PATIENT_ADDED", *key, None, f"{now['patient_code']} - {now['name']}", None))
            elif table == "bills":
                out.append(("BILL_CREATED", *key, None, f"Total: {now['total_amount']}", now["created_by_user_id"]))
            elif table == "payments":
                out.append(("PAYMENT_CREATED", *key, None, f"Amount: {now['paid_amount']}", now["received_by_user_id"]))
        elif table == "patients":
            same = all(now[k] == was[k] for k in now if k != "updated_at")
            if now["is_deleted"] and not was["is_deleted"]:
                out.append(("PATIENT_SOFT_DELETED", *key, was["name"], now["name"], None))
            elif not (same and changed_only):
                out.append(("PATIENT_UPDATED", *key, was["name"], now["name"], None))
        elif table == "appointments" and now["status"] != was["status"]:
            out.append(("APPOINTMENT_STATUS_CHANGED", *key, was["status"], now["status"], now["created_by_user_id"]))
    return sorted(out, key=repr)


def random_changes(rng, images, n):
    """Changes of stored and new rows, removals and images equal to the last one."""
    rows, out = dict(images), []
    samples = {table: [r for (of, _), r in images.items() if of == table] for table in KEYS}
    for version in range(1, n + 1):
        table = rng.choice(list(KEYS))
        row = dict(rng.choice(samples[table]))
        row[KEYS[table]] = rng.choice([1, 2, 3, 1023, 1024, 100_000])
        row = dict(rows.get((table, row[KEYS[table]])) or row)
        if table == "patients":
            if rng.random() < 0.7:
                row[rng.choice(["name", "address", "email"])] = rng.choice(["A", "B", "é"])
            row["email"] = rng.choice([None, row["email"]])
            row["is_deleted"] = rng.random() < 0.4
            row["updated_at"] = AT
        elif table == "appointments":
            row["status"] = rng.choice(["BOOKED", "COMPLETED", "CANCELLED"])
        elif table == "bills":
            row["status"] = rng.choice(["PAID", "UNPAID"])
        removed = rng.random() < 0.15
        rows[table, row[KEYS[table]]] = None if removed else row
        out.append((table, {**row, "version": version, "removed": removed, "changed_at": AT}))
    return out


def write(spark, changes, path):
    for table in KEYS:
        rows = [r for of, r in changes if of == table]
        if rows:
            schema = type(SCHEMAS[table])([*SCHEMAS[table].fields, *CHANGE_FIELDS])
            df = spark.createDataFrame([tuple(r[c] for c in schema.names) for r in rows], schema)
            df.coalesce(2).write.mode("append").parquet(f"{path}/{table}")


def shown(df):
    return sorted(map(tuple, df.select(SHOWN).collect()), key=repr)


@pytest.mark.parametrize("changed_only", [True, False])
def test_any_cut_restart_and_repeat_equals_the_fold(spark, seed, tmp_path, changed_only):
    rng = random.Random(5)
    images = {(n, r[k]): r.asDict() for n, k in KEYS.items() for r in seed[n].collect()}
    changes = random_changes(rng, images, 150)
    want = fold(images, changes, changed_only)
    assert len({x[0] for x in want}) == 6
    src, sink, ckpt = (str(tmp_path / x) for x in ("src", "sink", "ckpt"))
    empty_source(spark, src)
    for part in (changes[:60], changes[60:61], changes[30:110], changes[100:]):    # some are sent again
        write(spark, rng.sample(part, len(part)), src)
        q = start_audits(seed, src, sink, ckpt, changed_only=changed_only,
                         ids_per_block={"patients": 2})                            # restarts from the checkpoint
        q.awaitTermination()
        assert q.exception() is None
    assert shown(spark.read.parquet(sink)) == want


def test_snapshots_equal_the_batch_feed(spark, seed):
    p, a = seed.patients, seed.appointments
    patched = p.withColumn("name", F.when(F.col("patient_id") == 1, "Changed").otherwise(F.col("name"))) \
        .withColumn("updated_at", F.lit(AT).cast("timestamp"))
    more = seed.bills.withColumn("bill_id", F.col("bill_id") + 1000)
    first = seed.replace(patients=patched, appointments=a.withColumn("status", F.lit("CANCELLED")),
                         bills=seed.bills.unionByName(more))
    second = first.replace(patients=patched.withColumn("is_deleted", F.lit(True)),
                           payments=seed.payments.unionByName(seed.payments.withColumn("payment_id", F.col("payment_id") + 500)))
    got = stream_audit_feed([seed, first, second], AT)
    for version, (old, new) in enumerate([(seed, first), (first, second)], 1):
        want = shown(feeds.audit_feed(old, new, AT))
        assert want and shown(got.filter(F.col("version") == version)) == want
    assert got.filter(F.col("created_at") == F.lit(AT).cast("timestamp")).count() == got.count()


def test_no_changes(seed):
    assert stream_audit_feed([seed, seed], AT).count() == 0
