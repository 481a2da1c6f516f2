"""Row triggers re-aimed as change feeds (T1-T7, T9), batch form.

Two ways to feed the audit trail:
* from a job's accepted rows (exact: every UPDATE the reference runs fires,
  even one that changes nothing), see ``odonto.plans.jobs``;
* from a snapshot diff by key (``diff_*`` below), when only the before and
  after snapshots are known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import derived_bill_status
from odonto.operators.ids import assign_ids, max_id

AUDIT_COLS = ["action_type", "table_name", "record_id", "old_value", "new_value", "user_id", "created_at"]


def recompute_bill_status(bills: DataFrame, payments: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Set each affected bill's status from the sum of all its payments.

    PAID when the payments cover the total, PARTIAL when positive, else
    UNPAID. ``affected`` (bill_id) limits the change to bills that received
    a payment, as the trigger does; ``None`` recomputes every bill that has
    payments. Payments are summed per bill first (partial aggregation), so
    the join carries one row per bill.
    """
    pay = payments.select("bill_id", "paid_amount")
    if affected is not None:
        pay = pay.join(affected.select("bill_id").distinct(), "bill_id", "left_semi")
    sums = pay.groupBy("bill_id").agg(F.sum("paid_amount").alias("_paid"))
    j = bills.join(sums, "bill_id", "left")
    new_status = F.when(F.col("_paid").isNotNull(), derived_bill_status(F.col("_paid"), F.col("total_amount"))) \
        .otherwise(F.col("status"))
    return j.withColumn("status", new_status).select(bills.columns)


def bill_status_changes(bills: DataFrame, payments: DataFrame) -> DataFrame:
    """T7 as a feed: bills whose status the recompute changes (old -> new)."""
    new = recompute_bill_status(bills, payments).select("bill_id", F.col("status").alias("new_status"))
    return (bills.select("bill_id", F.col("status").alias("old_status")).join(new, "bill_id")
            .filter(F.col("old_status") != F.col("new_status")))


# --- snapshot diffs ----------------------------------------------------------

def _audit(df: DataFrame, action: Column | str, table: str, record: str, old: Column | None,
           new: Column | None, user: Column | None, ts: Column) -> DataFrame:
    return df.select(
        (F.lit(action) if isinstance(action, str) else action).alias("action_type"),
        F.lit(table).alias("table_name"), F.col(record).cast("long").alias("record_id"),
        (old if old is not None else F.lit(None)).cast("string").alias("old_value"),
        (new if new is not None else F.lit(None)).cast("string").alias("new_value"),
        (user if user is not None else F.lit(None)).cast("long").alias("user_id"),
        ts.cast("timestamp").alias("created_at"))


def patients_added(old: DataFrame, new: DataFrame, ts: Column) -> DataFrame:
    """PATIENT_ADDED for keys new to the snapshot, 'code - name'."""
    added = new.join(old.select("patient_id"), "patient_id", "left_anti")
    return _audit(added, "PATIENT_ADDED", "patients", "patient_id", None,
                  F.concat(F.col("patient_code"), F.lit(" - "), F.col("name")), None, ts)


def patients_updated(old: DataFrame, new: DataFrame, ts: Column, changed_only: bool = True) -> DataFrame:
    """PATIENT_SOFT_DELETED on FALSE -> TRUE, else PATIENT_UPDATED (old/new name).

    A diff only sees rows whose values changed (``changed_only``); the
    trigger also fires for updates that change nothing.
    """
    cols = [c for c in old.columns if c != "updated_at"]
    o = old.select("patient_id", F.col("name").alias("_old_name"), F.col("is_deleted").alias("_old_del"), F.struct(*cols).alias("_was"))
    j = o.join(new.select("patient_id", "name", "is_deleted", F.struct(*cols).alias("_is")), "patient_id")
    if changed_only:
        j = j.filter(~F.col("_was").eqNullSafe(F.col("_is")))
    action = F.when(~F.col("_old_del") & F.col("is_deleted"), "PATIENT_SOFT_DELETED").otherwise("PATIENT_UPDATED")
    return _audit(j, action, "patients", "patient_id", F.col("_old_name"), F.col("name"), None, ts)


def appointment_status_changed(old: DataFrame, new: DataFrame, ts: Column) -> DataFrame:
    """T4: APPOINTMENT_STATUS_CHANGED when the status differs; actor = creator."""
    o = old.select("appointment_id", F.col("status").alias("_old_status"))
    j = new.join(o, "appointment_id").filter(F.col("_old_status") != F.col("status"))
    return _audit(j, "APPOINTMENT_STATUS_CHANGED", "appointments", "appointment_id", F.col("_old_status"),
                  F.col("status"), F.col("created_by_user_id"), ts)


def bills_created(old: DataFrame, new: DataFrame, ts: Column) -> DataFrame:
    """T5: BILL_CREATED 'Total: x' for new bills."""
    added = new.join(old.select("bill_id"), "bill_id", "left_anti")
    return _audit(added, "BILL_CREATED", "bills", "bill_id", None,
                  F.concat(F.lit("Total: "), F.col("total_amount").cast("string")),
                  F.col("created_by_user_id"), ts)


def payments_created(old: DataFrame, new: DataFrame, ts: Column) -> DataFrame:
    """PAYMENT_CREATED 'Amount: x' for new payments."""
    added = new.join(old.select("payment_id"), "payment_id", "left_anti")
    return _audit(added, "PAYMENT_CREATED", "payments", "payment_id", None,
                  F.concat(F.lit("Amount: "), F.col("paid_amount").cast("string")),
                  F.col("received_by_user_id"), ts)


def stamp_updated_at(old: DataFrame, new: DataFrame, key: str, ts: Column,
                     col: str = "updated_at") -> DataFrame:
    """``updated_at`` = ``ts`` on rows whose other values changed."""
    cols = [c for c in new.columns if c != col]
    o = old.select(key, F.struct(*cols).alias("_was"))
    j = new.join(o, key, "left")
    changed = ~F.col("_was").eqNullSafe(F.struct(*[new[c] for c in cols]))
    return j.withColumn(col, F.when(changed, ts.cast("timestamp")).otherwise(F.col(col))).select(new.columns)


def audit_feed(old, new, ts) -> DataFrame:
    """T2-T6 from two snapshots, unioned in the audit-log shape."""
    ts = ts if isinstance(ts, Column) else F.lit(ts)
    parts = [
        patients_added(old.patients, new.patients, ts),
        patients_updated(old.patients, new.patients, ts),
        appointment_status_changed(old.appointments, new.appointments, ts),
        bills_created(old.bills, new.bills, ts),
        payments_created(old.payments, new.payments, ts),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def append_audit(audit_logs: DataFrame, rows: DataFrame, order_col: str = "_order") -> DataFrame:
    """Append audit rows with fresh log ids (after the current maximum).

    Ids follow ``order_col``, the arrival order that every job's audit frame
    carries. Rows of a snapshot diff have none: give them an order first.
    """
    rows = assign_ids(rows.withColumn("seq", F.col(order_col)), "log_id", max_id(audit_logs, "log_id"))
    return audit_logs.unionByName(rows.select("log_id", *AUDIT_COLS))
