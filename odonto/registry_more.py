"""Registered queries for audits, jobs, feeds and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from odonto.plans import audits
from odonto.registry import register


# --- data-quality audits ---------------------------------------------------
@register("dq_not_null")
def _q(t, spark, d):
    return audits.not_null(t)


@register("dq_unique")
def _q(t, spark, d):
    return audits.unique(t)


@register("dq_unique_slot")
def _q(t, spark, d):
    return audits.unique_slot(t)


@register("dq_checks")
def _q(t, spark, d):
    return audits.checks(t)


@register("dq_domains")
def _q(t, spark, d):
    return audits.domains(t)


@register("dq_orphans")
def _q(t, spark, d):
    return audits.orphans(t)


@register("dq_bill_status")
def _q(t, spark, d):
    return audits.bill_status(t)


@register("delete_actions")
def _q(t, spark, d):
    keys = t.patients.filter(F.col("is_deleted")).select("patient_id")
    report, _ = audits.delete_with_actions(t, "patients", keys)
    return report


# --- bulk write jobs -------------------------------------------------------
from odonto.plans import jobs  # noqa: E402
from odonto.sources import requests as rq  # noqa: E402

JOB_AS_OF = "2024-01-15 12:00:00"


def _as_of():
    import datetime as dt
    return dt.datetime.fromisoformat(JOB_AS_OF)


@register("book_appointments")
def _q(t, spark, d):
    return jobs.book_appointments(t, rq.booking_requests(spark, d), _as_of(), strict=True).outcome


@register("book_appointments_lenient")
def _q(t, spark, d):
    return jobs.book_appointments(t, rq.booking_requests(spark, d), _as_of(), strict=False).outcome


@register("create_bills")
def _q(t, spark, d):
    return jobs.create_bills(t, rq.bill_requests(spark, d), _as_of()).outcome


@register("add_payments")
def _q(t, spark, d):
    return jobs.add_payments(t, rq.payment_requests(spark, d), _as_of()).outcome


from odonto.plans import changes, records  # noqa: E402

_RECORD_JOBS = {
    "add_patients": (records.add_patients, rq.patient_requests),
    "patch_patients": (records.patch_patients, rq.patient_patch_requests),
    "soft_delete_patients": (records.soft_delete_patients, rq.patient_delete_requests),
    "add_dentists": (records.add_dentists, rq.dentist_requests),
    "patch_dentists": (records.patch_dentists, rq.dentist_patch_requests),
    "patch_appointments": (records.patch_appointments, rq.appointment_patch_requests),
    "cancel_appointments": (records.cancel_appointments, rq.appointment_cancel_requests),
    "add_treatments": (records.add_treatments, rq.treatment_requests),
    "patch_treatments": (records.patch_treatments, rq.treatment_patch_requests),
    "add_medicines": (records.add_medicines, rq.medicine_requests),
    "patch_medicines": (records.patch_medicines, rq.medicine_patch_requests),
    "upsert_permissions": (records.upsert_permissions, rq.permission_requests),
    "patch_clinic": (records.patch_clinic, rq.clinic_requests),
    "patch_timings": (records.patch_timings, rq.timing_requests),
}


def _record_job(job, build):
    def q(t, spark, d):
        return job(t, build(spark, d), _as_of()).outcome
    q.__doc__ = job.__doc__
    return q


for _name, (_job, _build) in _RECORD_JOBS.items():
    register(_name)(_record_job(_job, _build))


@register("patch_patients_result")
def _q(t, spark, d):
    snap = records.patch_patients(t, rq.patient_patch_requests(spark, d), _as_of()).snapshot
    h = snap.patient_medical_history.select("patient_id", "allergies", "current_medications", "medical_notes")
    return snap.patients.join(h, "patient_id", "left").select(
        "patient_id", "name", "phone", "gender", "address",
        F.coalesce(F.col("updated_at") == F.lit(_as_of()).cast("timestamp"), F.lit(False)).alias("touched"),
        "allergies", "current_medications", "medical_notes")


_AUDIT = ["action_type", "table_name", "record_id", "old_value", "new_value"]


@register("patch_patients_audit")
def _q(t, spark, d):
    return records.patch_patients(t, rq.patient_patch_requests(spark, d), _as_of()).audit.select(*_AUDIT)


@register("soft_delete_patients_audit")
def _q(t, spark, d):
    return records.soft_delete_patients(t, rq.patient_delete_requests(spark, d), _as_of()).audit.select(*_AUDIT)


@register("cancel_appointments_audit")
def _q(t, spark, d):
    return records.cancel_appointments(t, rq.appointment_cancel_requests(spark, d), _as_of()).audit.select(
        *_AUDIT, "user_id")


@register("patch_appointments_audit")
def _q(t, spark, d):
    return records.patch_appointments(t, rq.appointment_patch_requests(spark, d), _as_of()).audit.select(
        *_AUDIT, "user_id")


@register("upsert_permissions_result")
def _q(t, spark, d):
    snap = records.upsert_permissions(t, rq.permission_requests(spark, d), _as_of()).snapshot
    return snap.staff_permissions.select("permission_id", "staff_user_id", "can_manage_billing", "can_view_reports")


# --- written rows ------------------------------------------------------------

@register("soft_delete_patients_result")
def _q(t, spark, d):
    snap = records.soft_delete_patients(t, rq.patient_delete_requests(spark, d), _as_of()).snapshot
    return snap.patients.select("patient_id", "is_deleted", F.col("updated_at").isNotNull().alias("touched"))


@register("add_dentists_result")
def _q(t, spark, d):
    snap = records.add_dentists(t, rq.dentist_requests(spark, d), _as_of()).snapshot
    return snap.dentists.select("dentist_id", "dentist_code", "name", "phone", "specialization", "is_active")


@register("patch_dentists_result")
def _q(t, spark, d):
    snap = records.patch_dentists(t, rq.dentist_patch_requests(spark, d), _as_of()).snapshot
    return snap.dentists.select("dentist_id", "name", "specialization", "is_active")


@register("cancel_appointments_result")
def _q(t, spark, d):
    snap = records.cancel_appointments(t, rq.appointment_cancel_requests(spark, d), _as_of()).snapshot
    return snap.appointments.select("appointment_id", "status", F.col("updated_at").isNotNull().alias("touched"))


@register("add_medicines_result")
def _q(t, spark, d):
    snap = records.add_medicines(t, rq.medicine_requests(spark, d), _as_of()).snapshot
    return snap.medicines.select("medicine_id", "medicine_name", "batch_no", "quantity", "low_stock_limit", "expiry_date")


@register("book_appointments_result")
def _q(t, spark, d):
    return jobs.book_appointments(t, rq.booking_requests(spark, d), _as_of(), strict=True).accepted.select(
        "appointment_id", "appointment_code", "patient_id", "dentist_id", "appointment_date", "appointment_time", "status")


@register("create_bills_result")
def _q(t, spark, d):
    return jobs.create_bills(t, rq.bill_requests(spark, d), _as_of()).accepted.select(
        "bill_id", "bill_code", "patient_id", "treatment_id", "subtotal", "discount_amount", "total_amount", "status", "created_by_user_id")


@register("patch_clinic_result")
def _q(t, spark, d):
    return records.patch_clinic(t, rq.clinic_requests(spark, d), _as_of()).snapshot.clinic.select(
        "clinic_id", "clinic_name", "address", "phone", "whatsapp_number")


# --- change feeds -----------------------------------------------------------
from odonto.plans import feeds  # noqa: E402

_FEED = ["action_type", "table_name", "record_id", "old_value", "new_value", "user_id"]


@register("bill_status_recompute")
def _q(t, spark, d):
    new = feeds.recompute_bill_status(t.bills, t.payments).select("bill_id", "status")
    return t.bills.select("bill_id", F.col("status").alias("stored_status")).join(new, "bill_id")


@register("add_payments_bills")
def _q(t, spark, d):
    return jobs.add_payments(t, rq.payment_requests(spark, d), _as_of()).snapshot.bills.select("bill_id", "status")


@register("payments_audit")
def _q(t, spark, d):
    return jobs.add_payments(t, rq.payment_requests(spark, d), _as_of()).audit.select(*_FEED)


@register("bills_audit")
def _q(t, spark, d):
    return jobs.create_bills(t, rq.bill_requests(spark, d), _as_of()).audit.select(*_FEED)


@register("audit_feed")
def _q(t, spark, d):
    """The unified audit feed of one batch of bills, payments and cancellations."""
    a = _as_of()
    parts = [jobs.create_bills(t, rq.bill_requests(spark, d), a).audit,
             jobs.add_payments(t, rq.payment_requests(spark, d), a).audit,
             records.cancel_appointments(t, rq.appointment_cancel_requests(spark, d), a).audit]
    return parts[0].select(*_FEED).unionByName(parts[1].select(*_FEED)).unionByName(parts[2].select(*_FEED))


# --- streams ------------------------------------------------------------------
from odonto.streaming import bill_status as streams  # noqa: E402


@register("stream_bill_status")
def _q(t, spark, d):
    return streams.stream_bill_status(t)


@register("stream_payment_audit")
def _q(t, spark, d):
    return streams.stream_payment_audit(t).select(*_FEED)


@register("add_patients_audit")
def _q(t, spark, d):
    """T2 + T3 as the insert route fires them: PATIENT_ADDED then PATIENT_UPDATED."""
    return records.add_patients(t, rq.patient_requests(spark, d), _as_of()).audit.select(*_AUDIT)


@register("patients_diff_audit")
def _q(t, spark, d):
    """T2/T3 from a snapshot diff: the patch batch's before and after patients."""
    new = records.patch_patients(t, rq.patient_patch_requests(spark, d), _as_of()).snapshot
    return feeds.audit_feed(t, new, F.lit(_as_of()).cast("timestamp")).select(*_AUDIT)


# --- stored procedures as parametrised SQL ------------------------------------
from odonto.plans import procedures  # noqa: E402
from odonto.registry import AS_OF, SEARCH  # noqa: E402


@register("search_patient_sql")
def _q(t, spark, d):
    return procedures.search_patient(t, SEARCH)


@register("daily_report_sql")
def _q(t, spark, d):
    return procedures.daily_appointment_report(t, AS_OF)


# --- display labels (X22) -------------------------------------------------------
from odonto.plans import lists  # noqa: E402


@register("dentist_status_labels")
def _q(t, spark, d):
    return lists.dentist_status_labels(t)


@register("stock_labels")
def _q(t, spark, d):
    return lists.stock_labels(t)


@register("patch_appointments_chain")
def _q(t, spark, d):
    return changes.change_appointments(t, rq.appointment_change_requests(spark, d), _as_of()).outcome


@register("patch_appointments_chain_lenient")
def _q(t, spark, d):
    return changes.change_appointments(t, rq.appointment_change_requests(spark, d), _as_of(), strict=False).outcome


@register("patch_appointments_chain_result")
def _q(t, spark, d):
    snap = changes.change_appointments(t, rq.appointment_change_requests(spark, d), _as_of(), strict=False).snapshot
    return snap.appointments.select("appointment_id", "appointment_date", "appointment_time", "status",
                                    F.col("updated_at").isNotNull().alias("touched"))


@register("stream_add_payments")
def _q(t, spark, d):
    from odonto.streaming.payments import stream_add_payments
    return stream_add_payments(t, rq.payment_requests(spark, d)).select("seq", "status_code", "reason")


@register("stream_audit_feed")
def _q(t, spark, d):
    """T9 as a stream over two batches: patients are patched, appointments cancelled
    and bills created; then patients are soft-deleted, payments come in and set
    the status of their bills."""
    from odonto.session import stage_files, staged_within
    from odonto.streaming.audits import stream_audit_feed
    a = _as_of()
    with staged_within(spark) as keep:
        bills = keep(jobs.create_bills(t, rq.bill_requests(spark, d), a).snapshot.bills)
    with staged_within(spark) as keep:
        payments = keep(jobs.add_payments(t, rq.payment_requests(spark, d), a).snapshot.payments)
    first = t.replace(
        patients=stage_files(records.patch_patients(t, rq.patient_patch_requests(spark, d), a).snapshot.patients),
        appointments=records.cancel_appointments(t, rq.appointment_cancel_requests(spark, d), a).snapshot.appointments,
        bills=bills)
    second = first.replace(
        patients=records.soft_delete_patients(first, rq.patient_delete_requests(spark, d), a).snapshot.patients,
        bills=feeds.recompute_bill_status(first.bills, payments), payments=payments)
    # The binding's payment ids are a hundred times sparser than the library's own.
    return stream_audit_feed([t, first, second], a, ids_per_block={"payments": 100_000}).select(*_FEED, "version")


# --- typed request bodies -------------------------------------------------------
from odonto.sources import bodies  # noqa: E402


@register("add_medicines_typed")
def _q(t, spark, d):
    path = bodies.write_lines(rq.medicine_bodies(spark, d), "medicine-bodies")
    job = records.add_medicines(t, bodies.read_bodies(spark, path, bodies.BODIES["add_medicines"]), _as_of())
    return job.accepted.select("medicine_id", "medicine_name", "batch_no", "quantity", "low_stock_limit", "expiry_date")


@register("malformed_requests")
def _q(t, spark, d):
    path = bodies.write_lines(rq.medicine_bodies(spark, d), "medicine-bodies")
    return bodies.quarantined(spark, path).select("line", "problem")


# --- versions that share unchanged buckets ----------------------------------------
@register("soft_delete_patients_versions")
def _q(t, spark, d):
    """W3 on stored versions: the deleted patients' buckets are rewritten, the rest is shared."""
    from odonto.session import ensure_checkpoint_dir
    from odonto.sources.versions import VersionedTables
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/versions-{uuid.uuid4().hex[:12]}"
    store = VersionedTables.create(spark, path, {"patients": t.patients})
    gone = records.soft_delete_patients(t, rq.patient_delete_requests(spark, d), _as_of()).accepted
    patches = gone.select("seq", F.col("patient_id").cast("long"), F.lit(True).alias("is_deleted"), F.lit(True).alias("has_is_deleted"))
    new = store.patch("patients", patches, ["is_deleted"], stamp=("updated_at", F.lit(_as_of())))
    return new.table("patients").select("patient_id", "is_deleted", F.col("updated_at").isNotNull().alias("touched"))


@register("patients_page_fences")
def _q(t, spark, d):
    """O7 from sorted ranges: only those that hold the page's offsets are read."""
    from odonto.operators.paging import SortedPages
    from odonto.registry import PAGE_OFFSET, PAGE_SIZE
    from odonto.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pages-{uuid.uuid4().hex[:12]}"
    return SortedPages.write(lists.live_patients(t), ["name", "patient_id"], path).page(PAGE_OFFSET, PAGE_SIZE)
