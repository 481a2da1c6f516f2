"""Record jobs and change feeds on the seed-shaped snapshot."""
import datetime as dt

from pyspark.sql import functions as F

from clinic_constants import AS_OF
from odonto.plans import audits, feeds, records

APPT = ("seq long, appointment_id string, patient_id string, has_patient_id boolean, dentist_id string, "
        "has_dentist_id boolean, appointment_date string, has_appointment_date boolean, appointment_time string, "
        "has_appointment_time boolean, status string, has_status boolean, problem_description string, "
        "has_problem_description boolean")


def appt_req(spark, rows):
    full = []
    for seq, aid, fields in rows:
        r = [seq, aid]
        for f in ["patient_id", "dentist_id", "appointment_date", "appointment_time", "status", "problem_description"]:
            r += [fields.get(f), f in fields]
        full.append(tuple(r))
    return spark.createDataFrame(full, APPT)


def test_patch_appointments(spark, seed):
    tomorrow = (AS_OF + dt.timedelta(days=1)).isoformat()
    req = appt_req(spark, [
        (1, "3", {"status": "completed"}),
        (2, "3", {"appointment_time": "19:00"}),
        (3, "99", {"status": "booked"}),
        (4, "4", {}),
        (5, "4", {"status": "done"}),
        (6, "1", {"appointment_date": tomorrow, "appointment_time": "12:00"}),   # takes appointment 3's slot
    ])
    res = records.patch_appointments(seed, req, AS_OF)
    out = {r.seq: (r.status_code, r.reason) for r in res.outcome.collect()}
    assert out[1] == (200, None)
    assert out[2][0] == 400 and out[2][1].startswith("Appointment time must be between")
    assert out[3] == (404, "Appointment not found")
    assert out[4] == (200, None)                       # no field: 'No changes'
    assert out[5] == (500, "Data truncated for column 'status'")
    assert out[6][0] == 409
    audit = [(r.record_id, r.old_value, r.new_value, r.user_id) for r in res.audit.collect()]
    assert audit == [(3, "BOOKED", "COMPLETED", 3)]
    assert res.snapshot.appointments.filter("appointment_id = 3").first().status == "COMPLETED"


def test_cancel_twice_audits_once(spark, seed):
    req = spark.createDataFrame([(1, "3"), (2, "3"), (3, "42")], "seq long, appointment_id string")
    res = records.cancel_appointments(seed, req, AS_OF)
    assert [r.status_code for r in res.outcome.collect()] == [200, 200, 200]
    assert [(r.record_id, r.old_value, r.new_value) for r in res.audit.collect()] == [(3, "BOOKED", "CANCELLED")]


def test_upsert_permissions(spark, seed):
    req = spark.createDataFrame(
        [(1, "OWNER", "4", "true", True, None, False), (2, "STAFF", "2", "true", True, None, False),
         (3, None, "2", "1", True, "false", True)],
        "seq long, caller_role string, staff_user_id string, can_manage_billing string, has_can_manage_billing boolean, "
        "can_view_reports string, has_can_view_reports boolean")
    res = records.upsert_permissions(seed, req, AS_OF)
    out = {r.seq: r.status_code for r in res.outcome.collect()}
    assert out == {1: 200, 2: 403, 3: 200}
    got = {r.staff_user_id: (r.permission_id, r.can_manage_billing, r.can_view_reports)
           for r in res.snapshot.staff_permissions.collect()}
    assert got == {2: (1, True, False), 3: (2, True, True), 4: (3, True, True)}


def test_delete_with_actions(spark, seed):
    keys = spark.createDataFrame([(1,), (5,)], "patient_id long")
    report, snap = audits.delete_with_actions(seed, "patients", keys)
    got = sorted((r.table_name, r.record_key, r.action) for r in report.collect())
    assert got == [("patient_medical_history", "5", "CASCADE_DELETED"),
                   ("patients", "1", "REJECTED"), ("patients", "5", "DELETED")]
    assert sorted(r.patient_id for r in snap.patients.collect()) == [1, 2, 3, 4]
    assert snap.patient_medical_history.filter("patient_id = 5").count() == 0


def test_delete_set_null(spark, seed):
    keys = spark.createDataFrame([(3,)], "user_id long")
    report, snap = audits.delete_with_actions(seed, "users", keys)
    acts = {(r.table_name, r.action) for r in report.collect()}
    assert ("staff_permissions", "CASCADE_DELETED") in acts and ("bills", "SET_NULL") in acts
    assert snap.bills.filter(F.col("created_by_user_id") == 3).count() == 0
    assert snap.bills.count() == 3


def test_add_patients_codes_and_audit(spark, seed):
    req = spark.createDataFrame(
        [(10, "New One", "0300-1234567", None, None, None, None, None, None, None),
         (11, "New Two", "123", None, "female", None, None, None, None, None),
         (12, "", "0300-7654321", None, None, None, None, None, None, None)],
        "seq long, name string, phone string, email string, gender string, date_of_birth string, address string, "
        "allergies string, current_medications string, medical_notes string")
    res = records.add_patients(seed, req, AS_OF)
    out = {r.seq: (r.status_code, r.record_code, r.reason) for r in res.outcome.collect()}
    assert out[10] == (201, "PAT-00006", None)
    assert out[11][0] == 500 and "chk_patient_phone" in out[11][2]
    assert out[12] == (400, None, "name is required")
    new = res.snapshot.patients.filter("patient_id = 6").first()
    assert (new.gender, new.is_deleted) == ("OTHER", False)
    assert res.snapshot.patient_medical_history.filter("patient_id = 6").first().allergies == ""
    acts = [(r.action_type, r.new_value) for r in res.audit.orderBy("_order").collect()]
    assert acts == [("PATIENT_ADDED", "PENDING - New One"), ("PATIENT_UPDATED", "New One")]


def test_diff_feed(spark, seed):
    ts = F.lit(dt.datetime(2026, 12, 2, 9)).cast("timestamp")
    new_p = seed.patients.withColumn("is_deleted", F.col("patient_id") == 2).withColumn(
        "name", F.when(F.col("patient_id") == 4, "Renamed").otherwise(F.col("name")))
    new_a = seed.appointments.withColumn("status", F.when(F.col("appointment_id") == 4, "CANCELLED")
                                         .otherwise(F.col("status")))
    new = seed.replace(patients=new_p, appointments=new_a)
    got = sorted((r.action_type, r.record_id, r.old_value, r.new_value) for r in feeds.audit_feed(seed, new, ts).collect())
    assert got == [("APPOINTMENT_STATUS_CHANGED", 4, "BOOKED", "CANCELLED"),
                   ("PATIENT_SOFT_DELETED", 2, "Patient Bravo", "Patient Bravo"),
                   ("PATIENT_UPDATED", 4, "Patient Delta", "Renamed")]
