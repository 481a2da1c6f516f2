"""Record-maintenance jobs: add / patch / delete routes as set-level jobs.

W1 add_patients, W2 patch_patients, W3 soft_delete_patients, W4 add_dentists,
W5 patch_dentists, W7 patch_appointments, W8 cancel_appointments,
W9 add_treatments, W10 patch_treatments, W13 add_medicines,
W14 patch_medicines, W15 upsert_permissions, W16 patch_clinic / patch_timings.

Batch semantics: a request refused by a check changes nothing. Accepted
patches of one key are applied in ``seq`` order (latest present value per
field wins). Checks that read the stored row (existence, the appointment's
current date/time, slot index) read the snapshot before the batch, plus the
batch's own earlier winners where a unique index is involved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import (clean_text, code, date_text_ok, date_value, is_blank, js_number, normalise_time,
                                    time_text_ok, time_value_ok, to_money)
from odonto.operators.access import MSG_OWNER_ONLY, owner_only
from odonto.operators.carry import previous_values
from odonto.operators.ids import assign_ids, max_id
from odonto.operators.patch import apply_patch, has, merge_patches, upsert
from odonto.operators.schedule import MSG_DUPLICATE, with_clinic_hours
from odonto.operators.validate import (Rule, date_rules, first_failure, non_negative_number,
                                       optional_text, required_text, required_text_default, time_rules)
from odonto.plans.jobs import MSG_FK, JobResult, _audit_rows, _date, _exists, _outcome, _ts
from odonto.schemas import APPOINTMENT_STATUSES, GENDERS, TREATMENT_STATUSES
from odonto.session import stage

MSG_BAD_DATE = "Incorrect date value"
MSG_BAD_INT = "Incorrect integer value"


def truthy(c) -> Column:
    """JS ``Boolean()`` of a JSON value given as text: '', 'false', 'null',
    numeric zero and missing are false; anything else is true."""
    c = F.col(c) if isinstance(c, str) else c
    zero = F.coalesce(c.try_cast("double") == 0, F.lit(False))
    return ~(c.isNull() | (c == "") | (c == "false") | (c == "null") | zero)


def _key(c: str) -> Column:
    """Route parameter ``:id`` as a key (non-numeric text matches nothing)."""
    return F.col(c).try_cast("double").try_cast("long")


def _ensure_has(req: DataFrame, fields: list[str]) -> DataFrame:
    for f in fields:
        if has(f) not in req.columns:
            req = req.withColumn(has(f), F.col(f).isNotNull())
    return req


def _settle(r: DataFrame, pre: list[Rule], post: list[Rule]) -> DataFrame:
    """status_code/reason from the pre-checks (400/403), then the store's checks.

    The validated batch is staged (written once to the shared checkpoint
    folder): refusals, accepted rows, snapshot and audit all read from it.
    """
    code_c, reason_c = first_failure(pre + post)
    return stage(r.withColumn("status_code", code_c).withColumn("reason", reason_c))


def _ok_outcome(r: DataFrame, ok_code: int, id_col=None, code_col=None) -> DataFrame:
    return _outcome(r, ok_code, id_col, code_col)


def _union(frames):
    return reduce(lambda a, b: a.unionByName(b), frames)


# --- W1 add patients -------------------------------------------------------

def add_patients(t, req: DataFrame, as_of) -> JobResult:
    """Insert patients (code from id) and their history row (always).

    400: name, phone, gender (default OTHER) required. 500: gender outside
    its domain, unreadable birth date, phone shorter than 7 bytes.
    Audit: PATIENT_ADDED ('PENDING - name') then PATIENT_UPDATED per patient.
    """
    ts = _ts(as_of)
    r_name, name = required_text("name", "name", 120)
    r_phone, phone = required_text("phone", "phone", 30)
    r_gender, gender = required_text_default("gender", "OTHER", "gender", 10)
    dob_text = F.when(F.col("date_of_birth").isNull() | (F.col("date_of_birth") == ""), F.lit(None)) \
        .otherwise(F.col("date_of_birth"))
    r = req.select(
        "seq", name.alias("name"), phone.alias("phone"), optional_text("email", 120).alias("email"),
        F.upper(gender).alias("gender"), dob_text.alias("_dob_text"),
        date_value(dob_text).alias("date_of_birth"), optional_text("address", 255).alias("address"),
        optional_text("allergies", 500).alias("allergies"),
        optional_text("current_medications", 500).alias("current_medications"),
        optional_text("medical_notes", 1000).alias("medical_notes"),
        *[rule.ok.alias(f"_ok{i}") for i, rule in enumerate([r_name, r_phone, r_gender])])
    pre = [Rule(F.col("_ok0"), 400, "name is required"), Rule(F.col("_ok1"), 400, "phone is required"),
           Rule(F.col("_ok2"), 400, "gender is required")]
    post = [Rule(F.col("gender").isin(GENDERS), 500, "Data truncated for column 'gender'"),
            Rule(F.col("_dob_text").isNull() | F.col("date_of_birth").isNotNull(), 500, MSG_BAD_DATE),
            Rule(F.octet_length("phone") >= 7, 500, "Check constraint 'chk_patient_phone' is violated.")]
    r = _settle(r, pre, post)
    ok = assign_ids(r.filter(F.col("status_code").isNull()), "patient_id", max_id(t.patients, "patient_id"))
    ok = assign_ids(ok, "history_id", max_id(t.patient_medical_history, "history_id"))
    new_p = ok.select("patient_id", code("patients", F.col("patient_id")).alias("patient_code"), "name", "phone",
                      "email", "gender", "date_of_birth", "address", F.lit(False).alias("is_deleted"),
                      ts.alias("created_at"), ts.alias("updated_at"), "seq")
    new_h = ok.select("history_id", "patient_id", "allergies", "current_medications", "medical_notes",
                      ts.alias("updated_at"))
    outcome = _union([_ok_outcome(r.filter(F.col("status_code").isNotNull()), 201),
                      _ok_outcome(new_p.withColumn("status_code", F.lit(None).cast("int"))
                                  .withColumn("reason", F.lit(None).cast("string")), 201,
                                  "patient_id", "patient_code")])
    audit = _union([
        _audit_rows(new_p, "PATIENT_ADDED", "patients", "patient_id", None,
                    F.concat(F.lit("PENDING - "), F.col("name")), None, ts, F.col("seq") * 2),
        _audit_rows(new_p, "PATIENT_UPDATED", "patients", "patient_id", F.col("name"), F.col("name"), None, ts,
                    F.col("seq") * 2 + 1)])
    accepted = new_p.drop("seq")
    snap = t.replace(patients=t.patients.unionByName(accepted),
                     patient_medical_history=t.patient_medical_history.unionByName(new_h))
    return JobResult(outcome, accepted, snap, audit)


# --- W2 patch patients -----------------------------------------------------

PATIENT_FIELDS = ["name", "phone", "email", "gender", "date_of_birth", "address"]
HISTORY_FIELDS = ["allergies", "current_medications", "medical_notes"]


def patch_patients(t, req: DataFrame, as_of) -> JobResult:
    """Apply the given patient fields; rewrite the history triple if any
    history field is given (missing ones become ''), inserting it if absent.

    400: a given name / phone / gender must not be blank. 500 (only when the
    patient exists): gender domain, birth date, phone length; a history row
    for an unknown patient (foreign key). Unknown ids are a silent no-op.
    Audit: PATIENT_UPDATED (old name -> new name) per update that hit a row.
    """
    ts = _ts(as_of)
    req = _ensure_has(req, PATIENT_FIELDS + HISTORY_FIELDS)
    r_name, name = required_text("name", "name", 120)
    r_phone, phone = required_text("phone", "phone", 30)
    r_gender, gender = required_text("gender", "gender", 10)
    dob_set = F.col(has("date_of_birth")) & truthy("date_of_birth")
    sets_p = reduce(lambda a, b: a | b, [F.col(has(f)) for f in ["name", "phone", "email", "gender", "address"]]) | dob_set
    sets_h = reduce(lambda a, b: a | b, [F.col(has(f)) for f in HISTORY_FIELDS])
    r = req.select(
        "seq", _key("patient_id").alias("patient_id"),
        name.alias("name"), phone.alias("phone"), optional_text("email", 120).alias("email"),
        F.upper(gender).alias("gender"), F.col("date_of_birth").alias("_dob_text"),
        date_value("date_of_birth").alias("date_of_birth"),
        optional_text("address", 255).alias("address"),
        *[optional_text(f, 1000 if f == "medical_notes" else 500).alias(f) for f in HISTORY_FIELDS],
        *[F.col(has(f)) for f in ["name", "phone", "email", "gender", "address"]],
        dob_set.alias(has("date_of_birth")), sets_p.alias("_sets_p"), sets_h.alias("_sets_h"),
        (F.col(has("name")) & ~r_name.ok).alias("_bad_name"),
        (F.col(has("phone")) & ~r_phone.ok).alias("_bad_phone"),
        (F.col(has("gender")) & ~r_gender.ok).alias("_bad_gender"))
    r = _exists(r, "patient_id", t.patients, "patient_id", "_found")
    r = _exists(r, "patient_id", t.patient_medical_history, "patient_id", "_has_hist")
    hit = F.col("_sets_p") & F.col("_found")
    pre = [Rule(~F.col("_bad_name"), 400, "name is required"), Rule(~F.col("_bad_phone"), 400, "phone is required"),
           Rule(~F.col("_bad_gender"), 400, "gender is required")]
    post = [Rule(~hit | ~F.col(has("gender")) | F.col("gender").isin(GENDERS), 500, "Data truncated for column 'gender'"),
            Rule(~hit | ~F.col(has("date_of_birth")) | F.col("date_of_birth").isNotNull(), 500, MSG_BAD_DATE),
            Rule(~hit | ~F.col(has("phone")) | (F.octet_length("phone") >= 7), 500,
                 "Check constraint 'chk_patient_phone' is violated."),
            Rule(~F.col("_sets_h") | F.col("_found") | F.col("_has_hist"), 500, MSG_FK)]
    r = _settle(r, pre, post)
    ok = r.filter(F.col("status_code").isNull())
    fields = ["name", "phone", "email", "gender", "date_of_birth", "address"]
    merged = merge_patches(ok.filter(hit), "patient_id", fields)
    patients = apply_patch(t.patients, merged, "patient_id", fields, stamp=("updated_at", ts))
    hist_req = ok.filter(F.col("_sets_h")).select(
        "patient_id", "seq", *HISTORY_FIELDS, *[F.lit(True).alias(has(f)) for f in HISTORY_FIELDS])
    # A new row is inserted by the first request that names its patient.
    hist_last = merge_patches(hist_req, "patient_id", HISTORY_FIELDS).withColumnRenamed("_first_seq", "seq")
    history, _ = upsert(t.patient_medical_history, hist_last.select("patient_id", "seq", *HISTORY_FIELDS),
                        "patient_id", "history_id", HISTORY_FIELDS, stamp=("updated_at", ts))
    updates = ok.filter(hit).select("patient_id", "seq", "name", F.col(has("name")).alias("_sets_name"))
    pv = previous_values(updates, "patient_id", "name", "_sets_name", t.patients, "name")
    audit = _audit_rows(pv, "PATIENT_UPDATED", "patients", "patient_id", F.col("prev_value"), F.col("next_value"),
                        None, ts, F.col("seq"))
    outcome = _ok_outcome(r, 200, "patient_id")
    snap = t.replace(patients=patients, patient_medical_history=history)
    return JobResult(outcome, ok, snap, audit)


# --- W3 soft delete --------------------------------------------------------

def soft_delete_patients(t, req: DataFrame, as_of) -> JobResult:
    """Set is_deleted and updated_at; unknown ids are a silent no-op.

    Audit (T3): the first delete of a live patient is PATIENT_SOFT_DELETED,
    every other update that hit a row is PATIENT_UPDATED (same name both sides).
    """
    ts = _ts(as_of)
    r = req.select("seq", _key("patient_id").alias("patient_id"))
    base = t.patients.select("patient_id", "name", F.col("is_deleted").alias("_was_deleted"))
    hits = r.join(base, "patient_id")
    first = hits.groupBy("patient_id").agg(F.min("seq").alias("_first"))
    hits = hits.join(first, "patient_id")
    action = F.when((F.col("seq") == F.col("_first")) & ~F.col("_was_deleted"), "PATIENT_SOFT_DELETED") \
        .otherwise("PATIENT_UPDATED")
    audit = hits.select(action.alias("action_type"), F.lit("patients").alias("table_name"),
                        F.col("patient_id").alias("record_id"), F.col("name").alias("old_value"),
                        F.col("name").alias("new_value"), F.lit(None).cast("long").alias("user_id"),
                        ts.alias("created_at"), F.col("seq").alias("_order"))
    patch = first.select("patient_id", F.lit(True).alias("is_deleted"), F.lit(True).alias(has("is_deleted")))
    patients = apply_patch(t.patients, patch, "patient_id", ["is_deleted"], stamp=("updated_at", ts))
    outcome = _ok_outcome(r.withColumn("status_code", F.lit(None).cast("int"))
                          .withColumn("reason", F.lit(None).cast("string")), 200, "patient_id")
    return JobResult(outcome, hits, t.replace(patients=patients), audit)


# --- W4 / W5 dentists ------------------------------------------------------

def add_dentists(t, req: DataFrame, as_of) -> JobResult:
    """Insert active dentists; name, phone, specialization required (400)."""
    ts = _ts(as_of)
    r_name, name = required_text("name", "name", 120)
    r_phone, phone = required_text("phone", "phone", 30)
    r_spec, spec = required_text("specialization", "specialization", 120)
    r = req.select("seq", name.alias("name"), phone.alias("phone"), optional_text("email", 120).alias("email"),
                   spec.alias("specialization"),
                   *[rule.ok.alias(f"_ok{i}") for i, rule in enumerate([r_name, r_phone, r_spec])])
    r = _settle(r, [Rule(F.col("_ok0"), 400, "name is required"), Rule(F.col("_ok1"), 400, "phone is required"),
                    Rule(F.col("_ok2"), 400, "specialization is required")], [])
    ok = assign_ids(r.filter(F.col("status_code").isNull()), "dentist_id", max_id(t.dentists, "dentist_id"))
    new = ok.select("dentist_id", code("dentists", F.col("dentist_id")).alias("dentist_code"), "name", "phone",
                    "email", "specialization", F.lit(True).alias("is_active"), ts.alias("created_at"), "seq")
    outcome = _union([_ok_outcome(r.filter(F.col("status_code").isNotNull()), 201),
                      _ok_outcome(new.withColumn("status_code", F.lit(None).cast("int"))
                                  .withColumn("reason", F.lit(None).cast("string")), 201, "dentist_id", "dentist_code")])
    accepted = new.drop("seq")
    return JobResult(outcome, accepted, t.replace(dentists=t.dentists.unionByName(accepted)))


DENTIST_FIELDS = ["name", "phone", "email", "specialization", "is_active"]


def patch_dentists(t, req: DataFrame, as_of) -> JobResult:
    """Apply given fields (is_active by JS truthiness); a request with no
    field answers 'No changes'. A given name/phone/specialization must not be blank."""
    req = _ensure_has(req, DENTIST_FIELDS)
    checks = {f: required_text(f, f, 30 if f == "phone" else 120) for f in ["name", "phone", "specialization"]}
    any_f = reduce(lambda a, b: a | b, [F.col(has(f)) for f in DENTIST_FIELDS])
    r = req.select("seq", _key("dentist_id").alias("dentist_id"),
                   *[checks[f][1].alias(f) for f in checks], optional_text("email", 120).alias("email"),
                   truthy("is_active").alias("is_active"), *[F.col(has(f)) for f in DENTIST_FIELDS],
                   any_f.alias("_any"),
                   *[(F.col(has(f)) & ~checks[f][0].ok).alias(f"_bad_{f}") for f in checks])
    r = _settle(r, [Rule(~F.col(f"_bad_{f}"), 400, f"{f} is required") for f in checks], [])
    ok = r.filter(F.col("status_code").isNull() & F.col("_any"))
    dentists = apply_patch(t.dentists, merge_patches(ok, "dentist_id", DENTIST_FIELDS), "dentist_id", DENTIST_FIELDS)
    return JobResult(_ok_outcome(r, 200, "dentist_id"), ok, t.replace(dentists=dentists))


# --- W7 / W8 appointments --------------------------------------------------

APPT_FIELDS = ["patient_id", "dentist_id", "appointment_date", "appointment_time", "status", "problem_description"]


def patch_appointments(t, req: DataFrame, as_of, clinic_id: int = 1) -> JobResult:
    """Patch appointments.

    404 when the appointment does not exist. A given time must be HH:MM; when
    a date or time is given, the resulting (date, time) must be inside
    clinic hours (the missing part comes from the stored row). A given date
    must be YYYY-MM-DD, a given status non-blank. The store then refuses a
    status outside its domain, an unknown patient or dentist (500) and a
    taken slot (409; among the batch's own moves the lowest seq wins).
    Audit (T4): APPOINTMENT_STATUS_CHANGED when the status differs.
    """
    ts = _ts(as_of)
    req = _ensure_has(req, APPT_FIELDS)
    base = t.appointments.select(
        F.col("appointment_id").alias("_aid"), F.col("appointment_date").alias("_cur_date"),
        F.col("appointment_time").alias("_cur_time"), F.col("dentist_id").alias("_cur_dentist"),
        F.col("patient_id").alias("_cur_patient"), F.col("created_by_user_id").alias("_creator"))
    date_given = truthy("appointment_date") & F.col(has("appointment_date"))
    time_given = truthy("appointment_time") & F.col(has("appointment_time"))
    t_rules, t_val = time_rules("appointment_time", "appointment_time")
    d_rules, d_val = date_rules("appointment_date", "appointment_date")
    r_status, status_v = required_text("status", "status", 20)
    any_f = reduce(lambda a, b: a | b, [F.col(has(f)) for f in APPT_FIELDS])
    r = req.select(
        "seq", _key("appointment_id").alias("_aid"), date_given.alias("_date_given"), time_given.alias("_time_given"),
        F.col("appointment_date").alias("_date_raw"), t_val.alias("_time_norm"), d_val.alias("_date_text"),
        js_number(F.col("patient_id")).alias("_pid_n"), js_number(F.col("dentist_id")).alias("_did_n"),
        F.upper(status_v).alias("status"), optional_text("problem_description", 500).alias("problem_description"),
        *[F.col(has(f)) for f in APPT_FIELDS], any_f.alias("_any"),
        *[(time_given & ~rule.ok).alias(f"_bad_t{i}") for i, rule in enumerate(t_rules)],
        *[(F.col(has("appointment_date")) & ~rule.ok).alias(f"_bad_d{i}") for i, rule in enumerate(d_rules)],
        (F.col(has("status")) & ~r_status.ok).alias("_bad_status"))
    r = r.join(base, "_aid", "left").withColumn("_found", F.col("_cur_date").isNotNull())
    r = (r.withColumn("_final_date", F.when(F.col("_date_given"), F.col("_date_raw"))
                      .otherwise(F.date_format("_cur_date", "yyyy-MM-dd")))
         .withColumn("_final_time", F.when(F.col("_time_given"), F.col("_time_norm")).otherwise(F.col("_cur_time"))))
    r = with_clinic_hours(t, r, "_final_date", "_final_time", clinic_id)
    r = (r.withColumn("appointment_date", F.when(F.col(has("appointment_date")), F.col("_date_text").try_cast("date"))
                      .otherwise(F.col("_cur_date")))
         .withColumn("appointment_time", F.when(F.col("_time_given"), F.col("_time_norm"))
                     .otherwise(F.col("_cur_time")))
         .withColumn("patient_id", F.when(F.col(has("patient_id")), F.col("_pid_n").try_cast("long"))
                     .otherwise(F.col("_cur_patient")))
         .withColumn("dentist_id", F.when(F.col(has("dentist_id")), F.col("_did_n").try_cast("long"))
                     .otherwise(F.col("_cur_dentist"))))
    r = _exists(r, "patient_id", t.patients, "patient_id", "_pat_ok")
    r = _exists(r, "dentist_id", t.dentists, "dentist_id", "_den_ok")
    moves = F.col(has("dentist_id")) | F.col(has("appointment_date")) | F.col(has("appointment_time"))
    # One row per used slot (count, lowest id): "another appointment holds
    # this slot" without pairing a request with every row of a crowded slot.
    slot = ["dentist_id", "appointment_date", "appointment_time"]
    used = t.appointments.groupBy(*slot).agg(F.count(F.lit(1)).alias("_in_slot"),
                                             F.min("appointment_id").alias("_slot_min_id"))
    r = (r.join(used, slot, "left")
         .withColumn("_clash", moves & F.coalesce((F.col("_in_slot") > 1) | (F.col("_slot_min_id") != F.col("_aid")),
                                                   F.lit(False)))
         .drop("_in_slot", "_slot_min_id"))
    pre = [Rule(F.col("_found"), 404, "Appointment not found"),
           *[Rule(~F.col(f"_bad_t{i}"), 400, rule.message) for i, rule in enumerate(t_rules)],
           Rule(~(F.col("_date_given") | F.col("_time_given")) | F.col("hours_ok"), 400, F.col("hours_reason")),
           *[Rule(~F.col(f"_bad_d{i}"), 400, rule.message) for i, rule in enumerate(d_rules)],
           Rule(~F.col("_bad_status"), 400, "status is required")]
    post = [Rule(~F.col("_any") | ~F.col(has("status")) | F.col("status").isin(APPOINTMENT_STATUSES), 500,
                 "Data truncated for column 'status'"),
            Rule(~F.col("_any") | F.col("appointment_date").isNotNull(), 500, MSG_BAD_DATE),
            Rule(~F.col("_any") | time_value_ok("appointment_time"), 500, "Incorrect time value"),
            Rule(~F.col("_any") | (F.col("_pat_ok") & F.col("_den_ok")), 500, MSG_FK),
            Rule(~F.col("_any") | ~F.col("_clash"), 409, MSG_DUPLICATE)]
    r = _settle(r, pre, post)
    passed = r.filter(F.col("status_code").isNull() & F.col("_any"))
    # The first appointment to reach a slot holds it; its own later moves to
    # the same slot change nothing.
    first = (passed.filter(moves).groupBy(*slot).agg(F.min_by("_aid", "seq").alias("_holder")))
    contest = (passed.filter(moves).join(first, slot).filter(F.col("_holder") != F.col("_aid"))
               .select("seq").withColumn("_lost", F.lit(True)))
    r = (r.join(contest, "seq", "left")
         .withColumn("status_code", F.when(F.col("_lost"), F.lit(409)).otherwise(F.col("status_code")))
         .withColumn("reason", F.when(F.col("_lost"), F.lit(MSG_DUPLICATE)).otherwise(F.col("reason"))))
    ok = r.filter(F.col("status_code").isNull() & F.col("_any")).withColumnRenamed("_aid", "appointment_id")
    merged = merge_patches(ok, "appointment_id", APPT_FIELDS)
    appts = apply_patch(t.appointments, merged, "appointment_id", APPT_FIELDS, stamp=("updated_at", ts))
    st = ok.filter(F.col(has("status"))).select("appointment_id", "seq", "status", "_creator")
    pv = previous_values(st.withColumn("_s", F.lit(True)), "appointment_id", "status", "_s",
                         t.appointments, "status")
    changed = pv.filter(F.col("prev_value") != F.col("next_value"))
    audit = _audit_rows(changed, "APPOINTMENT_STATUS_CHANGED", "appointments", "appointment_id",
                        F.col("prev_value"), F.col("next_value"), F.col("_creator"), ts, F.col("seq"))
    outcome = _ok_outcome(r.withColumnRenamed("_aid", "appointment_id"), 200, "appointment_id")
    return JobResult(outcome, ok, t.replace(appointments=appts), audit)


def cancel_appointments(t, req: DataFrame, as_of) -> JobResult:
    """Set status CANCELLED and updated_at; unknown ids are a silent no-op.
    Audit (T4): one APPOINTMENT_STATUS_CHANGED when a live status becomes CANCELLED."""
    ts = _ts(as_of)
    r = req.select("seq", _key("appointment_id").alias("appointment_id"))
    base = t.appointments.select("appointment_id", F.col("status").alias("_old"), "created_by_user_id")
    hits = r.join(base, "appointment_id")
    first = hits.groupBy("appointment_id").agg(F.min("seq").alias("_first"))
    firsts = hits.join(first, "appointment_id").filter(F.col("seq") == F.col("_first"))
    audit = _audit_rows(firsts.filter(F.col("_old") != "CANCELLED"), "APPOINTMENT_STATUS_CHANGED", "appointments",
                        "appointment_id", F.col("_old"), F.lit("CANCELLED"), F.col("created_by_user_id"), ts,
                        F.col("seq"))
    patch = first.select("appointment_id", F.lit("CANCELLED").alias("status"), F.lit(True).alias(has("status")))
    appts = apply_patch(t.appointments, patch, "appointment_id", ["status"], stamp=("updated_at", ts))
    outcome = _ok_outcome(r.withColumn("status_code", F.lit(None).cast("int"))
                          .withColumn("reason", F.lit(None).cast("string")), 200, "appointment_id")
    return JobResult(outcome, hits, t.replace(appointments=appts), audit)


# --- W9 / W10 treatments ---------------------------------------------------

def add_treatments(t, req: DataFrame, as_of) -> JobResult:
    """Insert treatments.

    400: name required, cost a non-negative number, date YYYY-MM-DD (default
    the as-of date), status non-blank (default DONE). 500: status domain,
    unreadable date, cost out of DECIMAL(10,2) range, non-integer ids,
    unknown patient / dentist / appointment (foreign keys).
    """
    ts = _ts(as_of)
    r_name, name = required_text("treatment_name", "treatment_name", 120)
    r_cost, cost_n = non_negative_number("cost", "cost")
    date_src = F.when(F.col("treatment_date").isNull() | (F.col("treatment_date") == ""),
                      F.date_format(_date(as_of), "yyyy-MM-dd")).otherwise(F.col("treatment_date"))
    d_text = clean_text(date_src, 10)
    r_status, status_v = required_text_default("status", "DONE", "status", 20)
    aid_src = F.when(F.col("appointment_id").isNull() | (F.col("appointment_id") == ""), F.lit(None)) \
        .otherwise(F.col("appointment_id"))
    pid_n, did_n, aid_n = js_number(F.col("patient_id")), js_number(F.col("dentist_id")), js_number(aid_src)
    r = req.select(
        "seq", name.alias("treatment_name"), optional_text("notes", 1000).alias("notes"),
        to_money(F.col("cost")).alias("cost"), d_text.alias("_date_text"),
        d_text.try_cast("date").alias("treatment_date"), F.upper(status_v).alias("status"),
        F.when(pid_n == F.floor(pid_n), pid_n.try_cast("long")).alias("patient_id"),
        F.when(did_n == F.floor(did_n), did_n.try_cast("long")).alias("dentist_id"),
        aid_src.alias("_aid_text"), F.when(aid_n == F.floor(aid_n), aid_n.try_cast("long")).alias("appointment_id"),
        r_name.ok.alias("_ok_name"), r_cost.ok.alias("_ok_cost"), (~is_blank(d_text)).alias("_ok_dreq"),
        date_text_ok(d_text).alias("_ok_dfmt"), r_status.ok.alias("_ok_status"))
    r = _exists(r, "patient_id", t.patients, "patient_id", "_pat_ok")
    r = _exists(r, "dentist_id", t.dentists, "dentist_id", "_den_ok")
    r = _exists(r, "appointment_id", t.appointments, "appointment_id", "_apt_ok")
    pre = [Rule(F.col("_ok_name"), 400, "treatment_name is required"),
           Rule(F.col("_ok_cost"), 400, "cost must be a valid non-negative number"),
           Rule(F.col("_ok_dreq"), 400, "treatment_date is required"),
           Rule(F.col("_ok_dfmt"), 400, "treatment_date must use YYYY-MM-DD format"),
           Rule(F.col("_ok_status"), 400, "status is required")]
    post = [Rule(F.col("patient_id").isNotNull() & F.col("dentist_id").isNotNull()
                 & (F.col("_aid_text").isNull() | F.col("appointment_id").isNotNull()), 500, MSG_BAD_INT),
            Rule(F.col("status").isin(TREATMENT_STATUSES), 500, "Data truncated for column 'status'"),
            Rule(F.col("treatment_date").isNotNull(), 500, MSG_BAD_DATE),
            Rule(F.col("cost").isNotNull(), 500, "Out of range value for column 'cost'"),
            Rule(F.col("_pat_ok") & F.col("_den_ok") & (F.col("appointment_id").isNull() | F.col("_apt_ok")), 500, MSG_FK)]
    r = _settle(r, pre, post)
    ok = assign_ids(r.filter(F.col("status_code").isNull()), "treatment_id", max_id(t.treatments, "treatment_id"))
    new = ok.select("treatment_id", "patient_id", "dentist_id", "appointment_id", "treatment_name", "notes", "cost",
                    "treatment_date", "status", ts.alias("created_at"), "seq")
    outcome = _union([_ok_outcome(r.filter(F.col("status_code").isNotNull()), 201),
                      _ok_outcome(new.withColumn("status_code", F.lit(None).cast("int"))
                                  .withColumn("reason", F.lit(None).cast("string")), 201, "treatment_id")])
    accepted = new.drop("seq")
    return JobResult(outcome, accepted, t.replace(treatments=t.treatments.unionByName(accepted)))


TREATMENT_FIELDS = ["treatment_name", "notes", "cost", "treatment_date", "status"]


def patch_treatments(t, req: DataFrame, as_of) -> JobResult:
    """Apply given fields among name, notes, cost, date, status.

    400: blank name, invalid cost, bad date, blank status. 500 (when the row
    exists): status domain, cost range, unreadable date. 'No changes' when
    no field is given; unknown ids are a silent no-op."""
    req = _ensure_has(req, TREATMENT_FIELDS)
    r_name, name = required_text("treatment_name", "treatment_name", 120)
    r_cost, _ = non_negative_number("cost", "cost")
    d_rules, d_val = date_rules("treatment_date", "treatment_date")
    r_status, status_v = required_text("status", "status", 20)
    any_f = reduce(lambda a, b: a | b, [F.col(has(f)) for f in TREATMENT_FIELDS])
    r = req.select(
        "seq", _key("treatment_id").alias("treatment_id"), name.alias("treatment_name"),
        optional_text("notes", 1000).alias("notes"), to_money(F.col("cost")).alias("cost"),
        d_val.try_cast("date").alias("treatment_date"), F.upper(status_v).alias("status"),
        *[F.col(has(f)) for f in TREATMENT_FIELDS], any_f.alias("_any"),
        (F.col(has("treatment_name")) & ~r_name.ok).alias("_b0"), (F.col(has("cost")) & ~r_cost.ok).alias("_b1"),
        *[(F.col(has("treatment_date")) & ~rule.ok).alias(f"_bd{i}") for i, rule in enumerate(d_rules)],
        (F.col(has("status")) & ~r_status.ok).alias("_b3"))
    r = _exists(r, "treatment_id", t.treatments, "treatment_id", "_found")
    hit = F.col("_any") & F.col("_found")
    pre = [Rule(~F.col("_b0"), 400, "treatment_name is required"),
           Rule(~F.col("_b1"), 400, "cost must be a valid non-negative number"),
           *[Rule(~F.col(f"_bd{i}"), 400, rule.message) for i, rule in enumerate(d_rules)],
           Rule(~F.col("_b3"), 400, "status is required")]
    post = [Rule(~hit | ~F.col(has("status")) | F.col("status").isin(TREATMENT_STATUSES), 500,
                 "Data truncated for column 'status'"),
            Rule(~hit | ~F.col(has("cost")) | F.col("cost").isNotNull(), 500, "Out of range value for column 'cost'"),
            Rule(~hit | ~F.col(has("treatment_date")) | F.col("treatment_date").isNotNull(), 500, MSG_BAD_DATE)]
    r = _settle(r, pre, post)
    ok = r.filter(F.col("status_code").isNull() & hit)
    treatments = apply_patch(t.treatments, merge_patches(ok, "treatment_id", TREATMENT_FIELDS), "treatment_id",
                             TREATMENT_FIELDS)
    return JobResult(_ok_outcome(r, 200, "treatment_id"), ok, t.replace(treatments=treatments))


# --- W13 / W14 medicines ---------------------------------------------------

def add_medicines(t, req: DataFrame, as_of) -> JobResult:
    """Insert medicines; quantity defaults to 0 and a falsy limit to 10.

    400: name, batch required, expiry YYYY-MM-DD. 500: quantity / limit not
    numbers, negative (CHECK), unreadable expiry date."""
    ts = _ts(as_of)
    r_name, name = required_text("medicine_name", "medicine_name", 120)
    r_batch, batch = required_text("batch_no", "batch_no", 40)
    d_rules, d_val = date_rules("expiry_date", "expiry_date")
    q = js_number(F.when(truthy("quantity"), F.col("quantity")).otherwise(F.lit("0")))
    # The body's text "0" is a truthy text: only a missing or empty one takes the default.
    lim = js_number(F.when(F.col("low_stock_limit").isNull() | (F.col("low_stock_limit") == ""), F.lit("10"))
                    .otherwise(F.col("low_stock_limit")))
    r = req.select("seq", name.alias("medicine_name"), batch.alias("batch_no"),
                   F.when(~F.isnan(q), F.round(q).try_cast("int")).alias("quantity"),
                   F.when(~F.isnan(lim), F.round(lim).try_cast("int")).alias("low_stock_limit"),
                   d_val.try_cast("date").alias("expiry_date"),
                   r_name.ok.alias("_o0"), r_batch.ok.alias("_o1"),
                   *[rule.ok.alias(f"_od{i}") for i, rule in enumerate(d_rules)])
    pre = [Rule(F.col("_o0"), 400, "medicine_name is required"), Rule(F.col("_o1"), 400, "batch_no is required"),
           *[Rule(F.col(f"_od{i}"), 400, rule.message) for i, rule in enumerate(d_rules)]]
    post = [Rule(F.col("quantity").isNotNull() & F.col("low_stock_limit").isNotNull(), 500, MSG_BAD_INT),
            Rule(F.col("expiry_date").isNotNull(), 500, MSG_BAD_DATE),
            Rule((F.col("quantity") >= 0) & (F.col("low_stock_limit") >= 0), 500,
                 "Check constraint 'chk_medicine_quantity' is violated.")]
    r = _settle(r, pre, post)
    ok = assign_ids(r.filter(F.col("status_code").isNull()), "medicine_id", max_id(t.medicines, "medicine_id"))
    new = ok.select("medicine_id", "medicine_name", "batch_no", "quantity", "low_stock_limit", "expiry_date",
                    ts.alias("created_at"), ts.alias("updated_at"), "seq")
    outcome = _union([_ok_outcome(r.filter(F.col("status_code").isNotNull()), 201),
                      _ok_outcome(new.withColumn("status_code", F.lit(None).cast("int"))
                                  .withColumn("reason", F.lit(None).cast("string")), 201, "medicine_id")])
    accepted = new.drop("seq")
    return JobResult(outcome, accepted, t.replace(medicines=t.medicines.unionByName(accepted)))


MEDICINE_FIELDS = ["medicine_name", "batch_no", "quantity", "low_stock_limit", "expiry_date"]


def patch_medicines(t, req: DataFrame, as_of) -> JobResult:
    """Apply given stock fields; updated_at stamped.

    400: blank name / batch, bad expiry date. 500 (row exists): non-numeric
    or negative quantity / limit. 'No changes' when no field is given."""
    ts = _ts(as_of)
    req = _ensure_has(req, MEDICINE_FIELDS)
    r_name, name = required_text("medicine_name", "medicine_name", 120)
    r_batch, batch = required_text("batch_no", "batch_no", 40)
    d_rules, d_val = date_rules("expiry_date", "expiry_date")
    q, lim = js_number(F.col("quantity")), js_number(F.col("low_stock_limit"))
    any_f = reduce(lambda a, b: a | b, [F.col(has(f)) for f in MEDICINE_FIELDS])
    r = req.select(
        "seq", _key("medicine_id").alias("medicine_id"), name.alias("medicine_name"), batch.alias("batch_no"),
        F.when(~F.isnan(q), F.round(q).try_cast("int")).alias("quantity"),
        F.when(~F.isnan(lim), F.round(lim).try_cast("int")).alias("low_stock_limit"),
        d_val.try_cast("date").alias("expiry_date"), *[F.col(has(f)) for f in MEDICINE_FIELDS], any_f.alias("_any"),
        (F.col(has("medicine_name")) & ~r_name.ok).alias("_b0"), (F.col(has("batch_no")) & ~r_batch.ok).alias("_b1"),
        *[(F.col(has("expiry_date")) & ~rule.ok).alias(f"_bd{i}") for i, rule in enumerate(d_rules)])
    r = _exists(r, "medicine_id", t.medicines, "medicine_id", "_found")
    hit = F.col("_any") & F.col("_found")
    qty_ok = ~F.col(has("quantity")) | F.col("quantity").isNotNull()
    lim_ok = ~F.col(has("low_stock_limit")) | F.col("low_stock_limit").isNotNull()
    pre = [Rule(~F.col("_b0"), 400, "medicine_name is required"), Rule(~F.col("_b1"), 400, "batch_no is required"),
           *[Rule(~F.col(f"_bd{i}"), 400, rule.message) for i, rule in enumerate(d_rules)]]
    post = [Rule(~hit | (qty_ok & lim_ok), 500, MSG_BAD_INT),
            Rule(~hit | ~F.col(has("expiry_date")) | F.col("expiry_date").isNotNull(), 500, MSG_BAD_DATE),
            Rule(~hit | ((~F.col(has("quantity")) | (F.col("quantity") >= 0))
                         & (~F.col(has("low_stock_limit")) | (F.col("low_stock_limit") >= 0))), 500,
                 "Check constraint 'chk_medicine_quantity' is violated.")]
    r = _settle(r, pre, post)
    ok = r.filter(F.col("status_code").isNull() & hit)
    meds = apply_patch(t.medicines, merge_patches(ok, "medicine_id", MEDICINE_FIELDS), "medicine_id",
                       MEDICINE_FIELDS, stamp=("updated_at", ts))
    return JobResult(_ok_outcome(r, 200, "medicine_id"), ok, t.replace(medicines=meds))


# --- W15 staff permissions -------------------------------------------------

def upsert_permissions(t, req: DataFrame, as_of) -> JobResult:
    """Owner-only upsert of a staff user's permissions.

    can_manage_billing = truthiness of the value (missing -> false);
    can_view_reports = truthiness when given, else true. Existing rows are
    updated (updated_at stamped, T1), others inserted (500 for an unknown user).
    """
    ts = _ts(as_of)
    req = _ensure_has(req, ["can_manage_billing", "can_view_reports"])
    r = req.select("seq", "caller_role", _key("staff_user_id").alias("staff_user_id"),
                   truthy("can_manage_billing").alias("can_manage_billing"),
                   F.when(F.col(has("can_view_reports")), truthy("can_view_reports")).otherwise(F.lit(True))
                   .alias("can_view_reports"))
    r = _exists(r, "staff_user_id", t.users, "user_id", "_user_ok")
    r = _exists(r, "staff_user_id", t.staff_permissions, "staff_user_id", "_has_row")
    r = _settle(r, [Rule(owner_only("caller_role"), 403, MSG_OWNER_ONLY)],
                [Rule(F.col("_has_row") | F.col("_user_ok"), 500, MSG_FK)])
    ok = r.filter(F.col("status_code").isNull())
    fields = ["can_manage_billing", "can_view_reports"]
    last = merge_patches(ok.select("staff_user_id", "seq", *fields, *[F.lit(True).alias(has(f)) for f in fields]),
                         "staff_user_id", fields).withColumnRenamed("_first_seq", "seq")
    perms, inserted = upsert(t.staff_permissions, last.select("staff_user_id", "seq", *fields), "staff_user_id",
                             "permission_id", fields, stamp=("updated_at", ts))
    return JobResult(_ok_outcome(r, 200, "staff_user_id"), ok, t.replace(staff_permissions=perms))


# --- W16 clinic profile and timings ----------------------------------------

CLINIC_FIELDS = ["clinic_name", "address", "phone", "email", "whatsapp_number"]


def patch_clinic(t, req: DataFrame, as_of, clinic_id: int = 1) -> JobResult:
    """Rewrite the clinic profile (name, address, phone, whatsapp
    required; e-mail optional); the latest accepted request wins."""
    caps = {"clinic_name": 120, "address": 255, "phone": 30, "whatsapp_number": 30}
    checks = {f: required_text(f, f, n) for f, n in caps.items()}
    r = req.select("seq", *[checks[f][1].alias(f) for f in caps], optional_text("email", 120).alias("email"),
                   *[checks[f][0].ok.alias(f"_ok_{f}") for f in caps])
    r = _settle(r, [Rule(F.col(f"_ok_{f}"), 400, f"{f} is required") for f in caps], [])
    ok = r.filter(F.col("status_code").isNull()).withColumn("clinic_id", F.lit(clinic_id).cast("long"))
    merged = merge_patches(ok.select("clinic_id", "seq", *CLINIC_FIELDS,
                                     *[F.lit(True).alias(has(f)) for f in CLINIC_FIELDS]), "clinic_id", CLINIC_FIELDS)
    clinic = apply_patch(t.clinic, merged, "clinic_id", CLINIC_FIELDS)
    return JobResult(_ok_outcome(r, 200), ok, t.replace(clinic=clinic))


def patch_timings(t, req: DataFrame, as_of) -> JobResult:
    """Set a weekday's hours (defaults 09:00 / 18:00) and closed flag.

    400: times must be HH:MM. 500 (row exists): unstorable time, or opening
    not before closing (CHECK)."""
    def tm(c, default):
        src = F.when(F.col(c).isNull() | (F.col(c) == ""), F.lit(default)).otherwise(F.col(c))
        v = clean_text(src, 8)
        return ~is_blank(v), time_text_ok(v), normalise_time(v)

    o_req, o_fmt, o_v = tm("opening_time", "09:00")
    c_req, c_fmt, c_v = tm("closing_time", "18:00")
    r = req.select("seq", _key("timing_id").alias("timing_id"), o_v.alias("opening_time"), c_v.alias("closing_time"),
                   truthy("is_closed").alias("is_closed"), o_req.alias("_o1"), o_fmt.alias("_o2"),
                   c_req.alias("_c1"), c_fmt.alias("_c2"))
    r = _exists(r, "timing_id", t.clinic_timings, "timing_id", "_found")
    pre = [Rule(F.col("_o1"), 400, "opening_time is required"), Rule(F.col("_o2"), 400, "opening_time must use HH:MM format"),
           Rule(F.col("_c1"), 400, "closing_time is required"), Rule(F.col("_c2"), 400, "closing_time must use HH:MM format")]
    post = [Rule(~F.col("_found") | (time_value_ok("opening_time") & time_value_ok("closing_time")), 500,
                 "Incorrect time value"),
            Rule(~F.col("_found") | (F.col("opening_time") < F.col("closing_time")), 500,
                 "Check constraint 'chk_clinic_time' is violated.")]
    r = _settle(r, pre, post)
    fields = ["opening_time", "closing_time", "is_closed"]
    ok = r.filter(F.col("status_code").isNull() & F.col("_found"))
    merged = merge_patches(ok.select("timing_id", "seq", *fields, *[F.lit(True).alias(has(f)) for f in fields]),
                           "timing_id", fields)
    timings = apply_patch(t.clinic_timings, merged, "timing_id", fields)
    return JobResult(_ok_outcome(r, 200, "timing_id"), ok, t.replace(clinic_timings=timings))
