"""List queries Q1-Q14 and the two docs-only forms (right join, paging)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import as_date, hhmm, ilike_any, weekday_name, weekday_ordinal, yes_no_label
from odonto.operators.access import billing_access
from odonto.plans.views import appointment_details, billing_summary, live_patients

HISTORY_COLS = ["allergies", "current_medications", "medical_notes"]


def _with_history(t, patients: DataFrame) -> DataFrame:
    mh = t.patient_medical_history.select("patient_id", *HISTORY_COLS)
    return patients.join(mh, "patient_id", "left").select(patients.columns + HISTORY_COLS)


def patients(t, search: str | None = None) -> DataFrame:
    """Q1: live patients with history, optional search on name/phone/code, by name.

    The text is trimmed and cut to 80 characters; a blank one filters nothing.
    """
    p = live_patients(t)
    if search := (search or "").strip()[:80]:
        p = p.filter(ilike_any(["name", "phone", "patient_code"], search))
    return _with_history(t, p).orderBy("name", "patient_id")


def patients_by_id(t, keys: DataFrame) -> DataFrame:
    """Q2: look up many patient ids at once.

    ``keys`` has a ``patient_id`` column. Found ids return the patient row
    with history and ``found = true``; ids with no live patient return one
    row with ``found = false`` (the not-found answer).
    """
    k = keys.select("patient_id").distinct()
    live = live_patients(t)
    found = _with_history(t, live.join(k, "patient_id", "left_semi")).withColumn("found", F.lit(True))
    missing = k.join(live.select("patient_id"), "patient_id", "left_anti").withColumn("found", F.lit(False))
    return found.unionByName(missing, allowMissingColumns=True)


def search_patient(t, text: str) -> DataFrame:
    """Q3: live patients whose code, name or phone contains ``text``, by name."""
    return (live_patients(t).filter(ilike_any(["patient_code", "name", "phone"], text))
            .select("patient_id", "patient_code", "name", "phone", "email", "gender")
            .orderBy("name", "patient_id"))


def dentists(t) -> DataFrame:
    """Q4: dentists, active first, then by name."""
    return t.dentists.orderBy(F.col("is_active").desc(), "name", "dentist_id")


def bookable_dentists(t) -> DataFrame:
    """Q12: active dentists only."""
    return t.dentists.filter(F.col("is_active")).orderBy("name", "dentist_id")


def appointments(t, date=None, status: str | None = None, dentist_id: int | None = None) -> DataFrame:
    """Q5: appointment details with optional date / status / dentist filters."""
    a = appointment_details(t)
    if date is not None:
        a = a.filter(F.col("appointment_date") == as_date(date))
    if status:
        a = a.filter(F.col("status") == status.upper())
    if dentist_id is not None:
        a = a.filter(F.col("dentist_id") == F.lit(dentist_id))
    return a.orderBy(F.col("appointment_date").desc(), "appointment_time", "appointment_id")


def treatments(t, patient_id: int | None = None) -> DataFrame:
    """Q6: treatments with patient and dentist names and the appointment code."""
    tr = t.treatments
    if patient_id is not None:
        tr = tr.filter(F.col("patient_id") == F.lit(patient_id))
    p = t.patients.select("patient_id", F.col("name").alias("patient_name"))
    d = t.dentists.select("dentist_id", F.col("name").alias("dentist_name"))
    a = t.appointments.select("appointment_id", "appointment_code")
    out = tr.join(p, "patient_id").join(d, "dentist_id").join(a, "appointment_id", "left")
    return (out.select(*t.treatments.columns, "patient_name", "dentist_name", "appointment_code")
            .orderBy(F.col("treatment_date").desc(), "treatment_id"))


def bills(t, status: str | None = None, caller: tuple | None = None) -> DataFrame:
    """Q7: billing summary rows, optional status, newest first.

    With ``caller`` = (caller_id, caller_role) the list is gated by billing
    access (G1): a caller without access gets a PermissionError with the
    refusal's reason, which costs one lookup and no join with the bills.
    """
    b = billing_summary(t)
    if status := (status or "").strip():
        b = b.filter(F.col("status") == status.upper())
    if caller is not None:
        req = t.spark.createDataFrame([caller], "caller_id long, caller_role string")
        verdict = billing_access(t, req).select("billing_allowed", "access_reason").first()
        if not verdict["billing_allowed"]:
            raise PermissionError(verdict["access_reason"])
    return b.orderBy(F.col("bill_date").desc(), "bill_id")


def payable_bills(t) -> DataFrame:
    """Q13: bills that can still take a payment (balance > 0)."""
    return billing_summary(t).filter(F.col("remaining_balance") > 0).orderBy(
        F.col("bill_date").desc(), "bill_id")


def medicines(t) -> DataFrame:
    """Q8: medicines with a low-stock flag, low stock first, then by name."""
    m = t.medicines.withColumn("is_low_stock", F.col("quantity") <= F.col("low_stock_limit"))
    return m.orderBy(F.col("is_low_stock").desc(), "medicine_name", "medicine_id")


def staff(t) -> DataFrame:
    """Q9: staff users with effective permissions (defaults: no billing, reports on)."""
    u = t.users.filter(F.col("role") == "STAFF").select("user_id", "full_name", "phone", "email", "is_active")
    sp = t.staff_permissions.select(F.col("staff_user_id").alias("user_id"), "can_manage_billing",
                                    "can_view_reports")
    return (u.join(sp, "user_id", "left")
            .select("user_id", "full_name", "phone", "email", "is_active",
                    F.coalesce("can_manage_billing", F.lit(False)).alias("can_manage_billing"),
                    F.coalesce("can_view_reports", F.lit(True)).alias("can_view_reports"))
            .orderBy("full_name", "user_id"))


def clinic_profile(t, clinic_id: int | None = None) -> DataFrame:
    """One clinic row (the given id, else the lowest id)."""
    c = t.clinic
    if clinic_id is not None:
        c = c.filter(F.col("clinic_id") == clinic_id)
    return c.orderBy("clinic_id").limit(1)


def clinic_week(t, clinic_id: int | None = None) -> DataFrame:
    """Weekly timetable in MONDAY..SUNDAY order."""
    ct = t.clinic_timings
    if clinic_id is not None:
        ct = ct.filter(F.col("clinic_id") == clinic_id)
    return (ct.withColumn("day_order", weekday_ordinal("day_of_week"))
            .orderBy("clinic_id", "day_order", "timing_id"))


def first_active_user_per_role(t) -> DataFrame:
    """Q11: for every role, its first active user (lowest id) and effective permissions.

    Permissions are only filled for STAFF (defaults when no row exists).
    """
    u = t.users.filter(F.col("is_active"))
    first = u.groupBy("role").agg(F.min("user_id").alias("user_id"))
    chosen = u.join(first, ["role", "user_id"], "left_semi")
    sp = t.staff_permissions.select(F.col("staff_user_id").alias("user_id"), "can_manage_billing",
                                    "can_view_reports")
    out = chosen.join(sp, "user_id", "left")
    is_staff = F.col("role") == "STAFF"
    return out.select(
        "role", "user_id", "full_name", "phone", "email", "is_active",
        F.when(is_staff, F.coalesce("can_manage_billing", F.lit(False))).alias("can_manage_billing"),
        F.when(is_staff, F.coalesce("can_view_reports", F.lit(True))).alias("can_view_reports"),
    ).orderBy("role")


def hours_for_dates(t, dates: DataFrame, date_col: str = "date", clinic_id: int | None = None) -> DataFrame:
    """Q14: opening hours for each date: weekday lookup in the timetable."""
    ct = t.clinic_timings
    if clinic_id is not None:
        ct = ct.filter(F.col("clinic_id") == clinic_id)
    ct = ct.select("day_of_week", "clinic_id", "opening_time", "closing_time", "is_closed")
    d = dates.withColumn("day_of_week", weekday_name(F.col(date_col)))
    out = d.join(ct, "day_of_week", "left")
    return out.select(
        *dates.columns, "day_of_week", "clinic_id",
        F.coalesce(F.col("is_closed"), F.lit(True)).alias("is_closed"),
        hhmm("opening_time").alias("opens"), hhmm("closing_time").alias("closes"))


def dentists_with_appointments(t) -> DataFrame:
    """J7 (right outer join): every dentist, with appointment counts (0 when none)."""
    per = t.appointments.groupBy("dentist_id").agg(F.count(F.lit(1)).alias("appointment_count"))
    d = t.dentists.select("dentist_id", "dentist_code", "name")
    return (per.join(d, "dentist_id", "right")
            .select("dentist_id", "dentist_code", "name",
                    F.coalesce("appointment_count", F.lit(0)).alias("appointment_count"))
            .orderBy("dentist_id"))


def patients_page(t, offset: int, size: int) -> DataFrame:
    """One page of the live-patient list (by name, then id)."""
    return live_patients(t).orderBy("name", "patient_id").offset(offset).limit(size)


def dentist_status_labels(t) -> DataFrame:
    """Dentists with their ACTIVE / INACTIVE label, active first."""
    return (t.dentists.select("dentist_id", "dentist_code", "name", "specialization",
                              yes_no_label("is_active", "ACTIVE", "INACTIVE").alias("status_label"))
            .orderBy(F.col("status_label"), "name", "dentist_id"))


def stock_labels(t) -> DataFrame:
    """Medicines with their LOW / OK stock label (quantity <= limit is LOW)."""
    return (t.medicines.select("medicine_id", "medicine_name", "quantity", "low_stock_limit",
                               yes_no_label(F.col("quantity") <= F.col("low_stock_limit"), "LOW", "OK")
                               .alias("stock_label"))
            .orderBy(F.col("stock_label"), "medicine_name", "medicine_id"))
