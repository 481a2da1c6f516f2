"""Hand-worked goldens on the seed-shaped snapshot."""
from decimal import Decimal

from pyspark.sql import functions as F

from clinic_constants import AS_OF
from odonto.plans import lists, reports, views


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_billing_summary(seed):
    got = sorted(rows(views.billing_summary(seed), "bill_id", "total_amount", "paid_amount",
                      "remaining_balance", "status"))
    assert got == [(1, Decimal("4000.00"), Decimal("4000.00"), Decimal("0.00"), "PAID"),
                   (2, Decimal("3000.00"), Decimal("1500.00"), Decimal("1500.00"), "PARTIAL"),
                   (3, Decimal("3500.00"), Decimal("0.00"), Decimal("3500.00"), "UNPAID")]


def test_pending(seed):
    assert reports.pending_total(seed).first()[0] == Decimal("5000.00")
    assert [r.bill_id for r in reports.pending_payments(seed).collect()] == [3, 2]


def test_dashboard_figures(seed):
    d = reports.dashboard(seed, AS_OF).first()
    assert d.today_appointments == 2
    assert d.total_patients == 5
    assert d.pending_payments == Decimal("5000.00")
    assert d.monthly_income == Decimal("5500.00")
    assert d.recent_activity == []          # no audit rows right after the import


def test_monthly_income(seed):
    r = reports.monthly_income(seed, AS_OF.year).collect()
    assert [(x.income_month, x.payment_count, x.total_income) for x in r] == [
        (AS_OF.strftime("%Y-%m"), 2, Decimal("5500.00"))]


def test_treatment_report_order(seed):
    r = reports.treatment_report(seed).collect()
    assert [x.total_value for x in r] == [Decimal(v) for v in ("4500.00", "3500.00", "3000.00", "2500.00")]
    assert all(x.treatment_count == 1 for x in r)


def test_low_stock_first(seed):
    r = lists.medicines(seed).collect()
    assert [x.medicine_name for x in r[:2]] == ["Medicine B", "Medicine D"]
    assert [x.is_low_stock for x in r] == [True, True, False, False, False]
    assert [x.medicine_name for x in r[2:]] == sorted(x.medicine_name for x in r[2:])


def test_staff_permissions(seed):
    assert rows(lists.staff(seed), "user_id", "can_manage_billing", "can_view_reports") == [
        (2, False, True), (3, True, True)]


def test_full_history(seed):
    r = views.patient_full_history(seed, AS_OF).collect()
    assert len(r) == 5
    assert [x.treatment_id for x in r if x.patient_id == 5] == [None]


def test_first_user_per_role(seed):
    got = {r.role: r.user_id for r in lists.first_active_user_per_role(seed).collect()}
    assert got == {"OWNER": 1, "STAFF": 2, "CUSTOMER": 4}


def test_clinic_week_order(seed):
    assert [r.day_of_week for r in lists.clinic_week(seed, 1).collect()] == [
        "MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]


def test_booking_hours(spark, seed):
    from odonto.plans.jobs import book_appointments
    # 2026-12-06 is a Sunday, 2026-12-04 a Friday.
    req = spark.createDataFrame(
        [(1, 1, "OWNER", "5", "2", "2026-12-06", "10:00", "x"),
         (2, 1, "OWNER", "5", "2", "2026-12-04", "13:00", "x"),
         (3, 1, "OWNER", "5", "2", "2026-12-04", "12:59", "x")],
        "seq long, caller_id long, caller_role string, patient_id string, dentist_id string, "
        "appointment_date string, appointment_time string, problem_description string")
    out = {r.seq: (r.status_code, r.reason, r.record_code)
           for r in book_appointments(seed, req, AS_OF).outcome.collect()}
    assert out[1][:2] == (400, "Clinic is closed on the selected date")
    assert out[2][:2] == (400, "Appointment time must be between 09:00 and 13:00")
    assert out[3] == (201, None, "APT-00005")
