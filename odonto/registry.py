"""Registered queries: one callable per key, each taking (spark, sf_dir).

Every query binds the driver's tables in ``sf_dir`` to the clinic schemas and
runs the library's own plan over all their rows. Amounts leave as DOUBLE
(the wire format); everything inside stays DECIMAL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.functions.exprs import to_double_edge
from odonto.plans import lists, reports, views
from odonto.sources.bind import driver
from odonto.sources.tables import Clinic

# Parameters of the registered queries (see FIXTURES.md).
AS_OF = dt.date(2024, 1, 15)          # appointment keys (events span 2024-01-01..30)
INCOME_YEAR = 1998                    # income keys (payments span 1995..2001)
INCOME_AS_OF = dt.date(1998, 6, 15)   # "this month" for the dashboard income figure
SEARCH = "00012"
PAGE_OFFSET, PAGE_SIZE = 100, 50
BILL_STATUS = "partial"
OWNER_CALLER = (1, "owner")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

_BOUND: dict[tuple[str, str], Clinic] = {}


def bound(spark: SparkSession, sf_dir: str) -> Clinic:
    """The driver tables bound to the clinic schemas, built once per
    application and directory. Only the (lazy) plans are reused: every query
    still reads the tables when it runs."""
    key = (spark.sparkContext.applicationId, sf_dir)
    t = _BOUND.get(key)
    if t is None or t.spark is not spark:
        t = _BOUND[key] = Clinic.from_driver(spark, sf_dir)
    return t


def register(name: str):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return to_double_edge(fn(bound(spark, sf_dir), spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# --- views ---------------------------------------------------------------
@register("patient_full_history")
def _q(t, spark, d):
    return views.patient_full_history(t, AS_OF)


@register("appointment_details")
def _q(t, spark, d):
    return views.appointment_details(t)


@register("billing_summary")
def _q(t, spark, d):
    return views.billing_summary(t)


@register("daily_appointments")
def _q(t, spark, d):
    return views.daily_appointments(t, AS_OF)


# --- lists ---------------------------------------------------------------
@register("patients_search")
def _q(t, spark, d):
    return lists.patients(t, SEARCH)


@register("patients_all")
def _q(t, spark, d):
    return lists.patients(t)


@register("patients_by_id")
def _q(t, spark, d):
    keys = driver(spark, d, "events").select((F.col("user_id") + 1).alias("patient_id"))
    return lists.patients_by_id(t, keys)


@register("search_patient")
def _q(t, spark, d):
    return lists.search_patient(t, SEARCH)


@register("dentists_list")
def _q(t, spark, d):
    return lists.dentists(t)


@register("bookable_dentists")
def _q(t, spark, d):
    return lists.bookable_dentists(t)


@register("appointments_filtered")
def _q(t, spark, d):
    return lists.appointments(t, date=AS_OF, status="booked")


@register("appointments_by_dentist")
def _q(t, spark, d):
    return lists.appointments(t, dentist_id=7)


@register("treatments_list")
def _q(t, spark, d):
    return lists.treatments(t)


@register("bills_by_status")
def _q(t, spark, d):
    return lists.bills(t, BILL_STATUS, caller=OWNER_CALLER)


@register("payable_bills")
def _q(t, spark, d):
    return lists.payable_bills(t)


@register("medicines_low_stock")
def _q(t, spark, d):
    return lists.medicines(t)


@register("staff_permissions")
def _q(t, spark, d):
    return lists.staff(t)


@register("clinic_profile")
def _q(t, spark, d):
    return lists.clinic_profile(t)


@register("clinic_week")
def _q(t, spark, d):
    return lists.clinic_week(t, 1)


@register("first_active_user_per_role")
def _q(t, spark, d):
    return lists.first_active_user_per_role(t)


@register("hours_for_dates")
def _q(t, spark, d):
    dates = t.appointments.select(F.col("appointment_date").alias("date")).distinct()
    return lists.hours_for_dates(t, dates, "date", clinic_id=1)


@register("dentists_right_join")
def _q(t, spark, d):
    return lists.dentists_with_appointments(t)


@register("patients_page")
def _q(t, spark, d):
    return lists.patients_page(t, PAGE_OFFSET, PAGE_SIZE)


# --- reports -------------------------------------------------------------
@register("today_appointments")
def _q(t, spark, d):
    return reports.today_appointments(t, AS_OF)


@register("total_patients")
def _q(t, spark, d):
    return reports.total_patients(t)


@register("pending_total")
def _q(t, spark, d):
    return reports.pending_total(t)


@register("monthly_income_now")
def _q(t, spark, d):
    return reports.monthly_income_now(t, INCOME_AS_OF)


@register("recent_activity")
def _q(t, spark, d):
    return reports.recent_activity(t, 8)


@register("dashboard")
def _q(t, spark, d):
    db = reports.dashboard(t, AS_OF, 8)
    return db.select("today_appointments", "total_patients", "pending_payments", "monthly_income",
                     F.concat_ws(" ", F.transform("recent_activity", lambda x: F.concat_ws(":", x["log_id"], x["action_type"], x["record_id"])))
                     .alias("recent"))


@register("daily_report")
def _q(t, spark, d):
    return reports.daily_report(t, AS_OF)


@register("monthly_income")
def _q(t, spark, d):
    return reports.monthly_income(t, INCOME_YEAR)


@register("pending_payments")
def _q(t, spark, d):
    return reports.pending_payments(t)


@register("treatment_report")
def _q(t, spark, d):
    return reports.treatment_report(t)


@register("treatment_report_min")
def _q(t, spark, d):
    return reports.treatment_report(t, with_lowest=True)


@register("patient_list")
def _q(t, spark, d):
    return reports.patient_list(t, AS_OF)


def load_all() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Import every module that registers queries, then return the registry."""
    import odonto.registry_more  # noqa: F401
    return dict(QUERIES)
