"""Reports and dashboard metrics R1-R11."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import age, as_date, month_range, year_range
from odonto.plans.views import appointment_details, billing_summary, live_patients

def _zero():
    return F.lit(0).cast("decimal(20,2)")


def _date(d) -> dt.date:
    return dt.date.fromisoformat(d) if isinstance(d, str) else d


def today_appointments(t, as_of) -> DataFrame:
    """Non-cancelled appointments on ``as_of`` (raw table, deleted patients count)."""
    return (t.appointments
            .filter((F.col("appointment_date") == as_date(as_of)) & (F.col("status") != "CANCELLED"))
            .agg(F.count(F.lit(1)).alias("today_appointments")))


def total_patients(t) -> DataFrame:
    """R2: live patient count."""
    return live_patients(t).agg(F.count(F.lit(1)).alias("total_patients"))


def pending_total(t) -> DataFrame:
    """Outstanding amount over bills with a positive balance, 0 if none."""
    return (billing_summary(t).filter(F.col("remaining_balance") > 0)
            .agg(F.coalesce(F.sum("remaining_balance"), _zero()).alias("pending_payments")))


def monthly_income_now(t, as_of) -> DataFrame:
    """Payments received in the month of ``as_of``, 0 if none.

    The year/month test is a date range so the scan can prune on it.
    """
    d = _date(as_of)
    return (t.payments.filter(month_range("payment_date", d.year, d.month))
            .agg(F.coalesce(F.sum("paid_amount"), _zero()).alias("monthly_income")))


def recent_activity(t, n: int = 8) -> DataFrame:
    """The ``n`` latest audit rows (log id breaks timestamp ties)."""
    return (t.audit_logs.select("log_id", "action_type", "table_name", "record_id", "created_at")
            .orderBy(F.col("created_at").desc_nulls_last(), F.col("log_id").desc())
            .limit(n))


def dashboard(t, as_of, n: int = 8) -> DataFrame:
    """The dashboard in one row: four figures and the latest ``n`` audit rows.

    Each figure is a scalar subquery of a one-row frame, so the five reads are
    one plan (one snapshot). The recent rows come as an ordered array of at
    most ``n`` structs, collected after the top-``n`` limit.
    """
    d = _date(as_of)
    recent = recent_activity(t, n)
    recent_arr = recent.agg(F.sort_array(F.collect_list(F.struct(
        F.col("created_at").isNull().alias("_nulls_last"),
        (-F.unix_micros(F.col("created_at"))).alias("_newest_first"),
        (-F.col("log_id")).alias("_id_desc"),
        "log_id", "action_type", "table_name", "record_id", "created_at")))
        .alias("a")).select(F.transform("a", lambda s: s.dropFields(
            "_nulls_last", "_newest_first", "_id_desc")).alias("recent_activity"))
    return t.spark.range(1).select(
        today_appointments(t, d).scalar().alias("today_appointments"),
        total_patients(t).scalar().alias("total_patients"),
        pending_total(t).scalar().alias("pending_payments"),
        monthly_income_now(t, d).scalar().alias("monthly_income"),
        recent_arr.scalar().alias("recent_activity"))


def daily_report(t, date) -> DataFrame:
    """The day's appointments by time, six columns (cancelled kept)."""
    return (appointment_details(t).filter(F.col("appointment_date") == as_date(date))
            .select("appointment_code", "patient_name", "patient_phone", "dentist_name",
                    "appointment_time", "status")
            .orderBy("appointment_time", "appointment_code"))


def monthly_income(t, year: int) -> DataFrame:
    """Payment count and income per month of ``year``, HAVING income >= 0."""
    return (t.payments.filter(year_range("payment_date", year))
            .groupBy(F.date_format("payment_date", "yyyy-MM").alias("income_month"))
            .agg(F.count(F.lit(1)).alias("payment_count"), F.sum("paid_amount").alias("total_income"))
            .filter(F.col("total_income") >= 0)
            .orderBy("income_month"))


def pending_payments(t) -> DataFrame:
    """Bills with a positive balance, largest balance first (bill id breaks ties)."""
    return (billing_summary(t).filter(F.col("remaining_balance") > 0)
            .orderBy(F.col("remaining_balance").desc(), F.col("bill_id")))


def treatment_report(t, with_lowest: bool = False) -> DataFrame:
    """Per treatment name: count, total, average and highest cost.

    Only treatments of live patients; HAVING count >= 1; by total value. Names
    that differ in case only are one group, as under the reference's collation.
    ``with_lowest`` adds the lowest cost (MIN) as a fifth aggregate.
    """
    tr = t.treatments.select("patient_id", "treatment_name", "cost")
    live = live_patients(t).select("patient_id")
    return (tr.join(live, "patient_id", "left_semi")
            .groupBy(F.lower("treatment_name").alias("_name"))
            .agg(F.min("treatment_name").alias("treatment_name"), F.count(F.lit(1)).alias("treatment_count"), F.sum("cost").alias("total_value"),
                 F.avg("cost").alias("average_cost"), F.max("cost").alias("highest_cost"),
                 *([F.min("cost").alias("lowest_cost")] if with_lowest else []))
            .filter(F.col("treatment_count") >= 1).drop("_name")
            .orderBy(F.col("total_value").desc(), F.col("treatment_name")))


def patient_list(t, as_of) -> DataFrame:
    """Live patients with age in completed years, by name."""
    return (live_patients(t)
            .select("patient_code", "name", "phone", "gender", age("date_of_birth", as_of).alias("age"))
            .orderBy("name", "patient_code"))
