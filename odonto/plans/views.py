"""Read-model views V1-V4."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import age, as_date


def live_patients(t) -> DataFrame:
    return t.patients.filter(~F.col("is_deleted"))


def patient_full_history(t, as_of) -> DataFrame:
    """V1: every live patient with history, treatments, dentist and appointment code.

    One row per (patient, treatment); a patient without treatments keeps one
    row with NULL treatment columns.
    """
    p = live_patients(t).select("patient_id", "patient_code", F.col("name").alias("patient_name"),
                                "phone", "gender", "date_of_birth")
    mh = t.patient_medical_history.select("patient_id", "allergies", "current_medications",
                                          "medical_notes")
    tr = t.treatments.select("treatment_id", "patient_id", "dentist_id", "appointment_id",
                             "treatment_name", "treatment_date", "cost")
    d = t.dentists.select("dentist_id", F.col("name").alias("dentist_name"))
    a = t.appointments.select("appointment_id", "appointment_code")
    out = (p.join(mh, "patient_id", "left")
           .join(tr, "patient_id", "left")
           .join(d, "dentist_id", "left")
           .join(a, "appointment_id", "left"))
    return out.select(
        "patient_id", "patient_code", "patient_name", "phone", "gender",
        age("date_of_birth", as_of).alias("age"),
        "allergies", "current_medications", "medical_notes",
        "treatment_id", "treatment_name", "treatment_date", "cost",
        "dentist_name", "appointment_code")


def appointment_details(t) -> DataFrame:
    """V2: appointments with patient and dentist names; deleted patients dropped."""
    a = t.appointments.select("appointment_id", "appointment_code", "patient_id", "dentist_id",
                              "appointment_date", "appointment_time", "status", "problem_description")
    p = live_patients(t).select("patient_id", "patient_code", F.col("name").alias("patient_name"),
                                F.col("phone").alias("patient_phone"))
    d = t.dentists.select("dentist_id", "dentist_code", F.col("name").alias("dentist_name"),
                          "specialization")
    out = a.join(p, "patient_id").join(d, "dentist_id")
    return out.select(
        "appointment_id", "appointment_code", "patient_id", "dentist_id", "appointment_date",
        "appointment_time", "status", "problem_description", "patient_code", "patient_name",
        "patient_phone", "dentist_code", "dentist_name", "specialization")


def paid_per_bill(t) -> DataFrame:
    """Sum of payments per bill: partial aggregation map-side, one row per bill out."""
    return t.payments.groupBy("bill_id").agg(F.sum("paid_amount").alias("paid_sum"),
                                             F.count(F.lit(1)).alias("payment_count"))


def billing_summary(t) -> DataFrame:
    """V3: each bill of a known patient with paid amount and remaining balance.

    Soft-deleted patients are kept. Payments are summed per bill before the
    join, so the join carries one row per bill instead of one per payment and
    the group-by never spans the eleven descriptive columns.
    """
    b = t.bills.select("bill_id", "bill_code", "patient_id", "treatment_id", "bill_date", "subtotal",
                       "discount_amount", "total_amount", "status")
    p = t.patients.select("patient_id", "patient_code", F.col("name").alias("patient_name"))
    paid = F.coalesce(F.col("paid_sum"), F.lit(0).cast("decimal(20,2)"))
    out = b.join(paid_per_bill(t).select("bill_id", "paid_sum"), "bill_id", "left").join(p, "patient_id")
    return out.select(
        "bill_id", "bill_code", "patient_id", "patient_code", "patient_name", "treatment_id",
        "bill_date", "subtotal", "discount_amount", "total_amount",
        paid.alias("paid_amount"), (F.col("total_amount") - paid).alias("remaining_balance"),
        "status")


def daily_appointments(t, as_of) -> DataFrame:
    """V4: appointment details on the ``as_of`` date."""
    return appointment_details(t).filter(F.col("appointment_date") == as_date(as_of))
