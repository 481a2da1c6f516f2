"""Stored procedures as parametrised Spark SQL over the registered views (F8).

``Clinic.register_views`` must have run on the session: the SQL reads the
table views and the read-model views by name, and parameters are bound by
``spark.sql(query, args=...)``, never spliced into the text.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from odonto.functions.exprs import substring_pattern


def search_patient(t, text: str, prefix: str = "") -> DataFrame:
    """Q3 by SQL: live patients with code, name or phone like the parameter."""
    t.register_views(prefix)
    return t.spark.sql(f"""
        SELECT patient_id, patient_code, name, phone, email, gender
        FROM {prefix}patients
        WHERE is_deleted = FALSE AND (patient_code ILIKE :pattern OR name ILIKE :pattern OR phone ILIKE :pattern)
        ORDER BY name, patient_id""", args={"pattern": substring_pattern(text)})


def daily_appointment_report(t, date, prefix: str = "") -> DataFrame:
    """R7 by SQL: the day's appointments by time (view over view)."""
    t.register_views(prefix)
    day = dt.date.fromisoformat(date) if isinstance(date, str) else date
    return t.spark.sql(f"""
        SELECT appointment_code, patient_name, patient_phone, dentist_name, appointment_time, status
        FROM {prefix}appointment_details_view
        WHERE appointment_date = :day
        ORDER BY appointment_time, appointment_code""", args={"day": day})
