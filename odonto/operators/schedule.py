"""Clinic-hours check (J5 / VL5) and slot conflicts (J6) for booking requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odonto.functions.exprs import hhmm, weekday_name

# Fixed reason texts of the booking checks.
MSG_CLOSED = "Clinic is closed on the selected date"
MSG_SLOT_TAKEN = "This dentist already has an appointment in this slot"
MSG_DUPLICATE = "Duplicate entry. This record already exists or the appointment slot is booked."


def day_hours(t, clinic_id: int = 1) -> DataFrame:
    """The clinic's timetable, one row per weekday (the lowest timing id)."""
    return (t.clinic_timings.filter(F.col("clinic_id") == clinic_id)
            .groupBy(F.col("day_of_week").alias("_dow"))
            .agg(F.min_by(F.struct("opening_time", "closing_time", "is_closed"), "timing_id").alias("_t"))
            .select("_dow", F.col("_t.opening_time").alias("_open"), F.col("_t.closing_time").alias("_close"),
                    F.col("_t.is_closed").alias("_closed")))


def with_clinic_hours(t, df: DataFrame, date_col: str, time_col: str, clinic_id: int = 1) -> DataFrame:
    """Add ``hours_ok`` and ``hours_reason`` for (date text, 'HH:mm:ss' time).

    The weekday of the date is looked up in the clinic's timetable, reduced to
    one row per weekday (the lowest timing id) so that it can't multiply
    requests; an unreadable date finds no weekday and so counts as closed. Opening hours are half-open: [opening, closing).
    """
    ct = day_hours(t, clinic_id)
    d = df.withColumn("_dow", weekday_name(F.col(date_col).try_cast("date")))
    j = d.join(ct, "_dow", "left")
    tm = F.col(time_col)
    closed = F.col("_open").isNull() | F.coalesce(F.col("_closed"), F.lit(True))
    outside = (tm < F.col("_open")) | (tm >= F.col("_close"))
    reason = (F.when(closed, F.lit(MSG_CLOSED))
              .when(outside, F.concat(F.lit("Appointment time must be between "), hhmm(F.col("_open")),
                                      F.lit(" and "), hhmm(F.col("_close")))))
    return (j.withColumn("hours_ok", reason.isNull()).withColumn("hours_reason", reason)
            .drop("_dow", "_open", "_close", "_closed"))


def slot_flags(existing: DataFrame, req: DataFrame, keys=("dentist_id", "appointment_date", "appointment_time"),
               ) -> DataFrame:
    """Add ``slot_live`` (a non-cancelled appointment holds the slot) and
    ``slot_any`` (any appointment, cancelled included, holds it).

    Only appointments in slots that the batch asks for are grouped, one row
    per slot; the requests join them on the three-column key.
    """
    asked = req.select(*keys).distinct()
    used = existing.join(asked, list(keys), "left_semi").groupBy(*keys).agg(
        F.max(F.col("status") != "CANCELLED").alias("slot_live"), F.lit(True).alias("slot_any"))
    return (req.join(used, list(keys), "left")
            .withColumn("slot_live", F.coalesce("slot_live", F.lit(False)))
            .withColumn("slot_any", F.coalesce("slot_any", F.lit(False))))


def winners(cands: DataFrame, keys=("dentist_id", "appointment_date", "appointment_time"),
            order_col: str = "seq") -> DataFrame:
    """Add ``slot_winner``: true for the lowest ``order_col`` of each slot.

    A grouped min (partially aggregated map-side) joined back, rather than a
    window, so a slot wanted by a third of all requests is not buffered in
    one task; AQE can split that hot key in the join.
    """
    mins = cands.groupBy(*keys).agg(F.min(order_col).alias("_min_seq"))
    return (cands.join(mins, list(keys))
            .withColumn("slot_winner", F.col(order_col) == F.col("_min_seq")).drop("_min_seq"))
