"""Bind the driver's TPC-H-ish tables to the clinic schemas.

This gives rows in the clinic schemas and nothing else: the read models,
reports, audits and jobs run on whatever rows these tables hold. Driver keys
start at 0, so ids add 1.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odonto.functions.exprs import code, padded
from odonto.sources.tables import conform

# Fixed opening hours of every fixture clinic (a closed day keeps its hours).
FIXTURE_WEEK = [("MONDAY", "09:00:00", "18:00:00"), ("TUESDAY", "09:00:00", "18:00:00"), ("WEDNESDAY", "09:00:00", "18:00:00"),
                ("THURSDAY", "09:00:00", "18:00:00"), ("FRIDAY", "09:00:00", "13:00:00"), ("SATURDAY", "10:00:00", "16:00:00"),
                ("SUNDAY", "09:00:00", "18:00:00")]
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def driver(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _line_rank(li: DataFrame) -> DataFrame:
    """Rank the lines of each order; (orderkey, linenumber) alone is not unique.

    The window is keyed by order, whose line count is bounded by the order
    model (a handful of lines), so no window group grows with the data.
    """
    w = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return li.withColumn("_rn", F.row_number().over(w))


def bind_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    r = lambda n: driver(spark, sf_dir, n)
    customer, supplier, nation, part = r("customer"), r("supplier"), r("nation"), r("part")
    orders, lineitem, events = r("orders"), r("lineitem"), r("events")
    n_suppliers = supplier.agg(F.count(F.lit(1))).scalar()
    n_events = events.agg(F.count(F.lit(1))).scalar()
    ck = F.col("c_custkey")

    patients = customer.select(
        (ck + 1).alias("patient_id"),
        code("patients", ck + 1).alias("patient_code"),
        F.col("c_name").alias("name"),
        F.concat(F.lit("0300-"), padded(ck, 7)).alias("phone"),
        F.when(ck % 3 == 0, "MALE").when(ck % 3 == 1, "FEMALE").otherwise("OTHER").alias("gender"),
        F.when(ck % 11 == 0, F.lit(None).cast("date"))
         .otherwise(F.date_add(F.lit(dt.date(1940, 1, 1)), (ck * 37 % 25000).cast("int")))
         .alias("date_of_birth"),
        F.col("c_mktsegment").alias("address"),
        (F.col("c_acctbal") < 0).alias("is_deleted"),
    )
    history = customer.filter(ck % 5 != 0).select(
        (ck + 1).alias("history_id"), (ck + 1).alias("patient_id"),
        F.col("c_mktsegment").alias("allergies"), F.lit("None").alias("current_medications"),
        F.lit("").alias("medical_notes"))
    sk = F.col("s_suppkey")
    dentists = supplier.join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        (sk + 1).alias("dentist_id"), code("dentists", sk + 1).alias("dentist_code"),
        F.col("s_name").alias("name"), F.col("n_name").alias("specialization"),
        (F.col("s_acctbal") >= 0).alias("is_active"))
    ek, uk = F.col("event_id"), F.col("user_id")
    appointments = events.select(
        (ek + 1).alias("appointment_id"), code("appointments", ek + 1).alias("appointment_code"),
        (uk + 1).alias("patient_id"), (uk % n_suppliers + 1).alias("dentist_id"),
        F.col("ts").cast("date").alias("appointment_date"),
        F.date_format("ts", "HH:00:00").alias("appointment_time"),
        F.when(F.col("event_type") == "purchase", "COMPLETED")
         .when(F.col("event_type") == "error", "CANCELLED").otherwise("BOOKED").alias("status"),
        F.col("event_type").alias("problem_description"),
        # One creator in 26 is no user: a foreign-key violation for the audit.
        (uk % 26 + 1).alias("created_by_user_id"))
    ranked = _line_rank(lineitem)
    ok = F.col("l_orderkey")
    treatments = (ranked.join(orders, F.col("o_orderkey") == ok)
                  .join(part, F.col("p_partkey") == F.col("l_partkey"))
                  .select((ok * 100 + F.col("_rn")).alias("treatment_id"),
                          (F.col("o_custkey") + 1).alias("patient_id"),
                          (F.col("l_suppkey") + 1).alias("dentist_id"),
                          F.when(F.col("l_linenumber") == 1, ok % n_events + 1).alias("appointment_id"),
                          F.col("p_name").alias("treatment_name"),
                          F.col("l_extendedprice").cast("decimal(10,2)").alias("cost"),
                          F.col("l_shipdate").cast("date").alias("treatment_date"),
                          F.when(F.col("l_linestatus") == "F", "DONE").otherwise("PLANNED").alias("status")))
    subtotal = F.col("o_totalprice").cast("decimal(10,2)")
    discount = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(500).cast("decimal(10,2)")) \
        .otherwise(F.lit(0).cast("decimal(10,2)"))
    bills = orders.select(
        (F.col("o_orderkey") + 1).alias("bill_id"), code("bills", F.col("o_orderkey") + 1).alias("bill_code"),
        (F.col("o_custkey") + 1).alias("patient_id"), F.lit(None).cast("long").alias("treatment_id"),
        F.col("o_orderdate").cast("date").alias("bill_date"), subtotal.alias("subtotal"),
        discount.alias("discount_amount"), (subtotal - discount).cast("decimal(10,2)").alias("total_amount"),
        F.when(F.col("o_orderstatus") == "F", "PAID").when(F.col("o_orderstatus") == "P", "PARTIAL")
         .otherwise("UNPAID").alias("status"),
        (F.col("o_custkey") % 25 + 1).alias("created_by_user_id"))
    payments = ranked.select(
        (ok * 100 + F.col("_rn")).alias("payment_id"), (ok + 1).alias("bill_id"),
        F.col("l_extendedprice").cast("decimal(10,2)").alias("paid_amount"),
        F.col("l_shipdate").cast("date").alias("payment_date"),
        F.when(F.col("l_returnflag") == "A", "CASH").when(F.col("l_returnflag") == "R", "CARD")
         .when(F.col("l_linenumber") == 7, "CHEQUE")      # outside the domain, for the audit
         .otherwise("BANK_TRANSFER").alias("payment_method"))
    pk = F.col("p_partkey")
    medicines = part.select(
        (pk + 1).alias("medicine_id"), F.col("p_name").alias("medicine_name"),
        # Some batches are missing and some stocks negative, for the audits.
        F.when(pk % 97 != 0, F.col("p_brand")).alias("batch_no"), (F.col("p_size") - 3).alias("quantity"),
        F.lit(10).alias("low_stock_limit"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), (pk % 720).cast("int")).alias("expiry_date"))
    audit_logs = events.select(
        (ek + 1).alias("log_id"), F.upper("event_type").alias("action_type"),
        F.lit("events").alias("table_name"), (uk + 1).alias("record_id"),
        F.col("ts").cast("timestamp").alias("created_at"))
    nk = F.col("n_nationkey")
    users = nation.select(
        (nk + 1).alias("user_id"), F.col("n_name").alias("full_name"),
        F.concat(F.lower("n_name"), F.lit("@clinic.test")).alias("email"),
        F.when(nk == 0, "OWNER").when(nk % 5 == 4, "CUSTOMER").otherwise("STAFF").alias("role"),
        (nk % 7 != 1).alias("is_active"))
    staff_permissions = nation.filter((nk % 2 == 0) & (nk != 0) & (nk % 5 != 4)).select(
        (nk + 1).alias("permission_id"), (nk + 1).alias("staff_user_id"),
        (F.col("n_regionkey") < 2).alias("can_manage_billing"),
        (F.col("n_regionkey") != 3).alias("can_view_reports"))
    # One clinic per nation, each with the fixed week of the fixture.
    week = F.array(*[F.struct(F.lit(i).alias("day"), F.lit(name).alias("day_of_week"), F.lit(o).alias("opening_time"),
                              F.lit(c).alias("closing_time"), F.lit(name == "SUNDAY").alias("is_closed"))
                     for i, (name, o, c) in enumerate(FIXTURE_WEEK, start=1)])
    clinic_timings = (nation.select((nk + 1).alias("clinic_id"), F.explode(week).alias("w"))
                      .select(((F.col("clinic_id") - 1) * 7 + F.col("w.day")).alias("timing_id"), "clinic_id", "w.day_of_week",
                              "w.opening_time", "w.closing_time", "w.is_closed"))
    clinic = nation.select((nk + 1).alias("clinic_id"), F.concat(F.lit("Clinic "), F.col("n_name")).alias("clinic_name"),
                           F.lit("Main Road").alias("address"), F.concat(F.lit("0300-"), padded(nk, 7)).alias("phone"),
                           F.concat(F.lit("92"), padded(nk, 10)).alias("whatsapp_number"))

    frames = {
        "users": users, "staff_permissions": staff_permissions, "clinic": clinic,
        "clinic_timings": clinic_timings, "patients": patients, "patient_medical_history": history,
        "dentists": dentists, "appointments": appointments, "treatments": treatments, "bills": bills,
        "payments": payments, "medicines": medicines, "audit_logs": audit_logs,
    }
    return {k: conform(v, k) for k, v in frames.items()}
