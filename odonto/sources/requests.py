"""Request batches: read from JSON, or derived from the driver's tables.

A request batch is one row per API call: ``seq`` (arrival order), the
caller headers ``caller_id`` / ``caller_role`` and the body fields as text.
For patch requests a ``has_<field>`` flag tells an absent field from a
JSON ``null`` (the first is not touched, the second is written as '').

The builders below only project driver rows onto that shape;
all validation and application is done by the jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odonto.functions.exprs import padded
from odonto.sources.bind import _line_rank, driver


def read_requests(spark: SparkSession, path: str, fields: list[str], streaming: bool = False,
                  files_per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines request bodies -> one row per request with text fields.

    Each line is an object with ``seq``, optional ``caller_id`` /
    ``caller_role`` and body fields. Field values are kept as text whatever
    their JSON type; ``has_<field>`` records whether the key was present. As a
    stream, a trigger takes as much as one of the two bounds allows, or all.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif streaming and bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    raw = reader.text(path).select(F.col("value").alias("_j"))
    keys = F.json_object_keys("_j")
    cols = [F.get_json_object("_j", "$.seq").try_cast("long").alias("seq"),
            F.get_json_object("_j", "$.caller_id").alias("caller_id"),
            F.get_json_object("_j", "$.caller_role").alias("caller_role")]
    for f in fields:
        cols.append(F.get_json_object("_j", f"$.{f}").alias(f))
        cols.append(F.coalesce(F.array_contains(keys, f), F.lit(False)).alias(f"has_{f}"))
    return raw.select(*cols)


def cents_text(x):
    """Non-negative amount as 'units.cc' text, truncated to the cent (exact in
    any engine, unlike rounding a binary double at a half-cent tie)."""
    c = F.floor(x * 100).cast("long")
    return F.concat((c / 100).cast("long").cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def _n_suppliers(spark, sf_dir):
    return driver(spark, sf_dir, "supplier").agg(F.count(F.lit(1))).scalar()


def booking_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks for a booking one week after it, on the hour, with the
    patient and dentist of the event."""
    ev = driver(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 25 + 1).alias("caller_id"),
        F.lit("STAFF").alias("caller_role"),
        (F.col("user_id") + 1).cast("string").alias("patient_id"),
        (F.col("user_id") % _n_suppliers(spark, sf_dir) + 1).cast("string").alias("dentist_id"),
        F.date_format(F.date_add(F.col("ts").cast("date"), 7), "yyyy-MM-dd").alias("appointment_date"),
        F.date_format("ts", "HH:00").alias("appointment_time"),
        F.col("event_type").alias("problem_description"))


def bill_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for a bill for its customer; the caller's role comes
    from the order priority and the discount from the order key."""
    o = driver(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    role = (F.when(F.col("o_orderpriority") == "1-URGENT", "OWNER")
            .when(F.col("o_orderpriority") == "2-HIGH", "staff")
            .when(F.col("o_orderpriority") == "5-LOW", "CUSTOMER").otherwise("STAFF"))
    return o.select(
        ok.alias("seq"), (F.col("o_custkey") % 25 + 1).alias("caller_id"), role.alias("caller_role"),
        (F.col("o_custkey") + 1).cast("string").alias("patient_id"),
        F.when(ok % 3 == 0, (ok * 100 + 1).cast("string")).when(ok % 3 == 1, F.lit(""))
         .otherwise((ok * 100 + 9).cast("string")).alias("treatment_id"),
        F.col("o_totalprice").cast("decimal(12,2)").cast("string").alias("subtotal"),
        cents_text(F.col("o_totalprice") * (ok % 7) / 5).alias("discount_amount"))


def payment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line item pays its order's bill: the discount part of its price."""
    li = _line_rank(driver(spark, sf_dir, "lineitem"))
    method = (F.when(F.col("l_returnflag") == "A", "cash").when(F.col("l_returnflag") == "R", "Card")
              .otherwise("cheque"))
    role = F.when(F.col("l_linestatus") == "O", "OWNER").otherwise("STAFF")
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("_rn")).alias("seq"),
        (F.col("l_suppkey") % 25 + 1).alias("caller_id"), role.alias("caller_role"),
        (F.col("l_orderkey") + 1).cast("string").alias("bill_id"),
        cents_text(F.col("l_extendedprice") * F.col("l_discount")).alias("paid_amount"),
        method.alias("payment_method"), F.lit(None).cast(T.StringType()).alias("notes"))


def _n_events(spark, sf_dir):
    return driver(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar()


def patient_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer asks to be registered as a patient."""
    c = driver(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    return c.select(
        ck.alias("seq"),
        F.when(F.col("c_acctbal") < -900, F.lit(" ")).otherwise(F.col("c_name")).alias("name"),
        F.when(ck % 13 == 0, F.lit("12345")).otherwise(F.concat(F.lit("0300-"), padded(ck, 7)))
         .alias("phone"),
        F.lit(None).cast("string").alias("email"),
        F.when(ck % 4 == 0, "male").when(ck % 4 == 1, "Female").when(ck % 4 == 2, "").otherwise("x").alias("gender"),
        F.when(ck % 17 == 0, F.lit("1990-02-30"))
         .otherwise(F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (ck * 13 % 20000).cast("int")),
                                  "yyyy-MM-dd")).alias("date_of_birth"),
        F.col("c_mktsegment").alias("address"), F.col("c_mktsegment").alias("allergies"),
        F.lit(None).cast("string").alias("current_medications"), F.lit("").alias("medical_notes"))


def patient_patch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order patches its customer's patient record; which fields it
    carries depends on the order key (several patches hit one patient)."""
    o = driver(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    return o.select(
        ok.alias("seq"), (F.col("o_custkey") + 1).cast("string").alias("patient_id"),
        F.concat(F.lit("Patient "), ok.cast("string")).alias("name"), (ok % 5 == 0).alias("has_name"),
        ok.cast("string").alias("phone"), (ok % 7 == 0).alias("has_phone"),
        F.lit(None).cast("string").alias("email"), F.lit(False).alias("has_email"),
        F.when(F.col("o_orderstatus") == "F", "female").when(F.col("o_orderstatus") == "O", "male")
         .otherwise("unknown").alias("gender"), (ok % 11 == 0).alias("has_gender"),
        F.lit(None).cast("string").alias("date_of_birth"), F.lit(False).alias("has_date_of_birth"),
        F.col("o_orderpriority").alias("address"), (ok % 3 == 0).alias("has_address"),
        F.lit("None").alias("allergies"), (ok % 4 == 0).alias("has_allergies"),
        F.lit(None).cast("string").alias("current_medications"), F.lit(False).alias("has_current_medications"),
        F.lit(None).cast("string").alias("medical_notes"), F.lit(False).alias("has_medical_notes"))


def patient_delete_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks to soft-delete its customer's patient record."""
    o = driver(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") + 1).cast("string").alias("patient_id"))


def dentist_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = driver(spark, sf_dir, "supplier")
    sk = F.col("s_suppkey")
    return s.select(sk.alias("seq"), F.col("s_name").alias("name"),
                    F.concat(F.lit("0304-"), padded(sk, 7)).alias("phone"),
                    F.lit(None).cast("string").alias("email"),
                    F.when(F.col("s_acctbal") < 0, F.lit("")).otherwise(F.lit("General Dentistry"))
                    .alias("specialization"))


def dentist_patch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = driver(spark, sf_dir, "supplier")
    nk = F.col("s_nationkey")
    return s.select(
        F.col("s_suppkey").alias("seq"), (F.col("s_suppkey") + 1).cast("string").alias("dentist_id"),
        F.upper("s_name").alias("name"), (nk % 3 == 0).alias("has_name"),
        F.lit(None).cast("string").alias("phone"), F.lit(False).alias("has_phone"),
        F.lit(None).cast("string").alias("email"), F.lit(False).alias("has_email"),
        F.lit(None).cast("string").alias("specialization"), (nk % 5 == 4).alias("has_specialization"),
        F.when(F.col("s_acctbal") > 0, "true").otherwise("false").alias("is_active"), (nk % 2 == 0).alias("has_is_active"))


def appointment_patch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event patches an appointment: status, time or date by event type."""
    e = driver(spark, sf_dir, "events")
    et = F.col("event_type")
    none = F.lit(None).cast("string")
    return e.select(
        F.col("event_id").alias("seq"),
        ((F.col("event_id") * 7) % _n_events(spark, sf_dir) + 1).cast("string").alias("appointment_id"),
        none.alias("patient_id"), F.lit(False).alias("has_patient_id"),
        none.alias("dentist_id"), F.lit(False).alias("has_dentist_id"),
        F.date_format(F.date_add(F.col("ts").cast("date"), 1), "yyyy-MM-dd").alias("appointment_date"),
        (et == "signup").alias("has_appointment_date"),
        F.date_format("ts", "HH:30").alias("appointment_time"), (et == "click").alias("has_appointment_time"),
        F.when(et == "purchase", "completed").when(et == "error", "cancelled").otherwise("pending").alias("status"),
        et.isin("purchase", "error", "view").alias("has_status"),
        none.alias("problem_description"), F.lit(False).alias("has_problem_description"))


def appointment_cancel_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = driver(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"),
                    ((F.col("event_id") * 31) % _n_events(spark, sf_dir) + 1).cast("string").alias("appointment_id"))


def appointment_change_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event changes one appointment in three, so that an appointment gets
    several changes: a cancellation, a time, a date, both, or a status."""
    e = driver(spark, sf_dir, "events")
    et = F.col("event_type")
    none = F.lit(None).cast("string")
    third = F.greatest(F.floor(_n_events(spark, sf_dir) / 3), F.lit(1))
    return e.select(
        F.col("event_id").alias("seq"), F.when(et == "view", "cancel").otherwise("patch").alias("op"),
        ((F.col("event_id") * 7) % third * 3 + 1).cast("string").alias("appointment_id"),
        none.alias("patient_id"), F.lit(False).alias("has_patient_id"),
        none.alias("dentist_id"), F.lit(False).alias("has_dentist_id"),
        F.date_format(F.date_add(F.col("ts").cast("date"), 1), "yyyy-MM-dd").alias("appointment_date"),
        et.isin("signup", "purchase").alias("has_appointment_date"),
        F.date_format("ts", "HH:00").alias("appointment_time"), et.isin("click", "purchase").alias("has_appointment_time"),
        F.lit("booked").alias("status"), (et == "error").alias("has_status"),
        none.alias("problem_description"), F.lit(False).alias("has_problem_description"))


def treatment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _line_rank(driver(spark, sf_dir, "lineitem"))
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("_rn")).alias("seq"),
        (F.col("l_partkey") + 1).cast("string").alias("patient_id"),
        (F.col("l_suppkey") + 1).cast("string").alias("dentist_id"),
        F.when(F.col("l_linenumber") == 1, (F.col("l_orderkey") + 1).cast("string")).otherwise(F.lit(""))
         .alias("appointment_id"),
        F.concat(F.lit("Procedure "), F.col("l_returnflag"), F.col("l_linestatus")).alias("treatment_name"),
        F.lit(None).cast("string").alias("notes"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("cost"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("treatment_date"),
        F.when(F.col("l_linestatus") == "F", "done").otherwise("planned").alias("status"))


def treatment_patch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = driver(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    none = F.lit(None).cast("string")
    return o.select(
        ok.alias("seq"), (ok * 100 + 1).cast("string").alias("treatment_id"),
        none.alias("treatment_name"), F.lit(False).alias("has_treatment_name"),
        none.alias("notes"), F.lit(False).alias("has_notes"),
        cents_text(F.col("o_totalprice") / 100).alias("cost"), (ok % 2 == 0).alias("has_cost"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("treatment_date"), (ok % 5 == 0).alias("has_treatment_date"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "planned")
         .otherwise("paused").alias("status"), (ok % 3 == 0).alias("has_status"))


def medicine_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = driver(spark, sf_dir, "part")
    pk = F.col("p_partkey")
    return p.select(
        pk.alias("seq"), F.col("p_name").alias("medicine_name"), F.col("p_brand").alias("batch_no"),
        (F.col("p_size") - 5).cast("string").alias("quantity"),
        F.when(F.col("p_size") % 4 == 0, F.lit("0")).otherwise((F.col("p_size") % 20).cast("string"))
         .alias("low_stock_limit"),
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (pk % 720).cast("int")), "yyyy-MM-dd")
         .alias("expiry_date"))


def medicine_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as the JSON line of a new medicine: limits come as a number, a
    text or a boolean, some quantities as null; in every fifty lines one is cut
    off and one is a list."""
    pk, size = F.col("p_partkey"), F.col("p_size")
    limit = (F.when(size % 4 == 0, "0").when(size % 4 == 1, '"0"').when(size % 4 == 2, "true")
             .otherwise((size % 20).cast("string")))
    named = F.to_json(F.struct(
        pk.alias("seq"), F.col("p_name").alias("medicine_name"), F.col("p_brand").alias("batch_no"),
        F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (pk % 720).cast("int")), "yyyy-MM-dd").alias("expiry_date")))
    body = F.concat(F.rtrim(named, F.lit("}")), F.lit(',"quantity":'),
                    F.when(pk % 10 == 0, "null").otherwise((size - 5).cast("string")),
                    F.lit(',"low_stock_limit":'), limit)
    return driver(spark, sf_dir, "part").select(
        F.when(pk % 50 == 7, body).when(pk % 50 == 9, F.concat(F.lit("["), body, F.lit("}]")))
        .otherwise(F.concat(body, F.lit("}"))).alias("value"))


def medicine_patch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = _line_rank(driver(spark, sf_dir, "lineitem"))
    none = F.lit(None).cast("string")
    return li.select(
        (F.col("l_orderkey") * 100 + F.col("_rn")).alias("seq"),
        (F.col("l_partkey") + 1).cast("string").alias("medicine_id"),
        none.alias("medicine_name"), F.lit(False).alias("has_medicine_name"),
        none.alias("batch_no"), F.lit(False).alias("has_batch_no"),
        (F.col("l_quantity").cast("int") - 3).cast("string").alias("quantity"), F.lit(True).alias("has_quantity"),
        (F.col("l_linenumber") + 9).cast("string").alias("low_stock_limit"),
        (F.col("l_linenumber") == 1).alias("has_low_stock_limit"),
        none.alias("expiry_date"), F.lit(False).alias("has_expiry_date"))


def permission_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = driver(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    return c.select(
        ck.alias("seq"), F.when(ck % 3 == 0, "STAFF").otherwise("owner").alias("caller_role"),
        F.when(ck % 29 == 0, F.lit(999)).otherwise(F.col("c_nationkey") + 1).cast("string").alias("staff_user_id"),
        F.when(F.col("c_acctbal") > 0, "true").otherwise("false").alias("can_manage_billing"),
        F.lit(True).alias("has_can_manage_billing"),
        F.when(ck % 4 == 0, "false").otherwise("1").alias("can_view_reports"), (ck % 2 == 0).alias("has_can_view_reports"))


def clinic_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = driver(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("seq"), F.col("r_name").alias("clinic_name"),
                    F.lit("Main Road").alias("address"), F.lit("0300-0000000").alias("phone"),
                    F.lit(None).cast("string").alias("email"),
                    F.when(F.col("r_regionkey") == 2, F.lit("")).otherwise(F.lit("923000000000")).alias("whatsapp_number"))


def timing_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = driver(spark, sf_dir, "nation")
    rk = F.col("n_regionkey")
    return n.select(
        F.col("n_nationkey").alias("seq"), (F.col("n_nationkey") % 7 + 1).cast("string").alias("timing_id"),
        F.when(rk == 0, "08:00").when(rk == 1, "10:30").when(rk == 2, "9:00").when(rk == 3, "").otherwise("19:00")
         .alias("opening_time"),
        F.when(rk == 1, "17:00").otherwise(F.lit(None)).alias("closing_time"),
        F.when(F.col("n_nationkey") % 6 == 0, "true").otherwise("false").alias("is_closed"))
