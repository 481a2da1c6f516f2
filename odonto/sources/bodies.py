"""S4 with types: JSON request bodies whose values keep what they were.

A body is parsed once into a ``VARIANT``, which tells absent, null, boolean, number,
text, list and object apart. Each field then becomes the text that the jobs' checks
read as JavaScript reads the typed value, by how its route uses the field:

* ``TEXT``: ``String(value || "")``; false, 0, null and "" are empty
* ``NUMBER``: ``Number(value)``; null is 0, true is 1, text must be a number's
* ``NUMBER_OR``: ``Number(value || default)``; a false value takes the default,
  so the number 0 does and the text "0" doesn't
* ``FLAG``: ``Boolean(value)``; the texts "0" and "false" are true

Lines that are no JSON, no object, name a key twice, or have no whole ``seq`` are
quarantined with the reason and their file. Everything is one projection over the
scan (no shuffle, no Python), in batch and as a stream. Numbers written with an
exponent show as whole numbers below 1e18, else in Spark's notation; only ``TEXT``
can tell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.session import ensure_checkpoint_dir

TEXT, NUMBER, NUMBER_OR, FLAG = "text", "number", "number or default", "flag"


def _body(text: str = "", number: str = "", number_or: str = "", flag: str = "") -> dict[str, str]:
    kinds = {TEXT: text, NUMBER: number, NUMBER_OR: number_or, FLAG: flag}
    return {field: kind for kind, fields in kinds.items() for field in fields.split()}


_HISTORY = "allergies current_medications medical_notes"
_PATIENT = "name phone email gender date_of_birth address " + _HISTORY
#: The fields of each job's requests; route parameters are among them.
BODIES = {
    "add_patients": _body(_PATIENT),
    "patch_patients": _body(_PATIENT, "patient_id"),
    "soft_delete_patients": _body(number="patient_id"),
    "add_dentists": _body("name phone email specialization"),
    "patch_dentists": _body("name phone email specialization", "dentist_id", flag="is_active"),
    "book_appointments": _body("appointment_date appointment_time problem_description", "patient_id dentist_id"),
    "patch_appointments": _body("appointment_date appointment_time status problem_description",
                                "appointment_id patient_id dentist_id"),
    "cancel_appointments": _body(number="appointment_id"),
    "add_treatments": _body("treatment_name notes treatment_date status", "patient_id dentist_id cost", "appointment_id"),
    "patch_treatments": _body("treatment_name notes treatment_date status", "treatment_id cost"),
    "create_bills": _body("", "patient_id subtotal", "treatment_id discount_amount"),
    "add_payments": _body("payment_method notes", "bill_id paid_amount"),
    "add_medicines": _body("medicine_name batch_no expiry_date", "", "quantity low_stock_limit"),
    "patch_medicines": _body("medicine_name batch_no expiry_date", "medicine_id quantity low_stock_limit"),
    "upsert_permissions": _body("", "staff_user_id", flag="can_manage_billing can_view_reports"),
    "patch_clinic": _body("clinic_name address phone email whatsapp_number"),
    "patch_timings": _body("opening_time closing_time", "timing_id", flag="is_closed"),
}


def _lines(spark: SparkSession, path: str, streaming: bool, files_per_trigger: int | None,
           bytes_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif streaming and bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    raw = reader.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    # Blank lines between requests are no requests.
    return raw.filter(F.trim("line") != "").withColumn("_body", F.try_parse_json("line"))


def _problem() -> Column:
    b = F.col("_body")
    whole = F.try_variant_get(b, "$.seq", "decimal(38,9)")
    return (F.when(b.isNull(), "no JSON").when(~F.schema_of_variant(b).startswith("OBJECT"), "no object")
            .when(whole.isNull() | (whole != F.floor(whole)) | F.try_variant_get(b, "$.seq", "long").isNull(), "no seq"))


def _field(v: Column, of: Column, kind: str) -> Column:
    """A typed value as the text that stands for it; absent (NULL) stays NULL."""
    s = F.try_variant_get(v, "$", "string")
    d = F.try_variant_get(v, "$", "double")
    number = of.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    false = ((of == "VOID") | ((of == "BOOLEAN") & (s == "false")) | (number & (d == 0)) | ((of == "STRING") & (s == "")))
    if kind == FLAG:
        return F.when(v.isNotNull(), F.when(false, "false").otherwise("true"))
    whole = F.when((of == "DOUBLE") & (d == F.floor(d)) & (F.abs(d) < 1e18), d.cast("long").cast("string"))
    shown = (F.when(of.startswith("OBJECT"), "[object Object]")
             .when(of.startswith("ARRAY"), F.array_join(F.try_variant_get(v, "$", "array<string>"), ",", ""))
             .otherwise(F.coalesce(whole, s)))
    if kind == TEXT:
        return F.when(v.isNotNull(), F.when(false, "").otherwise(shown))
    # The checks read an empty text as 0 and, where there is one, as the default.
    as_number = (F.when(of == "VOID", "").when(of == "BOOLEAN", F.when(s == "true", "1").otherwise("0"))
                 .when((of == "STRING") & s.isin("false", "null"), "NaN").otherwise(shown))
    if kind == NUMBER_OR:
        as_number = F.when(false, "").otherwise(as_number)
    return F.when(v.isNotNull(), as_number)


def read_bodies(spark: SparkSession, path: str, fields: dict[str, str], streaming: bool = False,
                files_per_trigger: int | None = None, bytes_per_trigger: int | None = None) -> DataFrame:
    """JSON-lines request bodies -> one row per request, as ``read_requests`` shapes
    it: ``seq``, the caller, and per field its text and ``has_<field>``."""
    good = _lines(spark, path, streaming, files_per_trigger, bytes_per_trigger).filter(_problem().isNull())
    b = F.col("_body")
    # One step per use of a value, so that none is looked up twice.
    typed = good.select(
        F.try_variant_get(b, "$.seq", "long").alias("seq"), F.try_variant_get(b, "$.caller_id", "string").alias("caller_id"),
        F.try_variant_get(b, "$.caller_role", "string").alias("caller_role"),
        *[F.variant_get(b, f"$.{f}", "variant").alias(f"_v_{f}") for f in fields])
    typed = typed.select("*", *[F.schema_of_variant(f"_v_{f}").alias(f"_k_{f}") for f in fields])
    cols = []
    for f, kind in fields.items():
        v = F.col(f"_v_{f}")
        cols += [_field(v, F.col(f"_k_{f}"), kind).alias(f), v.isNotNull().alias(f"has_{f}")]
    return typed.select("seq", "caller_id", "caller_role", *cols)


def quarantined(spark: SparkSession, path: str, streaming: bool = False, files_per_trigger: int | None = None,
                bytes_per_trigger: int | None = None) -> DataFrame:
    """The lines under ``path`` that ``read_bodies`` leaves out: (file, line, problem)."""
    lines = _lines(spark, path, streaming, files_per_trigger, bytes_per_trigger)
    return lines.select("file", "line", _problem().alias("problem")).filter(F.col("problem").isNotNull())


def start_quarantine(spark: SparkSession, source: str, sink: str, checkpoint: str, available_now: bool = True,
                     **per_trigger: int | None):
    """Append the malformed lines of a request folder to Parquet under ``sink``."""
    w = (quarantined(spark, source, streaming=True, **per_trigger).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def write_lines(lines: DataFrame, name: str) -> str:
    """Write one text column as a request folder in the shared folder; returns its path."""
    import uuid
    path = f"{ensure_checkpoint_dir(lines.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    lines.write.text(path)
    return path
