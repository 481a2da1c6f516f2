"""Structured Streaming forms of the payment triggers.

T8: running paid total and status per bill. Payment change files stream in;
a stateful ``groupBy(bill_id)`` keeps one row per bill (sum, count) and runs
in update mode, so each trigger emits only the bills it touched. A
``foreachBatch`` sink appends those updates, tagged with the batch id, to a
Parquet table in the shared checkpoint folder; readers take the latest total
per bill with ``max_by(total, batch_id)``. Nothing is rewritten in full per
trigger and nothing goes through the driver. The log is idempotent under
retries: a batch re-run after a failure appends rows with the same batch id
and the same totals, which the compaction reads the same way. Totals never
expire (a bill can always receive another payment), so state grows with the
number of bills: use the RocksDB state store at scale.

T9: payment change files mapped to PAYMENT_CREATED audit rows, appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.functions.exprs import derived_bill_status
from odonto.schemas import SCHEMAS
from odonto.session import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def payment_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None,
                   bytes_per_trigger: int | None = None) -> DataFrame:
    """Payment change files (Parquet, payments schema) under ``path`` as a
    stream; a trigger takes as much as one of the two bounds allows, or all."""
    r = spark.readStream.schema(SCHEMAS["payments"])
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        r = r.option("maxBytesPerTrigger", bytes_per_trigger)
    return r.parquet(path)


def running_totals(payments: DataFrame) -> DataFrame:
    """Stateful per-bill sum and count of a payment stream."""
    return payments.groupBy("bill_id").agg(F.sum("paid_amount").alias("paid_total"),
                                           F.count(F.lit(1)).alias("payment_count"))


def start_bill_totals(spark: SparkSession, source_path: str, sink_path: str, checkpoint: str,
                      available_now: bool = True, **per_trigger: int | None):
    """Start T8: stream running totals into an append-only update log at ``sink_path``."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") == "":
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write_batch(df: DataFrame, batch_id: int):
        df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("append").parquet(sink_path)

    q = (running_totals(payment_stream(spark, source_path, **per_trigger))
         .writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write_batch))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()


def latest_totals(spark: SparkSession, sink_path: str) -> DataFrame:
    """Compact the update log: the latest (paid_total, payment_count) per bill."""
    log = spark.read.parquet(sink_path)
    return log.groupBy("bill_id").agg(F.max_by("paid_total", "batch_id").alias("paid_total"),
                                      F.max_by("payment_count", "batch_id").alias("payment_count"))


def bill_status_from_totals(bills: DataFrame, totals: DataFrame) -> DataFrame:
    """Bill status as the payment trigger leaves it, from per-bill totals."""
    j = bills.select("bill_id", "total_amount", "status").join(totals, "bill_id", "left")
    return j.select("bill_id", F.col("status").alias("stored_status"),
                    F.when(F.col("paid_total").isNotNull(), derived_bill_status(F.col("paid_total"), F.col("total_amount")))
                    .otherwise(F.col("status")).alias("status"))


def write_changes(payments: DataFrame, path: str) -> None:
    """Payments as change files by payment year: a bill paid over several
    years arrives in several files. As many files as the scan has tasks and
    years; none is gathered anywhere."""
    payments.withColumn("change_year", F.year("payment_date")).write.partitionBy("change_year").parquet(path)


def stream_bill_status(t, **per_trigger: int | None) -> DataFrame:
    """T8 end to end over the snapshot's payments.

    The payments are written as change files in the shared checkpoint folder,
    streamed until caught up (in one trigger, unless ``files_per_trigger`` or
    ``bytes_per_trigger`` bounds it), and the final per-bill totals give each
    bill's status.
    """
    spark = t.spark
    src, sink, ckpt = _scratch(spark, "pay-src"), _scratch(spark, "bill-totals"), _scratch(spark, "bill-ckpt")
    write_changes(t.payments, src)
    q = start_bill_totals(spark, src, sink, ckpt, **per_trigger)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return bill_status_from_totals(t.bills, latest_totals(spark, sink))


def payment_audit_stream(payments: DataFrame) -> DataFrame:
    """T9 stream: PAYMENT_CREATED rows for a payment stream."""
    return payments.select(
        F.lit("PAYMENT_CREATED").alias("action_type"), F.lit("payments").alias("table_name"),
        F.col("payment_id").alias("record_id"), F.lit(None).cast("string").alias("old_value"),
        F.concat(F.lit("Amount: "), F.col("paid_amount").cast("string")).alias("new_value"),
        F.col("received_by_user_id").alias("user_id"), F.col("created_at"))


def stream_payment_audit(t, **per_trigger: int | None) -> DataFrame:
    """T9 end to end: stream the snapshot's payments as change files into an
    audit table in the shared folder and read it back."""
    spark = t.spark
    src, sink, ckpt = _scratch(spark, "pay-src"), _scratch(spark, "audit-sink"), _scratch(spark, "audit-ckpt")
    write_changes(t.payments, src)
    q = (payment_audit_stream(payment_stream(spark, src, **per_trigger)).writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", ckpt).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink)
