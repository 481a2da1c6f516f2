"""Live audits (T2-T6, T9): audit rows from a stream of after-images.

Change files hold rows of patients, appointments, bills and payments as they are
after a change, with its ``version``. What a row was before is kept in state, so
the after-images alone tell an insert from an update and give old values.

A state row holds the images of ``IDS_PER_BLOCK`` consecutive ids of one table as
one Arrow stream: a trigger reads and writes once per block it touches, not once per
row. Ids are dense where the library gives them; a table with gaps can take wider
blocks (``ids_per_block``), but not on a checkpoint begun with others. An image is what a trigger can ask of the old row: the value it shows, the
soft-delete flag, and a 64-bit hash of all columns but ``updated_at``. State grows
with the rows of the four tables (RocksDB).

A row's changes are applied by version, in any order within a trigger. A version that
isn't above the row's last one is a repeat and gives nothing, so files can be sent
again; files must therefore reach the folder in version order per row. The
tables' own triggers see single rows only, so the order between rows is free. A task
holds a block's changes of one trigger: ``bytes_per_trigger`` bounds them.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from odonto.plans.feeds import AUDIT_COLS
from odonto.schemas import PRIMARY_KEYS, SCHEMAS
from odonto.session import shuffles_dropped
from odonto.streaming.bill_status import ROCKSDB, _scratch

# The processor runs in Python workers that need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = ("patients", "appointments", "bills", "payments")
IDS_PER_BLOCK = 1024
IMAGE = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("live", pa.bool_()), ("shown", pa.string()),
                   ("flag", pa.bool_()), ("digest", pa.int64())])
CHANGE_FIELDS = [T.StructField("version", T.LongType(), False), T.StructField("removed", T.BooleanType(), False),
                 T.StructField("changed_at", T.TimestampType())]
OUT_SCHEMA = ("table_name string, id long, version long, live boolean, shown string, flag boolean, digest long, "
              "inserted string, user_id long, changed_at timestamp, was_live boolean, old_shown string, "
              "old_flag boolean, old_digest long")


class LastImages(StatefulProcessor):
    """Gives each change of a block's rows the image that it replaces."""

    def init(self, handle) -> None:
        self.block = handle.getValueState("block", "images binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        rows = pd.concat([self._stored(), initialState[IMAGE.names]], ignore_index=True)
        self._keep(rows.sort_values(["id", "version"], kind="stable").drop_duplicates("id", keep="last"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        stored = self._stored()
        # A stored image stands before the changes of its row and version.
        both = pd.concat([stored.assign(_new=False), new.assign(_new=True)], ignore_index=True)
        both = both.sort_values(["id", "version", "_new"], kind="stable").drop_duplicates(["id", "version"])
        last = stored.set_index("id")["version"]
        behind = both["_new"] & (both["version"] < both["id"].map(last).fillna(np.iinfo(np.int64).min))
        both = both[~behind].reset_index(drop=True)
        ids, fresh = both["id"].to_numpy(), both["_new"].to_numpy(dtype=bool)
        if not fresh.any():
            return
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        before = both.iloc[np.maximum(np.arange(len(ids)) - 1, 0)].reset_index(drop=True)
        live, flag = before["live"].to_numpy(dtype=bool), before["flag"].to_numpy(dtype=bool)
        out = both.assign(was_live=live & ~first, old_shown=before["shown"].where(~first, None), old_flag=flag & ~first,
                          old_digest=before["digest"].where(~first, 0).astype("int64"))
        self._keep(both.drop_duplicates("id", keep="last"))
        yield out[fresh].drop(columns=["_new", "block"], errors="ignore")

    def _stored(self) -> pd.DataFrame:
        if (state := self.block.get()) is None:
            return IMAGE.empty_table().to_pandas()
        with pa.ipc.open_stream(state[0]) as reader:
            return reader.read_pandas()

    def _keep(self, images: pd.DataFrame) -> None:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, IMAGE) as writer:
            writer.write_table(pa.Table.from_pandas(images[IMAGE.names], schema=IMAGE, preserve_index=False))
        self.block.update((sink.getvalue().to_pybytes(),))


def _digest(table: str) -> Column:
    cols = [F.col(c) for c in SCHEMAS[table].names if c != "updated_at"]
    # The hash passes over nulls, so where they are is hashed too.
    return F.xxhash64(*cols, *[c.isNull() for c in cols])


def _images(table: str, width: int) -> list[Column]:
    """The columns of a row that the triggers of its table look at."""
    none = F.lit(None).cast("string")
    shown = {"patients": F.col("name"), "appointments": F.col("status")}.get(table, none)
    flag = F.coalesce("is_deleted", F.lit(False)) if table == "patients" else F.lit(False)
    key = F.col(PRIMARY_KEYS[table])
    return [F.lit(table).alias("table_name"), F.floor(key / width).cast("long").alias("block"),
            key.alias("id"), shown.alias("shown"), flag.alias("flag"), _digest(table).alias("digest")]


def _arrivals(changes: DataFrame, table: str, width: int) -> DataFrame:
    """A table's change rows in the shape that all tables share."""
    c = F.col
    inserted, user = F.lit(None), F.lit(None)
    if table == "patients":
        inserted = F.concat(c("patient_code"), F.lit(" - "), c("name"))
    elif table == "appointments":
        user = c("created_by_user_id")
    elif table == "bills":
        inserted, user = F.concat(F.lit("Total: "), c("total_amount").cast("string")), c("created_by_user_id")
    elif table == "payments":
        inserted, user = F.concat(F.lit("Amount: "), c("paid_amount").cast("string")), c("received_by_user_id")
    return changes.select(*_images(table, width), "version", (~F.col("removed")).alias("live"),
                          inserted.cast("string").alias("inserted"), user.cast("long").alias("user_id"), "changed_at")


def stored_images(t, widths: dict[str, int]) -> DataFrame:
    """The images that the state starts with: the rows of a snapshot, at version 0."""
    parts = [t[n].select(*_images(n, widths[n]), F.lit(0).cast("long").alias("version"), F.lit(True).alias("live")) for n in TABLES]
    return reduce(DataFrame.unionByName, parts)


def audit_rows(steps: DataFrame, changed_only: bool = True) -> DataFrame:
    """T2-T6 on changes that carry the image they replace.

    Without ``changed_only`` an after-image equal to the row before it counts as
    an update, as the triggers see it."""
    c = F.col
    of, insert, update = c("table_name"), ~c("was_live") & c("live"), c("was_live") & c("live")
    differs = (c("digest") != c("old_digest")) if changed_only else F.lit(True)
    action = (F.when(insert & (of == "patients"), "PATIENT_ADDED")
              .when(insert & (of == "bills"), "BILL_CREATED")
              .when(insert & (of == "payments"), "PAYMENT_CREATED")
              .when(update & (of == "patients") & c("flag") & ~c("old_flag"), "PATIENT_SOFT_DELETED")
              .when(update & (of == "patients") & differs, "PATIENT_UPDATED")
              .when(update & (of == "appointments") & (c("shown") != c("old_shown")), "APPOINTMENT_STATUS_CHANGED"))
    return (steps.withColumn("action_type", action).filter(c("action_type").isNotNull())
            .select("action_type", "table_name", c("id").alias("record_id"), F.when(update, c("old_shown")).alias("old_value"),
                    F.when(insert, c("inserted")).otherwise(c("shown")).alias("new_value"), "user_id",
                    c("changed_at").alias("created_at"), "version")
            .select(*AUDIT_COLS, "version"))


def start_audits(t, source: str, sink: str, checkpoint: str, changed_only: bool = True, available_now: bool = True,
                 files_per_trigger: int | None = None, bytes_per_trigger: int | None = None,
                 ids_per_block: dict[str, int] | None = None):
    """Turn the change files under ``source/<table>`` into audit rows (Parquet) under
    ``sink``, written exactly once. ``t`` gives the images on the first start only; a
    restart with the same ``checkpoint`` goes on with those it left."""
    spark: SparkSession = t.spark
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    widths = {n: (ids_per_block or {}).get(n, IDS_PER_BLOCK) for n in TABLES}
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", bytes_per_trigger)
    arrivals = reduce(DataFrame.unionByName, [
        _arrivals(reader.schema(T.StructType([*SCHEMAS[n].fields, *CHANGE_FIELDS])).parquet(f"{source}/{n}"), n, widths[n])
        for n in TABLES])
    steps = arrivals.groupBy("table_name", "block").transformWithStateInPandas(
        LastImages(), outputStructType=OUT_SCHEMA, outputMode="Append", timeMode="None",
        initialState=stored_images(t, widths).groupBy("table_name", "block"))
    w = (audit_rows(steps, changed_only).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")).start()


def row_changes(old: DataFrame, new: DataFrame, table: str, version: int, changed_at) -> DataFrame:
    """After-images of the rows in which two snapshots of a table differ, and the last
    image of rows that the newer one lacks, marked ``removed``."""
    key, cols = PRIMARY_KEYS[table], SCHEMAS[table].names
    was = old.select(F.col(key).alias("_key"), F.struct(*cols).alias("_was"))
    now = new.select(F.col(key).alias("_key"), F.struct(*cols).alias("_now"))
    j = was.join(now, "_key", "full").filter(~F.col("_was").eqNullSafe(F.col("_now")))
    return j.select(F.coalesce("_now", "_was").alias("_row"), F.col("_now").isNull().alias("removed")).select(
        "_row.*", F.lit(version).cast("long").alias("version"), "removed",
        F.lit(changed_at).cast("timestamp").alias("changed_at"))


def write_row_changes(old, new, path: str, version: int, changed_at) -> None:
    """Append the changes between two snapshots as change files; a table that both
    share writes nothing."""
    for n in TABLES:
        if old[n] is not new[n]:
            with shuffles_dropped(new[n].sparkSession):
                row_changes(old[n], new[n], n, version, changed_at).write.mode("append").parquet(f"{path}/{n}")


def empty_source(spark: SparkSession, path: str) -> None:
    """The folders of a change source, so that a stream can start on tables without files."""
    for n in TABLES:
        schema = T.StructType([*SCHEMAS[n].fields, *CHANGE_FIELDS])
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{n}")


def stream_audit_feed(snapshots: list, changed_at, **options) -> DataFrame:
    """End to end: the changes between consecutive snapshots are written as change
    files in the shared folder and streamed until caught up; returns the audit rows
    (``version``: 1 for the second snapshot)."""
    spark = snapshots[0].spark
    src, sink, ckpt = _scratch(spark, "rows-src"), _scratch(spark, "rows-audit"), _scratch(spark, "rows-ckpt")
    empty_source(spark, src)
    for i, (old, new) in enumerate(zip(snapshots, snapshots[1:]), 1):
        write_row_changes(old, new, src, i, changed_at)
    q = start_audits(snapshots[0], src, sink, ckpt, **options)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(sink)
