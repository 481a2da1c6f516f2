"""Sinks: result rows as JSON (S5), append (S6), and whole snapshots.

A job's new snapshot is written to a new directory (then the caller switches
its pointer to it); that write also cuts the lineage between batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from odonto.functions.exprs import to_double_edge
from odonto.schemas import PRIMARY_KEYS, SCHEMAS
from odonto.sources.tables import conform

# Fact tables are written sorted by their date column, so Parquet min/max
# statistics let date-range filters skip row groups.
FACT_DATES = {
    "appointments": "appointment_date", "treatments": "treatment_date", "bills": "bill_date",
    "payments": "payment_date", "audit_logs": "created_at",
}


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines; dates as 'yyyy-MM-dd' text, amounts as numbers."""
    (to_double_edge(df).write.mode(mode).option("dateFormat", "yyyy-MM-dd")
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(path))


def append(df: DataFrame, path: str, table: str) -> None:
    """Append rows (conformed to the table schema) to a stored table."""
    conform(df, table).write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, table: str, mode: str = "errorifexists") -> None:
    out = conform(df, table)
    order = [FACT_DATES[table], PRIMARY_KEYS[table]] if table in FACT_DATES else [PRIMARY_KEYS[table]]
    out.sortWithinPartitions(*order).write.mode(mode).parquet(path)


def write_snapshot(t, path: str, mode: str = "errorifexists") -> None:
    for name in SCHEMAS:
        write_table(t[name], f"{path.rstrip('/')}/{name}", name, mode)


def persist_snapshot(t, base_dir: str | None = None):
    """Write ``t`` to a fresh directory (the shared checkpoint folder by
    default) and return the snapshot read back from it: a lineage cut that
    survives executor loss, unlike an in-memory or local checkpoint."""
    from odonto.session import ensure_checkpoint_dir
    from odonto.sources.tables import Clinic
    base = base_dir or ensure_checkpoint_dir(t.spark)
    path = f"{base.rstrip('/')}/snapshot-{uuid.uuid4().hex[:12]}"
    write_snapshot(t, path)
    return Clinic.load(t.spark, path)


__all__ = ["write_json", "append", "write_table", "write_snapshot", "persist_snapshot"]
