"""Clinic tables: scans with explicit schemas and the table container."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.schemas import DEFAULTS, SCHEMAS, TABLES


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project ``df`` onto the table schema: column order, types, defaults.

    Columns the input lacks take the DDL default, or NULL when there is none;
    a column that is there keeps its values, an explicit NULL included.
    """
    have = set(df.columns)
    cols = []
    for f in SCHEMAS[table].fields:
        if f.name in have:
            c = F.col(f.name)
        elif (table, f.name) in DEFAULTS:
            c = F.lit(DEFAULTS[(table, f.name)])
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(cols)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Scan one clinic table stored as Parquet under ``path/name`` (no inference)."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{path.rstrip('/')}/{name}")


class Clinic:
    """The 13 clinic tables of one snapshot, by name.

    ``t.patients`` and ``t["patients"]`` both give the DataFrame.
    """

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        missing = [n for n in TABLES if n not in frames]
        if missing:
            raise ValueError(f"missing tables: {missing}")
        self.spark = spark
        self._frames = dict(frames)

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def __getitem__(self, name: str) -> DataFrame:
        return self._frames[name]

    def names(self):
        return list(self._frames)

    def replace(self, **frames: DataFrame) -> "Clinic":
        """A new snapshot with some tables swapped (conformed to their schema)."""
        new = dict(self._frames)
        for k, v in frames.items():
            new[k] = conform(v, k)
        return Clinic(self.spark, new)

    # --- constructors -------------------------------------------------
    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Clinic":
        return cls(spark, {n: table(spark, path, n) for n in TABLES})

    @classmethod
    def from_driver(cls, spark: SparkSession, sf_dir: str) -> "Clinic":
        from odonto.sources.bind import bind_all
        return cls(spark, bind_all(spark, sf_dir))

    @classmethod
    def seed(cls, spark: SparkSession, as_of) -> "Clinic":
        from odonto.sources.seed import seed_frames
        return cls(spark, seed_frames(spark, as_of))

    # --- catalog ------------------------------------------------------
    def register_views(self, prefix: str = "", as_of=None) -> None:
        """Temp views for every table and the read-model views.

        With ``as_of`` the daily view is defined in SQL over the appointment
        view (a view over a view, the date bound as a literal of the view).
        """
        import datetime as dt

        from odonto.plans import views
        for n, df in self._frames.items():
            df.createOrReplaceTempView(prefix + n)
        views.appointment_details(self).createOrReplaceTempView(prefix + "appointment_details_view")
        views.billing_summary(self).createOrReplaceTempView(prefix + "billing_summary_view")
        if as_of is not None:
            d = dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
            self.spark.sql(f"""CREATE OR REPLACE TEMP VIEW {prefix}daily_appointments_view AS
                SELECT * FROM {prefix}appointment_details_view WHERE appointment_date = DATE'{d.isoformat()}'""")

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Write every table as Parquet under ``path/<table>``; facts sorted by date."""
        from odonto.sources.io import write_snapshot
        write_snapshot(self, path, mode)
