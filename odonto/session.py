"""Session construction and lineage-cut storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes,
# coalesces small shuffle partitions and splits skewed ones.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Staged batches are reliable checkpoints: let Spark remove their files
    # once the frames that use them are gone.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "odonto", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master`` is only set when given, so a cluster submit keeps its own.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster that folder must be set by the deployment (shared storage).
    Only a local-mode session without the setting gets a scratch folder of its
    own, which is what tests use.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir() or conf_dir
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at shared storage")
    path = tempfile.mkdtemp(prefix="odonto-ckpt-", dir=os.environ.get("ODONTO_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return sc.getCheckpointDir() or path


# Where ``stage_files`` writes inside ``staged_within``.
_FOLDER: ContextVar[str | None] = ContextVar("odonto_staging_folder", default=None)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries begun in here drop their shuffle files when they end, instead of
    keeping them on disk until the driver's garbage collection. For queries that
    run once only: a second run of the same frame would compute them again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stage(df):
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder.

    Used where a job's validated batch feeds several branches (refusals,
    id assignment, snapshot, audit): without the cut each branch would
    recompute the whole validation plan. The eager reliable checkpoint is
    written in one pass, lives on shared storage (so it survives executor
    loss, unlike a cached or locally checkpointed frame) and keeps the
    frame's partitioning for the joins that follow.
    """
    ensure_checkpoint_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def stage_files(df: DataFrame) -> DataFrame:
    """Cut the lineage of a large ``df`` by Parquet files in the shared folder.

    Columns packed by zstd take a fraction of a checkpoint's rows, branches read only the
    columns they need, and joins plan with the files' size; the partitioning is
    not kept. Files stay until ``staged_within`` ends or the deployment clears the folder.
    """
    spark = df.sparkSession
    path = f"{_FOLDER.get() or ensure_checkpoint_dir(spark).rstrip('/')}/staged-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged_within(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Frames that ``stage_files`` cuts in here are gone when it ends. For a caller that
    wants one frame of a job and stages that, by the function it gets, to be kept."""
    outer = _FOLDER.get()
    folder = f"{outer or ensure_checkpoint_dir(spark).rstrip('/')}/within-{uuid.uuid4().hex}"
    _FOLDER.set(folder)

    def keep(df: DataFrame) -> DataFrame:
        _FOLDER.set(outer)
        try:
            return stage_files(df)
        finally:
            _FOLDER.set(folder)

    try:
        yield keep
    finally:
        _FOLDER.set(outer)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
