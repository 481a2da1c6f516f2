"""Helpers shared by the corpus operators.

Words are runs of characters other than space and U+0009..U+000D: in a task,
exactly what ``bytes.split()`` yields on the UTF-8 text. All helpers treat a
null text as the empty text.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.session import ensure_checkpoint_dir

#: Fixed by the contracts: the white space that separates words.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"


def ship_by_value(module_name: str) -> None:
    """Pickle a module's functions by value, so that Python workers need no
    copy of this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


ship_by_value(__name__)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    Inside a higher-order function an outer expression would be evaluated for
    each element; as a lambda variable it is evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """Array of the words of a text column (empty for null and blank)."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)),
               lambda t: F.when(t == "", F.array().cast("array<string>"))
               .otherwise(F.split(t, SPACE_PATTERN)))


def count_words(text: Column) -> Column:
    """Number of words of a text column (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named by ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: later branches read the columns they need from
    storage every executor sees, so a lost executor never recomputes what
    came before. Files stay until the deployment clears the folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bound_batches(spark: SparkSession, most: str = "8m") -> None:
    """Bound the bytes of an Arrow batch in this session, so that batches of
    long texts fill neither a Python worker nor the JVM's direct memory. A
    session that has a bound of its own keeps it."""
    name, usual = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, most)


def is_remainder(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``, is ``remainder``
    (false for a null id)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def task_count(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` rows, never fewer
    than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task), 1)
