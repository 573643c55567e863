"""What several operators share: intermediate tables and components of the core, small Arrow batches, bounded samples."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.networks import connected as components
from ..plans.storage import materialise, shared_dir

__all__ = ["bounded_batches", "components", "give_back", "materialise", "sampled", "shared_dir"]


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts are long, and both JVM and Python hold a whole batch of every running task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Hand what this process has freed back to the system; Arrow's pool and the C library would keep it for later."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def sampled(df: DataFrame, key: Column, rows: int, distinct: bool = False) -> DataFrame:
    """At most ``rows`` rows, those of least hash of ``key``, the same on every run; with ``distinct``, of unequal rows.

    A filter on the hash, at a rate from the row count, leaves little over ``rows`` rows before they are put in order, so
    what meets in one place does not grow with the tasks.
    """
    n = df.count()
    if n > rows:
        df = df.where(F.pmod(F.xxhash64(key, F.lit(0)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, (rows + 4 * rows**0.5) / n)))
    df = df.distinct() if distinct else df
    return df.orderBy(F.xxhash64(key, F.lit(0)), key).limit(rows)
