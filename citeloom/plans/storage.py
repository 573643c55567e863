"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may have no such setting (tests on one machine); a temporary folder serves it then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    _made.append(f"{root.rstrip('/')}/citeloom-{uuid.uuid4().hex}")
    return _made[-1]


def materialise(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the folders of intermediate tables that this process has made so far; how many there were.

    For jobs that have written their results: lazy results that were not written yet lose what they read.
    """
    files = spark.sparkContext._jvm.org.apache.hadoop.fs
    done = 0
    while _made:
        path = files.Path(_made.pop())
        done += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return done
