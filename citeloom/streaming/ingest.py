"""Incremental ingest of new export files (an addition: the batch operators know no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T


def first_seen(stream: DataFrame, time_column: str, delay: str = "1 day") -> DataFrame:
    """A record stream without rows whose DOI key was seen within the watermark; rows without a DOI all pass, equal ones too."""
    keyed = stream.withColumn("doi_key", T.doi_key(F.col("doi"))).withWatermark(time_column, delay)
    known = keyed.where("doi_key is not null").dropDuplicatesWithinWatermark(["doi_key"])
    return known.unionByName(keyed.where("doi_key is null"))


def windowed_counts(stream: DataFrame, time_column: str, key: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Rows by window of event time and key, late rows up to ``delay``."""
    return stream.withWatermark(time_column, delay).groupBy(F.window(time_column, width, slide or width).alias("window"), key).agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream's rows as Parquet, each micro-batch once, until what is there is done."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
