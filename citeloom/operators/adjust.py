"""Adjusted record tables: citations on a common scale, outliers removed, missing years filled, specs merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import rank_table
from .primitives import ratio


def normalise_citations(records: DataFrame, method: str = "per_year", as_of_year: int | None = None) -> DataFrame:
    """``records`` with ``normalised``: citations a year of age (``per_year``; the year counts as one), ``log`` (of one more),
    or the average ``rank`` from the lowest. ``as_of_year`` is the last year of the data by default."""
    if method == "per_year":
        last = records.agg(F.max("year").alias("_last")) if as_of_year is None else records.sparkSession.range(1).select(F.lit(as_of_year).alias("_last"))
        age = F.greatest(F.col("_last") - F.col("year") + 1, F.lit(1))
        return records.crossJoin(F.broadcast(last)).withColumn("normalised", ratio(F.col("citations"), age)).drop("_last")
    if method == "log":
        return records.withColumn("normalised", F.log1p(F.col("citations").cast("double")))
    if method == "rank":
        counted = records.where("citations is not null").groupBy("citations").agg(F.count("*").alias("_c"))
        return records.join(rank_table(counted, "citations", "_c", "normalised").drop("_t"), "citations", "left")
    raise ValueError(f"unknown method {method!r}")


def remove_citation_outliers(records: DataFrame, method: str = "iqr", threshold: float = 3.0) -> DataFrame:
    """``records`` without those whose citations lie over the third quartile plus ``threshold`` times the distance of
    quartiles (``iqr``), or over ``threshold`` deviations from the mean (``z``). Rows without citations stay."""
    x = F.col("citations")
    if method == "iqr":
        cuts = records.agg((F.percentile(x, F.lit(0.75)) + threshold * (F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25)))).alias("_high"), F.lit(None).cast("double").alias("_low"))
    elif method == "z":
        spread = threshold * F.stddev_samp(x)
        cuts = records.agg((F.avg(x) + spread).alias("_high"), (F.avg(x) - spread).alias("_low"))
    else:
        raise ValueError(f"unknown method {method!r}")
    out = (x > F.col("_high")) | (x < F.col("_low"))
    return records.crossJoin(F.broadcast(cuts)).where(~F.coalesce(out, F.lit(False))).drop("_high", "_low")


def impute_years(records: DataFrame, method: str = "median") -> DataFrame:
    """``records`` with missing years as the median of the others (rounded down) or their most frequent one, the earliest of
    several (``mode``)."""
    if method == "median":
        filling = records.agg(F.floor(F.median("year")).cast("int").alias("_y"))
    elif method == "mode":
        counted = records.where("year is not null").groupBy("year").agg(F.count("*").alias("n"))
        filling = counted.agg(F.max_by("year", F.struct("n", -F.col("year"))).alias("_y"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return records.crossJoin(F.broadcast(filling)).withColumn("year", F.coalesce("year", "_y")).drop("_y")


def merged_spec(base: dict, override: dict) -> dict:
    """``base`` with what ``override`` has instead, nested dicts merged alike."""
    out = dict(base)
    for key, value in override.items():
        out[key] = merged_spec(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def match_indicators(countries: DataFrame, indicators: DataFrame, column: str = "country") -> DataFrame:
    """``countries`` that ``indicators`` (a table with a row a country) has, by name without regard to case, with its columns."""
    named = indicators.withColumn("_key", F.upper(F.trim(column))).drop(column)
    return countries.withColumn("_key", F.upper(F.trim(column))).join(named, "_key").drop("_key")


def per_indicator(table: DataFrame, value: str, indicator: str, scale: float = 1.0) -> DataFrame:
    """``table`` with ``value`` per ``scale`` of ``indicator`` and its rank from the highest; null where there is none."""
    from .primitives import ranked

    name = f"{value}_per_{indicator}"
    return ranked(table.withColumn(name, ratio(F.col(value) * scale, F.col(indicator))), name, f"rank_{name}")
