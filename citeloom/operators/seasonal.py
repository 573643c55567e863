"""Local regression and the split of series into trend, season and remainder (STL: Cleveland and others, 1990).

A series is the values of a key in the order of ``year`` (any counter of equal steps: months, days); the series of a corpus are
short and many, so keys are what is distributed. Local lines are weighted sums over the places near a place: one pass is a fold
in the JVM, the loop of passes that the split takes is numpy over one series a group (nested as column expressions it passes
the analyzer's limit of iterations). Null values are left out and the steps close up.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import let

#: What a spread of places must have for a line; under it the weighted mean is taken.
FLAT = 1e-9


def _series(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    pairs = F.array_sort(F.collect_list(F.struct("year", F.col(value).cast("double").alias("y"))))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(pairs.alias("p"), F.count("*").cast("int").alias("n"))


def local_line(y: Column, rho: Column | None, span: int, x: Column) -> Column:
    """The tricube-weighted line over the ``span`` values of ``y`` nearest to place ``x`` (from 1; beyond the ends too), at ``x``.
    ``rho`` weights the values besides."""
    n = F.size(y)
    q = F.least(F.lit(span), n)
    low = F.greatest(F.lit(1), F.least(x - F.floor((q - 1) / 2).cast("int"), n - q + 1))
    high = low + q - 1
    reach = F.greatest(x - low, high - x).cast("double")
    start = F.struct(*(F.lit(0.0).alias(c) for c in ("w", "u", "y", "uu", "uy")))

    def add(acc: Column, j: Column) -> Column:
        u = (j - x).cast("double")
        near = F.abs(u) / reach
        tricube = F.when(near <= 0.001, 1.0).when(near <= 0.999, F.pow(1 - F.pow(near, 3), 3)).otherwise(0.0)
        weight = F.when(reach > 0, tricube).otherwise(1.0) if rho is None else F.when(reach > 0, tricube * rho[j - 1]).otherwise(rho[j - 1])
        value = y[j - 1]
        return F.struct((acc["w"] + weight).alias("w"), (acc["u"] + weight * u).alias("u"), (acc["y"] + weight * value).alias("y"), (acc["uu"] + weight * u * u).alias("uu"), (acc["uy"] + weight * u * value).alias("uy"))

    def fit(s: Column) -> Column:
        spread = s["w"] * s["uu"] - s["u"] * s["u"]
        line = (s["y"] * s["uu"] - s["u"] * s["uy"]) / F.nullif(spread, F.lit(0.0))
        mean = s["y"] / F.nullif(s["w"], F.lit(0.0))
        return F.coalesce(F.when(spread > FLAT * F.greatest(s["w"] * s["w"], F.lit(1e-12)), line), mean, y[F.greatest(F.lit(0), F.least(x, n) - 1)])

    return F.aggregate(F.sequence(low, high), start, add, fit)


def loess(df: DataFrame, keys: Sequence[str], span: int = 7, value: str = "articles") -> DataFrame:
    """``keys, year, value, smooth``: the local line over the ``span`` nearest values at every place."""
    lines = lambda y: F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: local_line(y, None, span, i))
    smooth = let(F.transform("p", lambda v: v["y"]), lines)
    out = _series(df, keys, value).withColumn("_s", smooth).select(*keys, F.explode_outer(F.arrays_zip("p", "_s")).alias("e"))
    return out.select(*keys, F.col("e.p.year").alias("year"), F.col("e.p.y").alias(value), F.col("e._s").alias("smooth"))


def lines(y: np.ndarray, rho: np.ndarray, span: int, x: np.ndarray) -> np.ndarray:
    """``local_line`` at all places ``x`` (from 1) of an array at once."""
    n = len(y)
    q = min(span, n)
    low = np.clip(x - (q - 1) // 2, 1, n - q + 1)
    at = low[:, None] + np.arange(q)
    u = (at - x[:, None]).astype(float)
    reach = np.maximum(x - low, low + q - 1 - x).astype(float)[:, None]
    near = np.abs(u) / np.where(reach > 0, reach, 1.0)
    w = np.where(near <= 0.001, 1.0, np.where(near <= 0.999, (1 - near**3) ** 3, 0.0)) * rho[at - 1]
    v = y[at - 1]
    sw, su, sv, suu, suv = (z.sum(axis=1) for z in (w, w * u, w * v, w * u * u, w * u * v))
    spread = sw * suu - su * su
    straight = spread > FLAT * np.maximum(sw * sw, 1e-12)
    mean = np.where(sw > 0, sv / np.where(sw > 0, sw, 1.0), y[np.clip(x, 1, n) - 1])
    return np.where(straight, (sv * suu - su * suv) / np.where(straight, spread, 1.0), mean)


def split(y: np.ndarray, period: int, seasonal: int, trend: int, inner: int, outer: int) -> tuple[np.ndarray, np.ndarray]:
    """Trend and season of an array of at least two periods."""
    n = len(y)
    every, whole = np.arange(1, n + 1), np.arange(1 - period, n + period + 1)
    mean = lambda x, width: np.convolve(x, np.full(width, 1.0 / width), "valid")
    t, s, rho = np.zeros(n), np.zeros(n), np.ones(n)
    for turn in range(outer + 1):
        for _ in range(inner):
            c = np.zeros(n + 2 * period)
            for k in range(period):
                own = slice(k, n, period)
                c[(whole - 1) % period == k] = lines((y - t)[own], rho[own], seasonal, np.arange(len(y[own]) + 2))
            slow = mean(mean(mean(c, period), period), 3)
            s = c[period : period + n] - lines(slow, np.ones(n), period + 1 - period % 2, every)
            t = lines(y - s, rho, trend, every)
        if turn < outer:
            r = np.abs(y - t - s)
            far = r / (6 * np.median(r)) if np.median(r) > 0 else np.zeros(n)
            rho = np.where(far <= 0.001, 1.0, np.where(far <= 0.999, (1 - far**2) ** 2, 0.0))
    return t, s


def decompose(df: DataFrame, keys: Sequence[str], period: int = 12, seasonal: int = 7, trend: int = 21, inner: int = 2, outer: int = 0, value: str = "articles") -> DataFrame:
    """``keys, year, value, trend, seasonal, remainder`` and the key's ``trend_strength`` and ``seasonal_strength`` in [0, 1].

    ``inner`` rounds each smooth the values of every place in the period along the periods (span ``seasonal``, one period beyond both
    ends), take off their slow part (means over the period twice and over three, then a local line) and smooth the rest
    (span ``trend``). ``outer`` more times values far off (six medians of the remainder's size) lose weight. Series of under two
    periods have no rows. A task holds one series.
    """
    if period < 2:
        raise ValueError("a period has at least two places")
    names = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    ready = df.where(F.col(value).isNotNull()).select(*keys, "year", F.col(value).cast("double").alias(value))

    def parted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("year", kind="stable")
        y = rows[value].to_numpy(float)
        if len(y) < 2 * period:
            return pd.DataFrame(columns=[*rows.columns, "trend", "seasonal", "remainder", "trend_strength", "seasonal_strength"])
        t, s = split(y, period, seasonal, trend, inner, outer)
        r = y - t - s
        strength = lambda part: max(0.0, 1 - r.var() / (part + r).var()) if (part + r).var() > 1e-12 else 0.0
        return rows.assign(trend=t, seasonal=s, remainder=r, trend_strength=strength(t), seasonal_strength=strength(s))

    schema = ", ".join([*(f"{k} {names[k]}" for k in keys), f"year {names['year']}", *(f"{c} double" for c in (value, "trend", "seasonal", "remainder", "trend_strength", "seasonal_strength"))])
    return ready.groupBy(*keys).applyInPandas(parted, schema)
