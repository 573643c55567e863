"""Break points of series: optimal partitions, least-squares breaks, binary segmentation, and what the methods agree on.

A series becomes an array by key (years, not rows of the corpus, so it is short), with prefix sums of values and squares. The
cost of any segment follows from two places of those, and dynamic programmes over cut positions are folds over arrays in the
JVM. Values are taken in the order of ``year``; null values are left out. Ties go to the earlier cut, costs compared to nine places.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import f_tail
from .primitives import ratio, trend
from .series import cusum, pettitt

#: Least variance of a segment: that of rounding to whole counts.
FLOOR = 1.0 / 12
PENALTIES = ("bic", "aic", "mbic", "hannan_quinn")


def _arrays(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key ``n`` and ``p``, its values by year: ``year`` and the sums of values and squares about the key's mean before (``s0,
    q0``) and with (``s, q``) each. The array is what the aggregation gives, so folds over it read it and work out nothing again."""
    own = Window.partitionBy(*keys)
    run = own.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value).cast("double")
    centred = df.where(F.col(value).isNotNull()).select(*keys, "year", (x - F.avg(x).over(own)).alias("_y"))
    square = F.col("_y") * F.col("_y")
    sums = centred.select(*keys, "year", F.row_number().over(own.orderBy("year")).alias("i"), F.sum("_y").over(run).alias("s"), F.sum(square).over(run).alias("q"), "_y")
    each = F.struct("i", "year", (F.col("s") - F.col("_y")).alias("s0"), (F.col("q") - square).alias("q0"), "s", "q")
    return sums.groupBy(*keys).agg(F.array_sort(F.collect_list(each)).alias("p"), F.count("*").cast("int").alias("n"))


def _squares(a: Column, b: Column) -> Column:
    """Sum of squares about their mean of the values after place ``a`` up to place ``b``."""
    low, high = F.col("p")[a], F.col("p")[b - 1]
    s = high["s"] - low["s0"]
    return F.greatest(F.lit(0.0), high["q"] - low["q0"] - s * s / (b - a))


def _years(places: Column) -> Column:
    return F.transform(places, lambda place: F.col("p")[place - 1]["year"])


def _likelihood(a: Column, b: Column) -> Column:
    """Negative log-likelihood of a normal segment, its variance at least ``FLOOR``; splitting never raises the sum."""
    n, squares = (b - a).cast("double"), _squares(a, b)
    variance = F.greatest(squares / n, F.lit(FLOOR))
    return n / 2 * (math.log(2 * math.pi) + F.log(variance) + squares / n / variance)


def _penalty(n: Column, kind: str) -> Column:
    logs = F.log(n.cast("double"))
    return {"bic": logs, "aic": F.lit(2.0), "mbic": logs + 2 * F.log(logs), "hannan_quinn": 2 * F.log(logs)}[kind]


def _cuts(back: Column, n: Column) -> Column:
    """Ascending cut places of the partition that ``back`` (the last cut before every place) leads to from place ``n``."""
    start = F.struct(n.alias("at"), F.array().cast("array<int>").alias("cuts"))

    def step(acc: Column, _: Column) -> Column:
        before = F.when(acc["at"] > 0, back[acc["at"]]).otherwise(0)
        return F.struct(before.alias("at"), F.when(before > 0, F.concat(F.array(before), acc["cuts"])).otherwise(acc["cuts"]).alias("cuts"))

    return F.aggregate(F.sequence(F.lit(1), n), start, step)["cuts"]


def optimal_partition(df: DataFrame, keys: Sequence[str], value: str = "articles", penalty: str = "bic", least: int = 2) -> DataFrame:
    """Per key the partition into normal segments (mean and variance) of least cost: ``n, cost, breaks`` (the years that end a
    segment but for the last) and ``places`` (how many values lie up to each).

    Cost is the negative log-likelihood plus the penalty for every break; segments have at least ``least`` values, and a
    shorter series is one segment. PELT: a cut is given up once it is dearer than a later one by itself, which loses no optimum; with
    a least length that holds from ``least`` values later on.
    """
    if penalty not in PENALTIES:
        raise ValueError(f"unknown penalty {penalty!r}")
    if least < 1:
        raise ValueError("segments have at least one value")
    series = _arrays(df, keys, value).withColumn("_b", _penalty(F.col("n"), penalty))
    beta, never = F.col("_b"), F.lit(float("inf"))
    start = F.struct(F.array(-beta).alias("f"), F.array(F.lit(0)).alias("back"), F.array(F.lit(0)).alias("open"))

    def step(acc: Column, t: Column) -> Column:
        f, past = acc["f"], t - least
        kept = F.filter(acc["open"], lambda c: (past <= c) | (f[past] == never) | (f[c] + _likelihood(c, past) <= f[past] + 1e-9))
        tried = F.transform(F.filter(kept, lambda c: c <= past), lambda c: F.struct(F.round(f[c] + _likelihood(c, t) + beta, 9).alias("v"), c.alias("c")))
        best = F.array_min(tried)
        fresh = F.struct(F.coalesce(best["v"], never).alias("v"), F.coalesce(best["c"], F.lit(0)).alias("c"))
        now = F.when(F.coalesce(best["v"], never) < never, F.concat(kept, F.array(t))).otherwise(kept)
        return F.struct(F.concat(f, F.array(fresh["v"])).alias("f"), F.concat(acc["back"], F.array(fresh["c"])).alias("back"), now.alias("open"))

    done = series.withColumn("_d", F.aggregate(F.sequence(F.lit(1), F.col("n")), start, step))
    out = done.withColumn("places", F.when(F.col("n") >= least, _cuts(F.col("_d.back"), F.col("n"))).otherwise(F.array().cast("array<int>")))
    alone = _likelihood(F.lit(0), F.col("n"))
    cost = F.when(F.col("n") >= least, F.col("_d.f")[F.col("n")]).otherwise(alone)
    return out.select(*keys, "n", cost.alias("cost"), _years(F.col("places")).alias("breaks"), "places")


def mean_breaks(df: DataFrame, keys: Sequence[str], value: str = "articles", most: int = 5, trim: float = 0.15) -> DataFrame:
    """Least-squares breaks of the mean after Bai and Perron: per key and number of breaks ``m`` from 0 to ``most`` the partition of
    least squared error with segments of at least ``trim`` of the values: ``ssr, f, p_value`` (against no break), ``bic, breaks`` and
    ``best`` by bic (fewer breaks of equals). Series of under ten values have no rows."""
    series = _arrays(df, keys, value).where("n >= 10").withColumn("h", F.ceil(F.round(F.lit(trim) * F.col("n"), 9)).cast("int"))
    n, h = F.col("n"), F.col("h")
    never = F.lit(float("inf"))
    everywhere = F.sequence(F.lit(0), n)
    first = F.transform(everywhere, lambda t: F.when(t >= h, _squares(F.lit(0), t)).otherwise(never))
    start = F.struct(F.array(first).alias("g"), F.array(F.transform(everywhere, lambda t: F.lit(0))).alias("back"))

    def layer(acc: Column, m: Column) -> Column:
        before = acc["g"][m - 1]

        def best(t: Column) -> Column:
            tried = F.transform(F.when(t >= 2 * h, F.sequence(h, t - h)).otherwise(F.array().cast("array<int>")), lambda c: F.struct(F.round(before[c] + _squares(c, t), 9).alias("v"), c.alias("c")))
            found = F.array_min(tried)
            return F.struct(F.coalesce(found["v"], never).alias("v"), F.coalesce(found["c"], F.lit(0)).alias("c"))

        row = F.transform(everywhere, best)
        return F.struct(F.concat(acc["g"], F.array(F.transform(row, lambda r: r["v"]))).alias("g"), F.concat(acc["back"], F.array(F.transform(row, lambda r: r["c"]))).alias("back"))

    done = series.withColumn("_d", F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, layer)).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(most))))
    walk = F.struct(n.alias("at"), F.array().cast("array<int>").alias("cuts"))

    def back(acc: Column, k: Column) -> Column:
        cut = F.col("_d.back")[F.col("m") - k][acc["at"]]
        return F.struct(cut.alias("at"), F.concat(F.array(cut), acc["cuts"]).alias("cuts"))

    places = F.when(F.col("m") > 0, F.aggregate(F.sequence(F.lit(0), F.greatest(F.col("m") - 1, F.lit(0))), walk, back)["cuts"]).otherwise(F.array().cast("array<int>"))
    ssr, none, m = F.col("_d.g")[F.col("m")][n], F.col("_d.g")[0][n], F.col("m")
    rows = done.select(*keys, "n", "m", ssr.alias("ssr"), none.alias("_none"), places.alias("places"), "p").where(F.coalesce(F.col("ssr"), never) < never)
    df2 = F.col("n") - m - 1
    f = F.when((m > 0) & (df2 > 0) & (F.col("ssr") > 1e-9), ((F.col("_none") - F.col("ssr")) / m) / (F.col("ssr") / df2))
    bic = F.when(F.col("ssr") > 1e-9, F.col("n") * F.log(F.col("ssr") / F.col("n")) + (2 * m + 1) * F.log(F.col("n").cast("double")))
    out = rows.withColumns({"f": f, "bic": bic}).withColumn("p_value", f_tail(F.col("f"), m, df2))
    exact = F.when(F.col("bic").isNull(), 0).otherwise(1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(exact, F.round("bic", 9), "m"))
    return out.select(*keys, "m", "ssr", "f", "p_value", "bic", _years(F.col("places")).alias("breaks"), (place == 1).alias("best"))


def binary_segmentation(df: DataFrame, keys: Sequence[str], value: str = "articles", least: int = 5, most: int = 5) -> DataFrame:
    """Per key up to ``most`` breaks: ``break_no, year, gain``. Segments are split level by level, from the left, each where
    n1 ln(mse1 + 1) + n2 ln(mse2 + 1) is least, with over ``least`` values before the cut and at least ``least`` after it; a segment
    of at most 2 ``least`` values stays whole. ``gain`` is what the split takes off n ln(mse + 1)."""
    order = Window.partitionBy(*keys).orderBy("year")
    rows = df.where(F.col(value).isNotNull()).select(*keys, "year", F.col(value).cast("double").alias("y"), F.row_number().over(order).alias("i")).withColumn("seg", F.lit(1).cast("long"))
    found: DataFrame | None = None
    for level in range(most):
        own = Window.partitionBy(*keys, "seg")
        run = own.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
        y = F.col("y") - F.avg("y").over(own)
        sums = rows.withColumn("_y", y).withColumns({"_k": F.count("*").over(run), "_n": F.count("*").over(own), "_s": F.sum("_y").over(run), "_q": F.sum(F.col("_y") * F.col("_y")).over(run), "_qq": F.sum(F.col("_y") * F.col("_y")).over(own)})
        k, n, s = F.col("_k"), F.col("_n"), F.col("_s")
        left = F.greatest(F.lit(0.0), F.col("_q") / k - s * s / (k * k))
        right = F.greatest(F.lit(0.0), (F.col("_qq") - F.col("_q")) / (n - k) - s * s / ((n - k) * (n - k)))
        cost = k * F.log(left + 1) + (n - k) * F.log(right + 1)
        tried = sums.where((n > 2 * least) & (k > least) & (n - k >= least)).withColumn("_c", F.round(cost, 9))
        best = tried.groupBy(*keys, "seg").agg(F.min_by(F.struct("i", "year", (n * F.log(F.col("_qq") / n + 1) - F.col("_c")).alias("gain")), F.struct("_c", "i")).alias("_b"))
        made = best.select(*keys, "seg", F.lit(level).alias("level"), F.col("_b.i").alias("cut"), F.col("_b.year").alias("year"), F.col("_b.gain").alias("gain"))
        found = made if found is None else found.unionByName(made)
        cut = made.select(*keys, "seg", "cut")
        halves = rows.join(cut, [*keys, "seg"])
        rows = halves.withColumn("seg", 2 * F.col("seg") + (F.col("i") > F.col("cut")).cast("long")).drop("cut")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("level", "cut"))
    return found.withColumn("break_no", place).where(F.col("break_no") <= most).select(*keys, "break_no", "year", "gain")


def change_points(df: DataFrame, keys: Sequence[str], tolerance: int = 2) -> DataFrame:
    """Breaks of four methods (``pelt``, ``binseg``, ``cusum``, ``pettitt``) with ``votes``, how many methods have one within
    ``tolerance`` years, and ``consensus`` for two and more. Values are the column ``articles``."""
    parts = [
        optimal_partition(df, keys).select(*keys, F.explode("breaks").alias("year"), F.lit("pelt").alias("method")),
        binary_segmentation(df, keys).select(*keys, "year", F.lit("binseg").alias("method")),
        cusum(df, keys).where("statistic > 1.143").select(*keys, "year", F.lit("cusum").alias("method")),
        pettitt(df, keys).where("p_value < 0.05").select(*keys, "year", F.lit("pettitt").alias("method")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    other = every.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("year").alias("_year"), F.col("method").alias("_method"))
    near = F.abs(F.col("year") - F.col("_year")) <= tolerance
    for k in keys:
        near = near & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return every.join(other, near).groupBy(*keys, "method", "year").agg(F.count_distinct("_method").alias("votes")).withColumn("consensus", F.col("votes") >= 2)


def phase(slope: Column, mean: Column) -> Column:
    """rapid_growth over .10 of the mean a year, growth over .03, decline under -.03, else stagnation; unknown without a slope."""
    relative = F.when(F.abs(mean) > 1e-12, slope / mean).otherwise(slope)
    return F.when(relative.isNull(), "unknown").when(relative > 0.10, "rapid_growth").when(relative > 0.03, "growth").when(relative < -0.03, "decline").otherwise("stagnation")


def segment_phases(df: DataFrame, keys: Sequence[str], breaks: DataFrame) -> DataFrame:
    """Segments between ``breaks`` (``keys`` and the array column ``breaks`` of last years): ``segment, start_year, end_year, n, mean,
    sd, slope, r2, growth_rate`` (percent of the mean a year) and ``phase``."""
    own = breaks.select(*(F.col(k).alias(f"_{k}") for k in keys), "breaks")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    placed = df.join(own, same, "left") if keys else df.crossJoin(F.broadcast(own))
    numbered = placed.withColumn("segment", 1 + F.coalesce(F.size(F.filter("breaks", lambda b: b < F.col("year"))), F.lit(0)))
    sums = numbered.groupBy(*keys, "segment").agg(F.min("year").alias("start_year"), F.max("year").alias("end_year"), F.count("articles").alias("n"), F.avg("articles").alias("mean"), F.stddev_samp("articles").alias("sd"))
    lines = trend(numbered, [*keys, "segment"], "year", "articles").select(*keys, "segment", "slope", "r2")
    joined = sums.join(lines, [*keys, "segment"], "left")
    return joined.withColumn("growth_rate", F.when(F.col("mean") > 0, 100 * ratio(F.col("slope"), F.col("mean")))).withColumn("phase", phase(F.col("slope"), F.col("mean")))
