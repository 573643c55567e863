"""How well distributions fit: Kolmogorov-Smirnov against five families and between samples, Anderson-Darling, chi-square, and the
scan for the least value of a power law.

Everything works on the histogram of values with running counts (``stats.cumulated``), so equal values are one row, whatever
their number. Only the parameters of a group meet its values. Null values are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import chi_square_tail, gamma_lower, gamma_shape, kolmogorov_tail
from ..functions.stats import cumulated, normal_cdf
from .primitives import ratio

#: Euler's constant.
EULER = 0.5772156649015329
FAMILIES = ("normal", "log_normal", "exponential", "gamma", "weibull")


def _met(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``'s row of its group."""
    if not groups:
        return left.crossJoin(F.broadcast(right))
    named = right.select(*(F.col(g).alias(f"_{g}") for g in groups), *(c for c in right.columns if c not in groups))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups))
    return left.join(named, same).drop(*(f"_{g}" for g in groups))


def _met_at(left: DataFrame, right: DataFrame, groups: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right``'s row of its group and value ``x``."""
    named = right.withColumnsRenamed({c: f"_{c}" for c in (*groups, "x")})
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups), F.col("x") == F.col("_x"))
    return left.join(named, same).drop("_x", *(f"_{g}" for g in groups))


def fitted_families(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per group ``n`` and, per family, parameters ``first`` and ``second`` of the values over 0.

    normal (mean, deviation), log_normal (of logs), exponential (rate) and gamma (shape, rate) by most likelihood, weibull (shape,
    scale) by the moments of logs. Without spread the families of two parameters have nulls.
    """
    x = F.col(value).cast("double")
    sums = df.where(x > 0).groupBy(*groups).agg(F.count("*").alias("n"), F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"), F.avg(F.log(x)).alias("_ml"), F.stddev_pop(F.log(x)).alias("_sl"), F.stddev_samp(F.log(x)).alias("_sn")).where("n > 0")
    spread = F.col("_s") > 1e-12
    shape = gamma_shape(F.log("_m") - F.col("_ml"))
    slope = math.pi / (F.col("_sn") * math.sqrt(6))
    family = lambda name, a, b: F.struct(F.lit(name).alias("family"), a.alias("first"), b.cast("double").alias("second"))
    rows = F.array(
        family("normal", F.col("_m"), F.when(spread, F.col("_s"))),
        family("log_normal", F.col("_ml"), F.when(spread, F.col("_sl"))),
        family("exponential", 1 / F.col("_m"), F.lit(None)),
        family("gamma", F.when(spread, shape), F.when(spread, shape / F.col("_m"))),
        family("weibull", F.when(spread, slope), F.when(spread, F.exp(F.col("_ml") + EULER / slope))),
    )
    return sums.select(*groups, "n", F.explode(rows).alias("e")).select(*groups, "n", "e.*")


def distribution(family: Column, x: Column, first: Column, second: Column) -> Column:
    """The distribution function of a family at ``x`` over 0."""
    return (
        F.when(family == "normal", normal_cdf((x - first) / second))
        .when(family == "log_normal", normal_cdf((F.log(x) - first) / second))
        .when(family == "exponential", 1 - F.exp(-first * x))
        .when(family == "gamma", gamma_lower(first, second * x))
        .when(family == "weibull", 1 - F.exp(-F.pow(x / second, first)))
    )


def ks_families(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per group and family ``n, first, second, statistic, p_value``: the greatest distance between the distribution of the values over 0
    and the fitted one. Groups of under ten values have no rows. p takes the parameters as given, as the test is read
    commonly; fitted ones make it too large."""
    known = df.where(F.col(value) > 0)
    placed = cumulated(known, list(groups), value)
    fits = fitted_families(known, groups, value).where("n >= 10").withColumnRenamed("n", "rows")
    met = _met(placed, fits, groups)
    f = distribution(F.col("family"), F.col("x"), F.col("first"), F.col("second"))
    far = met.withColumn("_f", f).withColumn("_d", F.greatest(F.abs((F.col("before") + F.col("n")) / F.col("total") - F.col("_f")), F.abs(F.col("before") / F.col("total") - F.col("_f"))))
    out = far.groupBy(*groups, "family", "first", "second").agg(F.max("rows").alias("n"), F.max("_d").alias("statistic"))
    return out.select(*groups, "family", "n", "first", "second", "statistic", kolmogorov_tail(F.col("statistic"), F.col("n")).alias("p_value"))


def ks_two_samples(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Rows where ``first`` holds against the rest (null: neither): ``n1, n2, statistic, p_value``."""
    sided = df.where(F.col(value).isNotNull() & first.isNotNull()).select(F.col(value).cast("double").alias("x"), first.alias("g"))
    both = cumulated(sided, [], "x").select("x", "n", "before")
    ones = cumulated(sided.withColumn("w", F.col("g").cast("double")), [], "x", F.col("w")).select(F.col("x").alias("_x"), F.col("n").alias("n1"), F.col("before").alias("b1"), F.col("total").alias("t1"))
    met = both.join(ones, F.col("x") == F.col("_x")).crossJoin(F.broadcast(sided.agg(F.count("*").cast("double").alias("t"))))
    t2 = F.col("t") - F.col("t1")
    gap = F.abs(ratio(F.col("b1") + F.col("n1"), F.col("t1")) - ratio(F.col("before") + F.col("n") - F.col("b1") - F.col("n1"), t2))
    out = met.agg(F.max("t1").cast("long").alias("n1"), F.max(t2).cast("long").alias("n2"), F.max(gap).alias("statistic"))
    return out.withColumn("p_value", kolmogorov_tail(F.col("statistic"), F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))))


def anderson_darling(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per group ``n, statistic, adjusted, p_value`` against the normal with the group's mean and deviation (n - 1), p by Stephens'
    formulas. Groups of under eight values have no rows; without spread there is no statistic."""
    known = df.where(F.col(value).isNotNull())
    sums = known.groupBy(*groups).agg(F.count("*").cast("double").alias("_n"), F.avg(F.col(value).cast("double")).alias("_m"), F.stddev_samp(F.col(value).cast("double")).alias("_s")).where("_n >= 8")
    met = _met(cumulated(known, list(groups), value), sums, groups)
    z = F.when(F.col("_s") > 1e-12, (F.col("x") - F.col("_m")) / F.col("_s"))
    b, n, t = F.col("before"), F.col("n"), F.col("total")
    part = n * (2 * b + n) * F.log(normal_cdf(z)) + n * (2 * (t - b) - n) * F.log(normal_cdf(-z))
    out = met.groupBy(*groups).agg(F.max("_n").alias("n"), F.sum(part).alias("_sum")).withColumn("statistic", -F.col("n") - F.col("_sum") / F.col("n"))
    out = out.withColumn("adjusted", F.col("statistic") * (1 + 0.75 / F.col("n") + 2.25 / (F.col("n") * F.col("n"))))
    a = F.col("adjusted")
    p = F.when(a < 0.2, 1 - F.exp(-13.436 + 101.14 * a - 223.73 * a * a)).when(a < 0.34, 1 - F.exp(-8.318 + 42.796 * a - 59.938 * a * a)).when(a < 0.6, F.exp(0.9177 - 4.279 * a - 1.38 * a * a)).when(a < 10, F.exp(1.2937 - 5.709 * a + 0.0186 * a * a)).when(a >= 10, 3.7e-24)
    return out.select(*groups, F.col("n").cast("long").alias("n"), "statistic", "adjusted", p.alias("p_value"))


def chi_square_fit(df: DataFrame, category: str, expected: DataFrame | None = None) -> DataFrame:
    """Counts of categories against equal ones, or against ``expected`` (``category`` and ``weight``, in any unit): ``n, statistic, df,
    p_value``. Categories of ``expected`` that do not occur count as 0; null ones and those it lacks are left out."""
    counted = df.where(F.col(category).isNotNull()).groupBy(category).agg(F.count("*").alias("_n"))
    weighted = counted.withColumn("_w", F.lit(1.0)) if expected is None else expected.select(category, F.col("weight").cast("double").alias("_w")).join(counted, category, "left").fillna(0, ["_n"])
    sums = weighted.agg(F.sum("_n").cast("double").alias("_all"), F.sum("_w").alias("_ww"), F.count("*").alias("_k"))
    share = F.col("_w") / F.col("_ww") * F.col("_all")
    out = weighted.crossJoin(F.broadcast(sums)).agg(F.max("_all").cast("long").alias("n"), F.sum(F.pow(F.col("_n") - share, 2) / share).alias("statistic"), (F.max("_k") - 1).alias("df"))
    return out.withColumn("p_value", F.when(F.col("df") > 0, chi_square_tail(F.col("statistic"), F.col("df").cast("double"))))


def power_law_scan(df: DataFrame, value: str, groups: Sequence[str] = (), candidates: int = 100, least: int = 10) -> DataFrame:
    """Per group and cutoff ``x_min``: ``n_tail``, the exponent ``alpha`` of most likelihood from it on, the distance ``ks`` and ``best``
    (least distance, the smaller of equals).

    Cutoffs are all distinct values over 0, or ``candidates`` of them evenly spread by rank where there are more; tails of
    under ``least`` values, and of a single value, are left out. One table of running counts serves all cutoffs: the tail from a
    cutoff is the rest of the histogram, so every cutoff takes one sum and one maximum over it, combined map-side.
    """
    placed = cumulated(df.where(F.col(value) > 0), list(groups), value)
    ranked = placed.select(*groups, "x", "before", "total", (F.col("total") - F.col("before")).alias("n_tail")).where(F.col("n_tail") >= least)
    order = cumulated(ranked, list(groups), "x").select(*groups, "x", F.col("before").alias("_i"), F.col("total").alias("_k"))
    turn = lambda i: F.floor(i * candidates / F.col("_k"))
    chosen = _met_at(ranked, order, groups).where((F.col("_k") <= candidates) | (F.col("_i") == 0) | (turn(F.col("_i")) > turn(F.col("_i") - 1)))
    chosen = chosen.select(*groups, F.col("x").alias("x_min"), "n_tail", F.col("before").alias("_skip"))
    named = chosen.select(*(F.col(g).alias(f"_{g}") for g in groups), "x_min", "n_tail", "_skip")
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups), F.col("x") >= F.col("x_min"))
    meet = lambda right: placed.join(right if groups else F.broadcast(right), same).drop(*(f"_{g}" for g in groups))
    tails = meet(named)
    logs = tails.groupBy(*groups, "x_min").agg(F.max("n_tail").alias("n_tail"), F.max("_skip").alias("_skip"), F.sum(F.col("n") * F.log(F.col("x") / F.col("x_min"))).alias("_l")).where("_l > 1e-12")
    fits = logs.withColumn("alpha", 1 + F.col("n_tail") / F.col("_l"))
    cut = fits.select(*(F.col(g).alias(f"_{g}") for g in groups), "x_min", "n_tail", "_skip", "alpha")
    far = meet(cut)
    seen = (F.col("before") + F.col("n") - F.col("_skip")) / F.col("n_tail")
    d = F.abs(seen - (1 - F.pow(F.col("x_min") / F.col("x"), F.col("alpha") - 1)))
    out = far.groupBy(*groups, "x_min", "n_tail", "alpha").agg(F.max(d).alias("ks"))
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(F.round("ks", 9), "x_min"))
    return out.select(*groups, "x_min", F.col("n_tail").cast("long").alias("n_tail"), "alpha", "ks", (place == 1).alias("best"))


def rank_size_slope(df: DataFrame, value: str, least: int = 50) -> DataFrame:
    """Slope of ln value on ln rank (from the largest; equal values follow each other) over values over 0: ``n, slope, r2`` and
    ``power_law``, whether it lies within a half of -1; null for under ``least`` values.

    Ranks come from the histogram's running counts, a row a rank, so no window orders all values.
    """
    placed = cumulated(df.where(F.col(value) > 0), [], value)
    first = (F.col("total") - F.col("before") - F.col("n")).cast("long") + 1
    ranks = placed.select("x", "total", F.explode(F.sequence(first, first + F.col("n").cast("long") - 1)).alias("rank"))
    sums = ranks.agg(F.count("*").alias("n"), F.regr_slope(F.log("x"), F.log("rank")).alias("slope"), F.regr_r2(F.log("x"), F.log("rank")).alias("r2"))
    enough = F.col("n") >= least
    return sums.select("n", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, F.col("r2")).alias("r2"), F.when(enough, F.abs(F.col("slope") + 1) <= 0.5).alias("power_law"))
