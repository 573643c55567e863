"""Distribution functions as column expressions, and corrections for many tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .distributions import normal_quantile
from .numbers import steady

#: Coefficients of the complementary error function's rational approximation (Numerical Recipes, relative error 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc(x: Column) -> Column:
    """Complementary error function."""
    size = F.abs(x)
    t = 1.0 / (1.0 + 0.5 * size)
    power = F.lit(_ERFC[-1])
    for c in _ERFC[-2::-1]:
        power = F.lit(c) + t * power
    tail = t * F.exp(-size * size + power)
    return F.when(x >= 0, tail).otherwise(2 - tail)


def normal_cdf(z: Column) -> Column:
    return 0.5 * erfc(-z / math.sqrt(2))


def normal_two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), erfc(F.abs(z) / math.sqrt(2)))


def chi_square_tail(x: Column, df: Column) -> Column:
    """Upper tail of chi-square: the finite series for whole ``df`` up to 200, else Wilson and Hilferty's approximation."""
    half, whole = x / 2, df.cast("int")
    terms = F.greatest(F.floor(whole / 2), F.lit(1)).cast("int")
    start = F.struct(F.lit(1.0).cast("double").alias("term"), F.lit(0.0).cast("double").alias("sum"))

    def series(first: Column, step: float) -> Column:
        """Sum of ``whole / 2`` (rounded down) terms: ``first``, each next one times half / (place + step)."""
        def add(acc: Column, i: Column) -> Column:
            term = F.when(i == 1, first).otherwise(acc["term"] * half / (i - 1 + step))
            on = i <= F.floor(whole / 2)
            return F.struct(F.when(on, term).otherwise(acc["term"]).alias("term"), F.when(on, acc["sum"] + term).otherwise(acc["sum"]).alias("sum"))

        return F.aggregate(F.sequence(F.lit(1), terms), start, add)["sum"]

    even = F.exp(-half) * series(F.lit(1.0), 0.0)
    odd = erfc(F.sqrt(half)) + F.exp(-half) * series(F.sqrt(half) * (2 / math.sqrt(math.pi)), 0.5)
    h = 2.0 / (9.0 * df)
    rough = 1 - normal_cdf((F.pow(x / df, 1.0 / 3) - (1 - h)) / F.sqrt(h))
    exact = F.when(whole % 2 == 0, even).otherwise(odd)
    return F.when(x <= 0, F.lit(1.0)).when((df == whole) & (df <= 200), F.least(F.lit(1.0), exact)).otherwise(rough)


def benjamini_hochberg(tests: DataFrame, p: str = "p_value", groups: tuple[str, ...] = ()) -> DataFrame:
    """``tests`` with ``p_bh``, ``p_holm`` and ``p_bonferroni``; nulls stay null and do not count. One row a hypothesis."""
    own = Window.partitionBy(*groups, F.col(p).isNull())
    up = own.orderBy(p)
    m, rank = F.count(p).over(own), F.row_number().over(up)
    ranked = tests.withColumns({"_m": m, "_r": rank})
    back = own.orderBy(F.desc(p), F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
    forth = own.orderBy(p, "_r").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(p)
    out = ranked.withColumns(
        {
            "p_bh": F.when(x.isNotNull(), F.least(F.lit(1.0), F.min(x * F.col("_m") / F.col("_r")).over(back))),
            "p_holm": F.when(x.isNotNull(), F.least(F.lit(1.0), F.max(x * (F.col("_m") - F.col("_r") + 1)).over(forth))),
            "p_bonferroni": F.when(x.isNotNull(), F.least(F.lit(1.0), x * F.col("_m"))),
        }
    )
    return out.drop("_m", "_r")


def decision(p: Column, alpha: float = 0.05) -> Column:
    """reject, fail_to_reject, or inconclusive where there is no p."""
    return F.when(p.isNull(), "inconclusive").when(p <= alpha, "reject").otherwise("fail_to_reject")


def claim_strength(p: Column) -> Column:
    """strong under .01, moderate under .05, weak under .10, else none."""
    return F.when(p < 0.01, "strong").when(p < 0.05, "moderate").when(p < 0.10, "weak").otherwise("none")


def average_ranks(df: DataFrame, value: str, groups: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """Ranks from 1 with ties averaged, inside ``groups``, through the histogram of values (``numbers.steady``)."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, steady(df, value).alias("_x")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*groups).orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counted.select(*(F.col(g).alias(f"_{g}") for g in groups), "_x", (before + (F.col("_n") + 1) / 2).alias(out))
    same = steady(df, value) == F.col("_x")
    for g in groups:
        same = same & (F.col(g) == F.col(f"_{g}"))
    return df.join(places, same, "left").drop("_x", *(f"_{g}" for g in groups))


#: Bands of values inside which running counts are made; bands hold about equally many distinct values.
BANDS = 64


def cumulated(df: DataFrame, groups: tuple[str, ...] | list[str], value: str, count: Column | None = None) -> DataFrame:
    """``groups``, ``x``, ``n``, and of each distinct value: ``before`` and ``sum_before`` (rows below it and their sum), ``total`` and
    ``sum_total``. ``count`` weights rows (1 by default); nulls are left out.

    Running sums go inside bands of values, cut at percentiles of the group's distinct values, and bands go on from each other,
    so no window holds all values of a group.
    """
    weight = F.lit(1.0) if count is None else count.cast("double")
    counted = df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).cast("double").alias("x")).agg(F.sum(weight).alias("n"))
    cuts = counted.groupBy(*groups).agg(F.percentile_approx("x", [k / BANDS for k in range(1, BANDS)], 1000).alias("_cuts"), F.sum("n").alias("total"), F.sum(F.col("x") * F.col("n")).alias("sum_total"))
    own = cuts.select(*(F.col(g).alias(f"_{g}") for g in groups), "_cuts", "total", "sum_total")
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    met = counted.join(own, same) if groups else counted.crossJoin(F.broadcast(own))
    banded = met.withColumn("_band", F.size(F.filter("_cuts", lambda c: c < F.col("x")))).drop("_cuts", *(f"_{g}" for g in groups))
    before = Window.unboundedPreceding, -1
    sums = banded.groupBy(*groups, "_band").agg(F.sum("n").alias("_n"), F.sum(F.col("x") * F.col("n")).alias("_s"))
    over_bands = Window.partitionBy(*groups).orderBy("_band").rowsBetween(*before)
    base = sums.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col("_band").alias("_b"), F.coalesce(F.sum("_n").over(over_bands), F.lit(0.0)).alias("_n"), F.coalesce(F.sum("_s").over(over_bands), F.lit(0.0)).alias("_s"))
    inside = Window.partitionBy(*groups, "_band").orderBy("x").rowsBetween(*before)
    run = banded.withColumns({"_below": F.coalesce(F.sum("n").over(inside), F.lit(0.0)), "_sum": F.coalesce(F.sum(F.col("x") * F.col("n")).over(inside), F.lit(0.0))})
    out = run.join(base, same & (F.col("_band") == F.col("_b")))
    return out.select(*groups, "x", "n", (F.col("_n") + F.col("_below")).alias("before"), (F.col("_s") + F.col("_sum")).alias("sum_before"), "total", "sum_total")


def rank_table(counted: DataFrame, value: str, n: str, out: str) -> DataFrame:
    """``value`` and its average rank ``out`` in a table of values with counts ``n``; one row a distinct value."""
    of = counted.groupBy(value).agg(F.sum(n).alias("_t"))
    before = F.coalesce(F.sum("_t").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return of.select(value, "_t", (before + (F.col("_t") + 1) / 2).alias(out))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman's rho with average ranks, n, and the large-sample z of rho * sqrt(n - 1). Rows are counted by pair of values
    first, so a value that many rows have is one row of the joins; values equal to nine places are ties."""
    pairs = df.select(steady(df, x).alias("x"), steady(df, y).alias("y")).dropna().groupBy("x", "y").agg(F.count("*").alias("c"))
    both = pairs.join(rank_table(pairs, "x", "c", "rx").drop("_t"), "x").join(rank_table(pairs, "y", "c", "ry").drop("_t"), "y")
    c, rx, ry = F.col("c"), F.col("rx"), F.col("ry")
    sums = both.agg(F.sum("c").alias("n"), F.sum(c * rx).alias("_x"), F.sum(c * ry).alias("_y"), F.sum(c * rx * rx).alias("_xx"), F.sum(c * ry * ry).alias("_yy"), F.sum(c * rx * ry).alias("_xy"))
    n = F.col("n").cast("double")
    spread = F.sqrt((n * F.col("_xx") - F.col("_x") * F.col("_x")) * (n * F.col("_yy") - F.col("_y") * F.col("_y")))
    rho = F.when(spread > 0, (n * F.col("_xy") - F.col("_x") * F.col("_y")) / spread)
    return sums.select(rho.alias("rho"), F.coalesce("n", F.lit(0)).alias("n")).withColumn("z", F.col("rho") * F.sqrt(F.col("n") - 1.0))


def _tie_sum(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum(F.col("_t").cast("double") * F.col("_t") * F.col("_t") - F.col("_t")).alias("_ties"))


def rank_sum(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Wilcoxon rank-sum (Mann-Whitney) of rows where ``first`` holds against the rest: U, tie-corrected z, p. Ranks weight the
    histogram of values; no row meets its rank."""
    counted = df.select(F.col(value).alias("v"), first.alias("g")).dropna().groupBy("v").agg(F.count_if("g").alias("f"), F.count("*").alias("c"))
    ranks = rank_table(counted, "v", "c", "rank")
    sums = counted.join(ranks, "v").agg(F.sum("f").alias("n1"), F.sum(F.col("c") - F.col("f")).alias("n2"), F.sum(F.col("f") * F.col("rank")).alias("_w")).crossJoin(_tie_sum(ranks))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_w") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.when(sd > 0, (u - n1 * n2 / 2) / sd)
    return sums.select("n1", "n2", u.alias("u"), z.alias("z"), normal_two_sided(z).alias("p_value"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H over groups with tie correction, degrees of freedom, p and epsilon squared, from the histogram of
    (value, group)."""
    counted = df.select(F.col(value).alias("v"), F.col(group).alias("g")).dropna().groupBy("v", "g").agg(F.count("*").alias("c"))
    ranks = rank_table(counted, "v", "c", "rank")
    sums = counted.join(ranks, "v").groupBy("g").agg(F.sum(F.col("c") * F.col("rank")).alias("r"), F.sum("c").alias("k")).agg(F.sum(F.col("r") * F.col("r") / F.col("k")).alias("_s"), F.sum("k").alias("n"), (F.count("*") - 1).alias("df"))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))
    return sums.crossJoin(_tie_sum(ranks)).select("n", "df", h.alias("h"), chi_square_tail(h, F.col("df").cast("double")).alias("p_value"), (h / (n - 1)).alias("epsilon_squared"))


def benford(df: DataFrame, value: str) -> DataFrame:
    """First digits of positive values: observed and expected shares and the chi-square over all (the same in each row)."""
    digit = F.substring(F.regexp_replace(F.format_string("%.15e", F.col(value).cast("double")), "-", ""), 1, 1).cast("int")
    counted = df.where(F.col(value) > 0).groupBy(digit.alias("digit")).agg(F.count("*").alias("n"))
    digits = df.sparkSession.range(1, 10).select(F.col("id").cast("int").alias("digit"))
    every = Window.partitionBy()
    joined = digits.join(counted, "digit", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    expected = F.log10(1 + 1.0 / F.col("digit"))
    total = F.sum("n").over(every)
    gap = F.pow(F.col("n") - expected * total, 2) / (expected * total)
    return joined.select("digit", "n", (F.col("n") / total).alias("observed"), expected.alias("expected"), F.sum(gap).over(every).alias("chi_square"))


def levene(df: DataFrame, value: str, group: str) -> DataFrame:
    """Brown-Forsythe: F of absolute deviations from group medians, with its degrees of freedom."""
    medians = df.groupBy(group).agg(F.median(value).alias("_m"))
    spread = df.join(medians, group).select(group, F.abs(F.col(value) - F.col("_m")).alias("d")).dropna()
    of_groups = spread.groupBy(group).agg(F.count("*").alias("n"), F.avg("d").alias("m"), F.sum(F.col("d") * F.col("d")).alias("q"))
    sums = of_groups.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_b"), F.sum(F.col("n") * F.col("m")).alias("_t"), F.sum("q").alias("_q"))
    between = (F.col("_b") - F.col("_t") * F.col("_t") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("_q") - F.col("_b")) / (F.col("n") - F.col("k"))
    return sums.select((F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"), F.when(within > 0, between / within).alias("f"))


def poisson(mean: Column, u: Column, z: Column) -> Column:
    """A Poisson draw from a uniform ``u``: the quantile by summing the distribution for means up to 50, and by the rounded
    normal one from ``z`` beyond."""
    most = (mean + 9 * F.sqrt(mean) + 10).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("below"), F.lit(0).alias("k"))

    def step(acc: Column, j: Column) -> Column:
        below = acc["below"] + acc["p"]
        return F.struct((acc["p"] * mean / j).alias("p"), below.alias("below"), (acc["k"] + (u > below).cast("int")).alias("k"))

    few = F.aggregate(F.sequence(F.lit(1), F.least(most, F.lit(130))), start, step)["k"]
    return F.when(mean <= 50, few.cast("double")).otherwise(F.greatest(F.lit(0.0), F.round(mean + F.sqrt(mean) * z)))


def bootstrap_draws(df: DataFrame, value: str, rounds: int = 500, seed: int = 42) -> DataFrame:
    """``r`` (1 to ``rounds``), ``x`` and ``w``: how often each distinct value is drawn in a round of a Poisson bootstrap.

    Each row counts a Poisson(1) number of times, so n equal rows count Poisson(n) times: a row of the histogram for them
    all. Draws follow from a hash of value and round: a run repeats, every row takes part and nothing is gathered.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("x")).agg(F.count("*").cast("double").alias("n"))
    unit = lambda salt: (F.pmod(F.xxhash64("x", "r", F.lit(seed + salt)), F.lit(1 << 30)) + 0.5) / F.lit(float(1 << 30))
    normal = F.sqrt(-2 * F.log(unit(0))) * F.cos(2 * math.pi * unit(1))
    drawn = counted.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    return drawn.select("r", "x", poisson(F.col("n"), unit(2), normal).alias("w"))


def interval(estimates: DataFrame, column: str, level: float = 0.95) -> DataFrame:
    """Percentile interval ``low`` to ``high`` of ``column`` over rounds."""
    tail = (1 - level) / 2
    return estimates.agg(F.percentile(column, F.lit(tail)).alias("low"), F.percentile(column, F.lit(1 - tail)).alias("high"))


def bootstrap_mean(df: DataFrame, value: str, rounds: int = 500, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The mean and its percentile interval by ``bootstrap_draws``."""
    means = bootstrap_draws(df, value, rounds, seed).groupBy("r").agg((F.sum(F.col("x") * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    return df.agg(F.avg(F.col(value).cast("double")).alias("estimate")).crossJoin(interval(means, "mean", level))


def bootstrap_proportion(df: DataFrame, test: Column, rounds: int = 500, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The share of rows (with a non-null test) that pass, and its percentile interval."""
    return bootstrap_mean(df.select(test.cast("double").alias("x")), "x", rounds, level, seed)


def bootstrap_median(df: DataFrame, value: str, rounds: int = 500, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The median and its percentile interval: in each round the least value at which half the draws are reached."""
    drawn = bootstrap_draws(df, value, rounds, seed).where("w > 0")
    up = Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    reached = drawn.withColumn("c", F.sum("w").over(up)).withColumn("all", F.sum("w").over(Window.partitionBy("r")))
    low = F.min(F.when(2 * F.col("c") >= F.col("all"), F.col("x")))
    high = F.min(F.when(2 * F.col("c") > F.col("all"), F.col("x")))
    medians = reached.groupBy("r").agg(((low + high) / 2).alias("median"))
    return df.agg(F.median(F.col(value).cast("double")).alias("estimate")).crossJoin(interval(medians, "median", level))


def _gini(placed: DataFrame, groups: list[str]) -> DataFrame:
    """Gini of ``cumulated`` values of 0 and more; 0 for a zero total."""
    rank_sum = F.col("n") * F.col("before") + F.col("n") * (F.col("n") + 1) / 2
    sums = placed.groupBy(*groups).agg(F.max("total").alias("_n"), F.max("sum_total").alias("_s"), F.sum(F.col("x") * rank_sum).alias("_q"))
    value = F.when(F.col("_s") > 0, 2 * F.col("_q") / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n")).otherwise(0.0)
    return sums.select(*groups, value.alias("v"))


def bootstrap_gini(df: DataFrame, value: str, rounds: int = 500, level: float = 0.95, seed: int = 42) -> DataFrame:
    """The Gini coefficient (of values of 0 and more) and its percentile interval."""
    drawn = bootstrap_draws(df, value, rounds, seed).where("w > 0")
    estimates = _gini(cumulated(drawn, ["r"], "x", F.col("w")), ["r"])
    return _gini(cumulated(df, [], value), []).withColumnRenamed("v", "estimate").crossJoin(interval(estimates, "v", level))


#: Statistics that ``bca`` knows.
BCA = ("mean", "median", "gini")


def _median(placed: DataFrame, groups: list[str]) -> DataFrame:
    """Median of ``cumulated`` values with whole weights."""
    reached, all_ = F.col("before") + F.col("n"), F.col("total")
    low, high = F.min(F.when(2 * reached >= all_, F.col("x"))), F.min(F.when(2 * reached > all_, F.col("x")))
    return placed.groupBy(*groups).agg(((low + high) / 2).alias("v"))


def _left_out(placed: DataFrame, statistic: str) -> DataFrame:
    """``n`` and ``j``: the statistic without one row of each distinct value, in closed form."""
    x, n, before, total, s = (F.col(c) for c in ("x", "n", "before", "total", "sum_total"))
    if statistic == "mean":
        return placed.select("n", ((s - x) / F.nullif(total - 1, F.lit(0.0))).alias("j"))
    if statistic == "gini":
        whole = placed.agg(F.sum(x * (n * before + n * (n + 1) / 2)).alias("_q"))
        ranked = F.col("_q") - x * (before + 1) - (s - F.col("sum_before") - x)
        m, left = total - 1, s - x
        return placed.crossJoin(F.broadcast(whole)).select("n", F.when(left > 0, 2 * ranked / (m * left) - (m + 1) / m).otherwise(0.0).alias("j"))
    at = lambda k: F.min(F.when(before + n >= k, x))  # noqa: E731  the k-th smallest value
    half = F.floor(total / 2)
    middle = placed.groupBy("total").agg(at(half).alias("_a"), at(half + 1).alias("_b"), at(half + 2).alias("_c")).select(*(F.col(c) for c in ("_a", "_b", "_c")))
    met = placed.crossJoin(F.broadcast(middle))
    a, b, c = F.col("_a"), F.col("_b"), F.col("_c")
    odd = total % 2 == 1
    lower = F.greatest(F.lit(0.0), F.least(n, half - before))
    centre = F.when(odd & (before <= half) & (before + n > half), 1.0).otherwise(0.0)
    parts = F.array(
        F.struct(lower.alias("n"), F.when(odd, (b + F.coalesce(c, b)) / 2).otherwise(b).alias("j")),
        F.struct(centre.alias("n"), ((F.coalesce(a, b) + F.coalesce(c, b)) / 2).alias("j")),
        F.struct((n - lower - centre).alias("n"), F.when(odd, (a + b) / 2).otherwise(a).alias("j")),
    )
    return met.select(F.explode(parts).alias("e")).select("e.n", "e.j").where("n > 0")


def bca(df: DataFrame, value: str, statistic: str = "mean", rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Bias-corrected and accelerated interval of the ``mean``, ``median`` or ``gini``: ``estimate, low, high, bias_z, acceleration``.

    Rounds are Poisson bootstraps of the histogram. Values of the statistic without one row are known in closed form for every
    distinct value, so the acceleration takes all rows and draws none. Bounds interpolate between the sorted rounds, which are
    all that is gathered. Without spread in the left-out values the acceleration is 0; below two rows the interval is null.
    """
    if statistic not in BCA:
        raise ValueError(f"unknown statistic {statistic!r}")
    placed = cumulated(df, [], value)
    drawn = cumulated(bootstrap_draws(df, value, rounds, seed).where("w > 0"), ["r"], "x", F.col("w"))
    per_round = {"mean": lambda t, g: t.groupBy(*g).agg((F.max("sum_total") / F.max("total")).alias("v")), "median": _median, "gini": _gini}[statistic]
    estimate = per_round(placed, []).select(F.col("v").alias("estimate"))
    left = _left_out(placed, statistic)
    centre = left.agg((F.sum(F.col("n") * F.col("j")) / F.sum("n")).alias("_m"))
    d = F.col("_m") - F.col("j")
    speed = left.crossJoin(F.broadcast(centre)).agg(F.sum("n").alias("_rows"), F.sum(F.col("n") * d * d * d).alias("_3"), F.sum(F.col("n") * d * d).alias("_2"))
    rounds_ = per_round(drawn, ["r"]).crossJoin(F.broadcast(estimate))
    below = rounds_.agg(F.array_sort(F.collect_list("v")).alias("_v"), F.max("estimate").alias("estimate"), F.avg((F.round("v", 9) < F.round("estimate", 9)).cast("double")).alias("_below"), F.avg((F.round("v", 9) == F.round("estimate", 9)).cast("double")).alias("_equal"))
    joined = below.crossJoin(speed).withColumns({"bias_z": normal_quantile(F.col("_below") + F.col("_equal") / 2), "acceleration": F.when(F.col("_2") > 1e-300, F.col("_3") / (6 * F.pow("_2", 1.5))).otherwise(0.0)})

    tail = (1 - level) / 2
    ends = {"low": tail, "high": 1 - tail}
    joined = joined.withColumns({f"_z_{k}": F.col("bias_z") + normal_quantile(F.lit(p)) for k, p in ends.items()})
    joined = joined.withColumns({f"_at_{k}": normal_cdf(F.col("bias_z") + F.col(f"_z_{k}") / (1 - F.col("acceleration") * F.col(f"_z_{k}"))) * (F.size("_v") - 1) + 1 for k in ends})

    def bound(place: Column) -> Column:
        low = F.greatest(F.lit(1), F.least(F.floor(place).cast("int"), F.size("_v")))
        at = lambda k: F.element_at("_v", k)
        return F.when(F.col("_rows") > 1, at(low) + (place - low) * (at(F.least(low + 1, F.size("_v"))) - at(low)))

    return joined.select("estimate", *(bound(F.col(f"_at_{k}")).alias(k) for k in ends), "bias_z", "acceleration")


def cohens_d(df: DataFrame, value: str, first: Column) -> DataFrame:
    """Standardised mean difference with pooled deviation, and its verbal size."""
    x = F.col(value)
    sums = df.agg(*(f(F.when(test, x)).alias(f"{n}{k}") for k, test in ((1, first), (2, ~first)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (F.col("n1") + F.col("n2") - 2))
    d = F.when(pooled > 0, (F.col("m1") - F.col("m2")) / pooled)
    size = F.abs(d)
    return sums.select("n1", "n2", d.alias("d"), F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large").alias("size"))
