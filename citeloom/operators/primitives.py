"""Bibliometric measures over any grouped value: indices, concentration, inequality, ranks and trends.

Measures of a group are computed from its histogram (distinct values and their counts), so a group with a third of all
rows is combined map-side before it is shuffled. Windows run over histograms and over small aggregates, never over the
rows themselves. Null values are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import steady


def ratio(numerator: Column, denominator: Column, default: float | None = None) -> Column:
    """A double quotient; ``default`` where the denominator is zero or null."""
    quotient = F.when(denominator != 0, numerator.cast("double") / denominator)
    return quotient if default is None else F.coalesce(quotient, F.lit(default))


def proportion(numerator: Column, denominator: Column) -> Column:
    """``ratio`` kept inside [0, 1], 0 by default."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio(numerator, denominator, 0.0)))


def guarded(aggregate: Column, counted: Column, least: int) -> Column:
    """An aggregate, null unless ``least`` values were there."""
    return F.when(F.count(counted) >= least, aggregate)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_log(x: Column, offset: float = 1.0) -> Column:
    """Natural logarithm of ``x + offset``; null where that is not positive."""
    return F.when(x + offset > 0, F.log(x + F.lit(offset)))


def min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column`` scaled to [0, 1] over all rows; 0 where it does not vary."""
    bounds = df.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, ratio(F.col(column) - F.col("_low"), F.col("_high") - F.col("_low"), 0.0)).drop("_low", "_high")


def z_score(df: DataFrame, column: str, out: str) -> DataFrame:
    """``column`` less its mean over its standard deviation (n - 1), 0 where it does not vary."""
    moments = df.agg(F.avg(column).alias("_mean"), F.stddev_samp(column).alias("_sd"))
    return df.crossJoin(F.broadcast(moments)).withColumn(out, ratio(F.col(column) - F.col("_mean"), F.col("_sd"), 0.0)).drop("_mean", "_sd")


def histogram(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``groups``, ``x`` and ``n``: how often each value of a group occurs."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("x")).agg(F.count("*").alias("n"))


def citation_indices(df: DataFrame, groups: Sequence[str], citations: str) -> DataFrame:
    """Per group: ``n_papers``, ``total_citations``, ``h_index``, ``g_index``, ``i10_index``.

    h is the largest rank whose citations reach it, g the largest rank whose running total reaches its square.
    """
    down = Window.partitionBy(*groups).orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    counted = histogram(df, groups, citations).withColumn("papers", F.sum("n").over(down)).withColumn("total", F.sum(F.col("x") * F.col("n")).over(down))
    before, already = F.col("papers") - F.col("n"), F.col("total") - F.col("x") * F.col("n")
    lead = F.col("x") - 2 * before
    square = lead * lead + 4 * (already - before * before)
    extra = F.when(square >= 0, F.floor((lead + F.sqrt(square.cast("double"))) / 2)).otherwise(F.lit(0))
    g = before + clamp(extra, 0, 1 << 60).cast("long")
    reached = F.when(already >= before * before, F.least(g, F.col("papers"))).otherwise(F.lit(0))
    return counted.groupBy(*groups).agg(
        F.max("papers").alias("n_papers"),
        F.max("total").alias("total_citations"),
        F.max(F.least(F.col("x"), F.col("papers"))).alias("h_index"),
        F.max(reached).alias("g_index"),
        F.sum(F.when(F.col("x") >= 10, F.col("n")).otherwise(0)).alias("i10_index"),
    )


def concentration(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Per group over its values: ``n``, ``total``, ``gini``, ``hhi``, ``entropy`` (bits), ``evenness``, ``theil``.

    Gini is 0 for one value or a zero total. Evenness is entropy over its maximum, log2 n. Theil is the mean of
    (x / mean) ln(x / mean) over positive values.
    """
    up = Window.partitionBy(*groups).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    counted = histogram(df, groups, value).withColumn("x", F.col("x").cast("double")).withColumn("below", F.coalesce(F.sum("n").over(up), F.lit(0)))
    rank_sum = F.col("n") * F.col("below") + F.col("n") * (F.col("n") + 1) / 2
    sums = counted.groupBy(*groups).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("x") * F.col("n")).alias("total"),
        F.sum(F.col("x") * rank_sum).alias("_ranked"),
        F.sum(F.col("x") * F.col("x") * F.col("n")).alias("_squares"),
        F.sum(F.when(F.col("x") > 0, F.col("n") * F.col("x") * F.log2("x")).otherwise(0.0)).alias("_logs"),
        F.sum(F.when(F.col("x") > 0, F.col("n")).otherwise(0)).alias("_positive"),
        F.sum(F.when(F.col("x") > 0, F.col("n") * F.col("x") * F.log("x")).otherwise(0.0)).alias("_naturals"),
    )
    n, total = F.col("n"), F.col("total")
    some = total > 0
    gini = F.when(some & (n > 1), 2 * F.col("_ranked") / (n * total) - (n + 1) / n).otherwise(F.lit(0.0))
    entropy = F.when(some, F.log2(total) - F.col("_logs") / total)
    mean = total / F.col("_positive")
    theil = F.when(some, F.col("_naturals") / (mean * F.col("_positive")) - F.log(mean))
    return sums.select(
        *groups,
        "n",
        "total",
        clamp(gini, 0.0, 1.0).alias("gini"),
        F.when(some, F.col("_squares") / (total * total)).alias("hhi"),
        entropy.alias("entropy"),
        F.when(n > 1, entropy / F.log2(n.cast("double"))).alias("evenness"),
        theil.alias("theil"),
    )


def lorenz(df: DataFrame, value: str) -> DataFrame:
    """Points of the Lorenz curve: ``population`` and ``share``, one for each distinct value, from the origin."""
    up = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    counted = histogram(df, [], value)
    points = counted.select(ratio(F.sum("n").over(up), F.sum("n").over(every)).alias("population"), ratio(F.sum(F.col("x") * F.col("n")).over(up), F.sum(F.col("x") * F.col("n")).over(every), 0.0).alias("share"))
    origin = df.sparkSession.range(1).select(F.lit(0.0).alias("population"), F.lit(0.0).alias("share"))
    return origin.unionByName(points)


def ranked(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """Competition rank by descending ``value`` (1, 2, 2, 4), through the histogram of values; nulls have none. Doubles
    equal to nine places are ties."""
    down = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    kept = df.select(steady(df, value).alias("x")).where("x is not null").groupBy("x").agg(F.count("*").alias("n"))
    places = kept.select("x", (F.coalesce(F.sum("n").over(down), F.lit(0)) + 1).alias(out))
    return df.join(places, steady(df, value) == F.col("x"), "left").drop("x")


def top_share(df: DataFrame, value: str, shares: Sequence[float]) -> DataFrame:
    """For each fraction of holders (rounded up): ``fraction``, ``holders`` and the ``share`` of the total they hold."""
    down = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    counted = histogram(df, [], value).withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
    totals = counted.agg(F.sum("n").alias("all"), F.sum(F.col("x") * F.col("n")).alias("whole"))
    wanted = df.sparkSession.createDataFrame([(float(s),) for s in shares], "fraction double")
    holders = F.ceil(F.round(F.col("fraction") * F.col("all"), 9)).cast("long")
    targets = wanted.crossJoin(F.broadcast(totals)).withColumn("holders", holders)
    taken = F.least(F.greatest(F.col("holders") - F.col("before"), F.lit(0)), F.col("n"))
    held = targets.crossJoin(counted).select("fraction", "holders", "whole", (F.col("x") * taken).alias("part"))
    return held.groupBy("fraction", "holders").agg(ratio(F.sum("part"), F.max("whole"), 0.0).alias("share"))


def square_root_law(df: DataFrame, value: str) -> DataFrame:
    """Share of the total that the ceil(sqrt(n)) largest holders have, and whether half, give or take a tenth."""
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"))
    down = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    counted = histogram(df, [], value).withColumn("before", F.coalesce(F.sum("n").over(down), F.lit(0)))
    core = F.ceil(F.sqrt(F.col("holders").cast("double"))).cast("long")
    held = counted.crossJoin(F.broadcast(n.withColumnRenamed("n", "holders"))).withColumn("core", core)
    taken = F.least(F.greatest(F.col("core") - F.col("before"), F.lit(0)), F.col("n"))
    out = held.groupBy("holders", "core").agg(ratio(F.sum(F.col("x") * taken), F.sum(F.col("x") * F.col("n")), 0.0).alias("share"))
    return out.withColumn("holds", F.col("share").between(0.4, 0.6))


def bradford(df: DataFrame, source: str, value: str) -> DataFrame:
    """Sources by descending ``value`` (ties by name) with ``rank``, ``cumulative`` and ``zone``.

    Zone 1 while the cumulative count stays within a third of the total, 2 within two thirds, then 3. Ranks run inside each
    value and go on from the histogram of values, so no window holds all sources; one holds those of equal value.
    """
    down = Window.orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, -1)
    amount = F.col("x") * F.col("n")
    counted = histogram(df, [], value).select("x", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("_before"), F.coalesce(F.sum(amount).over(down), F.lit(0)).alias("_sum"), F.sum(amount).over(Window.partitionBy()).alias("_all"))
    own = F.row_number().over(Window.partitionBy(value).orderBy(source))
    placed = df.where(F.col(value).isNotNull()).select(source, value, own.alias("_own")).join(counted, F.col(value) == F.col("x"))
    out = placed.select(source, value, (F.col("_before") + F.col("_own")).cast("int").alias("rank"), (F.col("_sum") + F.col("_own") * F.col(value)).alias("cumulative"), "_all")
    zone = F.when(3 * F.col("cumulative") <= F.col("_all"), 1).when(3 * F.col("cumulative") <= 2 * F.col("_all"), 2).otherwise(3)
    return out.withColumn("zone", zone).drop("_all")


def bradford_zones(zoned: DataFrame, value: str) -> DataFrame:
    """Per zone the number of sources and their total, and the multiplier from the zone before (null for the first)."""
    sums = zoned.groupBy("zone").agg(F.count("*").alias("sources"), F.sum(value).alias("total"))
    before = F.lag("sources").over(Window.orderBy("zone"))
    return sums.withColumn("multiplier", ratio(F.col("sources"), before))


def trend(df: DataFrame, groups: Sequence[str], x: str, y: str) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` a group: ``slope``, ``intercept``, ``r2``, ``points``.

    Without spread in ``x`` slope, intercept and r2 are null; a constant ``y`` over different ``x`` is met exactly, r2 1.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    moments = known.groupBy(*groups).agg(F.count("*").alias("points"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.covar_pop(F.col(x).cast("double"), F.col(y).cast("double")).alias("_xy"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"))
    slope = ratio(F.col("_xy"), F.col("_xx"))
    return moments.select(*groups, slope.alias("slope"), (F.col("_my") - slope * F.col("_mx")).alias("intercept"), F.when(F.col("_xx") == 0, None).when(F.col("_yy") == 0, 1.0).otherwise(ratio(F.col("_xy") * F.col("_xy"), F.col("_xx") * F.col("_yy"))).alias("r2"), "points")


def growth(df: DataFrame, groups: Sequence[str], year: str, value: str) -> DataFrame:
    """Per group: first and last year and value, ``cagr`` over the span of years, and the last year's growth."""
    ends = df.groupBy(*groups).agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min_by(value, year).alias("first_value"),
        F.max_by(value, year).alias("last_value"),
    )
    span = F.col("last_year") - F.col("first_year")
    factor = ratio(F.col("last_value"), F.col("first_value"))
    return ends.withColumn("cagr", F.when((span > 0) & (F.col("first_value") > 0), F.pow(factor, 1.0 / span) - 1))


#: Items of a group in a block; a pair of blocks is the most that one task of a pair count holds.
PAIR_BLOCK = 1000


def pair_counts(df: DataFrame, group: str, item: str, blocked: bool = False) -> DataFrame:
    """``a``, ``b`` (a before b) and ``weight``: in how many groups both items occur; df has each (group, item) once.

    An item-pair join on the group: a group of k items gives k (k - 1) / 2 pairs, which is the result itself, and counts
    are combined map-side. Groups are documents as a rule, and items what one lists. ``blocked`` is for groups of any
    size: one of over ``PAIR_BLOCK`` items is cut into blocks by a hash and joined as pairs of blocks, so no task holds
    it whole.
    """
    if not blocked:
        left, right, keys = df.select(group, F.col(item).alias("a")), df.select(group, F.col(item).alias("b")), [group]
    else:
        sizes = df.groupBy(group).agg(F.ceil(F.count("*") / F.lit(PAIR_BLOCK)).cast("int").alias("_blocks")).where("_blocks > 1")
        placed = df.join(sizes, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
        own = placed.withColumn("_own", F.pmod(F.xxhash64(item), F.col("_blocks")).cast("int"))
        dealt = own.select(group, item, "_own", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
        left = dealt.select(group, F.col(item).alias("a"), F.col("_own").alias("_i"), F.col("_other").alias("_j"))
        right = dealt.select(group, F.col(item).alias("b"), F.col("_other").alias("_i"), F.col("_own").alias("_j"))
        keys = [group, "_i", "_j"]
    return left.join(right, keys).where("a < b").groupBy("a", "b").agg(F.count("*").alias("weight"))


def pair_similarity(pairs: DataFrame, totals: DataFrame, item: str, total: str) -> DataFrame:
    """``pairs`` with Salton's cosine, Jaccard and both affinities from the items' own totals."""
    own = totals.select(F.col(item).alias("_i"), F.col(total).alias("_t"))
    with_a = pairs.join(own, F.col("a") == F.col("_i")).withColumnRenamed("_t", "total_a").drop("_i")
    both = with_a.join(own, F.col("b") == F.col("_i")).withColumnRenamed("_t", "total_b").drop("_i")
    w, a, b = F.col("weight"), F.col("total_a"), F.col("total_b")
    return both.withColumns({"salton": ratio(w, F.sqrt(a * b.cast("double"))), "jaccard": ratio(w, a + b - w), "affinity_a": ratio(w, a), "affinity_b": ratio(w, b)})
