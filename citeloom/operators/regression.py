"""Least squares with several predictors, a fit for every key.

All a fit needs are the sums of products of its columns (the Gram matrix), which are one aggregation with map-side combining: a key
with a third of all rows is no hot task, and nothing is gathered but a matrix of (predictors + 1) squared numbers a key. The
matrix is centred and swept predictor by predictor, a fold over arrays in the JVM, which leaves the coefficients, the inverse for
their errors and the residual sum of squares. Columns are shifted by their overall means first, so years and other values far
from zero lose no digits.

Rows with a null in any column of a fit are left out. A predictor that depends on those before it (its pivot falls under
``DEPENDENT`` of its own spread) gets null and costs no degree of freedom. Errors and tests are null without residual degrees of
freedom; a key without rows has no fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distributions import f_tail, t_two_sided
from .primitives import ratio

#: Share of a predictor's spread that must be left, once those before it are taken out, for it to count.
DEPENDENT = 1e-10


def _add(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key ``n``, ``shift`` (overall means), ``s`` (sums) and ``q`` (sums of products) of the shifted columns."""
    known = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).dropna(subset=list(columns))
    means = known.agg(F.array(*(F.coalesce(F.avg(c), F.lit(0.0)) for c in columns)).alias("shift"))
    moved = known.crossJoin(F.broadcast(means)).select(*keys, "shift", *((F.col(c) - F.col("shift")[i]).alias(f"_{i}") for i, c in enumerate(columns)))
    wide = range(len(columns))
    product = {(i, j): F.sum(F.col(f"_{i}") * F.col(f"_{j}")).alias(f"q{i}_{j}") for i in wide for j in wide if i <= j}
    sums = moved.groupBy(*keys).agg(F.count("*").alias("n"), F.first("shift").alias("shift"), *(F.sum(f"_{i}").alias(f"s{i}") for i in wide), *product.values())
    square = F.array(*(F.array(*(F.col(f"q{min(i, j)}_{max(i, j)}") for j in wide)) for i in wide))
    out = sums.select(*keys, "n", "shift", F.array(*(F.col(f"s{i}") for i in wide)).alias("s"), square.alias("q"))
    return out if keys else out.where("n > 0")


def _centred(n: Column, s: Column, q: Column) -> Column:
    return F.transform(q, lambda row, i: F.transform(row, lambda v, j: v - s[i] * s[j] / n))


def sweep(matrix: Column, predictors: int) -> Column:
    """Struct ``m`` and ``used``: the centred Gram matrix of predictors and response, swept on its first ``predictors`` places.

    Then m[i][i] and m[i][j] are the inverse, m[i][last] the coefficients and m[last][last] the residual sum of squares.
    ``used`` says which predictors were swept; those that depend on the ones before were not.
    """

    def swept(m: Column, k: Column) -> Column:
        d = m[k][k]
        return F.transform(m, lambda row, i: F.transform(row, lambda v, j: F.when((i == k) & (j == k), 1.0 / d).when(i == k, v / d).when(j == k, -v / d).otherwise(v - row[k] * m[k][j] / d)))

    def step(acc: Column, k: Column) -> Column:
        free = acc["m"][k][k] > DEPENDENT * matrix[k][k]
        return F.struct(F.when(free, swept(acc["m"], k)).otherwise(acc["m"]).alias("m"), F.concat(acc["used"], F.array(free)).alias("used"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(predictors - 1)), F.struct(matrix.alias("m"), F.array().cast("array<boolean>").alias("used")), step)


def _fitted(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], by_n: bool = False) -> DataFrame:
    """Per key the swept matrix and what follows from it. ``by_n``: variances over n instead of degrees of freedom."""
    p = len(xs)
    sums = _sums(df, keys, [*xs, y]).withColumn("c", _centred(F.col("n"), F.col("s"), F.col("q")))
    swept = sums.withColumn("w", sweep(F.col("c"), p)).withColumn("mean", F.transform("shift", lambda v, i: v + F.col("s")[i] / F.col("n")))
    out = swept.withColumn("rank", F.size(F.filter("w.used", lambda u: u)))
    out = out.withColumns({"df2": F.col("n") - F.col("rank") - 1, "sst": F.col("c")[p][p], "sse": F.greatest(F.lit(0.0), F.col("w.m")[p][p])})
    b = F.transform("w.used", lambda u, i: F.when(u, F.col("w.m")[i][p]))
    out = out.withColumn("b", b)
    return out.withColumn("a", F.col("mean")[p] - _add([F.coalesce(F.col("b")[i], F.lit(0.0)) * F.col("mean")[i] for i in range(p)]))


def summary(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per key ``n, df1, df2, sse, r2, adjusted_r2, sigma, f, p_value`` of the fit of ``y`` on ``xs`` and a constant.

    A constant response is met exactly: r2 is 1 and f null.
    """
    fitted = _fitted(df, keys, y, xs)
    sse, sst, df1, df2 = F.col("sse"), F.col("sst"), F.col("rank"), F.col("df2")
    r2 = F.when(sst > 0, 1.0 - sse / sst).otherwise(1.0)
    f = F.when((df1 > 0) & (df2 > 0) & (sse > DEPENDENT * sst), ((sst - sse) / df1) / (sse / df2))
    out = fitted.select(*keys, "n", df1.alias("df1"), df2.alias("df2"), sse.alias("sse"), r2.alias("r2"), F.when(df2 > 0, 1.0 - (1.0 - r2) * (F.col("n") - 1) / df2).alias("adjusted_r2"), F.when(df2 > 0, F.sqrt(sse / df2)).alias("sigma"), f.alias("f"))
    return out.withColumn("p_value", f_tail(F.col("f"), F.col("df1"), F.col("df2")))


def coefficients(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """Per key and term (``constant`` and ``xs``) ``coefficient, std_error, t, p_value``."""
    p = len(xs)
    fitted = _fitted(df, keys, y, xs).withColumn("s2", F.when(F.col("df2") > 0, F.col("sse") / F.col("df2")))
    m, mean, used = F.col("w.m"), F.col("mean"), F.col("w.used")
    both = [F.when(used[i] & used[j], m[i][j] * mean[i] * mean[j]).otherwise(0.0) for i in range(p) for j in range(p)]
    term = lambda name, b, variance: F.struct(F.lit(name).alias("term"), b.alias("coefficient"), F.sqrt(F.col("s2") * variance).alias("std_error"))
    terms = [term("constant", F.col("a"), 1.0 / F.col("n") + _add(both))]
    terms += [term(x, F.col("b")[i], F.when(used[i], m[i][i])) for i, x in enumerate(xs)]
    long = fitted.select(*keys, "df2", F.explode(F.array(*terms)).alias("e")).select(*keys, "df2", "e.*").withColumn("t", ratio(F.col("coefficient"), F.col("std_error")))
    return long.withColumn("p_value", t_two_sided(F.col("t"), F.col("df2"))).drop("df2")


def residuals(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str]) -> DataFrame:
    """``df`` with ``fitted`` and ``residual``; rows with a null in a column of the fit have nulls. Fits meet rows by key; a hot
    key's rows are split by AQE, its fit is one row."""
    fits = _fitted(df, keys, y, xs).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("a").alias("_a"), F.col("b").alias("_b"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)), F.lit(True))
    met = df.join(fits, same, "left") if keys else df.crossJoin(F.broadcast(fits))
    fitted = F.col("_a") + _add([F.coalesce(F.col("_b")[i], F.lit(0.0)) * F.col(x) for i, x in enumerate(xs)])
    out = met.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted"))
    return out.select(*df.columns, "fitted", "residual")


def nested_f(df: DataFrame, keys: Sequence[str], y: str, xs: Sequence[str], more: Sequence[str]) -> DataFrame:
    """Per key the F of adding ``more`` to ``xs``: ``sse_small, sse_large, df1, df2, f, p_value``. Both fits are of the rows that
    have all columns, and come from one Gram matrix: the small fit is the large one before ``more`` is swept in."""
    p, k = len(xs), len(xs) + len(more)
    sums = _sums(df, keys, [*xs, *more, y]).withColumn("c", _centred(F.col("n"), F.col("s"), F.col("q")))
    small = sweep(F.col("c"), p) if p else F.struct(F.col("c").alias("m"), F.array().cast("array<boolean>").alias("used"))
    both = sums.withColumns({"small": small, "large": sweep(F.col("c"), k)})
    count = lambda c: F.size(F.filter(F.col(f"{c}.used"), lambda u: u))
    out = both.select(*keys, "n", F.greatest(F.lit(0.0), F.col("small.m")[k][k]).alias("sse_small"), F.greatest(F.lit(0.0), F.col("large.m")[k][k]).alias("sse_large"), F.col("c")[k][k].alias("_sst"), (count("large") - count("small")).alias("df1"), (F.col("n") - count("large") - 1).alias("df2"))
    f = F.when((F.col("df1") > 0) & (F.col("df2") > 0) & (F.col("sse_large") > DEPENDENT * F.col("_sst")), ((F.col("sse_small") - F.col("sse_large")) / F.col("df1")) / (F.col("sse_large") / F.col("df2")))
    return out.withColumn("f", f).withColumn("p_value", f_tail(F.col("f"), F.col("df1"), F.col("df2"))).drop("_sst")


def with_powers(df: DataFrame, x: str, degree: int) -> DataFrame:
    """``df`` with ``x1`` to ``x<degree>``, powers of ``x``."""
    return df.withColumns({f"x{d}": F.pow(F.col(x).cast("double"), d) for d in range(1, degree + 1)})


def polynomial_trends(df: DataFrame, keys: Sequence[str], year: str = "year", value: str = "articles", most: int = 3) -> DataFrame:
    """Per key and ``degree`` 1 to ``most`` of the year (from 0 at the key's first): ``n, r2, adjusted_r2``, the F against one
    degree less with its p, and ``best`` by adjusted r2 (the smaller of equals)."""
    first = Window.partitionBy(*keys)
    base = with_powers(df.select(*keys, F.col(value).cast("double").alias("y"), (F.col(year) - F.min(year).over(first)).alias("t")), "t", most)
    parts = []
    for d in range(1, most + 1):
        below, own = [f"x{i}" for i in range(1, d)], f"x{d}"
        step = nested_f(base, keys, "y", below, [own]).select(*keys, "f", F.col("p_value").alias("f_p"))
        fit = summary(base, keys, "y", [*below, own]).select(*keys, "n", "r2", "adjusted_r2")
        parts.append((fit.join(step, list(keys)) if keys else fit.crossJoin(step)).withColumn("degree", F.lit(d)))
    every = reduce(DataFrame.unionByName, parts)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last(F.round("adjusted_r2", 9)), "degree"))
    return every.select(*keys, "degree", "n", "r2", "adjusted_r2", "f", "f_p", (place == 1).alias("best"))


def ridge_polynomial(df: DataFrame, keys: Sequence[str], year: str = "year", value: str = "articles", degree: int = 2, folds: int = 5, penalties: int = 100) -> DataFrame:
    """Per key the ridge fit of ``value`` on powers of the year (from 0 at the key's first): ``penalty`` of least error over
    ``folds`` folds (year modulo ``folds``), ``constant, b1 .. b<degree>, r2, cv_error``. The constant is not penalised.

    Penalties go evenly in logs from the largest absolute X'y / n down to a ten-thousandth. A fold's fit follows from the sums of
    all rows less its own, and so does its error: no row is read again.
    """
    own = Window.partitionBy(*keys)
    base = df.select(*keys, F.col(value).cast("double").alias("y"), (F.col(year) - F.min(year).over(own)).alias("t"), F.pmod(F.col(year), F.lit(folds)).alias("fold"))
    columns = [*(f"x{d}" for d in range(1, degree + 1)), "y"]
    parts = _sums(with_powers(base, "t", degree), [*keys, "fold"], columns)
    flat = parts.withColumn("v", F.concat(F.array(F.col("n").cast("double")), "s", F.flatten("q")))
    width = 1 + (degree + 1) + (degree + 1) ** 2
    total = flat.withColumn("t", F.array(*(F.sum(F.col("v")[i]).over(own) for i in range(width))))

    def unpack(v: Column) -> tuple[Column, Column, Column]:
        k = degree + 1
        return v[0], F.slice(v, 2, k), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.slice(v, 2 + k + i * k, k))

    def solved(table: DataFrame, v: Column) -> DataFrame:
        """Coefficients ``b`` and constant ``a`` in shifted columns."""
        n, s, q = unpack(v)
        c = F.transform(_centred(n, s, q), lambda row, i: F.transform(row, lambda x, j: x + F.when((i == j) & (i < degree), F.col("penalty")).otherwise(0.0)))
        out = table.withColumn("_c", c).withColumn("_w", sweep(F.col("_c"), degree)).withColumn("b", F.transform(F.sequence(F.lit(0), F.lit(degree - 1)), lambda i: F.when(F.col("_w.used")[i], F.col("_w.m")[i][degree]).otherwise(0.0)))
        return out.withColumn("a", s[degree] / n - _add([F.col("b")[i] * s[i] / n for i in range(degree)]))

    def squares(v: Column) -> Column:
        n, s, q = unpack(v)
        w = [*(-F.col("b")[i] for i in range(degree)), F.lit(1.0)]
        return _add([w[i] * w[j] * q[i][j] for i in range(degree + 1) for j in range(degree + 1)]) - 2 * F.col("a") * _add([w[i] * s[i] for i in range(degree + 1)]) + n * F.col("a") * F.col("a")

    n, s, q = unpack(F.col("t"))
    shift = F.col("shift")
    products = [F.abs(q[i][degree] + shift[i] * s[degree] + shift[degree] * s[i] + n * shift[i] * shift[degree]) for i in range(degree)]
    top = F.greatest(F.abs(s[degree] + n * shift[degree]), *products) / n
    tried = total.where((F.col("t")[0] > F.col("v")[0]) & (top > 0)).withColumn("_top", top).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(penalties - 1)))).withColumn("penalty", F.col("_top") * F.exp(F.col("k") * F.log(F.lit(1e-4)) / max(penalties - 1, 1)))
    without = tried.withColumn("rest", F.transform("t", lambda x, i: x - F.col("v")[i]))
    errors = solved(without, F.col("rest")).withColumn("mse", squares(F.col("v")) / F.col("v")[0])
    scored = errors.groupBy(*keys, "k", "penalty").agg(F.avg("mse").alias("cv_error"), F.first("t").alias("t"), F.first("shift").alias("shift"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("cv_error", 9), "k"))
    best = solved(scored.withColumn("_place", place).where("_place = 1"), F.col("t"))
    constant = F.col("a") + shift[degree] - _add([F.col("b")[i] * shift[i] for i in range(degree)])
    spread = _centred(n, s, q)[degree][degree]
    return best.select(*keys, "penalty", constant.alias("constant"), *(F.col("b")[i].alias(f"b{i + 1}") for i in range(degree)), F.when(spread > 0, 1.0 - squares(F.col("t")) / spread).otherwise(1.0).alias("r2"), "cv_error")


def dynamic_trend(df: DataFrame, keys: Sequence[str], horizon: int = 5) -> DataFrame:
    """A line over the years (1, 2 ..) with first-order autoregressive errors, by one step of Cochrane and Orcutt:
    ``intercept, slope, rho, aic`` and ``forecast``, an array of ``horizon`` values after the last.

    rho is the first autocorrelation of the line's residuals; from 0.99 on (in size) the plain line stays. Series of under
    four years have no rows.
    """
    own = Window.partitionBy(*keys)
    order = own.orderBy("year")
    rows = df.select(*keys, "year", F.col("articles").cast("double").alias("y"), F.row_number().over(order).cast("double").alias("t"), F.count("*").over(own).alias("n")).where("n >= 4")
    seen = residuals(rows, keys, "y", ["t"]).withColumns({"e1": F.lag("residual").over(order), "y1": F.lag("y").over(order), "t1": F.lag("t").over(order)})
    rho = ratio(F.sum(F.col("residual") * F.col("e1")), F.sum(F.col("residual") * F.col("residual")), 0.0)
    sums = seen.groupBy(*keys).agg(rho.alias("rho"), F.max("n").alias("n"), F.sum(F.col("residual") * F.col("residual")).alias("sse"), F.max_by("residual", "t").alias("last"))
    line = F.when(F.abs("rho") < 0.99, F.col("rho")).otherwise(0.0)
    moved = (seen.join(sums.select(*keys, "rho"), list(keys)) if keys else seen.crossJoin(F.broadcast(sums.select("rho")))).withColumn("_r", line)
    moved = moved.where((F.col("t") > 1) | (F.col("_r") == 0)).select(*keys, (F.col("y") - F.col("_r") * F.coalesce("y1", F.lit(0.0))).alias("y"), (F.col("t") - F.col("_r") * F.coalesce("t1", F.lit(0.0))).alias("t"))
    fit = _fitted(moved, keys, "y", ["t"]).select(*keys, F.col("a").alias("_a"), F.col("b")[0].alias("slope"))
    met = fit.join(sums, list(keys)) if keys else fit.crossJoin(sums)
    out = met.withColumn("intercept", F.col("_a") / (1.0 - line)).withColumn("aic", F.when(F.col("sse") > 1e-9, F.col("n") * F.log(F.col("sse") / F.col("n")) + 4))
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: F.col("intercept") + F.col("slope") * (F.col("n") + h) + F.pow(line, h) * F.col("last"))
    return out.select(*keys, "intercept", "slope", "rho", "aic", ahead.alias("forecast"))


def interrupted(df: DataFrame, keys: Sequence[str], shock: int) -> DataFrame:
    """An interrupted series: coefficients of ``t`` (year), ``level`` (1 from ``shock`` on) and ``since`` (years after it)."""
    after = (F.col("year") >= shock).cast("double")
    rows = df.select(*keys, F.col("articles").alias("y"), F.col("year").alias("t"), after.alias("level"), (after * (F.col("year") - shock)).alias("since"))
    return coefficients(rows, keys, "y", ["t", "level", "since"])


def lagged(df: DataFrame, keys: Sequence[str], columns: Sequence[str], lags: int = 1) -> DataFrame:
    """``df`` with ``<column>_lag1`` .. of each column, by year inside a key; years follow each other as the rows do."""
    order = Window.partitionBy(*keys).orderBy("year")
    return df.withColumns({f"{c}_lag{k}": F.lag(c, k).over(order) for c in columns for k in range(1, lags + 1)})


def granger(df: DataFrame, keys: Sequence[str], y: str, x: str, lags: int = 1) -> DataFrame:
    """Does the past of ``x`` say more of ``y`` than its own past does: the nested F of ``lags`` lags of ``x``."""
    return nested_f(lagged(df, keys, [y, x], lags), keys, y, [f"{y}_lag{k}" for k in range(1, lags + 1)], [f"{x}_lag{k}" for k in range(1, lags + 1)])


#: Critical values at 1, 5 and 10 % for a constant: of a unit root (MacKinnon's response surfaces: limit, 1/n, 1/n**2), and of residuals of one regressor.
UNIT_ROOT = ((-3.43035, -6.5393, -16.786), (-2.86154, -2.8903, -4.234), (-2.56677, -1.5384, -2.809))
RESIDUAL_ROOT = ((-3.89644, -10.9519, -22.527), (-3.33613, -6.1101, -6.823), (-3.04445, -4.2412, -2.720))


def _judged(df: DataFrame, keys: Sequence[str], surfaces: tuple) -> DataFrame:
    n = F.col("n").cast("double")
    limits = [F.lit(a) + b / n + c / (n * n) for a, b, c in surfaces]
    level = F.when(F.col("t") <= limits[0], 0.01).when(F.col("t") <= limits[1], 0.05).when(F.col("t") <= limits[2], 0.10)
    return df.select(*keys, "n", F.col("coefficient").alias("gamma"), "t", *(c.alias(f"critical_{p}") for c, p in zip(limits, (1, 5, 10), strict=True)), level.alias("level"), (F.col("t") <= limits[1]).alias("stationary"))


def unit_root(df: DataFrame, keys: Sequence[str], value: str = "articles", lags: int = 1, surfaces: tuple = UNIT_ROOT) -> DataFrame:
    """Augmented Dickey-Fuller with a constant: ``n, gamma, t``, critical values for that many rows, the ``level`` reached (null
    over 10 %) and ``stationary`` at 5 %."""
    order = Window.partitionBy(*keys).orderBy("year")
    rows = df.select(*keys, "year", F.col(value).cast("double").alias("_v")).withColumns({"_past": F.lag("_v").over(order)}).withColumn("_d", F.col("_v") - F.col("_past"))
    rows = lagged(rows, keys, ["_d"], lags)
    xs = ["_past", *(f"_d_lag{k}" for k in range(1, lags + 1))]
    sizes = rows.dropna(subset=["_d", *xs]).groupBy(*keys).agg(F.count("*").alias("n"))
    own = coefficients(rows, keys, "_d", xs).where(F.col("term") == "_past")
    return _judged(own.join(sizes, list(keys)) if keys else own.crossJoin(sizes), keys, surfaces)


def cointegration(df: DataFrame, keys: Sequence[str], y: str, x: str) -> DataFrame:
    """Engle and Granger's two steps: the residuals of ``y`` on ``x`` tested for a unit root, without lags of differences."""
    left = residuals(df, keys, y, [x]).select(*keys, "year", F.col("residual").alias("_e"))
    return unit_root(left, keys, "_e", 0, RESIDUAL_ROOT)
