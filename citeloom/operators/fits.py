"""Fitted models: forecasts of annual series, distributions of citations, growth of countries, ridge lines.

Everything follows from sums over a series or a histogram, so a fit is an aggregation; no series is gathered.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import histogram, ratio, trend

#: Normal quantiles of two-sided 80 % and 95 % intervals.
Z80, Z95 = 1.2815515655446004, 1.959963984540054


def one_step_models(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series and model its error figures: ``model, n, k`` (errors, parameters), ``sse, rmse, mae, mape, aic``.

    Models: ``mean`` (of the series), ``naive`` (the year before), ``drift`` (naive plus the mean change), ``linear`` (a line on
    the year) and ``ar1`` (a line on the year before). Years follow each other as the rows do. aic is n ln(sse / n) + 2k,
    null where the fit is exact; mape leaves out values of 0. Series of under four years have no rows.
    """
    fitted = _fitted(df, keys)
    error = F.col("y") - F.col("fit")
    out = fitted.where("fit is not null").groupBy(*keys, "model", "k").agg(F.count("*").alias("n"), F.sum(error * error).alias("sse"), F.avg(F.abs(error)).alias("mae"), F.avg(F.when(F.col("y") != 0, F.abs(error / F.col("y")))).alias("mape"))
    n, sse = F.col("n"), F.col("sse")
    return out.select(*keys, "model", "n", "k", "sse", F.sqrt(sse / n).alias("rmse"), "mae", "mape", F.when(sse > 1e-9, n * F.log(sse / n) + 2 * F.col("k")).alias("aic"))


def _parameters(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    own = Window.partitionBy(*keys)
    order = own.orderBy("year")
    y = F.col("articles").cast("double")
    rows = df.select(*keys, "year", y.alias("y"), F.lag(y).over(order).alias("y1"), F.count("*").over(own).alias("years")).where("years >= 4")
    known = F.col("y1").isNotNull()
    sums = rows.groupBy(*keys).agg(
        F.avg("y").alias("mean"),
        F.min_by("y", "year").alias("first"),
        F.max_by("y", "year").alias("last"),
        F.max("year").alias("last_year"),
        F.count("*").alias("years"),
        F.regr_slope("y", "year").alias("b"),
        F.regr_intercept("y", "year").alias("a"),
        F.regr_slope(F.when(known, F.col("y")), F.col("y1")).alias("phi"),
        F.regr_intercept(F.when(known, F.col("y")), F.col("y1")).alias("c"),
    )
    return rows.drop("years"), sums.withColumn("step", (F.col("last") - F.col("first")) / (F.col("years") - 1))


def _fitted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows, sums = _parameters(df, keys)
    joined = rows.join(sums, list(keys)) if keys else rows.crossJoin(F.broadcast(sums))
    of = {"mean": (1, F.col("mean")), "naive": (0, F.col("y1")), "drift": (1, F.col("y1") + F.col("step")), "linear": (2, F.col("a") + F.col("b") * F.col("year")), "ar1": (2, F.col("c") + F.col("phi") * F.col("y1"))}
    models = F.array(*(F.struct(F.lit(name).alias("model"), F.lit(k).alias("k"), fit.alias("fit")) for name, (k, fit) in of.items()))
    return joined.select(*keys, "year", "y", F.explode(models).alias("m")).select(*keys, "year", "y", "m.model", "m.k", "m.fit")


def _ahead(h: Column) -> dict[str, Column]:
    phi = F.col("phi")
    settled = F.when(F.abs(phi - 1) < 1e-12, F.col("c") * h).otherwise(F.col("c") * (1 - F.pow(phi, h)) / (1 - phi))
    return {"mean": F.col("mean"), "naive": F.col("last"), "drift": F.col("last") + h * F.col("step"), "linear": F.col("a") + F.col("b") * (F.col("last_year") + h), "ar1": settled + F.pow(phi, h) * F.col("last")}


def forecasts(df: DataFrame, keys: Sequence[str], horizon: int = 5) -> DataFrame:
    """``keys, model, year, forecast, low80, high80, low95, high95`` for ``horizon`` years after the last, of each model and of
    the ``ensemble``, whose weights are exp(-aic / 2) over their sum. Intervals are rmse * sqrt(h) times the normal quantile."""
    _, sums = _parameters(df, keys)
    fits = one_step_models(df, keys).select(*keys, "model", "rmse", "aic")
    best = Window.partitionBy(*keys)
    weighed = fits.withColumn("_w", F.when(F.col("aic").isNotNull(), F.exp((F.min("aic").over(best) - F.col("aic")) / 2)))
    weighed = weighed.withColumn("weight", ratio(F.col("_w"), F.sum("_w").over(best))).drop("_w")
    spread = sums.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    made = _ahead(F.col("h").cast("double"))
    points = spread.select(*keys, "h", (F.col("last_year") + F.col("h")).alias("year"), F.explode(F.array(*(F.struct(F.lit(m).alias("model"), x.alias("forecast")) for m, x in made.items()))).alias("p")).select(*keys, "h", "year", "p.model", "p.forecast")
    joined = points.join(weighed, [*keys, "model"])
    together = joined.where("weight is not null").groupBy(*keys, "h", "year").agg(F.sum(F.col("weight") * F.col("forecast")).alias("forecast"), F.sum(F.col("weight") * F.col("rmse")).alias("rmse")).withColumn("model", F.lit("ensemble"))
    out = joined.select(*keys, "model", "h", "year", "forecast", "rmse").unionByName(together)
    wide = F.col("rmse") * F.sqrt(F.col("h").cast("double"))
    return out.select(*keys, "model", "year", "forecast", *(( F.col("forecast") + sign * z * wide).alias(f"{side}{level}") for level, z in ((80, Z80), (95, Z95)) for side, sign in (("low", -1), ("high", 1))))


def model_table(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``one_step_models`` with ranks by aic, rmse and mape inside a series (1, 2, 2, 4), their mean, and the place by it."""
    own = Window.partitionBy(*keys)
    ranks = {f"rank_{c}": F.rank().over(own.orderBy(F.asc_nulls_last(F.round(c, 9)))) for c in ("aic", "rmse", "mape")}
    scored = one_step_models(df, keys).withColumns(ranks).withColumn("score", (F.col("rank_aic") + F.col("rank_rmse") + F.col("rank_mape")) / 3)
    return scored.withColumn("place", F.row_number().over(own.orderBy("score", "model")))


def expanding_errors(df: DataFrame, keys: Sequence[str], least: int = 4) -> DataFrame:
    """Expanding-window validation: for every year after the first ``least``, the next value by the naive, drift, mean and
    linear forecasts of the years before it; per series and model ``folds, mae, rmse, mape``."""
    before = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    y, x = F.col("articles").cast("double"), F.col("year").cast("double")
    n, sx, sy = F.count("*").over(before), F.sum(x).over(before), F.sum(y).over(before)
    sxx, sxy = F.sum(x * x).over(before), F.sum(x * y).over(before)
    rows = df.select(*keys, y.alias("y"), x.alias("x"), n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"), F.last(y).over(before).alias("last"), F.first(y).over(before).alias("first")).where(F.col("n") >= least)
    slope = ratio(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    of = {"naive": F.col("last"), "drift": F.col("last") + (F.col("last") - F.col("first")) / (F.col("n") - 1), "mean": F.col("sy") / F.col("n"), "linear": F.col("sy") / F.col("n") + slope * (F.col("x") - F.col("sx") / F.col("n"))}
    long = rows.select(*keys, "y", F.explode(F.array(*(F.struct(F.lit(m).alias("model"), f.alias("forecast")) for m, f in of.items()))).alias("m")).select(*keys, "y", "m.model", "m.forecast")
    error = F.col("y") - F.col("forecast")
    return long.groupBy(*keys, "model").agg(F.count("*").alias("folds"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.when(F.col("y") != 0, F.abs(error / F.col("y")))).alias("mape"))


def ridge(df: DataFrame, keys: Sequence[str], folds: int = 5, penalties: Sequence[float] = tuple(10 ** (k / 4) for k in range(-8, 17))) -> DataFrame:
    """Per series the ridge line of articles on the centred year: ``penalty`` of least squared error over ``folds`` folds (year
    modulo ``folds``; the smaller of equals), ``slope, intercept, cv_error``. The intercept is not penalised.

    A fold's line follows from the sums of all years less its own.
    """
    x, y = F.col("year").cast("double"), F.col("articles").cast("double")
    sums = [F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy")]
    by_fold = df.groupBy(*keys, F.pmod(F.col("year"), F.lit(folds)).alias("fold")).agg(*sums)
    names = ("n", "sx", "sy", "sxx", "sxy", "syy")
    own = Window.partitionBy(*keys)
    parts = by_fold.withColumns({f"t_{c}": F.sum(c).over(own) - F.col(c) for c in names}).where("t_n >= 2")
    tried = parts.withColumn("penalty", F.explode(F.array(*(F.lit(float(p)) for p in penalties))))

    def line(prefix: str) -> tuple[Column, Column]:
        n, sx, sy, sxx, sxy = (F.col(f"{prefix}{c}") for c in names[:5])
        slope = (sxy - sx * sy / n) / (sxx - sx * sx / n + F.col("penalty"))
        return slope, sy / n - slope * sx / n

    b, a = line("t_")
    lined = tried.withColumns({"b": b, "a": a})
    sse = F.col("syy") - 2 * F.col("a") * F.col("sy") - 2 * F.col("b") * F.col("sxy") + F.col("n") * F.col("a") * F.col("a") + 2 * F.col("a") * F.col("b") * F.col("sx") + F.col("b") * F.col("b") * F.col("sxx")
    scored = lined.groupBy(*keys, "penalty").agg((F.sum(sse) / F.sum("n")).alias("cv_error"))
    chosen = scored.groupBy(*keys).agg(F.min(F.struct(F.round("cv_error", 6).alias("e"), "penalty", "cv_error")).alias("m")).select(*keys, "m.penalty", "m.cv_error")
    totals = df.groupBy(*keys).agg(*sums)
    slope, intercept = line("")
    return totals.join(chosen, list(keys)).select(*keys, "penalty", slope.alias("slope"), intercept.alias("intercept"), "cv_error")


def citation_distributions(records: DataFrame, value: str = "citations") -> DataFrame:
    """Fits to the positive values: ``model, n, first, second`` (parameters), ``log_likelihood, aic, weight``.

    exponential (rate), log_normal (mean and deviation of logs), weibull (shape of 0.05 to 5.04 in steps of a hundredth,
    scale) and power_law (exponent from the least value on; null where all are equal).
    """
    counted = histogram(records.where(F.col(value) > 0), [], value).select(F.col("x").cast("double").alias("x"), "n")
    sums = counted.agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("x")).alias("s"), F.sum(F.col("n") * F.log("x")).alias("l"), F.sum(F.col("n") * F.log("x") * F.log("x")).alias("q"), F.min("x").alias("m"))
    n, s, logs = F.col("n"), F.col("s"), F.col("l")
    rate, mu = n / s, logs / n
    sd = F.sqrt(F.col("q") / n - mu * mu)
    over = logs - n * F.log("m")
    exponent = F.when(over > 0, 1 + n / over)
    row = lambda model, first, second, likelihood, k: F.struct(F.lit(model).alias("model"), first.alias("first"), second.cast("double").alias("second"), likelihood.alias("log_likelihood"), F.lit(k).alias("k"))
    closed = sums.select("n", F.explode(F.array(
        row("exponential", rate, F.lit(None), n * F.log(rate) - n, 1),
        row("log_normal", mu, sd, F.when(sd > 0, -logs - n * F.log(sd * math.sqrt(2 * math.pi)) - n / 2), 2),
        row("power_law", exponent, F.col("m"), n * F.log((exponent - 1) / F.col("m")) - exponent * over, 1),
    )).alias("r")).select("n", "r.*")
    shapes = counted.withColumn("shape", F.explode(F.transform(F.sequence(F.lit(5), F.lit(504)), lambda i: i / 100.0)))
    powers = shapes.groupBy("shape").agg(F.sum(F.col("n") * F.pow("x", F.col("shape"))).alias("p")).crossJoin(F.broadcast(sums.select("n", "l")))
    scale_k = F.col("p") / n
    likelihood = n * F.log("shape") - n * F.log(scale_k) + (F.col("shape") - 1) * logs - n
    best = powers.withColumn("log_likelihood", likelihood).groupBy("n").agg(F.max_by(F.struct("shape", "p", "log_likelihood"), F.col("log_likelihood")).alias("b"))
    weibull = best.select("n", F.lit("weibull").alias("model"), F.col("b.shape").alias("first"), F.pow(F.col("b.p") / n, 1 / F.col("b.shape")).alias("second"), F.col("b.log_likelihood").alias("log_likelihood"), F.lit(2).alias("k"))
    out = closed.unionByName(weibull).withColumn("aic", 2 * F.col("k") - 2 * F.col("log_likelihood"))
    relative = F.exp((F.min("aic").over(Window.partitionBy()) - F.col("aic")) / 2)
    return out.withColumn("_w", relative).select("model", F.col("n").cast("long").alias("n"), "first", "second", "log_likelihood", "aic", ratio(F.col("_w"), F.sum("_w").over(Window.partitionBy())).alias("weight"))


def growth_models(panel: DataFrame, group: str, least: int = 3) -> DataFrame:
    """Per group of ``panel`` (group, year, articles) and model ``slope, intercept, r2, points`` and whether it is ``best`` (highest
    r2, first by name): linear, exponential, logarithmic and power, as lines over t = 1 in the group's first year and logs.
    Models of logs leave out years without articles; groups of under ``least`` years have no rows."""
    own = Window.partitionBy(group)
    t = (F.col("year") - F.min("year").over(own) + 1).cast("double")
    rows = panel.select(group, t.alias("t"), F.col("articles").cast("double").alias("y"), F.count("*").over(own).alias("_n")).where(F.col("_n") >= least)
    log_y, log_t = F.when(F.col("y") > 0, F.log("y")), F.log("t")
    shapes = (("linear", F.col("t"), F.col("y")), ("exponential", F.col("t"), log_y), ("logarithmic", log_t, F.col("y")), ("power", log_t, log_y))
    long = rows.select(group, F.explode(F.array(*(F.struct(F.lit(m).alias("model"), x.alias("x"), y.alias("y")) for m, x, y in shapes))).alias("m")).select(group, "m.model", "m.x", "m.y")
    lines = trend(long, [group, "model"], "x", "y")
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc_nulls_last(F.round("r2", 9)), "model"))
    return lines.withColumn("best", place == 1)


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column ``n, mean, median, sd, cv, skewness, kurtosis`` (excess), with the deviation of n - 1 in all."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("v.variable", "v.x").where("x is not null")
    base = long.groupBy("variable").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("sd"))
    d = (F.col("x") - F.col("mean")) / F.col("sd")
    higher = long.join(F.broadcast(base.select("variable", "mean", "sd")), "variable").groupBy("variable").agg(F.avg(F.when(F.col("sd") > 0, F.pow(d, 3))).alias("skewness"), (F.avg(F.when(F.col("sd") > 0, F.pow(d, 4))) - 3).alias("kurtosis"))
    return base.join(higher, "variable").select("variable", "n", "mean", "median", "sd", ratio(F.col("sd"), F.col("mean")).alias("cv"), "skewness", "kurtosis")
