"""Annual series, many at once: one series a key, rows ``key..., year, articles``.

Descriptions, trend tests and break searches are windows and self-joins inside a key (tens of rows each). Curves that need
iteration are fitted by a small numpy function in ``applyInPandas``, one key a group; a series has a row a year, so a
group is bounded by the span of years.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.distributions import log_gamma
from .primitives import growth, ratio, trend


def describe(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per series: years, total, peak, moments, coefficient of variation, CAGR over the span."""
    own = df.groupBy(*keys).agg(
        F.count("*").alias("years"),
        F.sum("articles").alias("total"),
        F.max_by("year", F.struct("articles", -F.col("year"))).alias("peak_year"),
        F.max("articles").alias("peak"),
        F.avg("articles").alias("mean"),
        F.median("articles").alias("median"),
        F.stddev_samp("articles").alias("sd"),
    )
    ends = growth(df, keys, "year", "articles").select(*keys, "first_year", "last_year", "cagr")
    joined = own.join(ends, list(keys)) if keys else own.crossJoin(ends)
    return joined.withColumn("cv", ratio(F.col("sd"), F.col("mean")))


def smoothed(df: DataFrame, keys: Sequence[str], spans: Sequence[int] = (3, 5, 10)) -> DataFrame:
    """``df`` with right-aligned moving averages, null until a window is full."""
    order = Window.partitionBy(*keys).orderBy("year")
    out = df
    for span in spans:
        w = order.rowsBetween(1 - span, 0)
        out = out.withColumn(f"ma{span}", F.when(F.count("articles").over(w) == span, F.avg("articles").over(w)))
    return out


def anomalies(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with z score, |z| > 3 flag and 1.5 IQR outlier flag (linear quartiles)."""
    own = Window.partitionBy(*keys)
    z = ratio(F.col("articles") - F.avg("articles").over(own), F.stddev_samp("articles").over(own), 0.0)
    q1, q3 = (F.percentile("articles", F.lit(q)).over(own) for q in (0.25, 0.75))
    marked = df.withColumns({"z": z, "_q1": q1, "_q3": q3})
    reach = 1.5 * (F.col("_q3") - F.col("_q1"))
    outlier = (F.col("articles") < F.col("_q1") - reach) | (F.col("articles") > F.col("_q3") + reach)
    return marked.withColumn("anomaly", F.abs("z") > 3).withColumn("outlier", outlier).drop("_q1", "_q3")


def _pairs(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs of years i < j of one series with their values."""
    a = df.select(*keys, F.col("year").alias("i"), F.col("articles").alias("x"))
    b = df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("year").alias("j"), F.col("articles").alias("y"))
    same = F.col("i") < F.col("j")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return a.join(b, same)


def mann_kendall(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mann-Kendall S, its tie-corrected variance, z (with continuity correction) and Sen's median slope."""
    pairs = _pairs(df, keys).groupBy(*keys).agg(
        F.sum(F.signum((F.col("y") - F.col("x")).cast("double"))).alias("s"),
        F.median((F.col("y") - F.col("x")) / (F.col("j") - F.col("i"))).alias("sen_slope"),
    )
    ties = df.groupBy(*keys, "articles").agg(F.count("*").alias("t")).groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(F.col("t") * (F.col("t") - 1) * (2 * F.col("t") + 5)).alias("_ties"))
    joined = pairs.join(ties, list(keys)) if keys else pairs.crossJoin(ties)
    n = F.col("n")
    variance = (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18.0
    z = F.when(F.col("variance") > 0, (F.col("s") - F.signum("s")) / F.sqrt("variance")).otherwise(F.lit(0.0))
    return joined.withColumn("variance", variance).withColumn("z", z).drop("_ties")


def pettitt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pettitt's change point: the year after which the rank statistic is largest, its K and approximate p."""
    order = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    a = df.alias("a")
    other = df.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("articles").alias("_y"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    signs = a.join(other, same).groupBy(*keys, "year").agg(F.sum(F.signum((F.col("articles") - F.col("_y")).cast("double"))).alias("v"), F.count("*").alias("n"))
    running = signs.withColumn("u", F.abs(F.sum("v").over(order)))
    best = running.groupBy(*keys).agg(F.max("u").alias("k"), F.max_by("year", F.struct("u", -F.col("year"))).alias("year"), F.max("n").alias("n"))
    p = 2 * F.exp(-6 * F.col("k") * F.col("k") / (F.pow("n", 3) + F.pow("n", 2)))
    return best.withColumn("p_value", F.least(F.lit(1.0), p))


def mean_shift(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The split into two means of least squared error, by prefix sums: last year before it, gain over one mean, F."""
    own = Window.partitionBy(*keys)
    run = own.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    y = F.col("articles").cast("double")
    sums = df.withColumns({"_i": F.count("*").over(run), "_n": F.count("*").over(own), "_s": F.sum(y).over(run), "_all": F.sum(y).over(own), "_q": F.sum(y * y).over(own)})
    i, n, s, total = F.col("_i"), F.col("_n"), F.col("_s"), F.col("_all")
    gain = s * s / i + (total - s) * (total - s) / (n - i) - total * total / n
    split = sums.where("_i < _n").withColumn("gain", gain).withColumn("_sse", F.col("_q") - total * total / n - gain)
    best = split.groupBy(*keys).agg(F.max_by(F.struct("year", "gain", "_sse", "_n"), F.struct(F.round("gain", 9), -F.col("year"))).alias("_b"))
    return best.select(*keys, F.col("_b.year").alias("year"), F.col("_b.gain").alias("gain"), ratio(F.col("_b.gain") * (F.col("_b._n") - 2), F.col("_b._sse")).alias("f"))


def cusum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running sum of deviations from the mean over sd * sqrt(n): the year of its greatest size."""
    own = Window.partitionBy(*keys)
    centred = df.withColumns({"_d": F.col("articles") - F.avg("articles").over(own), "_sd": F.stddev_samp("articles").over(own), "_n": F.count("*").over(own)})
    run = own.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    scored = centred.withColumn("cusum", ratio(F.sum("_d").over(run), F.col("_sd") * F.sqrt(F.col("_n").cast("double")), 0.0))
    size = F.struct(F.round(F.abs("cusum"), 9), -F.col("year"))
    return scored.groupBy(*keys).agg(F.max_by("year", size).alias("year"), F.max(F.abs("cusum")).alias("statistic"))


def change_consensus(df: DataFrame, keys: Sequence[str], tolerance: int = 2) -> DataFrame:
    """Break years of Pettitt, mean shift and CUSUM, with how many of the three lie within ``tolerance`` years."""
    found = pettitt(df, keys).select(*keys, "year", F.lit("pettitt").alias("method"))
    found = found.unionByName(mean_shift(df, keys).select(*keys, "year", F.lit("mean_shift").alias("method")))
    found = found.unionByName(cusum(df, keys).select(*keys, "year", F.lit("cusum").alias("method")))
    other = found.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("year").alias("_year"), F.col("method").alias("_method"))
    near = F.abs(F.col("year") - F.col("_year")) <= tolerance
    for k in keys:
        near = near & (F.col(k) == F.col(f"_{k}"))
    return found.join(other, near).groupBy(*keys, "method", "year").agg(F.count("*").alias("votes")).withColumn("consensus", F.col("votes") >= 2)


def hurst(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rescaled range exponent ln(R / S) / ln(n), S over n - 1."""
    own = Window.partitionBy(*keys)
    run = own.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    path = df.withColumn("_d", F.col("articles") - F.avg("articles").over(own)).withColumn("_c", F.sum("_d").over(run))
    sums = path.groupBy(*keys).agg((F.max("_c") - F.min("_c")).alias("_r"), F.stddev_samp("articles").alias("_s"), F.count("*").alias("n"))
    return sums.select(*keys, "n", F.when((F.col("_r") > 0) & (F.col("_s") > 0) & (F.col("n") > 1), F.log(F.col("_r") / F.col("_s")) / F.log(F.col("n").cast("double"))).alias("hurst"))


def residual_checks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residuals of the straight line: Durbin-Watson, lag-1 correlation, Ljung-Box Q and Breusch-Pagan LM."""
    line = trend(df, keys, "year", "articles").select(*keys, "slope", "intercept")
    joined = df.join(line, list(keys)) if keys else df.crossJoin(F.broadcast(line))
    order = Window.partitionBy(*keys).orderBy("year")
    left = joined.withColumn("e", F.col("articles") - F.col("intercept") - F.col("slope") * F.col("year")).withColumn("e1", F.lag("e").over(order))
    sums = left.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("_ss"), F.sum(F.col("e") * F.col("e1")).alias("_cross"), F.sum(F.pow(F.col("e") - F.col("e1"), 2)).alias("_diff"))
    squares = trend(left.withColumn("e2", F.col("e") * F.col("e")), keys, "year", "e2").select(*keys, F.col("r2").alias("_r2"))
    both = sums.join(squares, list(keys)) if keys else sums.crossJoin(squares)
    r1 = ratio(F.col("_cross"), F.col("_ss"))
    n = F.col("n")
    return both.select(*keys, "n", ratio(F.col("_diff"), F.col("_ss")).alias("durbin_watson"), r1.alias("lag1"), (n * (n + 2) * r1 * r1 / (n - 1)).alias("ljung_box"), (n * F.col("_r2")).alias("breusch_pagan"))


def rolling_baselines(df: DataFrame, keys: Sequence[str], least: int = 8) -> DataFrame:
    """One-step errors from every origin with ``least`` or more years: naive, mean and drift forecasts compared.

    Per model: folds, MAE, RMSE and MASE (scaled by the series' mean absolute change).
    """
    order = Window.partitionBy(*keys).orderBy("year")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last, n = F.lag("articles").over(order), F.count("*").over(before)
    origin = F.first("articles").over(order.rowsBetween(Window.unboundedPreceding, 0))
    models = {"naive": last.cast("double"), "mean": F.avg("articles").over(before), "drift": last + ratio(last - origin, n - 1, 0.0)}
    made = df.withColumns({"_n": n, "_step": F.abs(F.col("articles") - last), **models})
    long = made.select(*keys, "_n", "_step", "articles", F.explode(F.map_from_arrays(F.array(*(F.lit(m) for m in models)), F.array(*models))).alias("model", "forecast"))
    error = F.col("articles") - F.col("forecast")
    tested = F.col("_n") >= least
    out = long.groupBy(*keys, "model").agg(F.sum(tested.cast("int")).alias("folds"), F.avg(F.when(tested, F.abs(error))).alias("mae"), F.sqrt(F.avg(F.when(tested, error * error))).alias("rmse"), F.avg("_step").alias("_scale"))
    return out.withColumn("mase", ratio(F.col("mae"), F.col("_scale"))).drop("_scale")


def holt_forecast(df: DataFrame, keys: Sequence[str], horizon: int = 5, alpha: float = 0.3, beta: float = 0.1) -> DataFrame:
    """Holt's linear smoothing as one fold over the ordered values, then ``horizon`` years ahead."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("year", F.col("articles").cast("double").alias("y")))), lambda s: s["y"])
    folded = df.groupBy(*keys).agg(values.alias("_v"), F.max("year").alias("_last")).where(F.size("_v") >= 2)

    def step(state, y):
        level = alpha * y + (1 - alpha) * (state["level"] + state["trend"])
        return F.struct(level.alias("level"), (beta * (level - state["level"]) + (1 - beta) * state["trend"]).alias("trend"))

    start = F.struct(F.get("_v", F.lit(0)).alias("level"), (F.get("_v", F.lit(1)) - F.get("_v", F.lit(0))).alias("trend"))
    final = folded.withColumn("_s", F.aggregate(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), start, step))
    ahead = final.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return ahead.select(*keys, (F.col("_last") + F.col("h")).alias("year"), (F.col("_s.level") + F.col("h") * F.col("_s.trend")).alias("forecast"))


def poisson_dispersion(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pearson chi-square of counts against their mean over n - 1 degrees: over 1 is overdispersed."""
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("articles").alias("mean"), F.var_samp("articles").alias("_v"))
    return sums.withColumn("dispersion", ratio(F.col("_v"), F.col("mean"))).drop("_v")


def bursts(df: DataFrame, keys: Sequence[str], scale: float = 2.0) -> DataFrame:
    """Two-state Poisson bursts: years whose likelihood gain at ``scale`` times the mean rate outweighs switching.

    A dynamic programme over the ordered values as one fold: each state keeps its cost and path; entering the burst costs
    ln(scale). Consecutive burst years are one interval, with strength observed over expected.
    """
    rows = F.array_sort(F.collect_list(F.struct("year", F.col("articles").cast("double").alias("y"))))
    held = df.groupBy(*keys).agg(rows.alias("_v"), F.avg("articles").alias("_rate")).where(F.col("_rate") > 0)
    enter = float(np.log(scale))

    def step(state, s):
        calm_cost = F.col("_rate") - s["y"] * F.log("_rate")
        burst_cost = F.col("_rate") * scale - s["y"] * F.log(F.col("_rate") * scale)
        from_burst = state["burst"] < state["calm"]
        stay = state["burst"] <= state["calm"] + enter
        calm = F.struct((F.least(state["calm"], state["burst"]) + calm_cost).alias("c"), F.concat(F.when(from_burst, state["pb"]).otherwise(state["pc"]), F.array(F.lit(0))).alias("p"))
        burst = F.struct((F.least(state["burst"], state["calm"] + enter) + burst_cost).alias("c"), F.concat(F.when(stay, state["pb"]).otherwise(state["pc"]), F.array(F.lit(1))).alias("p"))
        return F.struct(calm["c"].alias("calm"), burst["c"].alias("burst"), calm["p"].alias("pc"), burst["p"].alias("pb"))

    empty = F.array().cast("array<int>")
    start = F.struct(F.lit(0.0).alias("calm"), F.lit(enter).alias("burst"), empty.alias("pc"), empty.alias("pb"))
    path = F.aggregate("_v", start, step, lambda s: F.when(s["burst"] < s["calm"], s["pb"]).otherwise(s["pc"]))
    marked = held.withColumn("_p", path).select(*keys, "_rate", F.posexplode("_v").alias("_k", "_s"), "_p")
    states = marked.select(*keys, "_rate", F.col("_s.year").alias("year"), F.col("_s.y").alias("y"), F.get("_p", F.col("_k")).alias("on"))
    order = Window.partitionBy(*keys).orderBy("year")
    island = F.row_number().over(order) - F.sum("on").over(order.rowsBetween(Window.unboundedPreceding, 0))
    intervals = states.withColumn("_island", island).where("on = 1").groupBy(*keys, "_island").agg(F.min("year").alias("start"), F.max("year").alias("end"), ratio(F.avg("y"), F.first("_rate")).alias("strength"))
    return intervals.drop("_island")


#: Curves of cumulative or annual counts: function of (t, parameters), starting parameters from (t, y).
CURVES: dict[str, tuple[Callable, Callable]] = {
    "linear": (lambda t, a, b: a + b * t, lambda t, y: (y[0], (y[-1] - y[0]) / max(t[-1], 1))),
    "quadratic": (lambda t, a, b, c: a + b * t + c * t * t, lambda t, y: (y[0], 0.0, 0.0)),
    "cubic": (lambda t, a, b, c, d: a + b * t + c * t**2 + d * t**3, lambda t, y: (y[0], 0.0, 0.0, 0.0)),
    "logarithmic": (lambda t, a, b: a + b * np.log1p(t), lambda t, y: (y[0], 1.0)),
    "power": (lambda t, a, b: a * np.power(t + 1, b), lambda t, y: (max(y[0], 1.0), 0.5)),
    "exponential": (lambda t, a, b: a * np.exp(np.clip(b * t, -50, 50)), lambda t, y: (max(y.mean(), 1e-3), 0.01)),
    "logistic": (lambda t, k, r, m: k / (1 + np.exp(np.clip(-r * (t - m), -50, 50))), lambda t, y: (1.5 * max(y.max(), 1e-3), 0.3, t.mean())),
    "gompertz": (lambda t, k, b, r: k * np.exp(-b * np.exp(np.clip(-r * t, -50, 50))), lambda t, y: (1.5 * max(y.max(), 1e-3), 3.0, 0.1)),
    "monomolecular": (lambda t, k, b, r: k * (1 - b * np.exp(np.clip(-r * t, -50, 50))), lambda t, y: (1.5 * max(y.max(), 1e-3), 1.0, 0.1)),
    "bertalanffy": (lambda t, k, b, r: k * np.power(np.clip(1 - b * np.exp(np.clip(-r * t, -50, 50)), 0, None), 3), lambda t, y: (1.5 * max(y.max(), 1e-3), 0.8, 0.1)),
    "hill": (lambda t, k, h, n: k * np.power(t + 1, n) / (np.power(abs(h), n) + np.power(t + 1, n)), lambda t, y: (1.5 * max(y.max(), 1e-3), t.mean() + 1, 1.5)),
    "gaussian": (lambda t, a, m, s: a * np.exp(-np.clip((t - m) ** 2 / (2 * s * s + 1e-9), 0, 50)), lambda t, y: (max(y.max(), 1e-3), float(t[y.argmax()]), max(t[-1] / 4, 1.0))),
    "weibull": (lambda t, k, a, b: k * (1 - np.exp(-np.clip(np.power(t / max(abs(a), 1e-9), abs(b)), 0, 50))), lambda t, y: (1.5 * max(y.max(), 1e-3), max(t.mean(), 1.0), 1.5)),
    "richards": (lambda t, k, r, m, v: k / np.power(1 + max(abs(v), 1e-6) * np.exp(np.clip(-r * (t - m), -50, 50)), 1 / max(abs(v), 1e-6)), lambda t, y: (1.5 * max(y.max(), 1e-3), 0.3, t.mean(), 1.0)),
    "bass": (lambda t, k, p, q: k * (1 - np.exp(-np.clip((p + q) * t, -50, 50))) / (1 + q / (np.sign(p) * max(abs(p), 1e-9)) * np.exp(-np.clip((p + q) * t, -50, 50))), lambda t, y: (1.5 * max(y.max(), 1e-3), 0.03, 0.3)),
    "harmonic": (lambda t, a, b, c, w: a + b * np.sin(w * t) + c * np.cos(w * t), lambda t, y: (y.mean(), y.std(), 0.0, 2 * np.pi / max(len(t) / 2, 2))),
}


def _levenberg(curve: Callable, start: Sequence[float], t: np.ndarray, y: np.ndarray, rounds: int = 120) -> np.ndarray:
    """Least-squares parameters by damped Gauss-Newton steps with numerical derivatives."""
    p, damp = np.array(start, float), 1e-2
    error = y - curve(t, *p)
    for _ in range(rounds):
        steps = np.maximum(np.abs(p), 1e-3) * 1e-6
        base = y - error
        jacobian = np.stack([(curve(t, *(p + h)) - base) / h.sum() for h in np.diag(steps)], axis=1)
        normal = jacobian.T @ jacobian
        try:
            move = np.linalg.solve(normal + damp * np.diag(np.maximum(np.diag(normal), 1e-12)), jacobian.T @ error)
        except np.linalg.LinAlgError:
            break
        fresh = y - curve(t, *(p + move))
        if np.isfinite(fresh).all() and fresh @ fresh < error @ error:
            done = error @ error - fresh @ fresh < 1e-10 * max(error @ error, 1e-12)
            p, error, damp = p + move, fresh, max(damp / 5, 1e-9)
            if done:
                break
        else:
            damp *= 5
            if damp > 1e9:
                break
    return p


def fit_curves(df: DataFrame, keys: Sequence[str], horizon: int = 5) -> DataFrame:
    """Per series and curve: parameters, R2, adjusted R2, RMSE, MAE, AIC, BIC, Akaike weight, rank and forecast."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds + ', ' if kinds else ''}model string, parameters array<double>, r2 double, adj_r2 double, rmse double, mae double, aic double, bic double, forecast array<double>"

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["year", "articles"]).sort_values("year")
        t, y = (rows["year"] - rows["year"].min()).to_numpy(float), rows["articles"].to_numpy(float)
        out = []
        for name, (curve, start) in CURVES.items() if len(y) else ():
            begin = start(t, y)
            n, k = len(y), len(begin)
            if n <= k + 1:
                continue
            with np.errstate(all="ignore"):
                p = _levenberg(curve, begin, t, y)
                error = y - curve(t, *p)
                ahead = curve(t[-1] + np.arange(1, horizon + 1), *p)
            sse, sst = float(error @ error), float(((y - y.mean()) ** 2).sum())
            if not np.isfinite(sse):
                continue
            r2 = min(max(1 - sse / sst, 0.0), 1.0) if sst else 0.0
            spread = n * np.log(max(sse / n, 1e-12))
            out.append((*(rows[c].iloc[0] for c in keys), name, p.tolist(), r2, max(1 - (1 - r2) * (n - 1) / (n - k - 1), 0.0), (sse / n) ** 0.5, float(np.abs(error).mean()), spread + 2 * (k + 1), spread + np.log(n) * (k + 1), ahead.tolist()))
        return pd.DataFrame(out, columns=[*keys, "model", "parameters", "r2", "adj_r2", "rmse", "mae", "aic", "bic", "forecast"])

    source = df.select(*keys, "year", "articles")
    fitted = (source.groupBy(*keys) if keys else source.groupBy(F.lit(0))).applyInPandas(fit, schema)
    own = Window.partitionBy(*keys)
    likelihood = F.exp(-(F.col("aic") - F.min("aic").over(own)) / 2)
    return fitted.withColumn("_l", likelihood).withColumns({"weight": F.col("_l") / F.sum("_l").over(own), "rank": F.row_number().over(own.orderBy("aic", "model"))}).drop("_l")


def spectrum(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Power of each non-zero frequency of the detrended series: ``frequency`` (cycles in the series), ``period``, share.

    A discrete Fourier sum over the join of years and frequencies, both bounded by the span of years.
    """
    line = trend(df, keys, "year", "articles").select(*keys, "slope", "intercept")
    joined = df.join(line, list(keys)) if keys else df.crossJoin(F.broadcast(line))
    own = Window.partitionBy(*keys)
    left = joined.withColumns({"e": F.col("articles") - F.col("intercept") - F.col("slope") * F.col("year"), "t": F.row_number().over(own.orderBy("year")) - 1, "n": F.count("*").over(own)}).where("n >= 4")
    waves = left.withColumn("frequency", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    angle = 2 * np.pi * F.col("frequency") * F.col("t") / F.col("n")
    power = waves.groupBy(*keys, "frequency", "n").agg(F.sum(F.col("e") * F.cos(angle)).alias("_c"), F.sum(F.col("e") * F.sin(angle)).alias("_s")).withColumn("power", (F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) / F.col("n"))
    return power.select(*keys, "frequency", (F.col("n") / F.col("frequency")).alias("period"), "power", ratio(F.col("power"), F.sum("power").over(own)).alias("share"))


def with_p_values(df: DataFrame, z: str = "z") -> DataFrame:
    """``df`` with the two-sided normal ``p_value`` of column ``z``."""
    return df.withColumn("p_value", stats.normal_two_sided(F.col(z)))


def fisher_g(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fisher's test for one hidden period: per series ``n, harmonic`` (how often the strongest wave goes through), ``period, g`` (its
    share of the periodogram) and ``p_value``, from the values less their mean.

    Waves are those of 1 to (n - 1) // 2 turns; each is two sums over the series. Series of under five values, and constant ones,
    have no rows. p sums Fisher's alternating terms that count, in logs of binomials.
    """
    own = Window.partitionBy(*keys)
    y = F.col("articles").cast("double")
    rows = df.where("articles is not null").select(*keys, (y - F.avg(y).over(own)).alias("y"), (F.row_number().over(own.orderBy("year")) - 1).alias("t"), F.count("*").over(own).alias("n")).where("n >= 5")
    waves = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.floor((F.col("n") - 1) / 2).cast("int"))))
    angle = 2 * math.pi * F.col("k") * F.col("t") / F.col("n")
    power = waves.groupBy(*keys, "n", "k").agg((F.pow(F.sum(F.col("y") * F.cos(angle)), 2) + F.pow(F.sum(F.col("y") * F.sin(angle)), 2)).alias("p"))
    best = power.groupBy(*keys, "n").agg(F.sum("p").alias("_all"), F.count("*").alias("m"), F.max("p").alias("_top"), F.max_by("k", F.struct(F.round("p", 9), -F.col("k"))).alias("harmonic")).where("_all > 1e-9")
    found = best.withColumn("g", F.col("_top") / F.col("_all"))
    m = F.col("m").cast("double")
    logs = lambda j: log_gamma(m + 1) - log_gamma(j + 1.0) - log_gamma(m - j + 1.0) + (m - 1) * F.log(1 - j * F.col("g"))
    term = lambda j: F.when(j * F.col("g") < 1, F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(logs(j))).otherwise(0.0)
    p = F.aggregate(F.sequence(F.lit(1), F.least(F.col("m").cast("int"), F.floor(1 / F.col("g")).cast("int"))), F.lit(0.0), lambda acc, j: acc + term(j))
    return found.select(*keys, "n", "harmonic", (F.col("n") / F.col("harmonic")).alias("period"), "g", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p_value"))
