"""Least squares with several predictors against numpy, and distribution functions against tables and quadrature."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import distributions as D
from citeloom.operators import regression


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("made", "expected"), [
    (lambda: D.log_gamma(F.lit(7.5)), math.lgamma(7.5)),
    (lambda: D.log_gamma(F.lit(0.3)), math.lgamma(0.3)),
    (lambda: D.t_two_sided(F.lit(2.228138852), F.lit(10)), 0.05),
    (lambda: D.t_two_sided(F.lit(-12.706204736), F.lit(1)), 0.05),
    (lambda: D.f_tail(F.lit(2.866081402), F.lit(4), F.lit(20)), 0.05),
    (lambda: D.f_tail(F.lit(0.0), F.lit(4), F.lit(20)), 1.0),
    (lambda: D.f_tail(F.lit(1.5), F.lit(4), F.lit(0)), None),
    (lambda: D.chi_square_tail(F.lit(11.07049769), F.lit(5.0)), 0.05),
    (lambda: D.chi_square_tail(F.lit(124.3421134), F.lit(100.0)), 0.05),
    (lambda: D.gamma_lower(F.lit(2.5), F.lit(0.0)), 0.0),
    (lambda: D.normal_quantile(F.lit(0.975)), 1.959963985),
    (lambda: D.normal_quantile(F.lit(0.001)), -3.090232306),
    (lambda: D.normal_quantile(F.lit(0.3)), -0.524400513),
    (lambda: D.kolmogorov_tail(F.lit(1.3581 / (10 + 0.12 + 0.011)), F.lit(100)), 0.05),
])
def test_distribution_functions(spark, made, expected):
    found = value(spark, made())
    assert found is None if expected is None else found == pytest.approx(expected, abs=2e-6)


def test_beta_matches_quadrature(spark):
    grid = np.linspace(0, 1, 400_001)
    mid = (grid[1:] + grid[:-1]) / 2
    for a, b, x in ((2.0, 5.0, 0.2), (7.5, 1.5, 0.9), (30.0, 40.0, 0.45)):
        density = mid ** (a - 1) * (1 - mid) ** (b - 1)
        assert value(spark, D.beta_lower(F.lit(a), F.lit(b), F.lit(x))) == pytest.approx(density[mid < x].sum() / density.sum(), abs=1e-5)


def table(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g, n in (("a", 60), ("b", 9), ("c", 3)):
        x = rng.normal(size=(n, 2)) + [2000, -3]
        rows += [(g, float(u), float(v), float(2 * u - v + rng.normal()), float(u + 1)) for u, v in x]
    rows += [("a", None, 1.0, 2.0, 1.0), (None, 1.0, 2.0, 3.0, 4.0), ("d", 1.0, 1.0, None, 1.0)]
    return spark.createDataFrame(rows, "g string, u double, v double, y double, copy double"), rows


def plain(rows, g, columns):
    kept = [r for r in rows if r[0] == g and None not in r[1:]]
    design = np.array([[1.0, *(r[c] for c in columns)] for r in kept])
    y = np.array([r[3] for r in kept])
    b = np.linalg.lstsq(design, y, rcond=None)[0]
    sse = float(((y - design @ b) ** 2).sum())
    left = len(y) - design.shape[1]
    errors = np.sqrt(sse / left * np.diag(np.linalg.inv(design.T @ design))) if left > 0 else None
    return b, errors, sse, ((y - y.mean()) ** 2).sum(), len(y)


def test_coefficients_match_numpy(spark):
    frame, rows = table(spark)
    found = {(r["g"], r["term"]): r for r in regression.coefficients(frame, ["g"], "y", ["u", "v"]).collect()}
    for g in "ab":
        b, errors, *_ = plain(rows, g, (1, 2))
        for k, term in enumerate(("constant", "u", "v")):
            row = found[g, term]
            assert row["coefficient"] == pytest.approx(b[k], rel=1e-6) and row["std_error"] == pytest.approx(errors[k], rel=1e-5)
            assert 0 <= row["p_value"] <= 1 and row["t"] == pytest.approx(b[k] / errors[k], rel=1e-5)
    assert found["c", "u"]["coefficient"] is not None and found["c", "u"]["std_error"] is None
    assert ("d", "u") not in found and found[None, "u"]["coefficient"] is None


def test_summary_and_nested_fit(spark):
    frame, rows = table(spark, 1)
    small, large = plain(rows, "a", (1,)), plain(rows, "a", (1, 2))
    fit = {r["g"]: r for r in regression.summary(frame, ["g"], "y", ["u", "v"]).collect()}["a"]
    assert (fit["n"], fit["df1"], fit["df2"]) == (60, 2, 57)
    assert fit["r2"] == pytest.approx(1 - large[2] / large[3]) and fit["f"] == pytest.approx((large[3] - large[2]) / 2 / (large[2] / 57))
    step = {r["g"]: r for r in regression.nested_f(frame, ["g"], "y", ["u"], ["v"]).collect()}["a"]
    assert step["f"] == pytest.approx((small[2] - large[2]) / (large[2] / 57), rel=1e-6) and step["df1"] == 1
    t = {(r["g"], r["term"]): r for r in regression.coefficients(frame, ["g"], "y", ["u", "v"]).collect()}["a", "v"]
    assert step["p_value"] == pytest.approx(t["p_value"], abs=1e-9) and t["t"] ** 2 == pytest.approx(step["f"], rel=1e-6)


def test_dependent_predictors_get_null(spark):
    frame, rows = table(spark, 2)
    found = {(r["g"], r["term"]): r for r in regression.coefficients(frame, ["g"], "y", ["u", "copy", "v"]).collect()}
    alone = plain(rows, "a", (1, 2))
    assert found["a", "copy"]["coefficient"] is None and found["a", "copy"]["std_error"] is None
    assert found["a", "u"]["coefficient"] == pytest.approx(alone[0][1], rel=1e-6) and found["a", "v"]["std_error"] == pytest.approx(alone[1][2], rel=1e-5)
    fit = {r["g"]: r for r in regression.summary(frame, ["g"], "y", ["u", "copy", "v"]).collect()}["a"]
    assert (fit["df1"], fit["df2"]) == (2, 57)


def test_residuals_and_no_keys(spark):
    frame, rows = table(spark, 3)
    known = frame.where("g = 'a'")
    left = regression.residuals(known, [], "y", ["u", "v"])
    sums = left.agg(F.sum("residual").alias("s"), F.sum(F.col("residual") * F.col("residual")).alias("q"), F.count("*").alias("n"), F.count("residual").alias("k")).first()
    assert sums["s"] == pytest.approx(0, abs=1e-6) and sums["q"] == pytest.approx(plain(rows, "a", (1, 2))[2], rel=1e-6)
    assert (sums["n"], sums["k"]) == (61, 60)
    assert regression.summary(known.limit(0), [], "y", ["u"]).collect() == []
    assert regression.summary(known.withColumn("y", F.lit(4.0)), [], "y", ["u"]).first()["r2"] == 1.0


def test_ridge_polynomial_matches_numpy(spark):
    rng = np.random.default_rng(4)
    years = np.arange(1990, 2014)
    y = 3 + 0.5 * (years - 1990) ** 1.5 + rng.normal(size=len(years))
    frame = spark.createDataFrame([("k", int(a), float(b)) for a, b in zip(years, y, strict=True)], "g string, year int, articles double")
    found = regression.ridge_polynomial(frame, ["g"]).first()
    x = np.stack([(years - 1990.0), (years - 1990.0) ** 2], axis=1)
    design = np.column_stack([np.ones(len(y)), x])
    top = np.abs(design.T @ y).max() / len(y)

    def solve(rows, penalty):
        d = design[rows]
        return np.linalg.solve(d.T @ d + penalty * np.diag([0, 1, 1]), d.T @ y[rows])

    best = min((round(float(np.mean([np.mean((y[years % 5 == f] - design[years % 5 == f] @ solve(years % 5 != f, p)) ** 2) for f in range(5)])), 9), k, p) for k in range(100) for p in [top * math.exp(k * math.log(1e-4) / 99)])
    b = solve(years > 0, best[2])
    assert found["penalty"] == pytest.approx(best[2]) and found["cv_error"] == pytest.approx(best[0])
    assert [found["constant"], found["b1"], found["b2"]] == pytest.approx(list(b), rel=1e-6)


def test_a_random_walk_has_a_unit_root_and_noise_has_none(spark):
    rng = np.random.default_rng(7)
    steps = rng.normal(size=120)
    rows = [(g, 1900 + i, float(v)) for g, series in (("walk", np.cumsum(steps)), ("noise", steps)) for i, v in enumerate(series)]
    frame = spark.createDataFrame(rows, "g string, year int, articles double")
    found = {r["g"]: r for r in regression.unit_root(frame, ["g"]).collect()}
    assert found["noise"]["level"] == 0.01 and not found["walk"]["stationary"]
    assert found["walk"]["critical_5"] == pytest.approx(-2.886, abs=2e-3)
    pair = frame.where("g = 'walk'").withColumn("other", 2 * F.col("articles") + F.sin(F.col("year") * 1.7))
    assert regression.cointegration(pair, ["g"], "other", "articles").first()["level"] == 0.01


def test_the_past_of_a_driver(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=80)
    y = np.concatenate([[0.0], 0.9 * x[:-1]]) + 0.1 * rng.normal(size=80)
    frame = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "year int, y double, x double")
    assert regression.granger(frame, [], "y", "x").first()["p_value"] < 1e-6
    assert regression.granger(frame, [], "x", "y").first()["p_value"] > 0.01
