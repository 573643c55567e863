"""Distribution tests, running counts and BCa intervals against plain computations on all values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.functions import distributions as D
from citeloom.functions import stats
from citeloom.operators import goodness


def values_frame(spark, groups):
    return spark.createDataFrame([(g, float(v)) for g, xs in groups.items() for v in xs] + [("a", None)], "g string, v double")


def test_running_counts_of_many_values(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(size=900), "b": rng.integers(0, 7, 400), None: [1.0, 1.0, 2.0]}
    found = stats.cumulated(values_frame(spark, groups), ["g"], "v").collect()
    assert len(found) == 900 + 7 + 2
    for r in found:
        x = np.array(groups[r["g"]], dtype=float)
        assert (r["n"], r["before"], r["total"]) == ((x == r["x"]).sum(), (x < r["x"]).sum(), len(x))
        assert r["sum_before"] == pytest.approx(x[x < r["x"]].sum(), abs=1e-9) and r["sum_total"] == pytest.approx(x.sum())


def test_digamma_and_gamma_shape(spark):
    row = spark.range(1).select(D.digamma(F.lit(1.0)).alias("a"), D.digamma(F.lit(12.5)).alias("b"), D.trigamma(F.lit(1.0)).alias("c"), D.gamma_shape(F.log(F.lit(2.5)) - D.digamma(F.lit(2.5))).alias("d")).first()
    assert row["a"] == pytest.approx(-goodness.EULER, abs=1e-8) and row["c"] == pytest.approx(math.pi**2 / 6, abs=1e-8) and row["d"] == pytest.approx(2.5, abs=1e-8)
    assert row["b"] == pytest.approx((math.lgamma(12.5001) - math.lgamma(12.4999)) / 2e-4, abs=1e-6)


def gamma_cdf(shape, rate, x):
    grid = np.linspace(0, rate * x, 20_001)
    mid = (grid[1:] + grid[:-1]) / 2
    return float((mid ** (shape - 1) * np.exp(-mid)).sum() * (grid[1] - grid[0]) / math.gamma(shape))


def test_distances_to_five_families(spark):
    rng = np.random.default_rng(1)
    xs = np.round(rng.gamma(3.0, 2.0, 150), 1) + 0.1
    frame = values_frame(spark, {"a": [*xs, -1.0, 0.0], "few": [1.0, 2.0]})
    found = {r["family"]: r for r in goodness.ks_families(frame, ["g"], "v").collect() if r["g"] == "a"}
    assert set(found) == set(goodness.FAMILIES)
    assert not [r for r in goodness.ks_families(frame, ["g"], "v").collect() if r["g"] == "few"]
    phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
    logs = np.log(xs)
    shape, rate = found["gamma"]["first"], found["gamma"]["second"]
    k = math.pi / (logs.std(ddof=1) * math.sqrt(6))
    scale = math.exp(logs.mean() + goodness.EULER / k)
    cdf = {"normal": lambda x: phi((x - xs.mean()) / xs.std()), "log_normal": lambda x: phi((math.log(x) - logs.mean()) / logs.std()), "exponential": lambda x: 1 - math.exp(-x / xs.mean()), "gamma": lambda x: gamma_cdf(shape, rate, x), "weibull": lambda x: 1 - math.exp(-((x / scale) ** k))}
    for family, f in cdf.items():
        far = max(max(abs((xs <= x).mean() - f(x)), abs((xs < x).mean() - f(x))) for x in np.unique(xs))
        assert found[family]["statistic"] == pytest.approx(far, abs=1e-5), family
    assert shape / rate == pytest.approx(xs.mean()) and found["gamma"]["p_value"] > 0.2 > found["exponential"]["p_value"]


def test_anderson_darling(spark):
    rng = np.random.default_rng(2)
    groups = {"normal": np.round(rng.normal(5, 2, 80), 1), "skewed": np.round(rng.exponential(1, 80), 2), "flat": [3.0] * 9, "few": [1.0, 2.0]}
    found = {r["g"]: r for r in goodness.anderson_darling(values_frame(spark, groups).where("g <> 'a'"), ["g"], "v").collect()}
    for g in ("normal", "skewed"):
        y = np.sort((groups[g] - groups[g].mean()) / groups[g].std(ddof=1))
        n = len(y)
        log_p, log_q = ([math.log(0.5 * math.erfc(s * z / math.sqrt(2))) for z in y] for s in (-1, 1))
        expected = -n - sum((2 * i + 1) * (log_p[i] + log_q[n - 1 - i]) for i in range(n)) / n
        assert found[g]["statistic"] == pytest.approx(expected, abs=1e-4)
    assert found["normal"]["p_value"] > 0.05 > found["skewed"]["p_value"] and found["flat"]["statistic"] is None and "few" not in found


def test_two_samples_and_categories(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, 90), rng.integers(4, 40, 70)
    frame = spark.createDataFrame([(int(v), True) for v in a] + [(int(v), False) for v in b] + [(3, None), (None, True)], "v int, first boolean")
    row = goodness.ks_two_samples(frame, "v", F.col("first")).first()
    far = max(abs((a <= x).mean() - (b <= x).mean()) for x in range(41))
    assert (row["n1"], row["n2"]) == (90, 70) and row["statistic"] == pytest.approx(far) and row["p_value"] < 0.05
    even = goodness.chi_square_fit(frame.where("v < 3"), "v").first()
    counts = [int((np.concatenate([a, b]) == k).sum()) for k in range(3)]
    assert even["statistic"] == pytest.approx(sum((c - sum(counts) / 3) ** 2 / (sum(counts) / 3) for c in counts)) and even["df"] == 2
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0), (99, 1.0)], "v int, weight double")
    named = goodness.chi_square_fit(frame.where("v < 2"), "v", weights).first()
    n = counts[0] + counts[1]
    assert named["statistic"] == pytest.approx((counts[0] - n / 4) ** 2 / (n / 4) + (counts[1] - n / 2) ** 2 / (n / 2) + n / 4)


def plain_scan(x, least):
    out = {}
    for low in np.unique(x[x > 0]):
        tail = x[x >= low]
        logs = np.log(tail / low).sum()
        if len(tail) >= least and logs > 1e-12:
            alpha = 1 + len(tail) / logs
            out[low] = (alpha, max(abs((tail <= v).mean() - (1 - (low / v) ** (alpha - 1))) for v in np.unique(tail)))
    return out


def test_power_law_scan(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([np.floor(5 * (1 - rng.random(300)) ** (-1 / 1.5)), rng.integers(1, 5, 200)])
    frame = values_frame(spark, {"a": x, "same": [2.0] * 20})
    found = goodness.power_law_scan(frame, "v", ["g"], candidates=1000).collect()
    expected = plain_scan(x, 10)
    assert {r["x_min"] for r in found} == set(expected) and {r["g"] for r in found} == {"a"}
    for r in found:
        assert (r["alpha"], r["ks"]) == pytest.approx(expected[r["x_min"]], abs=1e-9)
    best = [r["x_min"] for r in found if r["best"]]
    assert best == [min(expected, key=lambda low: (round(expected[low][1], 9), low))]
    few = goodness.power_law_scan(frame.where("g = 'a'"), "v", candidates=8).collect()
    assert 6 <= len(few) <= 9 and {r["x_min"] for r in few} <= set(expected) and min(r["x_min"] for r in few) == 1


def test_rank_size(spark):
    frame = spark.createDataFrame([(1000.0 / i,) for i in range(1, 80)], "v double")
    row = goodness.rank_size_slope(frame, "v").first()
    assert row["slope"] == pytest.approx(-1) and row["power_law"] and row["r2"] == pytest.approx(1)
    assert goodness.rank_size_slope(frame.limit(10), "v").first()["power_law"] is None


def gini(x):
    x = np.sort(x)
    n = len(x)
    return 2 * (np.arange(1, n + 1) * x).sum() / (n * x.sum()) - (n + 1) / n


@pytest.mark.parametrize(("kind", "statistic"), [("mean", np.mean), ("gini", gini), ("median", np.median)])
@pytest.mark.parametrize("n", [200, 201])
def test_left_out_values_are_exact(spark, kind, statistic, n):
    x = np.floor(np.random.default_rng(5).exponential(20, n))
    left = stats._left_out(stats.cumulated(values_frame(spark, {"a": x}), [], "v"), kind).collect()
    direct = sorted(round(float(statistic(np.delete(x, i))), 9) for i in range(n))
    assert sorted(round(r["j"], 9) for r in left for _ in range(int(r["n"]))) == direct


def test_bca_is_near_a_direct_one(spark):
    rng = np.random.default_rng(6)
    x = np.floor(rng.exponential(20, 200))
    frame = values_frame(spark, {"a": x})
    for kind, statistic in (("mean", np.mean), ("gini", gini)):
        draws = np.sort([statistic(rng.choice(x, 200)) for _ in range(6000)])
        estimate = statistic(x)
        left = np.array([statistic(np.delete(x, i)) for i in range(200)])
        d = left.mean() - left
        a = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        quantile = lambda p: float(np.quantile(draws, p))
        phi = lambda z: 0.5 * math.erfc(-z / math.sqrt(2))
        share = (draws < estimate).mean()
        z0 = min(np.linspace(-1, 1, 20001), key=lambda z: abs(phi(z) - share))
        ends = [quantile(phi(z0 + (z0 + z) / (1 - a * (z0 + z)))) for z in (-1.959964, 1.959964)]
        row = stats.bca(frame, "v", kind, 2000).first()
        assert row["estimate"] == pytest.approx(estimate) and row["acceleration"] == pytest.approx(a, rel=1e-6)
        assert [row["low"], row["high"]] == pytest.approx(ends, rel=0.015)
    assert stats.bca(frame.limit(1), "v", "mean", 20).first()["low"] is None
    with pytest.raises(ValueError):
        stats.bca(frame, "v", "mode")
