"""Break points against brute force over all partitions of short series."""

import itertools
import math

import numpy as np
import pytest

from citeloom.operators import segments


def frame_of(spark, series):
    rows = [(g, 1990 + i, float(v)) for g, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "g string, year int, articles double")


def likelihood(x):
    n, squares = len(x), ((x - x.mean()) ** 2).sum()
    variance = max(squares / n, segments.FLOOR)
    return n / 2 * (math.log(2 * math.pi) + math.log(variance) + squares / n / variance)


def partitions(n, least):
    for k in range(n):
        for cuts in itertools.combinations(range(1, n), k):
            if all(b - a >= least for a, b in itertools.pairwise((0, *cuts, n))):
                yield cuts


SERIES = {
    "steps": [1.0, 2, 1, 2, 30, 31, 29, 30, 31, 2, 1],
    "spread": [5.0, 5, 5, 6, 1, 12, 0, 14, 2, 11, 5],
    "flat": [3.0] * 8,
    "few": [1.0],
    "two": [1.0, 9],
    "random": [float(v) for v in np.random.default_rng(1).integers(0, 40, 12)],
}


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("penalty", ["bic", "aic"])
def test_partition_is_the_cheapest_of_all(spark, least, penalty):
    found = {r["g"]: r for r in segments.optimal_partition(frame_of(spark, SERIES), ["g"], penalty=penalty, least=least).collect()}
    for g, values in SERIES.items():
        x = np.array(values)
        beta = math.log(len(x)) if penalty == "bic" else 2.0
        costs = {cuts: sum(likelihood(x[a:b]) for a, b in itertools.pairwise((0, *cuts, len(x)))) + beta * len(cuts) for cuts in partitions(len(x), least)}
        if not costs:
            assert found[g]["places"] == [] and found[g]["cost"] == pytest.approx(likelihood(x))
            continue
        assert found[g]["cost"] == pytest.approx(min(costs.values()), abs=1e-7), g
        assert costs[tuple(found[g]["places"])] == pytest.approx(min(costs.values()), abs=1e-7)
        assert found[g]["breaks"] == [1989 + p for p in found[g]["places"]]


def test_partition_of_a_long_series_gives_cuts_up(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(m, 1, 60) for m in (0, 8, 3, -4)])
    row = segments.optimal_partition(frame_of(spark, {"a": values.tolist()}), ["g"]).first()
    assert all(min(abs(p - c) for p in row["places"]) <= 2 for c in (60, 120, 180)) and len(row["places"]) <= 8


def test_mean_breaks_are_least_squares(spark):
    rng = np.random.default_rng(3)
    series = {"a": (rng.normal(size=12) + np.repeat([0, 4, -3], 4)).tolist(), "short": [1.0] * 9, "flat": [2.0] * 10}
    found = segments.mean_breaks(frame_of(spark, series), ["g"], most=3).collect()
    x = np.array(series["a"])
    for r in (r for r in found if r["g"] == "a"):
        sse = lambda cuts: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise((0, *cuts, 12)))
        best = min((sse(c), c) for c in partitions(12, 2) if len(c) == r["m"])
        assert r["ssr"] == pytest.approx(best[0], abs=1e-7) and r["breaks"] == [1989 + c for c in best[1]]
        if r["m"]:
            assert r["f"] == pytest.approx((sse(()) - best[0]) / r["m"] / (best[0] / (11 - r["m"]))) and 0 <= r["p_value"] <= 1
    assert [r["m"] for r in found if r["g"] == "a" and r["best"]] == [2]
    assert {r["g"] for r in found} == {"a", "flat"} and [r["m"] for r in found if r["g"] == "flat" and r["best"]] == [0]


def plain_binary(x, least, most):
    queue, cuts = [(0, len(x))], []
    while queue and len(cuts) < most:
        a, b = queue.pop(0)
        if b - a <= 2 * least:
            continue
        best = min((round(k * math.log(x[a : a + k].var() + 1) + (b - a - k) * math.log(x[a + k : b].var() + 1), 9), k) for k in range(least + 1, b - a - least + 1))
        cuts.append(a + best[1])
        queue += [(a, a + best[1]), (a + best[1], b)]
    return cuts


def test_binary_segmentation(spark):
    rng = np.random.default_rng(5)
    series = {"a": (rng.normal(size=40) + np.repeat([0, 6, 0, 9], 10)).tolist(), "b": rng.normal(size=12).tolist(), "c": [1.0] * 6}
    found = segments.binary_segmentation(frame_of(spark, series), ["g"], least=3, most=4).collect()
    for g, values in series.items():
        assert [r["year"] - 1989 for r in sorted(found, key=lambda r: r["break_no"]) if r["g"] == g] == plain_binary(np.array(values), 3, 4)
    assert all(r["gain"] > -1e-9 for r in found)


def test_methods_agree_on_a_plain_step(spark):
    values = [10.0 + i % 2 for i in range(20)] + [40.0 + i % 3 for i in range(20)]
    found = segments.change_points(frame_of(spark, {"a": values}), ["g"]).collect()
    at = [r for r in found if r["year"] == 2009]
    assert {r["method"] for r in at} == {"pelt", "binseg", "cusum", "pettitt"} and all(r["votes"] == 4 and r["consensus"] for r in at)


def test_phases_of_segments(spark):
    frame = frame_of(spark, {"a": [10.0, 10, 10, 10, 20, 26, 32, 38, 40, 38, 36, 34]})
    breaks = spark.createDataFrame([("a", [1993, 1997])], "g string, breaks array<int>")
    rows = sorted(segments.segment_phases(frame, ["g"], breaks).collect(), key=lambda r: r["segment"])
    assert [(r["segment"], r["start_year"], r["end_year"], r["n"], r["phase"]) for r in rows] == [(1, 1990, 1993, 4, "stagnation"), (2, 1994, 1997, 4, "rapid_growth"), (3, 1998, 2001, 4, "decline")]
    assert rows[1]["growth_rate"] == pytest.approx(100 * 6 / 29)
