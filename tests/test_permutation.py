"""Permutation tests of networks against every order of their nodes."""

import itertools

import numpy as np
import pytest

from citeloom.operators import permutation

NODES = "abcdef"


def network(spark, matrix, names=NODES):
    rows = [(names[j], names[i], float(matrix[i, j])) for i in range(len(names)) for j in range(i) if matrix[i, j]]
    return spark.createDataFrame(rows, "a string, b string, weight double")


def random_matrix(seed, n=6):
    rng = np.random.default_rng(seed)
    m = np.tril(rng.integers(0, 5, (n, n)) * (rng.random((n, n)) < 0.7), -1).astype(float)
    return m + m.T


def lower(m):
    return m[np.tril_indices(len(m), -1)]


def average_ranks(x):
    return np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_qap_against_all_orders(spark, method):
    x, y = random_matrix(1), random_matrix(2)
    r = lambda a, b: np.corrcoef(*(average_ranks(lower(m)) if method == "spearman" else lower(m) for m in (a, b)))[0, 1]
    every = [r(x[np.ix_(p, p)], y) for p in map(list, itertools.permutations(range(6)))]
    observed = r(x, y)
    nodes = spark.createDataFrame([(c,) for c in NODES], "node string")
    moves = permutation.every_permutation(nodes)
    assert moves.count() == 720 * 6 and moves.groupBy("round").agg({"target": "count"}).count() == 720
    row = permutation.qap(network(spark, x), network(spark, y), method=method, nodes=nodes, moves=moves).first()
    others = np.array(every[1:])  # round 0 is the order as it is
    above, below = (others >= observed - 1e-9).mean(), (others <= observed + 1e-9).mean()
    assert row["correlation"] == pytest.approx(observed) and row["p_one"] == pytest.approx(above) and row["p_two"] == pytest.approx(min(1, 2 * min(above, below)))
    assert row["mean"] == pytest.approx(others.mean()) and row["sd"] == pytest.approx(others.std(ddof=1))


def test_seeded_rounds_are_permutations_and_repeat(spark):
    nodes = spark.createDataFrame([(i,) for i in range(30)], "node long")
    first, again = (sorted(permutation.permutations(nodes, 20, seed=3).collect()) for _ in range(2))
    assert first == again
    for k in range(21):
        moves = [(r["node"], r["target"]) for r in first if r["round"] == k]
        assert sorted(n for n, _ in moves) == sorted(t for _, t in moves) == list(range(30))
        assert (k == 0) == all(n == t for n, t in moves)


def test_p_of_seeded_rounds_is_near_the_exact_one(spark):
    x = random_matrix(5, 12)
    y = x + random_matrix(6, 12)
    names = "abcdefghijkl"
    row = permutation.qap(network(spark, x, names), network(spark, y, names), rounds=300).first()
    assert row["correlation"] == pytest.approx(np.corrcoef(lower(x), lower(y))[0, 1]) and row["p_two"] < 0.02 and abs(row["mean"]) < 0.05 and row["rounds"] == 300
    free = permutation.qap(network(spark, random_matrix(7, 12), names), network(spark, random_matrix(8, 12), names), rounds=300).first()
    assert free["p_two"] > 0.05


def test_mrqap_against_all_orders(spark):
    y, a, b = random_matrix(11), random_matrix(12), random_matrix(13)
    design = np.column_stack([np.ones(15), lower(a), lower(b)])
    fit = lambda m: np.linalg.lstsq(design, lower(m), rcond=None)[0]
    every = np.array([fit(y[np.ix_(p, p)]) for p in map(list, itertools.permutations(range(6)))])
    nodes = spark.createDataFrame([(c,) for c in NODES], "node string")
    found = {r["term"]: r for r in permutation.mrqap(network(spark, y), {"a": network(spark, a), "b": network(spark, b)}, nodes=nodes, moves=permutation.every_permutation(nodes)).collect()}
    residual = lower(y) - design @ every[0]
    for i, term in enumerate(("constant", "a", "b")):
        others = every[1:, i]
        above, below = (others >= every[0, i] - 1e-9).mean(), (others <= every[0, i] + 1e-9).mean()
        assert found[term]["coefficient"] == pytest.approx(every[0, i]) and found[term]["std_error"] == pytest.approx(others.std(ddof=1))
        assert found[term]["p_value"] == pytest.approx(min(1, 2 * min(above, below)))
        assert found[term]["r2"] == pytest.approx(1 - (residual**2).sum() / ((lower(y) - lower(y).mean()) ** 2).sum())


def test_pairs_add_up_and_empty_networks_have_no_correlation(spark):
    twice = spark.createDataFrame([("b", "a", 1.0), ("a", "b", 2.0), ("a", "a", 9.0), ("a", None, 1.0), ("b", "c", 1.0)], "a string, b string, weight double")
    assert sorted(tuple(r) for r in permutation.dyads(twice).collect()) == [("a", "b", 3.0), ("b", "c", 1.0)]
    row = permutation.qap(twice, twice.limit(0), rounds=5).first()
    assert row["correlation"] is None and row["nodes"] == 3
    with pytest.raises(ValueError):
        permutation.every_permutation(spark.range(9).withColumnRenamed("id", "node"))
