"""Communities by modularity against all partitions of small graphs."""

import numpy as np
import pytest

from citeloom.operators import modularity, networks


def graph(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "a long, b long, weight double")


def score(edges, label):
    total = 2 * sum(w for *_, w in edges)
    k = {}
    for a, b, w in edges:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(2 * w for a, b, w in edges if label[a] == label[b]) / total
    return inside - sum((sum(k[n] for n in k if label[n] == c) / total) ** 2 for c in set(label.values()))


def partitions(nodes):
    if not nodes:
        yield []
        return
    for rest in partitions(nodes[1:]):
        yield [[nodes[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [nodes[0], *rest[i]], *rest[i + 1 :]]


def best(edges):
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    return max(score(edges, {n: i for i, block in enumerate(p) for n in block}) for p in partitions(nodes))


def found(spark, edges):
    rows = modularity.communities(graph(spark, edges)).collect()
    label = {r["node"]: r["community"] for r in rows}
    assert all(c == min(n for n in label if label[n] == c) for c in label.values())
    return label


RING = [(i, (i + 1) % 8, 1) for i in range(8)]


@pytest.mark.parametrize("edges", [RING, [(0, 1, 5), (2, 3, 5), (1, 2, 1), (4, 5, 3), (5, 6, 3), (4, 6, 3), (3, 4, 1), (6, 7, 1)]])
def test_eight_nodes_match_the_best_of_all_partitions(spark, edges):
    assert score(edges, found(spark, edges)) == pytest.approx(best(edges), abs=1e-9)


def test_never_below_label_propagation(spark):
    rng = np.random.default_rng(4)
    blocks = [(a, b, 1 + int(rng.integers(0, 3))) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.5 if a // 10 == b // 10 else 0.04)]
    label = found(spark, blocks)
    other = {r["node"]: r["community"] for r in networks.communities(graph(spark, blocks)).collect()}
    assert score(blocks, label) >= score(blocks, other) - 1e-9 and 3 <= len(set(label.values())) <= 5
    members = spark.createDataFrame(list(label.items()), "node long, community long")
    row = networks.modularity(graph(spark, blocks), members, "community").first()
    assert row["modularity"] == pytest.approx(score(blocks, label))


def test_several_rows_loops_and_no_edges(spark):
    once = [(0, 1, 2), (1, 2, 2), (3, 4, 2), (2, 3, 1)]
    twice = [(1, 0, 1), (0, 1, 1), *once[1:], (5, 5, 3)]
    label = found(spark, twice)
    assert {k: v for k, v in label.items() if k != 5} == found(spark, once) and label[5] == 5
    assert modularity.communities(graph(spark, once).limit(0)).collect() == []
