"""All pairs by blocks of rows against every pair in numpy."""

import numpy as np
import pyarrow as pa
import pytest

from citeloom.operators import blocks, matching


def _titles(n, words, seed):
    """Titles of frequent and rare words: ids, lists of words and the matrix of counts."""
    rng = np.random.default_rng(seed)
    found = [[f"w{min(words - 1, int(x))}" for x in rng.pareto(0.7, rng.integers(1, 9)) * 3] for _ in range(n)]
    counts = np.zeros((n, words))
    for k, listed in enumerate(found):
        for w in listed:
            counts[k, int(w[1:])] += 1
    return found, counts


@pytest.mark.parametrize("blocked", [0, 100, 1e9])
def test_titles_by_terms_meet_as_all_pairs_do(spark, monkeypatch, blocked):
    monkeypatch.setattr(matching, "BLOCKED", blocked)
    found, counts = _titles(2500, 900, 1)
    weights = counts * np.log(1 + len(counts) / np.maximum((counts > 0).sum(0), 1))
    unit = weights / np.sqrt((weights**2).sum(1, keepdims=True))
    cosine = np.triu(unit @ unit.T, 1)
    frame = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(found)] + [(9999, None), (9998, "!")], "id long, title string")
    out = matching.similar_by_terms(frame, 0.6)
    assert ("MapInArrow" in out._jdf.queryExecution().toString()) == (blocked > 0)
    pairs = {(r["a"], r["b"]): r["cosine"] for r in out.collect()}
    sure = {(int(a), int(b)) for a, b in np.argwhere(cosine >= 0.6 + 1e-9)}
    assert sure <= set(pairs) and len(sure) > 1000 and all(cosine[k] >= 0.6 - 1e-9 and v == pytest.approx(cosine[k], abs=1e-12) for k, v in pairs.items())


@pytest.mark.parametrize("blocked", [0, 100])
def test_sets_of_words_meet_as_all_pairs_do(spark, monkeypatch, blocked):
    """Rows of one id are rows of their own and make no pair."""
    monkeypatch.setattr(matching, "BLOCKED", blocked)
    found, counts = _titles(2300, 700, 2)
    both = (counts > 0).astype(float) @ (counts > 0).T.astype(float)
    own = np.diag(both)
    share = both / (own[:, None] + own[None, :] - both)
    ids = [f"t{k // 2}" for k in range(len(found))]
    frame = spark.createDataFrame([(i, x) for i, x in zip(ids, found)] + [("none", None), ("empty", []), (None, ["w0"])], "id string, words array<string>")
    expected = sorted((*sorted((ids[i], ids[j])), share[i, j]) for i, j in np.argwhere(np.triu(share >= 0.5, 1)) if ids[i] != ids[j])
    out = matching.similar_by_words(frame, 0.5)
    assert ("MapInArrow" in out._jdf.queryExecution().toString()) == (blocked > 0)
    assert sorted(map(tuple, out.select("a", "b", "jaccard").collect())) == expected and len(expected) > 1000


def test_blocks_end_by_rows_and_cells(monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 3)
    monkeypatch.setattr(blocks, "CELLS", 10)
    monkeypatch.setattr(blocks, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls), "partitionId": staticmethod(lambda: 1)}))
    sizes = [1, 2, 3, 4, 50, 9, 1, 1, 20, 20, 0, 0]
    batches = [pa.RecordBatch.from_pylist([{"id": k, "cells": [0] * n} for k, n in enumerate(sizes)][at : at + 5]) for at in (0, 5, 10)]
    out = [(b.column("block")[0].as_py(), b.column("id")[0].as_py()) for b in blocks.pack(iter(batches), 4, "cells")]
    assert [x for _, ids in out for x in ids] == list(range(12))
    assert [k for k, _ in out] == [1 + 4 * k for k in range(len(out))]
    assert all(len(ids) <= 3 and (len(ids) == 1 or sum(sizes[i] for i in ids) <= 10) for _, ids in out)


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_strings_meet_as_all_pairs_do(spark):
    """No pair of strings is shuffled by what they share; letters of any script and long strings are found."""
    rng = np.random.default_rng(5)
    words = {"ée", "éé", "日本語学", "日本文学", "日本語", "a" * 40, "a" * 30 + "b" * 10, "x", "y" * 70, "y" * 49}
    while len(words) < 300:
        base = "".join(rng.choice(["th", "an", "er", "tion", "é", "x"], rng.integers(1, 6)))
        k = int(rng.integers(0, len(base)))
        words |= {base, base[:k] + str(rng.choice(list("aqß"))) + base[k + int(rng.integers(0, 2)) :]}
    words = sorted(words)
    out = matching.similar_by_edits(spark.createDataFrame(list(enumerate(words)), "id long, value string"), 0.7)
    plan = out._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "hashpartitioning(token" not in plan
    found = {(r["a"], r["b"]): r["similarity"] for r in out.collect()}
    near = {(i, j): 1 - _edits(a, b) / max(len(a), len(b)) for i, a in enumerate(words) for j, b in enumerate(words) if i < j}
    expected = {k: v for k, v in near.items() if v >= 0.7}
    assert set(found) == set(expected) and len(expected) > 200 and all(found[k] == pytest.approx(v) for k, v in expected.items())
