"""The buckets of the n-gram join: any two sets at the threshold meet, and a group of near copies costs linear work."""

import glob
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import ngram_join


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.sampled_from([(90, 100), (80, 100), (60, 100), (1, 1), (2, 3)]))
def test_sets_at_the_threshold_share_a_key(seed, threshold):
    rng = np.random.default_rng(seed)
    num, den = threshold
    steps = ngram_join.levels(num, den, 1 << 20)
    assert bool(steps) == (num / den > 0.85)
    n = int(rng.choice([3, 20, 60, 64, 65, 70, 96, 97, 150, 700, 3000]))
    base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
    gone = int(rng.integers(0, 1 + len(base) * (den - num) // den))
    more = int(rng.integers(0, 1 + len(base) * (den - num) // den))
    s, t = base, np.unique(np.concatenate([rng.permutation(base)[gone:], rng.integers(0, 2**63, more).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
    frequent = np.sort(rng.permutation(base)[: int(len(base) * rng.choice([0, 0.3, 0.9, 1]))])
    both = len(np.intersect1d(s, t))
    if den * both >= num * (len(s) + len(t) - both):
        assert len(np.intersect1d(ngram_join.keys_of(s, num, den, frequent, steps), ngram_join.keys_of(t, num, den, frequent, steps)))


def test_unrelated_sets_hardly_meet():
    rng, steps = np.random.default_rng(5), ngram_join.levels(90, 100, 1 << 20)
    shared = ngram_join.mix(rng.integers(0, 2**63, 200).astype(np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(shared)[:20], ngram_join.mix(rng.integers(0, 2**63, 400).astype(np.uint64))])) for _ in range(60)]
    keys = np.concatenate([ngram_join.keys_of(s, 90, 100, np.zeros(0, np.uint64), steps) for s in sets])
    assert len(keys) - len(np.unique(keys)) < 0.02 * len(keys)


@pytest.mark.parametrize("copies", [3000])
def test_near_copies_cost_linear_work(spark, copies):
    """A group of near copies is one class, found without block pairs: every table stays linear in the group."""
    words = [f"w{k}" for k in range(150)]
    rows = [(i, " ".join(w if k != 30 + i % 90 else f"x{i}" for k, w in enumerate(words))) for i in range(copies)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{root}/citeloom-*"))
    assert {r["component_id"] for r in ngram_join.ngram_jaccard_classes(frame).select("component_id").distinct().collect()} == {0}
    (folder,) = set(glob.glob(f"{root}/citeloom-*")) - before
    counts = {name: spark.read.parquet(f"file://{folder}/{name}").count() for name in os.listdir(folder) if name in ("members", "close", "stars", "true", "still", "near")}
    assert counts["stars"] <= 2.1 * copies and counts["members"] <= 40 * copies and counts["still"] <= 40 * copies and counts["near"] <= 5 * copies
