"""Rules are learned from every labelled document."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import quality_rules

from test_llm import text_of


def test_rules_see_every_labelled_row(spark):
    """Few bad rows among many: a sample of 8000 would hold under three of them to grow on or to accept by."""
    texts = [text_of(i) for i in range(50)]
    rows = [(i, texts[i % 50]) for i in range(60000)] + [(100000 + i, " ".join(w + "###" for w in texts[i].split())) for i in range(14)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = frame.select("doc_id", (F.col("doc_id") < 100000).cast("int").alias("quality"))
    rules = quality_rules.learn(frame, labels)
    assert rules
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame.where("doc_id % 50 = 0 OR doc_id >= 100000"), rules).collect()}
    assert all(kept[i] == (i < 100000) for i in kept)


def test_rounding_up_keeps_the_side_of_every_threshold(spark):
    x = [0.0, 1.0, 3.0, 255.0, 256.0, 257.0, 1000.5, 1e-7, 123456.7, *np.random.default_rng(3).lognormal(0, 4, 500).tolist()]
    up = np.array([r["v"] for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(quality_rules._rounded(F.col("v")).alias("v")).collect()])
    x = np.array(x)
    assert (up >= x).all() and (up <= x * (1 + 2**-8)).all()
    assert ((x[:, None] <= up) == (up[:, None] <= up)).all()


def test_whole_table_gives_the_rules_of_the_arrays(spark):
    rng = np.random.default_rng(5)
    names = list(quality_rules.features())
    n = 3000
    values = {name: rng.integers(0, 40, n) / 8 for name in names}
    bad = (values["symbols_per_word"] > 4) & (values["words"] > 1) | (rng.random(n) < 0.001)
    held = rng.random(n) < 1 / 3
    rows = [(int(bad[i]), bool(held[i]), *(float(values[name][i]) for name in names)) for i in range(n)]
    found = quality_rules._covering(spark.createDataFrame(rows, "bad int, held boolean, " + ", ".join(f"{x} double" for x in names)))
    assert found
    expected = quality_rules.sequential_covering(values, bad, held)
    covered = lambda rules: np.any([quality_rules.covers(r, values, n) for r in rules], axis=0)
    assert (covered(found) == covered(expected)).mean() > 0.999 and len(expected) == pytest.approx(len(found), abs=1)
