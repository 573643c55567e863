"""Answers that do not depend on how rows are partitioned."""

import os

import pytest

from citeloom import catalog
from citeloom.functions import stats
from citeloom.operators import primitives

FOLDER = "/root/testdata/sf0.001"


def test_doubles_equal_on_paper_are_ties(spark):
    rows = spark.createDataFrame([(1, 0.1 + 0.2), (2, 0.3), (3, 0.1)], "k int, v double")
    assert {r["k"]: r["rank"] for r in primitives.ranked(rows, "v").collect()} == {1: 1, 2: 1, 3: 3}
    assert {r["k"]: r["rank"] for r in stats.average_ranks(rows, "v").collect()} == {1: 2.5, 2: 2.5, 3: 1.0}
    assert stats.spearman(rows, "v", "k").first()["n"] == 3


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["hypotheses_of_countries", "hypotheses_of_sources"])
def test_hypotheses_at_any_partitioning(spark, name):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "8", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", "false")
            found.append(sorted(map(repr, catalog.QUERIES[name](spark, FOLDER).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert found[0] == found[1] == found[2]
