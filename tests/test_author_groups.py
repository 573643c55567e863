"""Author names by groups of last name and initials against every pair of names."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom import catalog_more
from citeloom.functions import text as T
from citeloom.operators import matching
from citeloom.plans.roles import Roles


def test_pairs_match_every_pair(spark):
    rng = np.random.default_rng(0)
    lasts = ["Smith", "Smyth", "Smithe", "Jones", "Johns", "Li", "Lee", "García", ""]
    given = ["John", "J.", "John B.", "B J", "Ann", "", "Jo Ann", "X"]
    names = sorted({f"{lasts[int(a)]}, {given[int(b)]}" for a, b in rng.integers(0, 8, (80, 2))} | {"John Smith", "j smith", "Li", ", J"})
    frame = spark.createDataFrame([(n,) for n in names], "value string")
    last, initials = matching.author_parts(F.col("value"))
    parts = {r["value"]: r for r in frame.select("value", last.alias("l"), initials.alias("i")).collect()}
    pairs = spark.createDataFrame([(a, b, parts[a]["l"], parts[a]["i"], parts[b]["l"], parts[b]["i"]) for a, b in itertools.combinations(names, 2) if parts[a]["l"] and parts[b]["l"]], "a string, b string, la string, ia array<string>, lb string, ib array<string>")
    scored = {(r["a"], r["b"]): r["s"] for r in pairs.select("a", "b", matching.name_score(F.col("la"), F.col("ia"), F.col("lb"), F.col("ib")).alias("s")).collect()}
    for least in (0.72, 0.85, 1.0):
        found = {(r["a"], r["b"]): r["score"] for r in matching.similar_authors(frame, least).collect()}
        expected = {k: v for k, v in scored.items() if v >= least}
        assert set(found) == set(expected) and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_a_last_name_of_very_many(spark):
    many = spark.range(20_000).select(F.concat(F.lit("Smith, J"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("name"))
    frame = many.unionByName(spark.createDataFrame([("Smith, A",), ("Smith",), ("Jones, J",)], "name string"))
    found = matching.disambiguate_authors(frame, "name").groupBy("canonical").agg(F.count("*").alias("n")).collect()
    assert sorted(r["n"] for r in found) == [1, 1, 1, 20_000]


def test_initials_are_one_character(spark, tmp_path):
    row = spark.createDataFrame([(c,) for c in "aßéᾀŉﬁ1"], "c string").select("c", T.capital(F.col("c")).alias("u"))
    assert {r["c"]: r["u"] for r in row.collect()} == {"a": "A", "ß": "ẞ", "é": "É", "ᾀ": "ᾈ", "ŉ": "ŉ", "ﬁ": "ﬁ", "1": "1"}
    turns = [(1, "Und so weiter"), (2, "Und ßo weiter"), (3, "Und ﬁnis"), (4, "Und finis"), (5, "Und"), (6, None)]
    spark.createDataFrame(turns, "conv_id long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    names = catalog_more._names(Roles(spark, str(tmp_path)))
    assert {r["value"] for r in names.collect()} == {"Und, S", "Und, ẞ", "Und, ﬁ", "Und, F"}
    assert matching.similar_authors(names).count() == 0
