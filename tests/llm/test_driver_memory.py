"""What the pipeline leaves on the driver: no model while its predictions are made, short code lengths, no idle rounds."""

import weakref

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import language_id
from citeloom.operators import networks

from test_llm import speech


def _documents(spark):
    return speech(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).alias("n_chars"))


@pytest.mark.parametrize("cells", [1 << 21, 90])
def test_the_driver_has_no_model_while_languages_are_predicted(spark, monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    held, there, train, write = [], [], language_id.train, corpus_pipeline.materialise

    def trained(*a, **b):
        model = train(*a, **b)
        held.append(weakref.ref(model.codes[-1]))
        return model

    def written(df, folder, name):
        there.extend(r() is not None for r in held if name == "languages")
        return write(df, folder, name)

    monkeypatch.setattr(language_id, "train", trained)
    monkeypatch.setattr(corpus_pipeline, "materialise", written)
    assert corpus_pipeline.identify_language(spark, _documents(spark), "").count() > 0
    assert there == [False]


def test_code_lengths_reach_the_driver_as_the_tables_hold_them(spark, monkeypatch):
    frame, tables = _documents(spark).where("lang IS NOT NULL"), []
    take = type(frame).toArrow

    def taken(self):
        tables.append(take(self))
        return tables[-1]

    monkeypatch.setattr(type(frame), "toArrow", taken)
    model = language_id.train(frame, order=3)
    assert [tables[-1].schema.field(c).type.value_type for c in ("own", "leave")] == [pa.float32()] * 2
    assert all(x.values.dtype == np.float32 for x in model.codes + model.escapes)


def _rounds(spark, monkeypatch, tmp_path, pairs):
    names, write = [], networks.materialise
    monkeypatch.setattr(networks, "materialise", lambda df, folder, name: names.append(name) or write(df, folder, name))
    found = networks.connected(spark.createDataFrame(pairs, "u long, v long"), f"file://{tmp_path}/{len(pairs)}", "x").collect()
    assert len(found) == len({r["node"] for r in found})
    return {r["node"]: r["label"] for r in found}, (len(names) - 1) // 2


def test_components_end_at_the_round_that_makes_stars(spark, monkeypatch, tmp_path):
    assert _rounds(spark, monkeypatch, tmp_path, [(1, 9), (9, 1), (8, 1), (3, 3), (7, 5)]) == ({1: 1, 9: 1, 8: 1, 5: 5, 7: 5}, 0)
    assert _rounds(spark, monkeypatch, tmp_path, [(3, 3)]) == ({}, 0)
    assert _rounds(spark, monkeypatch, tmp_path, [(1, 2), (2, 3)]) == ({1: 1, 2: 1, 3: 1}, 1)


def test_components_of_random_edges(spark, monkeypatch, tmp_path):
    pairs = np.random.default_rng(3).integers(-40, 110, (90, 2)).tolist() + [[k, k + 1] for k in range(200, 240)]
    least = {n: n for p in pairs if p[0] != p[1] for n in p}
    for _ in least:
        for u, v in pairs:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    assert _rounds(spark, monkeypatch, tmp_path, pairs)[0] == least
