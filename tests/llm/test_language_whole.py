"""The language model counts every byte of every row, whatever part of it is broadcast."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import language_id

from test_llm import SPEECH, brute_bits, speech


def _brute(rows, order):
    counts = defaultdict(lambda: defaultdict(Counter))
    for text, lang in rows:
        data = text.encode()
        for k in range(order + 1):
            for i in range(k, len(data)):
                counts[lang][k, data[i - k : i]][data[i]] += 1
    return counts


@pytest.mark.parametrize("cells", [1 << 21, 600, 90, 1])
def test_every_row_is_counted_and_codes_are_exact_beyond_the_broadcast(spark, monkeypatch, cells):
    monkeypatch.setattr(language_id, "CELLS", cells)
    rows = [(i, f"{SPEECH[lang]} w{i:04d} q{i * 7919 % 10007}", lang) for lang in ("de", "en") for i in range(1200)]
    asked = [*rows[::97], (5000, "the dog", None), (5001, "ist ñ x", None), (5002, "q", None), (5003, "perro 日", None), (5003, "perro 日", None), (5004, None, None), (5005, "", None), (5006, "1 2", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = language_id.train(frame, order=3)
    assert (model.rest is None) == (cells == 1 << 21)
    counts = _brute([r[1:] for r in rows], 3)
    found = language_id.predict(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()
    assert len(found) == len(asked)
    texts = {i: t for i, t, _ in asked}
    for r in found:
        text = texts[r["doc_id"]]
        if not text or not language_id.has_letter(text):
            assert r["lang_pred"] == "und" and r["score"] == 0
            continue
        bits = [brute_bits(counts[x], text.encode(), 3) for x in ("de", "en")]
        assert r["lang_pred"] == ("de", "en")[int(np.argmin(bits))]
        assert r["bits_per_byte"] * len(text.encode()) == pytest.approx(min(bits), rel=1e-4)
        assert r["score"] == pytest.approx(1 / sum(2.0 ** (min(bits) - b) for b in bits), rel=1e-3)


def test_language_stage_is_the_same_beyond_the_broadcast(spark, monkeypatch):
    frame = speech(spark).select("doc_id", "text", "lang", F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    frame = frame.union(frame.where("doc_id < 3")).union(frame.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    kept = []
    for cells in (1 << 21, 200):
        monkeypatch.setattr(language_id, "CELLS", cells)
        kept.append(sorted(map(str, corpus_pipeline.identify_language(spark, frame, "").collect())))
    assert kept[0] == kept[1] and len(kept[0]) == 124
