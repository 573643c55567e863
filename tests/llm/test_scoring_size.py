"""What scoring sends: pairs of listed words as numbers, and texts of the target only."""

import numpy as np
import pyarrow as pa

from citeloom.llm import lm_score
from citeloom.llm._text import words

from test_llm import text_of


class _Shared:
    def __init__(self, value):
        self.value = value


def test_pairs_of_listed_words_are_sent_as_numbers(monkeypatch):
    monkeypatch.setattr(lm_score, "PAIRED", 2)
    text = " ".join(f"w{i}" for i in np.random.default_rng(1).integers(0, 3000, 60000))
    hashes = np.unique(words(pa.array([text])).hashes())
    ones = np.ones((2, 2, len(hashes)))
    listed = lm_score.Listed(hashes, ones, np.ones((2, 2)) * 100, len(hashes), 4.0)
    listed.fill(np.zeros((2, 3 * 2)))
    batch = pa.record_batch([pa.array([1]), pa.array([text]), pa.array([0]), pa.array([lm_score.BOTH])], names=["id", "text", "row", "role"])
    sent = pa.Table.from_batches(list(lm_score._packed(_Shared(listed), 4, pa.int64(), iter([batch]))))
    names = ("pairs", "words")
    assert sum(len(x) for c in names for x in sent.column(c).to_pylist() if x) <= 8 * 60000


def test_texts_without_a_good_label_are_told_before_they_are_dealt(spark):
    docs = spark.createDataFrame([(i, text_of(i)) for i in range(400)] + [(None, "x")], "id long, text string")
    for kind in ("long", "string"):
        rows, marked = docs.select(docs["id"].cast(kind).alias("id"), "text"), spark.range(0, 400, 10).selectExpr(f"CAST(id AS {kind}) AS label_id")
        found = [r["id"] for r in lm_score._perhaps(rows, marked).collect()]
        assert {str(x) for x in range(0, 400, 10)} <= {str(x) for x in found} and len(found) < 45
    assert lm_score._perhaps(docs, marked).count() == 401
    assert lm_score._perhaps(docs.selectExpr("CAST(id AS int) AS id", "text"), spark.range(0).selectExpr("CAST(id AS int) AS label_id")).count() == 0
