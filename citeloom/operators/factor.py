"""Topics by non-negative factorisation of a sparse table of documents and terms.

``doc, term, weight`` is approached by the product of two tables of k non-negative numbers a document and a term, by Lee and
Seung's multiplicative updates, which never raise the squared error. A half round is one join of the sparse table with one of
the factors and an aggregation of k sums by the other's key, combined map-side; a document or term with a third of all cells
is one row of its factor, and AQE splits its cells. Only k by k Gram matrices are collected. Factors start from hashes of their
keys, so a run repeats, and are written every round.

Where terms are few (``FEW``), their factor travels with the tasks instead. Documents are packed with their cells once, a round reads
them once in numpy, and only sums by term leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise, shared_dir

#: What keeps a denominator above zero.
TINY = 1e-12
#: Terms whose factor is collected and sent to the tasks at most; rounds after which the documents' factor is written.
FEW, KEPT = 1 << 16, 8


def tf_idf(keywords: DataFrame, least: int = 1) -> DataFrame:
    """``doc, term, weight`` of keywords (``doc, keyword``): occurrences times ln(1 + documents / documents of the term), for terms
    of ``least`` documents or more."""
    counted = keywords.where("keyword is not null").groupBy("doc", "keyword").agg(F.count("*").alias("n"))
    counted = materialise(counted, shared_dir(keywords.sparkSession), "counted")
    terms = counted.groupBy("keyword").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    docs = counted.agg(F.count_distinct("doc").alias("docs"))
    joined = counted.join(terms, "keyword").crossJoin(F.broadcast(docs))
    return joined.select("doc", F.col("keyword").alias("term"), (F.col("n") * F.log(1 + F.col("docs") / F.col("df"))).alias("weight"))


def start(keys: DataFrame, name: str, topics: int, seed: int, scale: float, *also: str) -> DataFrame:
    """``name``, columns ``also`` and ``f0 ..``: numbers of (0, 1] times ``scale``, from md5 of key, place and seed."""
    unit = lambda i: (F.conv(F.substring(F.md5(F.concat_ws("-", F.col(name).cast("string"), F.lit(str(i)), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") + 1) / float(1 << 32)
    return keys.select(name, *also, *((unit(i) * scale).alias(f"f{i}") for i in range(topics)))


def _gram(factor: DataFrame, topics: int) -> list[list[float]]:
    sums = factor.agg(*(F.coalesce(F.sum(F.col(f"f{i}") * F.col(f"f{j}")), F.lit(0.0)).alias(f"g{i}_{j}") for i in range(topics) for j in range(i, topics))).first()
    return [[sums[f"g{min(i, j)}_{max(i, j)}"] for j in range(topics)] for i in range(topics)]


def _updated(cells: DataFrame, factor: DataFrame, other: DataFrame, name: str, by: str, gram: list[list[float]]) -> DataFrame:
    """``factor`` after its update; ``p0 ..`` are its products with the cells under ``other``."""
    topics = range(len(gram))
    met = cells.join(other, by).groupBy(name).agg(*(F.sum(F.col("weight") * F.col(f"f{i}")).alias(f"p{i}") for i in topics))
    both = factor.join(met, name, "left")
    product = lambda i: F.coalesce(f"p{i}", F.lit(0.0))
    below = lambda i: sum((F.col(f"f{j}") * gram[i][j] for j in topics), F.lit(TINY))
    return both.select(name, *((F.col(f"f{i}") * product(i) / below(i)).alias(f"f{i}") for i in topics), *(product(i).alias(f"p{i}") for i in topics))


def _read(batch: pa.RecordBatch, topics: int, history: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    """Factor of the packed documents after the updates of ``history`` (factor of terms and its Gram matrix), their products with the cells
    of the last update, and code, weight and document of each cell."""
    cells = batch.column("cells")
    n = np.asarray(cells.value_lengths())
    flat = cells.flatten()
    code, weight = np.asarray(flat.field("code")), np.asarray(flat.field("weight"))
    docs, product = np.column_stack([np.asarray(batch.column(f"f{i}")) for i in range(topics)]), None
    for terms, gram in history:
        product = np.add.reduceat(weight[:, None] * terms[code], np.cumsum(n) - n, axis=0)
        docs = docs * product / (docs @ gram + TINY)
    return docs, product, code, weight, np.repeat(np.arange(len(n)), n)


def _sums(packed: DataFrame, topics: int, many: int, history: list) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the documents after ``history``: products of the cells with them by term, Gram matrix, and sum of their own products."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term, gram, cross = np.zeros((many, topics)), np.zeros((topics, topics)), 0.0
        for batch in batches:
            if len(batch):
                docs, product, code, weight, row = _read(batch, topics, history)
                for i in range(topics):
                    by_term[:, i] += np.bincount(code, weight * docs[row, i], many)
                gram += docs.T @ docs
                cross += float((docs * product).sum()) if product is not None else 0.0
        rows = np.vstack([by_term, gram, np.full((1, topics), cross)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(topics))], ["code", *(f"p{i}" for i in range(topics))])

    parts = packed.mapInArrow(each, "code long, " + ", ".join(f"p{i} double" for i in range(topics)))
    whole = np.zeros((many + topics + 1, topics))
    for r in parts.groupBy("code").agg(*(F.sum(f"p{i}") for i in range(topics))).collect():
        whole[r[0]] = r[1:]
    return whole[:many], whole[many:-1], float(whole[-1, 0])


def _updated_docs(packed: DataFrame, topics: int, history: list) -> DataFrame:
    """``packed`` with the factor after ``history``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                docs = _read(batch, topics, history)[0]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("cells"), *(pa.array(np.ascontiguousarray(docs[:, i])) for i in range(topics))], ["doc", "cells", *(f"f{i}" for i in range(topics))])

    return packed.mapInArrow(each, packed.schema)


def _nmf_of_few(known: DataFrame, terms: DataFrame, q: float, scale: float, topics: int, rounds: int, tolerance: float, seed: int, folder: str) -> tuple[DataFrame, DataFrame, list[float]]:
    """``nmf`` with a factor of terms that fits into tasks."""
    spark, names = known.sparkSession, [f"f{i}" for i in range(topics)]
    listed = terms.orderBy("term").collect()
    factor, schema = np.array([r[1:] for r in listed]), terms.schema
    codes = spark.createDataFrame([(r["term"], k) for k, r in enumerate(listed)], known.select("term", F.lit(0).alias("code")).schema)
    cells = known.join(F.broadcast(codes), "term").groupBy("doc").agg(F.collect_list(F.struct("code", "weight")).alias("cells"))
    packed = materialise(start(cells, "doc", topics, seed, scale, "cells"), folder, "packed-0")
    history: list[tuple[np.ndarray, np.ndarray]] = []
    errors: list[float] = []
    by_term, own, _ = _sums(packed, topics, len(listed), history)
    while len(errors) < rounds:
        factor = factor * by_term / (factor @ own + TINY)
        gram = factor.T @ factor
        history.append((factor, gram))
        by_term, own, cross = _sums(packed, topics, len(listed), history)
        errors.append(max(0.0, q - 2 * cross + float((gram * own).sum())))
        if len(errors) > 1 and errors[-2] - errors[-1] <= tolerance * q:
            break
        if len(history) == KEPT:
            packed, history = materialise(_updated_docs(packed, topics, history), folder, f"packed-{len(errors)}"), []
    docs = _updated_docs(packed, topics, history).select("doc", *names)
    return docs, spark.createDataFrame([(r["term"], *map(float, x)) for r, x in zip(listed, factor)], schema), errors


def nmf(cells: DataFrame, topics: int = 5, rounds: int = 100, tolerance: float = 1e-5, seed: int = 42) -> tuple[DataFrame, DataFrame, list[float]]:
    """Factors of documents (``doc, f0 ..``) and terms (``term, f0 ..``), and the squared error after every round.

    Rounds end once the error falls by at most ``tolerance`` of the table's own sum of squares. Cells of one document and term
    add up; null keys and weights that are not over 0 are left out. An empty table gives empty factors.
    """
    folder = shared_dir(cells.sparkSession)
    known = cells.where("doc is not null and term is not null and weight > 0").groupBy("doc", "term").agg(F.sum(F.col("weight").cast("double")).alias("weight"))
    known = materialise(known, folder, "cells")
    whole = known.agg(F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias("q"), F.coalesce(F.avg("weight"), F.lit(0.0)).alias("m")).first()
    scale = (whole["m"] / topics) ** 0.5
    terms = materialise(start(known.select("term").distinct(), "term", topics, seed + 1, scale), folder, "terms-0")
    if whole["q"] > 0 and terms.count() <= FEW:
        return _nmf_of_few(known, terms, whole["q"], scale, topics, rounds, tolerance, seed, folder)
    docs = materialise(start(known.select("doc").distinct(), "doc", topics, seed, scale), folder, "docs-0")
    names = [f"f{i}" for i in range(topics)]
    errors: list[float] = []
    while whole["q"] > 0 and len(errors) < rounds:
        turn = len(errors) + 1
        terms = materialise(_updated(known, terms, docs, "term", "doc", _gram(docs, topics)).select("term", *names), folder, f"terms-{turn}")
        gram = _gram(terms, topics)
        raised = materialise(_updated(known, docs, terms, "doc", "term", gram), folder, f"docs-{turn}")
        docs = raised.select("doc", *names)
        own = _gram(docs, topics)
        cross = raised.agg(F.sum(sum((F.col(f"f{i}") * F.col(f"p{i}") for i in range(topics)), F.lit(0.0)))).first()[0]
        errors.append(max(0.0, whole["q"] - 2 * cross + sum(gram[i][j] * own[i][j] for i in range(topics) for j in range(topics))))
        if turn > 1 and errors[-2] - errors[-1] <= tolerance * whole["q"]:
            break
    return docs, terms, errors


def _long(factor: DataFrame, key: str, topics: int) -> DataFrame:
    listed = F.array(*(F.struct(F.lit(i).alias("topic"), F.col(f"f{i}").alias("weight")) for i in range(topics)))
    return factor.select(key, F.explode(listed).alias("e")).select(key, "e.topic", "e.weight")


def topic_terms(terms: DataFrame, topics: int, top: int = 10) -> DataFrame:
    """``topic, place, term, weight``: the ``top`` terms of each topic, weights as shares of the topic's (ties by term)."""
    long = _long(terms, "term", topics)
    totals = long.groupBy("topic").agg(F.sum("weight").alias("_t"))
    shared = long.join(F.broadcast(totals), "topic").withColumn("weight", F.when(F.col("_t") > 0, F.col("weight") / F.col("_t")))
    place = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 9)), "term"))
    return shared.withColumn("place", place).where(F.col("place") <= top).select("topic", "place", "term", "weight")


def document_topics(docs: DataFrame, topics: int) -> DataFrame:
    """``doc, topic, weight``: shares of the topics in each document; null where it has none."""
    total: Column = sum((F.col(f"f{i}") for i in range(topics)), F.lit(0.0))
    shared = docs.withColumn("_t", total)
    return _long(shared.select("doc", *(F.when(F.col("_t") > 0, F.col(f"f{i}") / F.col("_t")).alias(f"f{i}") for i in range(topics))), "doc", topics)
