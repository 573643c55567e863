"""The corpus pipeline: stages that each take what their predecessor kept.

A stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``. Nulls, empty texts, repeated
rows and empty tables are treated as the operators say; what a stage decides is stated at the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import language_id, ngram_join, packing, quality_rules
from citeloom.llm._shared import bounded_batches, give_back, materialise, shared_dir


def _whole(docs: DataFrame) -> DataFrame:
    """Each row as a struct beside its text, so that a verdict comes back with the row and needs no join."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language: those without a letter (or null), those of no clear winner (score under 0.5) and those
    that take far more bits than texts of the winner do (no learned language, or none at all) go."""
    bounded_batches(spark)
    learned = ~language_id.held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull()
    same = ("doc_id", F.xxhash64("text").alias("same"), F.octet_length("text").alias("size"))
    rows = docs.select(F.struct(*same, learned.alias("learned")).alias("row"), "text")
    told = language_id.predict(rows, language_id.train(docs.where(learned)), "row")
    give_back()  # the model is broadcast, and the driver has no other use for it
    found = materialise(told, shared_dir(spark), "languages")
    usual = language_id.usual_bits(found.where("row.learned"))
    named = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= 0.5)
    stay = found.where(named & language_id.fits(usual, F.col("row.size"))).select("row.doc_id", "row.same", "row.size").distinct()
    keys = docs.withColumns({"same": same[1], "size": same[2]})
    return keys.join(stay, keys["doc_id"].eqNullSafe(stay["doc_id"]) & (keys["same"] == stay["same"]) & (keys["size"] == stay["size"]), "left_semi").select(docs.columns)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the decision list learned from the labels of ``docs``."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learn(docs, labels)
    return quality_rules.judge(_whole(docs), rules, "row").where("kept").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of 5-word shingles, the one with the smallest id.

    Documents without words or partner stay; rows repeated with one id and text count once.
    """
    bounded_batches(spark)
    classes = ngram_join.ngram_jaccard_classes(docs, n=5, num=80)
    stay = classes.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay")).distinct()
    kept = docs.join(stay, docs["doc_id"].eqNullSafe(stay["stay"]), "left_semi")
    return kept.withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"]).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents packed into sequences of at most 1024 tokens."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("quality", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: SQL cannot express the learned stages; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again as the next one's input."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, folder, f"{k}-{name}")
    return docs
