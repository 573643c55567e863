"""Screening of records by reviewers: consensus, agreement and flow counts over a decision ledger.

The ledger has ``doc, stage, reviewer, decision, reason, is_final``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .primitives import ratio

_STAGES = {"title": "screening", "abstract": "screening", "title_abstract": "screening", "screening": "screening", "fulltext": "eligibility", "full_text": "eligibility", "eligibility": "eligibility", "included": "included", "quality": "quality"}
_DECISIONS = {"include": "include", "included": "include", "yes": "include", "accept": "include", "exclude": "exclude", "excluded": "exclude", "no": "exclude", "reject": "exclude"}


def standardise(ledger: DataFrame) -> DataFrame:
    """Vocabularies of stage and decision made one; unknown stages are screening, unknown decisions pending."""

    def named(column: str, names: dict[str, str], other: str):
        key = F.regexp_replace(F.lower(F.trim(F.col(column))), "[^a-z]+", "_")
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in names.items() for v in pair)), key), F.lit(other))

    return ledger.withColumns({"stage": named("stage", _STAGES, "screening"), "decision": named("decision", _DECISIONS, "pending"), "is_final": F.coalesce("is_final", F.lit(False))})


def resolve_documents(ledger: DataFrame, merged: DataFrame) -> DataFrame:
    """Ledger rows with ``doc`` found by id, then DOI key, then title key (``merged``: doc, doi_key, title_key)."""
    by_doi = merged.where("doi_key is not null").groupBy("doi_key").agg(F.min("doc").alias("_by_doi"))
    by_title = merged.where("title_key is not null").groupBy("title_key").agg(F.min("doc").alias("_by_title"))
    known = merged.select(F.col("doc").alias("_known")).distinct()
    joined = ledger.join(known, F.col("doc") == F.col("_known"), "left").join(by_doi, "doi_key", "left").join(by_title, "title_key", "left")
    return joined.withColumn("doc", F.coalesce("_known", "_by_doi", "_by_title")).drop("_known", "_by_doi", "_by_title")


def consensus(ledger: DataFrame) -> DataFrame:
    """Per document and stage the majority decision, of final rows only where there are any; a tie is a conflict.

    ``reason``: the most frequent reason of exclusion, first by name.
    """
    own = Window.partitionBy("doc", "stage")
    used = ledger.withColumn("_final", F.max(F.col("is_final").cast("int")).over(own)).where((F.col("_final") == 0) | F.col("is_final"))
    votes = used.groupBy("doc", "stage").agg(*(F.sum((F.col("decision") == d).cast("int")).alias(f"_{d}") for d in ("include", "exclude", "pending")))
    top = F.greatest("_include", "_exclude", "_pending")
    tied = (F.col("_include") == top).cast("int") + (F.col("_exclude") == top).cast("int") + (F.col("_pending") == top).cast("int")
    decided = F.when(tied > 1, "conflict").when(F.col("_include") == top, "include").when(F.col("_exclude") == top, "exclude").otherwise("pending")
    reasons = used.where("decision = 'exclude' and reason is not null").groupBy("doc", "stage", "reason").agg(F.count("*").alias("_n"))
    best = reasons.withColumn("_p", F.row_number().over(own.orderBy(F.desc("_n"), "reason"))).where("_p = 1").select("doc", "stage", "reason")
    return votes.select("doc", "stage", decided.alias("decision"), F.col("_include").alias("include_votes"), F.col("_exclude").alias("exclude_votes")).join(best, ["doc", "stage"], "left")


def decision_counts(consensus_: DataFrame) -> DataFrame:
    return consensus_.groupBy("stage", "decision").agg(F.count("*").alias("documents"))


def prisma(consensus_: DataFrame, identified: DataFrame) -> DataFrame:
    """Flow counts: identified, screened, excluded, assessed, excluded there, included; and whether they never rise."""
    of = lambda stage, decision=None: F.count_distinct(F.when((F.col("stage") == stage) & (F.lit(True) if decision is None else F.col("decision") == decision), F.col("doc")))
    counts = consensus_.agg(
        of("screening").alias("screened"), of("screening", "exclude").alias("screening_excluded"), of("eligibility").alias("assessed"), of("eligibility", "exclude").alias("eligibility_excluded"), of("eligibility", "include").alias("included")
    )
    out = identified.agg(F.count("*").alias("identified")).crossJoin(counts)
    return out.withColumn("monotone", (F.col("identified") >= F.col("screened")) & (F.col("screened") >= F.col("assessed")) & (F.col("assessed") >= F.col("included")))


def cohens_kappa(ledger: DataFrame) -> DataFrame:
    """Per stage and pair of reviewers: documents both decided, agreement, Cohen's kappa and its verbal level."""
    single = ledger.groupBy("doc", "stage", "reviewer").agg(F.max("decision").alias("decision"))
    a = single.select("doc", "stage", F.col("reviewer").alias("reviewer_a"), F.col("decision").alias("da"))
    b = single.select("doc", "stage", F.col("reviewer").alias("reviewer_b"), F.col("decision").alias("db"))
    both = a.join(b, ["doc", "stage"]).where("reviewer_a < reviewer_b")
    keys = ["stage", "reviewer_a", "reviewer_b"]
    seen = both.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("da") == F.col("db")).cast("double")).alias("agreement"), *(F.avg((F.col(c) == d).cast("double")).alias(f"_{c}_{d}") for c in ("da", "db") for d in ("include", "exclude", "pending")))
    chance = F.col("_da_include") * F.col("_db_include") + F.col("_da_exclude") * F.col("_db_exclude") + F.col("_da_pending") * F.col("_db_pending")
    kappa = F.when(chance < 1, (F.col("agreement") - chance) / (1 - chance)).otherwise(F.lit(1.0))
    out = seen.withColumn("kappa", kappa).select(*keys, "n", "agreement", "kappa")
    k = F.col("kappa")
    return out.withColumn("level", F.when(k < 0, "poor").when(k <= 0.2, "slight").when(k <= 0.4, "fair").when(k <= 0.6, "moderate").when(k <= 0.8, "substantial").otherwise("almost perfect"))


def fleiss_kappa(ledger: DataFrame) -> DataFrame:
    """Per stage Fleiss' kappa over documents with two or more ratings, each weighted by its own number of raters."""
    counts = ledger.groupBy("stage", "doc", "decision").agg(F.count("*").alias("n"))
    docs = counts.groupBy("stage", "doc").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    agree = docs.groupBy("stage").agg(F.avg(F.col("same") / (F.col("m") * (F.col("m") - 1))).alias("observed"), F.count("*").alias("documents"))
    every = counts.join(docs.select("stage", "doc"), ["stage", "doc"]).groupBy("stage", "decision").agg(F.sum("n").alias("n"))
    shares = every.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("stage"))).groupBy("stage").agg(F.sum(F.col("p") * F.col("p")).alias("chance"))
    return agree.join(shares, "stage").withColumn("kappa", F.when(F.col("chance") < 1, (F.col("observed") - F.col("chance")) / (1 - F.col("chance"))).otherwise(F.lit(1.0)))


def krippendorff_alpha(ledger: DataFrame) -> DataFrame:
    """Per stage Krippendorff's nominal alpha over documents with two or more ratings."""
    counts = ledger.groupBy("stage", "doc", "decision").agg(F.count("*").alias("n"))
    sized = counts.withColumn("m", F.sum("n").over(Window.partitionBy("stage", "doc"))).where("m > 1")
    per_doc = sized.groupBy("stage").agg(F.sum(F.col("n") * (F.col("m") - F.col("n")) / (F.col("m") - 1)).alias("_differ"), F.sum("n").alias("_all"))
    values = sized.groupBy("stage", "decision").agg(F.sum("n").alias("n")).groupBy("stage").agg((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("_pairs"))
    joined = per_doc.join(values, "stage")
    expected = F.col("_pairs") / (F.col("_all") - 1)
    return joined.select("stage", F.col("_all").alias("ratings"), F.when(expected > 0, 1 - F.col("_differ") / expected).otherwise(F.lit(1.0)).alias("alpha"))


def decision_matrix(ledger: DataFrame, reviewers: list[str]) -> DataFrame:
    """One row a document and stage, a column for each of ``reviewers`` with the decision."""
    return ledger.groupBy("doc", "stage").pivot("reviewer", reviewers).agg(F.max("decision"))


def template(documents: DataFrame, reviewers: list[str], stages: list[str]) -> DataFrame:
    """An empty ledger: every document for every reviewer and stage."""
    blank = documents.select("doc", F.explode(F.array(*(F.lit(s) for s in stages))).alias("stage"))
    return blank.select("doc", "stage", F.explode(F.array(*(F.lit(r) for r in reviewers))).alias("reviewer"), F.lit("pending").alias("decision"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("is_final"))


def unresolved(consensus_: DataFrame) -> DataFrame:
    """Documents and stages in conflict or pending, and their share a stage."""
    open_ = F.col("decision").isin("conflict", "pending").cast("int")
    return consensus_.groupBy("stage").agg(F.sum(open_).alias("unresolved"), ratio(F.sum(open_), F.count("*")).alias("share"))
