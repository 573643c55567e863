"""Institutions of affiliations: production, ranking, sectors, geography and joint work.

Tables are ``doc, institution, country, sector`` (as ``organise.affiliations`` gives them); a document counts once for each
institution, however often it names it. Rows without an institution are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .primitives import pair_counts, pair_similarity, ranked, ratio


def listed(affiliations: DataFrame) -> DataFrame:
    """``doc, institution, country, sector``, each document and institution once (the first country and sector by name)."""
    known = affiliations.where("institution is not null")
    return known.groupBy("doc", "institution").agg(F.min("country").alias("country"), F.min("sector").alias("sector"))


def production(affiliations: DataFrame, records: DataFrame) -> DataFrame:
    """Per institution: documents, fractional documents, citations, their mean, first and last year, country and sector most
    of its documents name (the first of several)."""
    own = listed(affiliations)
    sizes = own.groupBy("doc").agg(F.count("*").alias("_k"))
    joined = own.join(sizes, "doc").join(records.select("doc", "year", "citations"), "doc")
    totals = joined.groupBy("institution").agg(F.count("*").alias("documents"), F.sum(1.0 / F.col("_k")).alias("fractional"), F.sum("citations").alias("citations"), F.avg("citations").alias("mean_citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))

    def usual(column: str) -> DataFrame:
        counted = own.where(F.col(column).isNotNull()).groupBy("institution", column).agg(F.count("*").alias("_n"))
        place = F.row_number().over(Window.partitionBy("institution").orderBy(F.desc("_n"), column))
        return counted.withColumn("_p", place).where("_p = 1").select("institution", column)

    return totals.join(usual("country"), "institution", "left").join(usual("sector"), "institution", "left")


def ranking(production_: DataFrame) -> DataFrame:
    """Ranks by documents, citations and mean citations (1, 2, 2, 4), their mean, and the place by it (ties by name)."""
    out = production_
    for column in ("documents", "citations", "mean_citations"):
        out = ranked(out, column, f"rank_{column}")
    scored = out.withColumn("mean_rank", (F.col("rank_documents") + F.col("rank_citations") + F.col("rank_mean_citations")) / 3)
    held = scored.groupBy("mean_rank").agg(F.count("*").alias("_n"))
    before = held.select("mean_rank", F.coalesce(F.sum("_n").over(Window.orderBy("mean_rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("mean_rank").orderBy("institution"))
    return scored.withColumn("_own", own).join(before, "mean_rank").withColumn("place", F.col("_before") + F.col("_own")).select("institution", "documents", "citations", "mean_citations", "rank_documents", "rank_citations", "rank_mean_citations", "mean_rank", "place")


def sectors(affiliations: DataFrame, records: DataFrame) -> DataFrame:
    """Per sector: institutions, documents that name it, their share of all documents with a sector, citations, mean."""
    own = listed(affiliations).where("sector is not null")
    docs = own.select("doc", "sector").distinct().join(records.select("doc", "citations"), "doc")
    every = own.agg(F.count_distinct("doc").alias("_all"))
    made = docs.groupBy("sector").agg(F.count("*").alias("documents"), F.sum("citations").alias("citations"), F.avg("citations").alias("mean_citations"))
    names = own.groupBy("sector").agg(F.count_distinct("institution").alias("institutions"))
    return made.join(names, "sector").crossJoin(F.broadcast(every)).withColumn("share", ratio(F.col("documents"), F.col("_all"))).drop("_all")


def geography(affiliations: DataFrame) -> DataFrame:
    """Per country: institutions, documents, and the institution with the most documents (the first of several)."""
    own = listed(affiliations).where("country is not null")
    counted = own.groupBy("country", "institution").agg(F.count("*").alias("_n"))
    place = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("_n"), "institution"))
    leaders = counted.withColumn("_p", place).where("_p = 1").select("country", F.col("institution").alias("leader"), F.col("_n").alias("leader_documents"))
    totals = own.groupBy("country").agg(F.count_distinct("institution").alias("institutions"), F.count_distinct("doc").alias("documents"))
    return totals.join(leaders, "country")


def collaboration(affiliations: DataFrame) -> DataFrame:
    """Pairs of institutions ``a`` before ``b`` with their joint documents and similarity indices."""
    own = listed(affiliations).select("doc", "institution")
    totals = own.groupBy("institution").agg(F.count("*").alias("n"))
    return pair_similarity(pair_counts(own, "doc", "institution"), totals, "institution", "n")


def collaboration_rate(affiliations: DataFrame) -> DataFrame:
    """Per institution: documents, those with another institution, their share, and different partners."""
    own = listed(affiliations).select("doc", "institution")
    sizes = own.groupBy("doc").agg(F.count("*").alias("_k"))
    rates = own.join(sizes, "doc").groupBy("institution").agg(F.count("*").alias("documents"), F.count_if(F.col("_k") > 1).alias("joint"))
    pairs = pair_counts(own, "doc", "institution")
    partners = pairs.select(F.col("a").alias("institution")).unionByName(pairs.select(F.col("b").alias("institution"))).groupBy("institution").agg(F.count("*").alias("partners"))
    return rates.join(partners, "institution", "left").select("institution", "documents", "joint", ratio(F.col("joint"), F.col("documents")).alias("rate"), F.coalesce("partners", F.lit(0)).alias("partners"))
