"""The star schema around a document: tables exploded once from merged records (``doc`` and the record fields)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .primitives import citation_indices, ratio


def _exploded(records: DataFrame, field: str, name: str) -> DataFrame:
    """``doc``, place and value of each distinct non-blank value of an array field."""
    values = F.array_distinct(F.filter(F.transform(field, lambda v: T.squeeze(v)), lambda v: v != ""))
    return records.select("doc", F.posexplode(values).alias("position", name)).withColumn("position", F.col("position") + 1)


def author_documents(records: DataFrame, fractional: bool = False) -> DataFrame:
    out = _exploded(records, "authors", "author").join(records.select("doc", F.size("authors").alias("n_authors")), "doc")
    return out.withColumn("weight", 1.0 / F.col("n_authors") if fractional else F.lit(1.0))


def authors(records: DataFrame) -> DataFrame:
    joined = author_documents(records).join(records.select("doc", "citations", "year"), "doc")
    years = joined.groupBy("author").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return citation_indices(joined, ["author"], "citations").join(years, "author")


def country_documents(records: DataFrame) -> DataFrame:
    listed = records.select("doc", F.explode(F.transform("countries", lambda c: T.country(c))).alias("country")).where("country is not null").distinct()
    return listed.join(listed.groupBy("doc").agg(F.count("*").alias("n_countries")), "doc").withColumn("weight", 1.0 / F.col("n_countries"))


def affiliations(records: DataFrame) -> DataFrame:
    out = _exploded(records, "affiliations", "affiliation")
    aff = F.col("affiliation")
    named = T.institution(aff)
    return out.withColumns({"institution": named, "department": T.department(aff), "country": T.country(F.element_at(F.split(aff, ","), -1)), "sector": T.sector(named)})


def locations(affiliations_: DataFrame) -> DataFrame:
    return affiliations_.groupBy("country", "institution").agg(F.count_distinct("doc").alias("documents"), F.count("*").alias("mentions"))


def keywords_long(records: DataFrame) -> DataFrame:
    own = records.select("doc", F.explode("keywords").alias("raw")).withColumn("kind", F.lit("author"))
    index = records.select("doc", F.explode("index_keywords").alias("raw")).withColumn("kind", F.lit("index"))
    word = T.squeeze(F.lower("raw"))
    return own.unionByName(index).select("doc", "kind", word.alias("keyword")).where(T.present(F.col("keyword"))).distinct()


def keywords(long: DataFrame) -> DataFrame:
    of = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    return long.groupBy("keyword").agg(F.count("*").alias("frequency"), F.count_distinct("doc").alias("documents"), of("author").alias("author_hits"), of("index").alias("index_hits"))


def references(records: DataFrame) -> DataFrame:
    out = records.select("doc", F.posexplode("references").alias("position", "raw")).where(F.length("raw") > 10)
    return out.withColumn("parsed", T.reference(F.col("raw"))).select("doc", "position", "raw", "parsed.*")


def reference_statistics(references_: DataFrame, as_of_year: int, recent: int = 5) -> DataFrame:
    age = F.lit(as_of_year) - F.col("year")
    aged = references_.withColumn("age", F.when(age >= 0, age))
    return aged.agg(F.count("*").alias("references"), F.count_distinct("doc").alias("citing"), F.avg("age").alias("mean_age"), F.median("age").alias("half_life"), ratio(F.sum((F.col("age") < recent).cast("int")), F.count("age")).alias("price_index"), F.count("doi").alias("with_doi"))


def abstracts(records: DataFrame) -> DataFrame:
    clean = records.select("doc", T.clean_abstract(F.col("abstract")).alias("text"))
    words = F.size(F.filter(F.split("text", " "), lambda w: w != ""))
    return clean.select("doc", "text", F.coalesce(F.length("text"), F.lit(0)).alias("characters"), F.when(F.col("text").isNull(), 0).otherwise(words).alias("words"), T.language(F.col("text")).alias("language"), T.present(F.col("text")).alias("has_abstract"))


def funding(records: DataFrame) -> DataFrame:
    raw = records.select("doc", F.explode("funding").alias("raw"))
    named = raw.select("doc", F.explode(T.funders(F.col("raw"))).alias("value")).withColumn("kind", F.lit("funder"))
    numbers = raw.select("doc", F.explode(T.grants(F.col("raw"))).alias("value")).withColumn("kind", F.lit("grant"))
    return named.unionByName(numbers).distinct()


def collaborations(records: DataFrame) -> DataFrame:
    n, k = F.size("authors"), F.size(F.array_distinct("countries"))
    kind = F.when(n > 1, "multi_author").when(n == 1, "single_author")
    return records.select("doc", "year", n.alias("n_authors"), k.alias("n_countries"), kind.alias("type"), F.when(k > 1, "multi_country").when(k == 1, "single_country").alias("scope"))


def doc_types(records: DataFrame) -> DataFrame:
    counted = records.groupBy("doc_type").agg(F.count("*").alias("articles"))
    return counted.withColumn("share", ratio(F.col("articles"), F.sum("articles").over(Window.partitionBy())))


def sources(records: DataFrame) -> DataFrame:
    return records.where("source is not null").groupBy("source").agg(F.count("*").alias("articles"), F.sum("citations").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.avg(F.col("doi").isNotNull().cast("double")).alias("doi_coverage"))


def documents(records: DataFrame) -> DataFrame:
    """One row a document with counts of what it lists, language, and ready (title, authors, year, source) or partial."""
    listed = {f"n_{c}": F.coalesce(F.size(c), F.lit(0)) for c in ("authors", "countries", "keywords", "references", "affiliations")}
    ready = T.present(F.col("title")) & (F.col("n_authors") > 0) & F.col("year").isNotNull() & T.present(F.col("source"))
    return records.select("doc", "title", "year", "source", "doc_type", "citations", "doi", T.language(F.coalesce("abstract", "title")).alias("language"), *(c.alias(n) for n, c in listed.items())).withColumn("status", F.when(ready, "ready").otherwise("partial"))


def quality(records: DataFrame, as_of_year: int) -> DataFrame:
    """One row of checks: missing and impossible years, negative and extreme citations, repeated titles, country coverage."""
    titles = records.select(T.title_key(F.col("title")).alias("k")).where("k is not null").groupBy("k").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_titles"))
    cuts = records.agg(F.percentile("citations", F.lit(0.25)).alias("_q1"), F.percentile("citations", F.lit(0.75)).alias("_q3"))
    flagged = records.crossJoin(F.broadcast(cuts))
    of = lambda test: F.sum(F.coalesce(test.cast("long"), F.lit(0)))
    bad_year = (F.col("year") < 1800) | (F.col("year") > as_of_year + 1)
    out = flagged.agg(F.count("*").alias("records"), of(F.col("year").isNull()).alias("missing_year"), of(bad_year).alias("invalid_year"), of(F.col("citations") < 0).alias("negative_citations"), of(F.col("citations") > F.col("_q3") + 3 * (F.col("_q3") - F.col("_q1"))).alias("extreme_citations"), F.avg((F.size("countries") > 0).cast("double")).alias("country_coverage"))
    return out.crossJoin(titles)


def organise(records: DataFrame) -> dict[str, DataFrame]:
    """All tables by name, lazily."""
    long, places, cited = keywords_long(records), affiliations(records), references(records)
    return {
        "documents": documents(records), "author_documents": author_documents(records), "authors": authors(records), "country_documents": country_documents(records), "affiliations": places, "locations": locations(places),
        "keywords_long": long, "keywords": keywords(long), "references": cited, "abstracts": abstracts(records), "funding": funding(records), "collaborations": collaborations(records), "doc_types": doc_types(records), "sources": sources(records),
    }


def reference_journals(references_: DataFrame, journal: str = "journal") -> DataFrame:
    """Per cited journal (column ``journal`` of the references): mentions, citing documents, rank by mentions (ties by name)."""
    return _cited(references_, journal)


def reference_authors(references_: DataFrame) -> DataFrame:
    """Per first author of references: mentions, citing documents, rank by mentions (ties by name)."""
    return _cited(references_, "first_author")


def _cited(references_: DataFrame, column: str) -> DataFrame:
    counted = references_.where(T.present(F.col(column))).groupBy(F.trim(column).alias(column)).agg(F.count("*").alias("mentions"), F.count_distinct("doc").alias("citing"))
    sizes = counted.groupBy("mentions").agg(F.count("*").alias("_n"))
    before = sizes.select("mentions", F.coalesce(F.sum("_n").over(Window.orderBy(F.desc("mentions")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("mentions").orderBy(column))
    return counted.withColumn("_own", own).join(before, "mentions").select(column, "mentions", "citing", (F.col("_before") + F.col("_own")).alias("rank"))


def document_summaries(records: DataFrame) -> DataFrame:
    """Per document: keywords (author and index), affiliations, institutions, references and references with a year."""
    words = keywords_long(records).groupBy("doc").agg(F.count("*").alias("keywords"), F.count_distinct("keyword").alias("different_keywords"))
    places = affiliations(records).groupBy("doc").agg(F.count("*").alias("affiliations"), F.count_distinct("institution").alias("institutions"))
    cited = references(records).groupBy("doc").agg(F.count("*").alias("references"), F.count("year").alias("dated_references"))
    return records.select("doc").join(words, "doc", "left").join(places, "doc", "left").join(cited, "doc", "left").fillna(0)


def self_citations(records: DataFrame) -> DataFrame:
    """Per document with references: references, those that name the last name (over two letters) of one of its authors, share."""
    last = F.transform("authors", lambda a: F.upper(F.trim(F.when(F.contains(a, F.lit(",")), F.substring_index(a, ",", 1)).otherwise(F.substring_index(a, " ", -1)))))
    rows = records.select("doc", F.filter(last, lambda a: F.length(a) > 2).alias("last"), F.explode("references").alias("raw"))
    own = F.exists("last", lambda a: F.contains(F.upper("raw"), a))
    return rows.groupBy("doc").agg(F.count("*").alias("references"), F.count_if(own).alias("own")).withColumn("share", ratio(F.col("own"), F.col("references")))


def display_label(title, source, year, doi, most: int = 60):
    """A short label of a document: its title, cut at ``most`` letters, source and year; its DOI where it has no title."""
    short = F.when(F.length(title) > most, F.concat(F.rtrim(F.substring(title, 1, most - 3)), F.lit("..."))).otherwise(title)
    named = F.concat_ws(", ", short, F.nullif(F.trim(source), F.lit("")), year.cast("string"))
    return F.when(T.present(title), named).when(T.present(doi), doi).otherwise(F.lit("Untitled"))


def majority_cluster(references_: DataFrame, clusters: DataFrame) -> DataFrame:
    """Per document the cluster (``reference, cluster``) of most of its references (``doc, reference``; the smallest of several),
    how many, and their share."""
    votes = references_.join(clusters, "reference").groupBy("doc", "cluster").agg(F.count("*").alias("n"))
    best = votes.groupBy("doc").agg(F.max(F.struct("n", -F.col("cluster"))).alias("b"), F.sum("n").alias("all"))
    return best.select("doc", (-F.col("b.col2")).alias("cluster"), F.col("b.n").alias("votes"), ratio(F.col("b.n"), F.col("all")).alias("share"))
