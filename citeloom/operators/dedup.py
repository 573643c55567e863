"""Merging record tables: duplicates by DOI, by title and year, by similar titles; survivorship with provenance.

Records are in the schema of ``sources.schema.RECORD`` (multi-valued fields as arrays). ``order`` is a deterministic
place in the input, made of source rank, file and row; "first" means least order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions import text as T
from .networks import components

#: Best source first; fixed default of the rule.
PRIORITY = ("WOS", "SCOPUS", "PUBMED", "CROSSREF", "OPENALEX", "GENERIC", "ORCID", "ROR")
UNION = ("authors", "keywords", "index_keywords", "affiliations", "countries", "references", "funding")
LARGEST = ("citations",)
LONGEST = ("abstract", "title")


def source_rank(priority: tuple[str, ...] = PRIORITY):
    """Place of ``source_db`` in the priority, after all of them for an unknown one."""
    names = F.array(*(F.lit(p) for p in priority))
    place = F.array_position(names, F.upper(F.coalesce("source_db", F.lit(""))))
    return F.when(place > 0, place).otherwise(F.lit(len(priority) + 1))


def prepare(records: DataFrame, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """``records`` with keys, source rank, number of filled fields and a total order."""
    filled = reduce(lambda a, b: a + b, (F.col(c).isNotNull().cast("int") for c in records.columns))
    keyed = records.withColumns({"doi_key": T.doi_key(F.col("doi")), "title_key": T.title_key(F.col("title")), "rank": source_rank(priority), "filled": filled})
    row = F.xxhash64(*(F.col(c).cast("string") if not records.schema[c].dataType.simpleString().startswith(("array", "map", "struct")) else F.to_json(F.struct(c)) for c in records.columns))
    return keyed.withColumn("order", F.struct("rank", (-F.col("filled")).alias("f"), (-F.coalesce(F.length("title"), F.lit(0))).alias("t"), F.coalesce("doi_key", F.lit("")).alias("d"), row.alias("h")))


def _merged(column: str):
    """Survivor of a single-valued field in a group."""
    value = F.col(column)
    if column in LARGEST:
        return F.max(value)
    if column in LONGEST:
        return F.max_by(value, F.when(value.isNotNull(), F.struct(F.length(value), -F.col("rank"), F.xxhash64(value))))
    return F.min_by(value, F.when(value.isNotNull() & (value.cast("string") != ""), F.col("order")))


def _united(keyed: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key`` and arrays of the distinct values of multi-valued fields, and of ``sources``, in order of first occurrence.

    Values are reduced to one row each (map-side) before arrays are made, so a key with a great many rows, such as a
    bare "editorial" of a year, gathers its distinct values only.
    """
    entries = F.array(*(F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("array<string>"), F.array().cast("array<string>")).alias("values")) for c in [*fields, "sources"]))
    each = keyed.select(F.col(key).alias("_k"), "order", F.explode(entries).alias("e")).select("_k", "order", "e.field", F.posexplode("e.values").alias("place", "value"))
    first = each.groupBy("_k", "field", "value").agg(F.min(F.struct("order", "place")).alias("at"))
    arrays = first.groupBy("_k").agg(*(F.array_sort(F.collect_list(F.when(F.col("field") == c, F.struct("at", "value")))).alias(f"_u_{c}") for c in [*fields, "sources"]))
    return arrays.select("_k", *(F.transform(f"_u_{c}", lambda s: s["value"]).alias(f"_u_{c}") for c in fields), F.array_sort(F.transform("_u_sources", lambda s: s["value"])).alias("_u_sources"))


def collapse(keyed: DataFrame, key: str, method: str) -> DataFrame:
    """One row for each value of ``key``: union, largest, longest or best source's value by field, with provenance.

    ``sources`` lists the sources of its rows, ``n_merged`` counts the rows; ``conflicts`` lists the fields in which rows
    differ (the least and the greatest filled value are not the same); ``merged_by`` is ``method`` for two rows or more.
    """
    helpers = {"doi_key", "title_key", "rank", "filled", "order", "sources", "n_merged", "conflicts", "merged_by"}
    fields = [c for c in keyed.columns if c not in helpers and c != key]
    union = [c for c in fields if c in UNION]
    plain = [c for c in fields if c not in UNION and c not in LARGEST]
    conflicts = F.filter(F.array(*(F.when(F.col(f"_d_{c}"), F.lit(c)) for c in plain)), lambda c: c.isNotNull())
    out = keyed.groupBy(key).agg(
        *(_merged(c).alias(c) for c in fields if c not in UNION),
        *(F.min(c).alias(c) for c in ("doi_key", "title_key") if c != key),
        F.min("rank").alias("rank"),
        F.max("filled").alias("filled"),
        F.min("order").alias("order"),
        F.sum("n_merged").alias("n_merged"),
        F.max("merged_by").alias("_before"),
        F.count("*").alias("_n"),
        *((F.min(F.col(c).cast("string")) != F.max(F.col(c).cast("string"))).alias(f"_d_{c}") for c in plain),
    )
    out = out.join(_united(keyed, key, union), F.col(key) == F.col("_k"), "left").drop("_k")
    out = out.withColumns({**{c: F.coalesce(F.col(f"_u_{c}"), F.array().cast("array<string>")).cast(ArrayType(keyed.schema[c].dataType.elementType)) for c in union}, "sources": F.col("_u_sources")})
    out = out.withColumn("conflicts", conflicts).withColumn("merged_by", F.when(F.col("_n") > 1, F.lit(method)).otherwise(F.col("_before")))
    return out.select(*keyed.columns)


def deduplicate(records: DataFrame, fuzzy: float | None = None, priority: tuple[str, ...] = PRIORITY) -> DataFrame:
    """Records merged by exact DOI, then rows without a DOI by title key and year, then optionally by similar titles.

    A row with a DOI never merges with one without by title, as the keys of the passes say. Adds ``doc`` (a hash of keys and
    content, and of the number among equal rows where there is neither key), ``sources``, ``n_merged``, ``merged_by`` and
    ``conflicts``.
    """
    keyed = prepare(records, priority).withColumns(
        {"sources": F.array(F.coalesce("source_db", F.lit("GENERIC"))), "n_merged": F.lit(1).cast("long"), "conflicts": F.array().cast("array<string>"), "merged_by": F.lit(None).cast("string")}
    )
    with_doi = collapse(keyed.where("doi_key is not null"), "doi_key", "doi_exact")
    rest = keyed.where("doi_key is null")
    titled = rest.where("title_key is not null").withColumn("_key", F.concat_ws("|", "title_key", F.coalesce(F.col("year").cast("string"), F.lit(""))))
    by_title = collapse(titled, "_key", "title_year_normalized").drop("_key")
    keyless = rest.where("title_key is null").withColumn("_again", F.row_number().over(Window.partitionBy("order").orderBy("order")))
    out = with_doi.unionByName(by_title).withColumn("_again", F.lit(1)).unionByName(keyless)
    if fuzzy is not None:
        merged = merge_similar_titles(out.where("title_key is not null").drop("_again"), fuzzy)
        out = merged.withColumn("_again", F.lit(1)).unionByName(out.where("title_key is null"))
    doc = F.xxhash64(F.coalesce("doi_key", F.lit("")), F.coalesce("title_key", F.lit("")), F.coalesce("year", F.lit(-1)), F.col("order.h"), "_again")
    return out.withColumn("doc", doc).drop("order", "rank", "filled", "_again")


def similar_titles(keyed: DataFrame, least: float = 0.9) -> DataFrame:
    """Pairs ``a, b`` of row hashes with one year whose title keys are similar to ``least``.

    Words are put in order of rarity in the table, and only titles that share one of their rarest words (as many as a
    similarity of ``least`` needs) and a year are compared, so common words pair nothing.
    """
    rows = keyed.where("title_key is not null").select(F.col("order.h").alias("id"), "year", "title_key").withColumn("words", F.array_distinct(F.split("title_key", " ")))
    df = rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    placed = rows.select("id", "year", F.size("words").alias("k"), F.explode("words").alias("w")).join(df, "w")
    need = F.greatest(F.lit(1), F.floor(F.col("k") * (1 - (2 * least - 1)) + 1))
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "w"))
    prefix = placed.withColumn("place", place).where(F.col("place") <= need).select("id", "year", "w")
    a, b = prefix.withColumnRenamed("id", "a"), prefix.withColumnRenamed("id", "b")
    pairs = a.join(b, (a["w"] == b["w"]) & a["year"].eqNullSafe(b["year"]) & (F.col("a") < F.col("b"))).select("a", "b").distinct()
    own = rows.select("id", "title_key")
    both = pairs.join(own.withColumnsRenamed({"id": "a", "title_key": "ta"}), "a").join(own.withColumnsRenamed({"id": "b", "title_key": "tb"}), "b")
    return both.withColumn("similarity", T.title_similarity(F.col("ta"), F.col("tb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def merge_similar_titles(keyed: DataFrame, least: float = 0.9) -> DataFrame:
    """``keyed`` with classes of similar titles (connected components) collapsed."""
    links = similar_titles(keyed, least).select("a", "b", F.lit(1).alias("weight"))
    classes = components(links)
    joined = keyed.join(classes, F.col("order.h") == F.col("node"), "left").withColumn("_class", F.coalesce("component", F.col("order.h"))).drop("node", "component")
    return collapse(joined, "_class", "title_year_fuzzy").drop("_class")


def summary(raw: DataFrame, merged: DataFrame) -> DataFrame:
    """One row: raw and unique records, removed, rate, records of several sources, mean rows merged."""
    sizes = raw.agg(F.count("*").alias("raw"))
    of = merged.agg(F.count("*").alias("unique"), F.sum((F.size(F.array_distinct("sources")) > 1).cast("long")).alias("multi_source"), F.avg("n_merged").alias("mean_merged"))
    return sizes.crossJoin(of).withColumn("removed", F.col("raw") - F.col("unique")).withColumn("rate", F.when(F.col("raw") > 0, F.col("removed") / F.col("raw")))


def conflicts(merged: DataFrame) -> DataFrame:
    """``doc, field`` for each field in which merged rows differed."""
    return merged.select("doc", F.explode("conflicts").alias("field"))
