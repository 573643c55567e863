"""Readers of exports and API answers of scholarly databases, each giving the record table.

Files are read by Spark (globs and lists of paths included); a mapping is a select over columns. HTTP stays outside: API
answers are landed as JSON lines and mapped here.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .schema import RECORD, conform

#: Headers of exports by record field; fixed values of the formats.
SCOPUS = {
    "title": ("Title",), "authors": ("Authors",), "year": ("Year",), "source": ("Source title",), "citations": ("Cited by",), "doi": ("DOI",), "doc_type": ("Document Type",),
    "abstract": ("Abstract",), "keywords": ("Author Keywords",), "index_keywords": ("Index Keywords",), "affiliations": ("Affiliations",), "references": ("References",),
    "funding": ("Funding Details",), "language": ("Language of Original Document",), "volume": ("Volume",), "pages": ("Page range",),
}
WOS = {
    "title": ("Article Title", "TI"), "authors": ("Authors", "AU"), "year": ("Publication Year", "PY"), "source": ("Source Title", "SO"), "citations": ("Times Cited, All Databases", "Times Cited", "TC"),
    "doi": ("DOI", "DI"), "doc_type": ("Document Type", "DT"), "abstract": ("Abstract", "AB"), "keywords": ("Author Keywords", "DE"), "index_keywords": ("Keywords Plus", "ID"),
    "affiliations": ("Addresses", "Affiliations", "C1"), "references": ("Cited References", "CR"), "funding": ("Funding Orgs", "FU"), "language": ("Language", "LA"), "volume": ("Volume", "VL"), "pages": ("Pages",),
}
GENERIC = {f.name: (f.name,) for f in RECORD}


def header_key(name: str) -> str:
    """A header in lower case with runs of other marks as one underscore."""
    return re.sub("[^a-z0-9]+", "_", name.lstrip("﻿").lower()).strip("_")


def pick(df: DataFrame, candidates: tuple[str, ...]) -> Column:
    """The first of ``candidates`` that is a column, by exact name and then by ``header_key``; null if none is."""
    by_key = {header_key(c): c for c in reversed(df.columns)}
    found = next((c for c in candidates if c in df.columns), None) or next((by_key[header_key(c)] for c in candidates if header_key(c) in by_key), None)
    return F.col(f"`{found}`") if found else F.lit(None).cast("string")


def without_header_rows(df: DataFrame, share: float = 0.8) -> DataFrame:
    """``df`` without rows that repeat the header in at least ``share`` of their filled cells."""
    same = sum((F.coalesce((F.trim(F.col(f"`{c}`")) == c).cast("int"), F.lit(0)) for c in df.columns), F.lit(0))
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in df.columns), F.lit(0))
    return df.where(~((filled > 0) & (same >= share * filled)))


def page_range(df: DataFrame) -> Column:
    """``start-end`` where both are there, else the page range column or the article number."""
    first, last = pick(df, ("Page start", "Start Page", "BP")), pick(df, ("Page end", "End Page", "EP"))
    return F.coalesce(F.when(T.present(first) & T.present(last), F.concat(first, F.lit("-"), last)), pick(df, ("Page range", "Pages", "Art. No.", "Article Number", "AR")))


def csv_files(spark: SparkSession, paths: str | list[str], **options: object) -> list[tuple[list[str], list[str]]]:
    """The files of ``paths`` by their header: (column names, files).

    One job takes the first line of every file; files of equal first lines have one header, which the first of them is asked for.
    A header that goes on over a line break (an odd number of quotes) is asked for file by file. Files without a line are left out.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at")).where("at = 0")
    first = lines.withColumn("turn", F.monotonically_increasing_id()).groupBy("path").agg(F.min_by("value", "turn").alias("line")).collect()
    files: dict[tuple[str, str], list[str]] = {}
    for path, line in sorted((unquote(r["path"]), r["line"]) for r in first):
        files.setdefault((line, path if line.count('"') % 2 else ""), []).append(path)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for group in files.values():
        by_header.setdefault(tuple(spark.read.csv(group[0], header=True, **options).columns), []).extend(group)
    return [(list(names), sorted(group)) for names, group in by_header.items()]


def read_csv(spark: SparkSession, paths: str | list[str], kind: str = "generic", delimiter: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """Records of CSV exports; ``kind``: scopus, wos or generic. Quoted fields may span lines; repeated headers go.

    Files may have different columns or the same in another order: those of each header are read by themselves, and a
    record's fields come from its own file's columns.
    """
    options = {"sep": delimiter, "encoding": encoding, "multiLine": True, "escape": '"', "quote": '"', "mode": "PERMISSIVE"}
    parts = []
    for _, files in csv_files(spark, paths, **options):
        raw = spark.read.csv(files, header=True, enforceSchema=False, **options)
        named = raw.withColumn("_file", F.col("_metadata.file_name"))
        parts.append(map_export(named.where(~_is_header(named)), {"scopus": SCOPUS, "wos": WOS}.get(kind, GENERIC), kind.upper()))
    if not parts:
        return conform(spark.range(0).drop("id"))
    return reduce(DataFrame.unionByName, parts)


def _is_header(df: DataFrame) -> Column:
    names = [c for c in df.columns if c != "_file"]
    same = sum((F.coalesce((F.trim(F.col(f"`{c}`")) == c).cast("int"), F.lit(0)) for c in names), F.lit(0))
    filled = sum((F.col(f"`{c}`").isNotNull().cast("int") for c in names), F.lit(0))
    return (filled > 0) & (same >= 0.8 * filled)


def map_export(raw: DataFrame, names: dict[str, tuple[str, ...]], source_db: str) -> DataFrame:
    """Records of a table with export headers; countries come from affiliations where no column has them."""
    columns = {}
    for field in RECORD:
        if field.name in ("source_db", "source_file"):
            continue
        value = pick(raw, names.get(field.name, ()))
        columns[field.name] = T.split_values(value) if field.dataType.simpleString().startswith("array") else value
    mapped = raw.select(*(c.alias(n) for n, c in columns.items()), pick(raw, names.get("affiliations", ())).alias("_c1"), page_range(raw).alias("_pages"), (F.col("_file") if "_file" in raw.columns else F.lit(None).cast("string")).alias("source_file"))
    derived = mapped.withColumns({"countries": F.when(F.size("countries") > 0, F.col("countries")).otherwise(T.affiliation_countries(F.col("_c1"))), "pages": F.coalesce("pages", "_pages"), "source_db": F.lit(source_db)})
    return conform(derived)


#: One BibTeX field: name = {value} or "value", braces nested one level.
_FIELD = r"(?is)[\s,{]%s\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|([0-9]+))"


def read_bibtex(spark: SparkSession, paths: str | list[str], source_db: str = "GENERIC") -> DataFrame:
    """Records of BibTeX files: text is split at entries by the reader's line separator, fields are regular expressions."""
    raw = spark.read.text(paths, lineSep="\n@").withColumn("_file", F.col("_metadata.file_name"))
    entries = raw.where(F.col("value").rlike(r"^@?[A-Za-z]+\s*\{")).where(~F.col("value").rlike(r"(?i)^@?(comment|preamble|string)\s*\{"))

    def field(name: str) -> Column:
        parts = [F.nullif(F.regexp_extract("value", _FIELD % name, k), F.lit("")) for k in (1, 2, 3)]
        return T.squeeze(F.regexp_replace(F.coalesce(*parts), "[{}]", ""))

    cited = F.regexp_extract(field("note"), r"(?i)cited by:?\s*([0-9]+)", 1)
    out = entries.select(
        field("title").alias("title"),
        F.transform(F.split(field("author"), r"\s+and\s+"), lambda a: F.trim(a)).alias("authors"),
        field("year").alias("year"),
        F.coalesce(field("journal"), field("booktitle")).alias("source"),
        F.nullif(cited, F.lit("")).alias("citations"),
        field("doi").alias("doi"),
        F.upper(F.regexp_extract("value", r"^@?([A-Za-z]+)", 1)).alias("doc_type"),
        field("abstract").alias("abstract"),
        T.split_values(F.regexp_replace(field("(?:author_)?keywords"), ",", ";")).alias("keywords"),
        T.split_values(field("affiliations?")).alias("affiliations"),
        T.affiliation_countries(field("affiliations?")).alias("countries"),
        T.split_values(field("references")).alias("references"),
        field("language").alias("language"),
        field("volume").alias("volume"),
        field("pages").alias("pages"),
        F.lit(source_db).alias("source_db"),
        F.col("_file").alias("source_file"),
    )
    return conform(out)


OPENALEX_SCHEMA = (
    "id string, doi string, title string, publication_year int, cited_by_count long, type string, language string, abstract_inverted_index map<string,array<int>>,"
    " authorships array<struct<author:struct<display_name:string,orcid:string>,institutions:array<struct<display_name:string>>,countries:array<string>>>,"
    " primary_location struct<source:struct<display_name:string>>, concepts array<struct<display_name:string,score:double>>, referenced_works array<string>,"
    " biblio struct<volume:string,first_page:string,last_page:string>"
)
CROSSREF_SCHEMA = (
    "DOI string, title array<string>, `container-title` array<string>, author array<struct<family:string,given:string,affiliation:array<struct<name:string>>>>, `is-referenced-by-count` long,"
    " type string, abstract string, subject array<string>, reference array<struct<DOI:string,unstructured:string>>, language string, volume string, page string,"
    " `published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>"
)
PUBMED_SCHEMA = "uid string, title string, fulljournalname string, pubdate string, authors array<struct<name:string>>, pubtype array<string>, lang array<string>, volume string, pages string, articleids array<struct<idtype:string,value:string>>"


def openalex(landed: DataFrame) -> DataFrame:
    """Records of OpenAlex works (``OPENALEX_SCHEMA``): concepts of score over 0.3, at most 20, as index keywords."""
    names = F.transform("authorships", lambda a: a["author"]["display_name"])
    countries = F.array_distinct(F.flatten(F.transform("authorships", lambda a: F.coalesce(a["countries"], F.array().cast("array<string>")))))
    places = F.array_distinct(F.flatten(F.transform("authorships", lambda a: F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string>>")), lambda i: i["display_name"]))))
    concepts = F.transform(F.slice(F.filter("concepts", lambda c: c["score"] > 0.3), 1, 20), lambda c: c["display_name"])
    pages = F.concat_ws("-", "biblio.first_page", "biblio.last_page")
    return conform(
        landed.select(
            "title", names.alias("authors"), F.col("publication_year").alias("year"), F.col("primary_location.source.display_name").alias("source"), F.col("cited_by_count").alias("citations"), "doi",
            F.col("type").alias("doc_type"), T.abstract_from_index(F.col("abstract_inverted_index")).alias("abstract"), concepts.alias("index_keywords"), places.alias("affiliations"),
            countries.alias("countries"), F.col("referenced_works").alias("references"), "language", F.col("biblio.volume").alias("volume"), pages.alias("pages"), F.lit("OPENALEX").alias("source_db"),
        )
    )


def crossref(landed: DataFrame) -> DataFrame:
    """Records of Crossref works (``CROSSREF_SCHEMA``): the year of the first date there is."""
    date = F.coalesce(*(F.col(f"`{c}`.`date-parts`") for c in ("published-print", "published-online", "issued")))
    cited = F.filter(F.transform("reference", lambda r: F.coalesce(r["DOI"], r["unstructured"])), lambda r: r.isNotNull())
    places = F.array_distinct(F.flatten(F.transform("author", lambda a: F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name:string>>")), lambda p: p["name"]))))
    return conform(
        landed.select(
            F.get("title", F.lit(0)).alias("title"), F.transform("author", lambda a: F.concat_ws(", ", a["family"], a["given"])).alias("authors"), F.get(F.get(date, F.lit(0)), F.lit(0)).alias("year"),
            F.get(F.col("`container-title`"), F.lit(0)).alias("source"), F.col("`is-referenced-by-count`").alias("citations"), F.col("DOI").alias("doi"), F.col("type").alias("doc_type"),
            T.clean_abstract(F.col("abstract")).alias("abstract"), F.col("subject").alias("index_keywords"), places.alias("affiliations"), cited.alias("references"), "language", "volume", F.col("page").alias("pages"), F.lit("CROSSREF").alias("source_db"),
        )
    )


def pubmed(landed: DataFrame) -> DataFrame:
    """Records of PubMed summaries (``PUBMED_SCHEMA``)."""
    doi = F.get(F.transform(F.filter("articleids", lambda a: a["idtype"] == "doi"), lambda a: a["value"]), F.lit(0))
    return conform(
        landed.select(
            "title", F.transform("authors", lambda a: a["name"]).alias("authors"), F.nullif(F.regexp_extract("pubdate", "([0-9]{4})", 1), F.lit("")).alias("year"), F.col("fulljournalname").alias("source"),
            doi.alias("doi"), F.get("pubtype", F.lit(0)).alias("doc_type"), F.get("lang", F.lit(0)).alias("language"), "volume", "pages", F.lit("PUBMED").alias("source_db"),
        )
    )


def read_json(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """Records of landed API answers (JSON lines); ``kind``: openalex, crossref or pubmed."""
    schema, mapping = {"openalex": (OPENALEX_SCHEMA, openalex), "crossref": (CROSSREF_SCHEMA, crossref), "pubmed": (PUBMED_SCHEMA, pubmed)}[kind]
    return mapping(spark.read.schema(schema).json(paths))


READERS = {"csv": read_csv, "bibtex": read_bibtex, "json": read_json}


def read_sources(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Records of several sources: each spec has ``format`` (csv, bibtex, json), ``paths`` and ``kind``."""
    tables = []
    for spec in specs:
        if spec.get("format") not in READERS or not spec.get("paths"):
            raise ValueError(f"a source needs paths and a format of {sorted(READERS)}: {spec}")
        tables.append(READERS[spec["format"]](spark, spec["paths"], spec.get("kind", "generic")))
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table)
    return out


def enrich(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """Records with fields that they miss from ``metadata`` of the same DOI; citations are the larger count."""
    best = metadata.withColumn("_key", T.doi_key(F.col("doi"))).where("_key is not null")
    fields = [c for c in RECORD.fieldNames() if c not in ("doi", "source_db", "source_file")]
    one = best.groupBy("_key").agg(*(F.max_by(c, F.struct(F.col(c).isNotNull().cast("int"), F.xxhash64(*fields))).alias(f"_m_{c}") for c in fields))
    joined = records.join(one, T.doi_key(F.col("doi")) == F.col("_key"), "left")
    filled = {c: F.greatest(F.col(c), F.col(f"_m_{c}")) if c == "citations" else F.coalesce(F.when(F.size(c) > 0, F.col(c)), F.col(f"_m_{c}")) if RECORD[c].dataType.simpleString().startswith("array") else F.coalesce(c, f"_m_{c}") for c in fields}
    return joined.withColumns(filled).select(records.columns)


def coverage(records: DataFrame) -> DataFrame:
    """Per field: rows that have it and their share."""
    known = {c: (F.size(c) > 0 if RECORD[c].dataType.simpleString().startswith("array") else F.col(c).isNotNull()) for c in RECORD.fieldNames()}
    counted = records.agg(F.count("*").alias("_n"), *(F.sum(F.coalesce(k.cast("long"), F.lit(0))).alias(c) for c, k in known.items()))
    long = counted.select("_n", F.explode(F.create_map(*(x for c in known for x in (F.lit(c), F.col(c))))).alias("field", "present"))
    return long.select("field", "present", F.when(F.col("_n") > 0, F.col("present") / F.col("_n")).alias("share"))


def orcid_profiles(landed: DataFrame) -> DataFrame:
    """``orcid, name, works`` of landed ORCID records (``orcid-identifier``, ``person``, ``activities-summary``)."""
    name = F.col("person.name")
    return landed.select(
        F.col("`orcid-identifier`.path").alias("orcid"),
        T.squeeze(F.concat_ws(" ", name["given-names"]["value"], name["family-name"]["value"])).alias("name"),
        F.coalesce(F.size(F.col("`activities-summary`.works.group")), F.lit(0)).alias("works"),
    )


def ror_organisations(landed: DataFrame) -> DataFrame:
    """``ror, name, country, city`` of landed ROR organisations (version 1 answers)."""
    return landed.select(F.regexp_extract("id", "([^/]+)$", 1).alias("ror"), "name", F.upper("country.country_name").alias("country"), F.get("addresses", F.lit(0))["city"].alias("city"))


def ror_names(landed: DataFrame) -> DataFrame:
    """``ror, alias``: names, aliases and acronyms of landed ROR organisations, for ``dictionary.match_organisations``."""
    listed = [F.array("name"), *(F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("aliases", "acronyms") if c in landed.columns)]
    return landed.select(F.regexp_extract("id", "([^/]+)$", 1).alias("ror"), F.explode(F.array_distinct(F.concat(*listed))).alias("alias")).where("alias is not null")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """A screening ledger of CSV or JSON lines (by the file's ending): doc, stage, reviewer, decision, reason, is_final."""
    raw = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = {"doc": ("doc", "document_id", "record_id", "id"), "stage": ("stage", "phase"), "reviewer": ("reviewer", "screener"), "decision": ("decision", "status"), "reason": ("reason", "exclusion_reason"), "is_final": ("is_final", "final")}
    columns = [pick(raw, found).cast("string").alias(name) for name, found in names.items()]
    return raw.select(columns).withColumn("is_final", F.lower("is_final").isin("true", "1", "yes"))


def read_spec(spark: SparkSession, path: str, base: dict | None = None) -> dict:
    """A JSON file of settings (a flow specification, say) as a dict, over those of ``base``."""
    from ..operators.adjust import merged_spec

    text = spark.read.text(path, wholetext=True).first()
    return merged_spec(base or {}, json.loads(text[0]) if text else {})


def sample_records(spark: SparkSession, many: int = 500, seed: int = 42) -> DataFrame:
    """``many`` made-up records in the record schema, the same for a seed: for trials and tests."""
    at = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    number = lambda x: x.cast("string")
    rows = spark.range(many).select(
        F.concat(F.lit("Sample record "), number(F.col("id"))).alias("title"), F.transform(F.sequence(F.lit(0), at(1, 4).cast("int")), lambda k: F.concat(F.lit("Author "), number(F.pmod(F.xxhash64("id", k, F.lit(seed)), F.lit(60))))).alias("authors"),
        (2005 + at(2, 20)).cast("int").alias("year"), F.concat(F.lit("Journal "), number(at(3, 25))).alias("source"), F.floor(F.pow(at(4, 1000) / 100.0, 2)).cast("long").alias("citations"), F.concat(F.lit("10.5555/sample."), number(F.col("id"))).alias("doi"),
        F.when(at(5, 5) == 0, "Review").otherwise("Article").alias("doc_type"), F.transform(F.sequence(F.lit(0), at(6, 4).cast("int")), lambda k: F.concat(F.lit("topic "), number(F.pmod(F.xxhash64("id", k, F.lit(seed + 1)), F.lit(40))))).alias("keywords"), F.lit("SAMPLE").alias("source_db"),
    )
    return conform(rows)
