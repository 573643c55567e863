"""Names of a dictionary found in free text: countries in affiliations and addresses, organisations by their aliases.

Texts and aliases become words alike (upper case, letters without accents, anything but letters and digits between words). Every
place of a text carries as many words as the longest alias has and meets the aliases by their first word; those whose words all
agree are hits. Hits of a text are settled from the left, at one place the longest first, and what overlaps a taken one goes, so
"South Africa" in "Republic of South Africa" does not count beside the longer name.

The dictionary is broadcast up to ``SMALL`` aliases, and joined by exchange beyond that; AQE splits a frequent first word. Hits
meet by row; a text has at most as many as words and aliases at a place. Null texts have none. Of one alias with several
targets the smallest counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import COUNTRY_NAMES, plain_letters

#: Aliases up to which a dictionary is broadcast.
SMALL = 200_000
#: Languages whose names of countries are taken from the JVM's locale data.
LANGUAGES = ("en", "fr", "de", "es", "pt", "it")


def words(x: Column) -> Column:
    """The words of a text as they are compared; null gives none."""
    plain = F.regexp_replace(F.upper(plain_letters(F.coalesce(x, F.lit("")))), r"[^\p{L}\p{N}]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def table(aliases: DataFrame, alias: str = "alias", target: str = "target") -> DataFrame:
    """``words, size, first, target`` of a dictionary; aliases without words go."""
    split = aliases.where(F.col(target).isNotNull()).select(words(F.col(alias)).alias("words"), F.col(target).alias("target")).where(F.size("words") > 0)
    unique = split.groupBy("words").agg(F.min("target").alias("target"))
    return unique.select("words", F.size("words").alias("size"), F.element_at("words", 1).alias("first"), "target")


def scan(df: DataFrame, keys: Sequence[str], text: str, aliases: DataFrame) -> DataFrame:
    """``keys, place`` (word from 1), ``size`` (words) and ``target`` of every name in ``text``; ``aliases`` as ``table`` gives them.

    ``keys`` name the rows; rows of equal keys are taken as one row of the same text.
    """
    sizes = aliases.agg(F.max("size").alias("longest"), F.count("*").alias("n")).first()
    longest = sizes["longest"] or 1
    listed = F.broadcast(aliases) if sizes["n"] <= SMALL else aliases
    split = df.select(*keys, words(F.col(text)).alias("_w")).where(F.size("_w") > 0)
    places = F.transform("_w", lambda _, i: F.struct((i + 1).alias("place"), F.slice(F.col("_w"), i + 1, longest).alias("next")))
    at = split.select(*keys, F.explode(places).alias("_p")).select(*keys, "_p.place", "_p.next")
    hits = at.join(listed, F.element_at("next", 1) == F.col("first")).where(F.slice("next", 1, F.col("size")) == F.col("words")).select(*keys, "place", "size", "target").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("place", (-F.col("size")).alias("less"), "target")))

    def take(acc: Column, hit: Column) -> Column:
        free = hit["place"] >= acc["end"]
        return F.struct(F.when(free, hit["place"] - hit["less"]).otherwise(acc["end"]).alias("end"), F.when(free, F.concat(acc["taken"], F.array(hit))).otherwise(acc["taken"]).alias("taken"))

    found = hits.groupBy(*keys).agg(ordered.alias("hits"))
    kind = found.schema["hits"].dataType.simpleString()
    settled = found.select(*keys, F.aggregate("hits", F.struct(F.lit(0).alias("end"), F.array().cast(kind).alias("taken")), take)["taken"].alias("taken"))
    return settled.select(*keys, F.explode("taken").alias("t")).select(*keys, F.col("t.place").alias("place"), (-F.col("t.less")).alias("size"), F.col("t.target").alias("target"))


def country_aliases(spark: SparkSession, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``alias, target`` of all countries of ISO 3166 by their names in ``languages``, from the JVM's locale data, and the fixed spellings
    of ``functions.text``. Targets are upper-case English names, as those spellings have them where they name one."""
    locale = spark._jvm.java.util.Locale
    rows: list[tuple[str, str]] = []
    for code in locale.getISOCountries():
        place = locale("", code)
        english = place.getDisplayCountry(locale("en"))
        rows += [(place.getDisplayCountry(locale(language)), english.upper()) for language in languages]
    named = spark.createDataFrame(rows, "alias string, target string")
    fixed = spark.createDataFrame(list(COUNTRY_NAMES.items()), "spelling string, target string")
    plain = F.array_join(words(F.col("target")), " ")
    own = named.select("alias", plain.alias("target")).join(F.broadcast(fixed.select("spelling", F.col("target").alias("_t"))), plain == F.col("spelling"), "left").select("alias", F.coalesce("_t", "target").alias("target"))
    spelled = fixed.select(F.col("spelling").alias("alias"), "target")
    return own.join(spelled.select("alias").distinct(), "alias", "left_anti").unionByName(spelled).distinct()


def countries_in_text(df: DataFrame, keys: Sequence[str], text: str, aliases: DataFrame | None = None) -> DataFrame:
    """Distinct ``keys, country`` of the countries that ``text`` names."""
    known = table(country_aliases(df.sparkSession) if aliases is None else aliases)
    return scan(df, keys, text, known).select(*keys, F.col("target").alias("country")).distinct()


def match_organisations(affiliations: DataFrame, keys: Sequence[str], text: str, names: DataFrame) -> DataFrame:
    """``keys, ror, place, size``: the organisation that each affiliation names, by ``names`` (``ror, alias``). Of several names in one
    affiliation the longest counts, the first of equals."""
    hits = scan(affiliations, keys, text, table(names, "alias", "ror"))
    best = hits.groupBy(*keys).agg(F.max_by(F.struct("target", "place", "size"), F.struct("size", -F.col("place"))).alias("b"))
    return best.select(*keys, F.col("b.target").alias("ror"), F.col("b.place").alias("place"), F.col("b.size").alias("size"))
