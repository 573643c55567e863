"""Similarity joins over names and titles: TF-IDF cosine, token Jaccard and edit similarity, and the classes they give.

No join compares everything with everything: rows meet on a rare token (term, word or pair of letters) of their prefix,
which every pair at the threshold shares, and are then verified. Tokens are put in order of rarity in the whole table, so
frequent ones, which would make large groups, pair nothing unless a row has no others. Each function keeps one row a
distinct string; copies meet through it. Null and blank strings are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.storage import materialise, shared_dir
from . import blocks
from .networks import connected

#: Pairs of two blocks that cost as much as one meeting of two rows by a token.
BLOCKED = 100


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def _meeting(prefix: DataFrame) -> DataFrame:
    """Distinct pairs ``a`` < ``b`` of ids with a common ``token`` in ``prefix`` (id, token)."""
    a, b = prefix.withColumnRenamed("id", "a"), prefix.withColumnRenamed("id", "b")
    return a.join(b, "token").where("a < b").select("a", "b").distinct()


def _by_rarity(tokens: DataFrame) -> DataFrame:
    """``tokens`` (id, token, each once) with ``place`` from the rarest token of an id and its number of tokens ``k``."""
    rare = tokens.groupBy("token").agg(F.count("*").alias("df"))
    own = Window.partitionBy("id")
    return tokens.join(rare, "token").withColumns({"place": F.row_number().over(own.orderBy("df", "token")), "k": F.count("*").over(own)})


def tfidf(titles: DataFrame) -> DataFrame:
    """``id, token, df, weight`` of ``titles`` (id, title): tf * ln(1 + n / df) over words of the title key, of unit length."""
    words = titles.select("id", F.explode(F.split(T.title_key(F.col("title")), " ")).alias("token"))
    counts = words.groupBy("id", "token").agg(F.count("*").alias("tf"))
    n = titles.where(T.title_key(F.col("title")).isNotNull()).agg(F.count("*").alias("n"))
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    raw = counts.join(df, "token").crossJoin(F.broadcast(n)).withColumn("raw", F.col("tf") * F.log(1 + F.col("n") / F.col("df")))
    return raw.select("id", "token", "df", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("id")))).alias("weight"))


def _pairs_cost_less(prefix: DataFrame, n: int) -> bool:
    """Whether all pairs of ``n`` rows, compared in blocks, are cheaper than the meetings of ``prefix``, joined and shuffled."""
    met = prefix.groupBy("token").agg(F.count("*").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1.0) / 2)).first()[0] or 0.0
    return n * (n - 1) / 2 < BLOCKED * met


def similar_by_terms(titles: DataFrame, least: float = 0.8) -> DataFrame:
    """``a, b, cosine`` of titles (id, title) with a TF-IDF cosine of ``least`` or more.

    A pair's first common term, from the rarest on, lies where the weights from it on still have a length of ``least``:
    what comes later cannot add up to it. Where these prefixes are so long that most titles meet, blocks of titles are compared.
    """
    folder = shared_dir(titles.sparkSession)
    weights = materialise(tfidf(titles), folder, "weights")
    later = Window.partitionBy("id").orderBy("df", "token").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    prefix = weights.withColumn("left", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(later))).where(F.col("left") >= least - 1e-9).select("id", "token")
    n = weights.agg(F.count_distinct("id")).first()[0]
    if _pairs_cost_less(prefix, n):
        rows = blocks.coded(weights.select("id", "token", "weight"), folder).groupBy("id").agg(F.collect_list(F.struct("code", "weight")).alias("cells"))
        packed = blocks.blocks(rows, n, folder, "cells")
        return blocks.crossed(packed, blocks.cosines(least), dict(rows.dtypes)["id"]).withColumnRenamed("value", "cosine")
    wa = weights.select(F.col("id").alias("a"), "token", F.col("weight").alias("wa"))
    wb = weights.select(F.col("id").alias("b"), "token", F.col("weight").alias("wb"))
    both = _meeting(prefix).join(wa, "a").join(wb, ["b", "token"])
    return both.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") >= least)


def duplicate_titles(titles: DataFrame, least: float = 0.85) -> DataFrame:
    """``similar_by_terms`` with the Jaccard similarity of the titles' words."""
    keyed = titles.select("id", T.title_key(F.col("title")).alias("key"))
    pairs = similar_by_terms(titles, least)
    both = pairs.join(keyed.withColumnsRenamed({"id": "a", "key": "ka"}), "a").join(keyed.withColumnsRenamed({"id": "b", "key": "kb"}), "b")
    return both.select("a", "b", "cosine", overlap(F.split("ka", " "), F.split("kb", " ")).alias("jaccard"))


def similar_by_words(rows: DataFrame, least: float = 0.85) -> DataFrame:
    """``a, b, jaccard`` of rows (id, words: array) whose sets of words have a Jaccard similarity of ``least`` or more, every row by
    itself. As with terms, blocks of rows are compared where most rows would meet."""
    folder = shared_dir(rows.sparkSession)
    distinct = rows.select("id", F.array_distinct("words").alias("words")).where("id is not null").where(F.size("words") > 0)
    sets = materialise(distinct.withColumn("row", F.monotonically_increasing_id()), folder, "sets")
    tokens = sets.select("row", F.explode("words").alias("token"))
    placed = _by_rarity(tokens.withColumnRenamed("row", "id"))
    prefix = placed.where(F.col("place") <= F.col("k") - F.ceil(F.lit(least) * F.col("k") - 1e-9) + 1).select("id", "token")
    n = sets.count()
    if _pairs_cost_less(prefix, n):
        counted = sets.select("row", "id", F.size("words").alias("k"), F.explode("words").alias("token"))
        cell = F.struct("code", F.lit(1.0).alias("weight"))
        packed = blocks.blocks(blocks.coded(counted, folder).groupBy("row", "id", "k").agg(F.collect_list(cell).alias("cells")).drop("row"), n, folder, "cells")
        return blocks.crossed(packed, blocks.overlaps(least), dict(sets.dtypes)["id"]).withColumnRenamed("value", "jaccard")
    side = lambda p: sets.select(F.col("row").alias(p), F.col("id").alias(f"i{p}"), F.col("words").alias(f"w{p}"))
    both = _meeting(prefix).join(side("a"), "a").join(side("b"), "b").where("ia <> ib")
    return both.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), overlap(F.col("wa"), F.col("wb")).alias("jaccard")).where(F.col("jaccard") >= least)


def similar_by_edits(strings: DataFrame, least: float = 0.7) -> DataFrame:
    """``a, b, similarity`` of strings (id, value) with an edit similarity of ``least`` or more; ``least`` is 0.7 to 1.

    Strings are so short that most would meet by some pair of letters. So they are compared in blocks, length by length, by bits of their
    letters and pairs of letters, and the edit distance is taken of the few that can be near enough.
    """
    if not 0.7 <= least <= 1:
        raise ValueError("the threshold is 0.7 to 1")
    folder, kind = shared_dir(strings.sparkSession), dict(strings.dtypes)["id"]
    own = strings.where(T.present(F.col("value"))).select("id", "value", F.length("value").alias("n"))
    own = materialise(own.mapInArrow(blocks.masks, f"id {kind}, value string, n int, letters long, pairs long"), folder, "strings")
    packed = blocks.blocks(own, own.count(), folder, by="n")
    found = blocks.crossed(packed, blocks.near_strings(least), kind, ("value",))
    return found.select("a", "b", T.edit_similarity(F.col("a_value"), F.col("b_value")).alias("similarity")).where(F.col("similarity") >= least)


def classes(values: DataFrame, pairs: DataFrame) -> DataFrame:
    """``value, canonical``: each string with the first by name of its class under ``pairs`` (columns a, b of strings)."""
    labels = connected(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")), shared_dir(values.sparkSession), "classes")
    return values.join(labels, F.col("value") == F.col("node"), "left").select("value", F.coalesce("label", "value").alias("canonical"))


def _distinct(df: DataFrame, column: str) -> DataFrame:
    return df.where(T.present(F.col(column))).select(F.trim(column).alias("value")).distinct()


def disambiguate_journals(df: DataFrame, column: str, least: float = 0.85) -> DataFrame:
    """``value, canonical`` of journal names: equal keys with abbreviations spelled out, or words similar over ``least``."""
    names = _distinct(df, column).withColumn("key", T.journal_key(F.col("value")))
    same = names.groupBy("key").agg(F.min("value").alias("id"))
    equal = names.join(same, "key").where("value <> id").select(F.col("value").alias("a"), F.col("id").alias("b"))
    alike = similar_by_words(same.select("id", F.split("key", " ").alias("words")), least).where(F.col("jaccard") > least)
    return classes(names.select("value"), equal.unionByName(alike.select("a", "b")))


def canonical_institution(x: Column) -> Column:
    """An institution's name with its usual abbreviations spelled out and squeezed."""
    words = T.squeeze(F.regexp_replace(T.plain_letters(x), r"[.,;]+", " "))
    for short, long in (("univ", "University"), ("inst", "Institute"), ("natl", "National"), ("dept", "Department"), ("hosp", "Hospital"), ("coll", "College")):
        words = F.regexp_replace(words, rf"(?i)\b{short}\b", long)
    return words


def normalise_institutions(df: DataFrame, column: str, least: float = 0.85) -> DataFrame:
    """``value, canonical`` of institution names, similar over ``least`` by their words after spelling out."""
    names = _distinct(df, column).withColumn("key", F.lower(canonical_institution(F.col("value"))))
    same = names.groupBy("key").agg(F.min("value").alias("id"))
    equal = names.join(same, "key").where("value <> id").select(F.col("value").alias("a"), F.col("id").alias("b"))
    alike = similar_by_words(same.select("id", F.split("key", " ").alias("words")), least).where(F.col("jaccard") > least)
    return classes(names.select("value"), equal.unionByName(alike.select("a", "b")))


def institution_lookup(df: DataFrame, column: str, doc: str = "doc") -> DataFrame:
    """``canonical, papers, variants`` of the institutions of ``df`` (doc, column)."""
    named = df.join(normalise_institutions(df, column), F.trim(column) == F.col("value"))
    return named.groupBy("canonical").agg(F.count_distinct(doc).alias("papers"), F.count_distinct("value").alias("variants"))


def author_parts(x: Column) -> tuple[Column, Column]:
    """Last name (letters only, lower case) and the array of initials of "Last, First Middle" or "First Middle Last"."""
    plain = F.lower(T.plain_letters(T.squeeze(x)))
    comma = F.contains(plain, F.lit(","))
    last = F.when(comma, F.substring_index(plain, ",", 1)).otherwise(F.substring_index(plain, " ", -1))
    given = F.when(comma, F.substring_index(plain, ",", -1)).otherwise(F.rtrim(F.regexp_replace(plain, r"\S+$", "")))
    words = F.filter(F.split(F.regexp_replace(given, "[^a-z]+", " "), " "), lambda w: w != "")
    return F.regexp_replace(last, "[^a-z]", ""), F.array_distinct(F.transform(words, lambda w: F.substring(w, 1, 1)))


def name_score(last_a: Column, initials_a: Column, last_b: Column, initials_b: Column) -> Column:
    """0.6 of the last names' edit similarity (half as much under 0.7) and 0.4 of the initials' Jaccard similarity."""
    last = T.edit_similarity(last_a, last_b)
    return F.when(last < 0.7, 0.3 * last).otherwise(0.6 * last) + 0.4 * overlap(initials_a, initials_b)


def _author_groups(names: DataFrame) -> DataFrame:
    """``value, last, initials`` of names (column ``value``), initials in order; names without letters in the last name go."""
    last, initials = author_parts(F.col("value"))
    return names.select("value", last.alias("last"), F.array_sort(initials).alias("initials")).where("last <> ''")


def _alike_groups(parts: DataFrame, least: float) -> DataFrame:
    """``la, ia, lb, ib, score`` of groups (last name and initials) whose score is ``least`` or more, each pair once and each group with
    itself.

    Scores over 0.7 need last names alike to 0.7 and a common initial. So distinct last names meet by their letters, and groups by
    alike last names and an initial: a last name that very many bear has as many groups as it has different sets of initials.
    """
    groups = parts.select("last", "initials").distinct()
    lasts = groups.select(F.col("last").alias("id"), F.col("last").alias("value")).distinct()
    alike = similar_by_edits(lasts, 0.7).select("a", "b").unionByName(lasts.select(F.col("id").alias("a"), F.col("id").alias("b")))
    spread = groups.select("last", "initials", F.explode("initials").alias("i"))
    a = spread.select(F.col("last").alias("a"), F.col("initials").alias("ia"), "i")
    b = spread.select(F.col("last").alias("b"), F.col("initials").alias("ib"), "i")
    once = (F.col("a") != F.col("b")) | (F.array_join("ia", "") <= F.array_join("ib", ""))
    both = alike.join(a, "a").join(b, ["b", "i"]).where(once).select("a", "ia", "b", "ib").distinct()
    score = name_score(F.col("a"), F.col("ia"), F.col("b"), F.col("ib"))
    return both.select(F.col("a").alias("la"), "ia", F.col("b").alias("lb"), "ib", score.alias("score")).where(F.col("score") >= least)


def similar_authors(names: DataFrame, least: float = 0.85) -> DataFrame:
    """``a, b, score`` of author names (column ``value``) whose score is ``least`` or more, over 0.7.

    Names of one last name and initials are scored once, and only then made pairs of names, which are the result.
    """
    parts = _author_groups(names)
    own = lambda value, last, initials: parts.select(F.col("value").alias(value), F.col("last").alias(last), F.col("initials").alias(initials))
    met = _alike_groups(parts, least).join(own("x", "la", "ia"), ["la", "ia"]).join(own("y", "lb", "ib"), ["lb", "ib"])
    same = (F.col("la") == F.col("lb")) & (F.col("ia") == F.col("ib"))
    kept = met.where((~same & (F.col("x") != F.col("y"))) | (F.col("x") < F.col("y")))
    return kept.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "score").distinct()


def disambiguate_authors(df: DataFrame, column: str, least: float = 0.85) -> DataFrame:
    """``value, canonical`` of author names: classes of names with a score of ``least`` or more.

    Names of a group are linked to its first name and groups by their first names, so links grow with the names.
    """
    names = _distinct(df, column)
    parts = _author_groups(names)
    first = parts.groupBy("last", "initials").agg(F.min("value").alias("first"))
    alike = _alike_groups(parts, least)
    own = lambda name, last, initials: first.select(F.col("first").alias(name), F.col("last").alias(last), F.col("initials").alias(initials))
    between = alike.join(own("a", "la", "ia"), ["la", "ia"]).join(own("b", "lb", "ib"), ["lb", "ib"]).where("a <> b").select("a", "b")
    itself = alike.where((F.col("la") == F.col("lb")) & (F.col("ia") == F.col("ib"))).select(F.col("la").alias("last"), F.col("ia").alias("initials"))
    inside = parts.join(itself, ["last", "initials"]).join(first, ["last", "initials"]).where("value <> first").select(F.col("value").alias("a"), F.col("first").alias("b"))
    return classes(names, between.unionByName(inside))


def match_authors(left: DataFrame, right: DataFrame) -> DataFrame:
    """``a, b, score, how`` between two tables (name, orcid): 1 by equal ORCID, 0.95 for name scores over 0.9, else name
    scores over 0.7. A pair of names counts once, by its best."""
    one = left.select(F.trim("name").alias("a"), T.orcid(F.col("orcid")).alias("oa")).where("a <> ''").distinct()
    two = right.select(F.trim("name").alias("b"), T.orcid(F.col("orcid")).alias("ob")).where("b <> ''").distinct()
    by_id = one.join(two, F.col("oa") == F.col("ob")).select("a", "b", F.lit(1.0).alias("score"), F.lit("orcid").alias("how"))
    names = one.select(F.col("a").alias("value")).union(two.select("b")).distinct()
    scored = similar_authors(names, 0.7).where(F.col("score") > 0.7)
    scored = scored.unionByName(scored.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(names.select(F.col("value").alias("a"), F.col("value").alias("b"), F.lit(1.0).alias("score")))
    by_name = scored.join(one.select("a").distinct(), "a").join(two.select("b").distinct(), "b")
    by_name = by_name.select("a", "b", F.when(F.col("score") > 0.9, 0.95).otherwise(F.col("score")).alias("score"), F.lit("name").alias("how"))
    return by_id.unionByName(by_name).groupBy("a", "b").agg(F.max("score").alias("score"), F.max_by("how", "score").alias("how"))
