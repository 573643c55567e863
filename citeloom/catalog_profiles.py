"""Queries of profiles and text: similar and clustered countries, names found in texts, factorised topics, seasons.

Registered with those of ``catalog``, which imports this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query
from .catalog_models import _MONTHS, _months
from .functions.text import _ACCENTED, _PLAIN
from .operators import clusters, dictionary, factor, seasonal, series
from .plans.roles import Roles

_FEATURES = ["articles", "citations", "average", "single", "several"]
_SCORES = ", k AS (SELECT doc, count(*) AS k FROM countries GROUP BY doc), f AS (SELECT country, count(*) AS articles, sum(citations) AS citations, avg(citations) AS average, count(*) FILTER (k = 1) AS single, count(*) FILTER (k > 1) AS several FROM countries JOIN records USING (doc) JOIN k USING (doc) GROUP BY country), z AS (SELECT country, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}" for c in _FEATURES) + " FROM f)"


def _scores(r: Roles) -> DataFrame:
    return clusters.standardised(clusters.country_features(r.countries(), r.records()), "country", _FEATURES)


@query(_SCORES + "SELECT a.country AS a, b.country AS b, round(sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in _FEATURES) + "), 6) AS distance, round(1 / (1 + sqrt(" + " + ".join(f"(a.{c} - b.{c}) ** 2" for c in _FEATURES) + ")), 6) AS similarity FROM z a JOIN z b ON a.country < b.country")
def country_similarity(r: Roles) -> DataFrame:
    return clusters.distances(_scores(r), "country", _FEATURES)


@query()
def country_tree(r: Roles) -> DataFrame:
    """Complete linkage of all countries: every merge with its height."""
    return clusters.complete_linkage(clusters.distances(_scores(r), "country", _FEATURES))


@query()
def country_clusters(r: Roles) -> DataFrame:
    """Countries in three clusters, with their two first principal components."""
    scores = _scores(r)
    tree = clusters.complete_linkage(clusters.distances(scores, "country", _FEATURES))
    points, _ = clusters.principal_components(scores, "country", _FEATURES)
    return clusters.cut(tree, 3).withColumnRenamed("item", "country").join(points, "country")


def _words_sql(column: str) -> str:
    return f"list_filter(string_split(regexp_replace(upper(translate(coalesce({column}, ''), '{_ACCENTED}', '{_PLAIN}')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


@query(f""", bw AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark), al AS (SELECT words, min(target) AS target FROM (SELECT w[1:n] AS words, 'item ' || item_id || ', ' || n || ' words' AS target FROM bw, (VALUES (1), (2), (4)) v(n) WHERE len(w) >= n) GROUP BY words),
dw AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents), pl AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS place, unnest(w) AS word FROM dw),
gr AS (SELECT doc_id, place, [word] AS g FROM pl UNION ALL SELECT doc_id, place, [word, lead(word) OVER o] FROM pl WINDOW o AS (PARTITION BY doc_id ORDER BY place) UNION ALL SELECT doc_id, place, [word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o] FROM pl WINDOW o AS (PARTITION BY doc_id ORDER BY place)),
hi AS (SELECT doc_id, list({{'place': CAST(place AS INTEGER), 'less': -len(g), 'target': target}} ORDER BY place, -len(g)) AS h FROM gr JOIN al ON g = words GROUP BY doc_id),
tk AS (SELECT doc_id, h, 0 AS i, 0::BIGINT AS ends, false AS taken FROM hi UNION ALL SELECT doc_id, h, i + 1, CASE WHEN h[i + 1].place >= ends THEN h[i + 1].place - h[i + 1].less ELSE ends END, h[i + 1].place >= ends FROM tk WHERE i < len(h))
SELECT doc_id, h[i].place AS place, CAST(-h[i].less AS INTEGER) AS size, h[i].target AS target FROM tk WHERE taken""")
def phrases_in_documents(r: Roles) -> DataFrame:
    """Beginnings of benchmark items (one, two and four words, one inside the other) in every document, the longest from the left."""
    opening = r.table("benchmark").select("item_id", dictionary.words(F.col("text")).alias("w"), F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("n")).where(F.size("w") >= F.col("n"))
    target = F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(", "), F.col("n").cast("string"), F.lit(" words"))
    aliases = opening.select(F.array_join(F.slice("w", 1, F.col("n")), " ").alias("alias"), target.alias("target"))
    return dictionary.scan(r.table("documents"), ["doc_id"], "text", dictionary.table(aliases))


@query()
def keyword_topics(r: Roles) -> DataFrame:
    """Three topics of the keywords of all documents by non-negative factorisation."""
    _, terms, _ = factor.nmf(factor.tf_idf(r.keywords()), 3, 12)
    return factor.topic_terms(terms, 3, 6)


@query(_MONTHS + """
, p AS (SELECT doc_type, year, articles::DOUBLE AS y, row_number() OVER (PARTITION BY doc_type ORDER BY year) AS i, count(*) OVER (PARTITION BY doc_type) AS n FROM s), q AS (SELECT *, least(21, n) AS q FROM p), w AS (SELECT *, greatest(1, least(i - 10, n - q + 1)) AS lo FROM q),
j AS (SELECT w.doc_type, w.year, w.i, w.y, b.y AS v, (b.i - w.i)::DOUBLE AS u, abs(b.i - w.i) / greatest(w.i - lo, lo + q - 1 - w.i)::DOUBLE AS near FROM w JOIN p b ON b.doc_type = w.doc_type AND b.i BETWEEN lo AND lo + q - 1),
t AS (SELECT *, CASE WHEN near <= 0.001 THEN 1.0 WHEN near <= 0.999 THEN (1 - near ** 3) ** 3 ELSE 0.0 END AS k FROM j),
a AS (SELECT doc_type, year, any_value(y) AS y, sum(k) AS w, sum(k * u) AS u, sum(k * v) AS v, sum(k * u * u) AS uu, sum(k * u * v) AS uv FROM t GROUP BY ALL)
SELECT doc_type, year, y AS articles, round((v * uu - u * uv) / (w * uu - u * u), 6) AS smooth FROM a""")
def monthly_loess(r: Roles) -> DataFrame:
    return seasonal.loess(_months(r), ["doc_type"], 21)


@query()
def monthly_seasons(r: Roles) -> DataFrame:
    """Trend, season and remainder of the documents of a month by type."""
    return seasonal.decompose(_months(r), ["doc_type"], outer=1)


@query()
def daily_event_seasons(r: Roles) -> DataFrame:
    """The same of the events of a day by type, by the week."""
    day = F.datediff(F.to_date("ts"), F.to_date(F.lit("2000-01-01")))
    counted = r.table("events").groupBy("event_type", day.alias("year")).agg(F.count("*").alias("articles"))
    return seasonal.decompose(counted, ["event_type"], 7, 9, 15)


@query(_MONTHS + """
, c AS (SELECT doc_type, articles - avg(articles) OVER (PARTITION BY doc_type) AS y, row_number() OVER (PARTITION BY doc_type ORDER BY year) - 1 AS t, count(*) OVER (PARTITION BY doc_type) AS n FROM s),
w AS (SELECT doc_type, n, k, sum(y * cos(2 * pi() * k * t / n)) ** 2 + sum(y * sin(2 * pi() * k * t / n)) ** 2 AS p FROM c, range(1, 1000) r(k) WHERE k <= (n - 1) // 2 GROUP BY ALL)
SELECT doc_type, n, count(*) AS m, CAST(arg_max(k, round(p, 9)) AS INTEGER) AS harmonic, round(max(p) / sum(p), 6) AS g FROM w GROUP BY doc_type, n""")
def monthly_hidden_periods(r: Roles) -> DataFrame:
    out = series.fisher_g(_months(r), ["doc_type"])
    return out.select("doc_type", "n", F.floor((F.col("n") - 1) / 2).alias("m"), "harmonic", "g")


@query(r"""
, tx AS (SELECT p_partkey, 'Dept. of ' || p_type || ', ' || CASE WHEN p_partkey % 3 = 0 THEN 'c/o ' || p_brand || ' and ' ELSE '' END || upper(p_brand) || ' (' || p_name || ')' AS x, p_brand FROM part)
SELECT p_partkey, p_brand AS ror, CAST(len(list_filter(string_split(regexp_replace(split_part(upper(x), upper(p_brand), 1), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')) + 1 AS INTEGER) AS place, 2 AS size FROM tx""")
def organisations_of_parts(r: Roles) -> DataFrame:
    """Brands as organisations, found in addresses made of a part's type, brand and name."""
    part = r.table("part")
    twice = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("c/o "), "p_brand", F.lit(" and "))).otherwise("")
    text = F.concat(F.lit("Dept. of "), "p_type", F.lit(", "), twice, F.upper("p_brand"), F.lit(" ("), "p_name", F.lit(")"))
    names = part.select(F.col("p_brand").alias("ror"), F.col("p_brand").alias("alias")).distinct()
    return dictionary.match_organisations(part.withColumn("address", text), ["p_partkey"], "address", names)
