"""Further queries: matching, adjustment, institutions, fitted models, the star schema, merging and text functions.

Registered with those of ``catalog``, which imports this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _EDGES, _LEDGER, _PAIRS, _PANEL, _SERIES, _ledger, _panel, _series, query
from .functions import stats
from .functions import text as T
from .operators import adjust, countries, dedup, descriptive, fits, hypotheses, institutions, matching, networks, organise, screening, series, topics, venues
from .plans.roles import Roles

# Adjusted records


@query(", m AS (SELECT max(year) AS last FROM records) SELECT doc, citations, round(citations / greatest(last - year + 1, 1), 6) AS normalised FROM records, m")
def citations_per_year_of_age(r: Roles) -> DataFrame:
    return adjust.normalise_citations(r.records()).select("doc", "citations", "normalised")


@query("SELECT doc, citations, round(ln(citations + 1), 6) AS normalised FROM records")
def citations_logged(r: Roles) -> DataFrame:
    return adjust.normalise_citations(r.records(), "log").select("doc", "citations", "normalised")


@query("SELECT doc, citations, rank() OVER (ORDER BY citations) + (count(*) OVER (PARTITION BY citations) - 1) / 2.0 AS normalised FROM records")
def citations_ranked(r: Roles) -> DataFrame:
    return adjust.normalise_citations(r.records(), "rank").select("doc", "citations", "normalised")


@query(", q AS (SELECT quantile_cont(citations, 0.75) AS q3, quantile_cont(citations, 0.25) AS q1 FROM records) SELECT doc, citations FROM records, q WHERE citations <= q3 + 1.5 * (q3 - q1)")
def citations_without_outliers(r: Roles) -> DataFrame:
    return adjust.remove_citation_outliers(r.records(), threshold=1.5).select("doc", "citations")


@query(", q AS (SELECT avg(citations) AS m, stddev_samp(citations) AS s FROM records) SELECT doc, citations FROM records, q WHERE abs(citations - m) <= 2 * s")
def citations_without_far_values(r: Roles) -> DataFrame:
    return adjust.remove_citation_outliers(r.records(), "z", 2.0).select("doc", "citations")


def _yearless(r: Roles) -> DataFrame:
    return r.records().withColumn("year", F.when(F.col("doc") % 7 != 0, F.col("year")))


@query(", y AS (SELECT doc, CASE WHEN doc % 7 <> 0 THEN year END AS year FROM records) SELECT doc, coalesce(year, (SELECT CAST(floor(median(year)) AS INTEGER) FROM y)) AS year FROM y")
def years_by_median(r: Roles) -> DataFrame:
    return adjust.impute_years(_yearless(r)).select("doc", "year")


@query(", y AS (SELECT doc, CASE WHEN doc % 7 <> 0 THEN year END AS year FROM records), c AS (SELECT year, count(*) AS n FROM y WHERE year IS NOT NULL GROUP BY year) SELECT doc, coalesce(year, (SELECT year FROM c ORDER BY n DESC, year LIMIT 1)) AS year FROM y")
def years_by_mode(r: Roles) -> DataFrame:
    return adjust.impute_years(_yearless(r), "mode").select("doc", "year")


@query(_PANEL + """
, p AS (SELECT n_name AS country, count(*) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), j AS (SELECT country, articles, people, CAST(articles * 1000.0 / people AS DOUBLE) AS v FROM totals JOIN p USING (country))
SELECT country, articles, people, round(v, 6) AS articles_per_people, rank() OVER (ORDER BY round(v, 9) DESC) AS rank_articles_per_people FROM j""")
def country_output_per_head(r: Roles) -> DataFrame:
    customers, nations = r.table("customer"), r.table("nation")
    people = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.lower("n_name").alias("country")).agg(F.count("*").alias("people"))
    matched = adjust.match_indicators(countries.summary(_panel(r)).select("country", "articles"), people)
    return adjust.per_indicator(matched, "articles", "people", 1000.0)


# Institutions: brands, of the country of the supplier, in the sector of the part's type

_INSTITUTIONS = ", aff AS (SELECT doc, p_brand AS institution, country, string_split(p_type, ' ')[1] AS sector FROM lines JOIN nations ON l_suppkey = author), own AS (SELECT doc, institution, min(country) AS country, min(sector) AS sector FROM aff WHERE institution IS NOT NULL GROUP BY doc, institution)"


def _affiliations(r: Roles) -> DataFrame:
    part = r.table("part").select("p_partkey", F.col("p_brand").alias("institution"), F.get(F.split("p_type", " "), F.lit(0)).alias("sector"))
    line = r.table("lineitem").select(F.col("l_orderkey").alias("doc"), "l_partkey", F.col("l_suppkey").alias("author"))
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(r.nations(), "author").select("doc", "institution", "country", "sector")


_PRODUCTION = _INSTITUTIONS + """
, k AS (SELECT doc, count(*) AS k FROM own GROUP BY doc), t AS (SELECT institution, count(*) AS documents, sum(1.0 / k) AS fractional, CAST(sum(citations) AS BIGINT) AS citations, avg(citations) AS mean_citations, min(year) AS first_year, max(year) AS last_year FROM own JOIN k USING (doc) JOIN records USING (doc) GROUP BY institution),
uc AS (SELECT institution, country FROM (SELECT institution, country, row_number() OVER (PARTITION BY institution ORDER BY count(*) DESC, country) AS p FROM own GROUP BY institution, country) WHERE p = 1), us AS (SELECT institution, sector FROM (SELECT institution, sector, row_number() OVER (PARTITION BY institution ORDER BY count(*) DESC, sector) AS p FROM own GROUP BY institution, sector) WHERE p = 1)"""


@query(_PRODUCTION + " SELECT institution, documents, round(fractional, 6) AS fractional, citations, round(mean_citations, 6) AS mean_citations, first_year, last_year, country, sector FROM t JOIN uc USING (institution) JOIN us USING (institution)")
def institution_production(r: Roles) -> DataFrame:
    return institutions.production(_affiliations(r), r.records())


@query(_PRODUCTION + """
, k2 AS (SELECT institution, documents, citations, mean_citations, rank() OVER (ORDER BY documents DESC) AS rank_documents, rank() OVER (ORDER BY citations DESC) AS rank_citations, rank() OVER (ORDER BY round(mean_citations, 9) DESC) AS rank_mean_citations FROM t),
s AS (SELECT *, (rank_documents + rank_citations + rank_mean_citations) / 3 AS mean_rank FROM k2)
SELECT institution, documents, citations, round(mean_citations, 6) AS mean_citations, rank_documents, rank_citations, rank_mean_citations, round(mean_rank, 6) AS mean_rank, row_number() OVER (ORDER BY mean_rank, institution) AS place FROM s""")
def institution_ranking(r: Roles) -> DataFrame:
    return institutions.ranking(institutions.production(_affiliations(r), r.records()))


@query(_INSTITUTIONS + """
, d AS (SELECT DISTINCT doc, sector FROM own WHERE sector IS NOT NULL), a AS (SELECT count(DISTINCT doc) AS every FROM own WHERE sector IS NOT NULL), n AS (SELECT sector, count(DISTINCT institution) AS institutions FROM own WHERE sector IS NOT NULL GROUP BY sector)
SELECT sector, count(*) AS documents, CAST(sum(citations) AS BIGINT) AS citations, round(avg(citations), 6) AS mean_citations, any_value(institutions) AS institutions, round(count(*) / any_value(every), 6) AS share FROM d JOIN records USING (doc) JOIN n USING (sector), a GROUP BY sector""")
def institution_sectors(r: Roles) -> DataFrame:
    return institutions.sectors(_affiliations(r), r.records())


@query(_INSTITUTIONS + """
, c AS (SELECT country, institution, count(*) AS n, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, institution) AS p FROM own GROUP BY country, institution), t AS (SELECT country, count(DISTINCT institution) AS institutions, count(DISTINCT doc) AS documents FROM own GROUP BY country)
SELECT country, institutions, documents, institution AS leader, n AS leader_documents FROM t JOIN c USING (country) WHERE p = 1""")
def institution_geography(r: Roles) -> DataFrame:
    return institutions.geography(_affiliations(r))


@query(_INSTITUTIONS + """
, n AS (SELECT institution, count(*) AS n FROM own GROUP BY institution), p AS (SELECT a.institution AS a, b.institution AS b, count(*) AS weight FROM own a JOIN own b USING (doc) WHERE a.institution < b.institution GROUP BY ALL)
SELECT a, b, weight, x.n AS total_a, y.n AS total_b, round(weight / sqrt(x.n * CAST(y.n AS DOUBLE)), 6) AS salton, round(weight / (x.n + y.n - weight), 6) AS jaccard, round(weight / x.n, 6) AS affinity_a, round(weight / y.n, 6) AS affinity_b FROM p JOIN n x ON x.institution = a JOIN n y ON y.institution = b""")
def institution_collaboration(r: Roles) -> DataFrame:
    return institutions.collaboration(_affiliations(r))


@query(_INSTITUTIONS + """
, k AS (SELECT doc, count(*) AS k FROM own GROUP BY doc), p AS (SELECT a.institution, count(DISTINCT b.institution) AS partners FROM own a JOIN own b USING (doc) WHERE a.institution <> b.institution GROUP BY a.institution)
SELECT institution, count(*) AS documents, count(*) FILTER (k > 1) AS joint, round(count(*) FILTER (k > 1) / count(*), 6) AS rate, coalesce(any_value(partners), 0) AS partners FROM own JOIN k USING (doc) LEFT JOIN p USING (institution) GROUP BY institution""")
def institution_collaboration_rate(r: Roles) -> DataFrame:
    return institutions.collaboration_rate(_affiliations(r))


# Fitted models

_FITTED = _SERIES + """
, o AS (SELECT *, lag(articles) OVER (PARTITION BY doc_type ORDER BY year) AS y1, count(*) OVER (PARTITION BY doc_type) AS years FROM s), o4 AS (SELECT * FROM o WHERE years >= 4),
q AS (SELECT doc_type, avg(articles) AS mean, arg_min(articles, year) AS first, arg_max(articles, year) AS last, max(year) AS last_year, (arg_max(articles, year) - arg_min(articles, year)) / (count(*) - 1) AS step, regr_slope(articles, year) AS b, regr_intercept(articles, year) AS a,
      regr_slope(articles, y1) AS phi, regr_intercept(articles, y1) AS c FROM o4 GROUP BY doc_type),
f AS (SELECT doc_type, articles AS y, 'mean' AS model, 1 AS k, mean AS fit FROM o4 JOIN q USING (doc_type) UNION ALL SELECT doc_type, articles, 'naive', 0, y1 FROM o4 UNION ALL SELECT doc_type, articles, 'drift', 1, y1 + step FROM o4 JOIN q USING (doc_type)
      UNION ALL SELECT doc_type, articles, 'linear', 2, a + b * year FROM o4 JOIN q USING (doc_type) UNION ALL SELECT doc_type, articles, 'ar1', 2, c + phi * y1 FROM o4 JOIN q USING (doc_type)),
g AS (SELECT doc_type, model, k, count(*) AS n, sum((y - fit) * (y - fit)) AS sse, avg(abs(y - fit)) AS mae, avg(abs((y - fit) / y)) FILTER (y <> 0) AS mape FROM f WHERE fit IS NOT NULL GROUP BY ALL),
h AS (SELECT *, sqrt(sse / n) AS rmse, CASE WHEN sse > 1e-9 THEN n * ln(sse / n) + 2 * k END AS aic FROM g)"""


@query(_FITTED + " SELECT doc_type, model, n, k, round(sse, 6) AS sse, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(mape, 6) AS mape, round(aic, 6) AS aic FROM h")
def series_models(r: Roles) -> DataFrame:
    return fits.one_step_models(_series(r), ["doc_type"])


@query(_FITTED + """
, r AS (SELECT *, rank() OVER (PARTITION BY doc_type ORDER BY round(aic, 9) NULLS LAST) AS rank_aic, rank() OVER (PARTITION BY doc_type ORDER BY round(rmse, 9) NULLS LAST) AS rank_rmse, rank() OVER (PARTITION BY doc_type ORDER BY round(mape, 9) NULLS LAST) AS rank_mape FROM h), z AS (SELECT *, (rank_aic + rank_rmse + rank_mape) / 3 AS score FROM r)
SELECT doc_type, model, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_type ORDER BY score, model) AS place FROM z""")
def series_model_table(r: Roles) -> DataFrame:
    return fits.model_table(_series(r), ["doc_type"]).select("doc_type", "model", "score", "place")


@query(_FITTED + """
, w AS (SELECT doc_type, model, rmse, CASE WHEN aic IS NOT NULL THEN exp((min(aic) OVER (PARTITION BY doc_type) - aic) / 2) END AS w FROM h), v AS (SELECT *, w / sum(w) OVER (PARTITION BY doc_type) AS weight FROM w),
p AS (SELECT doc_type, t, last_year + t AS year, unnest([{'model': 'mean', 'x': mean}, {'model': 'naive', 'x': CAST(last AS DOUBLE)}, {'model': 'drift', 'x': last + t * step}, {'model': 'linear', 'x': a + b * (last_year + t)},
      {'model': 'ar1', 'x': (CASE WHEN abs(phi - 1) < 1e-12 THEN c * t ELSE c * (1 - pow(phi, t)) / (1 - phi) END) + pow(phi, t) * last}]) AS m FROM q, range(1, 6) u(t)),
j AS (SELECT p.doc_type, p.t, p.year, m.model AS model, m.x AS forecast, rmse, weight FROM p JOIN v ON v.doc_type = p.doc_type AND v.model = m.model),
e AS (SELECT doc_type, t, year, 'ensemble' AS model, sum(weight * forecast) AS forecast, sum(weight * rmse) AS rmse FROM j WHERE weight IS NOT NULL GROUP BY doc_type, t, year), u AS (SELECT doc_type, t, year, model, forecast, rmse FROM j UNION ALL SELECT doc_type, t, year, model, forecast, rmse FROM e)
SELECT doc_type, model, CAST(year AS INTEGER) AS year, round(forecast, 6) AS forecast, round(forecast - 1.2815515655446004 * rmse * sqrt(t), 6) AS low80, round(forecast + 1.2815515655446004 * rmse * sqrt(t), 6) AS high80, round(forecast - 1.959963984540054 * rmse * sqrt(t), 6) AS low95, round(forecast + 1.959963984540054 * rmse * sqrt(t), 6) AS high95 FROM u""")
def series_forecasts(r: Roles) -> DataFrame:
    return fits.forecasts(_series(r), ["doc_type"])


@query(_SERIES + """
, a AS (SELECT s.doc_type, s.year, s.articles AS y, count(*) AS n, arg_max(b.articles, b.year) AS last, arg_min(b.articles, b.year) AS first, avg(b.articles) AS m, avg(b.year) AS x, regr_slope(b.articles, b.year) AS slope FROM s JOIN s b ON s.doc_type = b.doc_type AND b.year < s.year GROUP BY ALL HAVING count(*) >= 4),
f AS (SELECT doc_type, y, 'naive' AS model, CAST(last AS DOUBLE) AS f FROM a UNION ALL SELECT doc_type, y, 'drift', last + (last - first) / (n - 1) FROM a UNION ALL SELECT doc_type, y, 'mean', m FROM a UNION ALL SELECT doc_type, y, 'linear', m + slope * (year - x) FROM a)
SELECT doc_type, model, count(*) AS folds, round(avg(abs(y - f)), 6) AS mae, round(sqrt(avg((y - f) * (y - f))), 6) AS rmse, round(avg(abs((y - f) / y)) FILTER (y <> 0), 6) AS mape FROM f GROUP BY doc_type, model""")
def series_expanding_errors(r: Roles) -> DataFrame:
    return fits.expanding_errors(_series(r), ["doc_type"])


@query(_SERIES + """
, g AS (SELECT pow(10, k / 4.0) AS penalty FROM range(-8, 17) u(k)),
t AS (SELECT h.doc_type, h.fold, penalty, n, mx, my, sxy / (sxx + penalty) AS b FROM (SELECT s.doc_type, f.fold, count(*) AS n, avg(year) AS mx, avg(articles) AS my, regr_sxx(articles, year) AS sxx, regr_sxy(articles, year) AS sxy FROM s JOIN (SELECT DISTINCT doc_type, year % 5 AS fold FROM s) f ON s.doc_type = f.doc_type AND s.year % 5 <> f.fold GROUP BY ALL HAVING count(*) >= 2) h, g),
e AS (SELECT t.doc_type, penalty, avg((s.articles - my - b * (s.year - mx)) * (s.articles - my - b * (s.year - mx))) AS cv FROM t JOIN s ON s.doc_type = t.doc_type AND s.year % 5 = t.fold GROUP BY ALL), c AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY round(cv, 6), penalty) AS p FROM e),
z AS (SELECT doc_type, avg(year) AS mx, avg(articles) AS my, regr_sxx(articles, year) AS sxx, regr_sxy(articles, year) AS sxy FROM s GROUP BY doc_type)
SELECT doc_type, round(penalty, 6) AS penalty, round(sxy / (sxx + penalty), 6) AS slope, round(my - sxy / (sxx + penalty) * mx, 6) AS intercept, round(cv, 6) AS cv_error FROM c JOIN z USING (doc_type) WHERE p = 1""")
def series_ridge(r: Roles) -> DataFrame:
    return fits.ridge(_series(r), ["doc_type"])


@query("""
, v AS (SELECT CAST(citations AS DOUBLE) AS x FROM records WHERE citations > 0), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, sum(x) AS s, sum(ln(x)) AS l, stddev_pop(ln(x)) AS sd, min(x) AS m FROM v), hx AS (SELECT x, count(*) AS c FROM v GROUP BY x),
w AS (SELECT i / 100.0 AS shape, (SELECT sum(c * pow(x, i / 100.0)) FROM hx) AS p FROM range(5, 505) u(i)), b AS (SELECT arg_max(shape, ll) AS shape, arg_max(p, ll) AS p, max(ll) AS ll FROM (SELECT shape, p, n * ln(shape) - n * ln(p / n) + (shape - 1) * l - n AS ll FROM w, s)),
m AS (SELECT 'exponential' AS model, n, n / s AS first, NULL AS second, n * ln(n / s) - n AS ll, 1 AS k FROM s UNION ALL SELECT 'log_normal', n, l / n, sd, -l - n * ln(sd * sqrt(2 * pi())) - n / 2, 2 FROM s
      UNION ALL SELECT 'power_law', n, 1 + n / (l - n * ln(m)), m, n * ln(n / (l - n * ln(m)) / m) - (1 + n / (l - n * ln(m))) * (l - n * ln(m)), 1 FROM s UNION ALL SELECT 'weibull', n, shape, pow(p / n, 1 / shape), ll, 2 FROM b, s),
a AS (SELECT *, 2 * k - 2 * ll AS aic FROM m), e AS (SELECT *, exp((min(aic) OVER () - aic) / 2) AS w FROM a)
SELECT model, CAST(n AS BIGINT) AS n, round(first, 6) AS first, round(second, 6) AS second, round(ll, 6) AS log_likelihood, round(aic, 6) AS aic, round(w / sum(w) OVER (), 6) AS weight FROM e""")
def citation_distributions(r: Roles) -> DataFrame:
    return fits.citation_distributions(r.records())


@query(_PANEL + """
, t AS (SELECT country, CAST(year - min(year) OVER w + 1 AS DOUBLE) AS t, articles AS y, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY country)),
l AS (SELECT country, 'linear' AS model, t AS x, CAST(y AS DOUBLE) AS y FROM t WHERE n >= 3 UNION ALL SELECT country, 'exponential', t, ln(y) FROM t WHERE n >= 3 UNION ALL SELECT country, 'logarithmic', ln(t), y FROM t WHERE n >= 3 UNION ALL SELECT country, 'power', ln(t), ln(y) FROM t WHERE n >= 3),
f AS (SELECT country, model, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2, count(*) AS points FROM l GROUP BY ALL)
SELECT country, model, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, points, row_number() OVER (PARTITION BY country ORDER BY round(r2, 9) DESC NULLS LAST, model) = 1 AS best FROM f""")
def country_growth_models(r: Roles) -> DataFrame:
    return fits.growth_models(_panel(r), "country")


@query(_PANEL + """
, v AS (SELECT 'articles' AS variable, CAST(articles AS DOUBLE) AS x FROM totals UNION ALL SELECT 'citations', citations FROM totals), b AS (SELECT variable, count(*) AS n, avg(x) AS mean, median(x) AS median, stddev_samp(x) AS sd FROM v GROUP BY variable)
SELECT variable, any_value(n) AS n, round(any_value(mean), 6) AS mean, round(any_value(median), 6) AS median, round(any_value(sd), 6) AS sd, round(any_value(sd / mean), 6) AS cv, round(avg(pow((x - mean) / sd, 3)), 6) AS skewness, round(avg(pow((x - mean) / sd, 4)) - 3, 6) AS kurtosis FROM v JOIN b USING (variable) GROUP BY variable""")
def country_moments(r: Roles) -> DataFrame:
    return fits.moments(countries.summary(_panel(r)), ["articles", "citations"])


@query(_PANEL + """
, x AS (SELECT country, CAST(articles AS DOUBLE) AS x, articles - avg(articles) OVER () AS d, count(*) OVER () AS n, avg(articles) OVER () AS m, stddev_pop(articles) OVER () AS s FROM totals), g AS (SELECT a.country AS a, b.country AS b FROM regions a JOIN regions b USING (region) WHERE a.country <> b.country),
o AS (SELECT a AS country, count(*) AS w, sum(d) AS wd, sum(x) AS wx FROM g JOIN x ON x.country = b GROUP BY a), j AS (SELECT country, x, d, n, m, s, coalesce(w, 0) AS w, coalesce(wd, 0) AS wd, coalesce(wx, 0) AS wx FROM x LEFT JOIN o USING (country))
SELECT country, round(d * wd / (s * s), 6) AS moran, round((wx + x - m * (w + 1)) / (s * sqrt((n * (w + 1) - (w + 1) * (w + 1)) / (n - 1))), 6) AS g_star, (CASE WHEN d >= 0 THEN 'high' ELSE 'low' END) || '-' || (CASE WHEN wd >= 0 THEN 'high' ELSE 'low' END) AS quadrant FROM j""")
def country_local_statistics(r: Roles) -> DataFrame:
    values = countries.summary(_panel(r)).select("country", F.col("articles").alias("x"))
    return countries.local_statistics(values, countries.region_weights(r.regions()))


@query(_PANEL + _PAIRS + ", g AS (SELECT ln(x.articles) + ln(y.articles) AS x, ln(weight) AS y FROM pairs JOIN totals x ON x.country = a JOIN totals y ON y.country = b) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS points FROM g")
def country_gravity(r: Roles) -> DataFrame:
    return countries.gravity(countries.collaboration(r.countries()), countries.summary(_panel(r)))


@query(_EDGES + """
, tr AS (SELECT x.node, count(*) / 2 AS t FROM w x JOIN w y ON x.node = y.node JOIN w z ON x.other = z.node AND y.other = z.other WHERE x.other <> y.other GROUP BY x.node), cl AS (SELECT avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) AS c, count(*) AS n, avg(degree) AS k FROM d LEFT JOIN tr USING (node)),
r(s, n, h) AS (SELECT node, node, 0 FROM d UNION SELECT s, other, h + 1 FROM r JOIN w ON n = node WHERE h < 12), m AS (SELECT s, n, min(h) AS h FROM r GROUP BY ALL), f AS (SELECT avg(h) AS l FROM m WHERE h > 0)
SELECT n AS nodes, round(k, 6) AS mean_degree, round(c, 6) AS mean_clustering, round(l, 6) AS mean_distance, round(k / n, 6) AS random_clustering, round(ln(n) / ln(k), 6) AS random_distance, round((c / (k / n)) / (l / (ln(n) / ln(k))), 6) AS sigma FROM cl, f""")
def keyword_small_world(r: Roles) -> DataFrame:
    return countries.small_world(networks.cooccurrence(r.keywords(), "keyword"))


# Series, sources, topics

@query(_SERIES + """
, c AS (SELECT *, articles - avg(articles) OVER p AS d, stddev_samp(articles) OVER p AS sd, count(*) OVER p AS n FROM s WINDOW p AS (PARTITION BY doc_type)), u AS (SELECT doc_type, year, CASE WHEN sd > 0 THEN abs(sum(d) OVER (PARTITION BY doc_type ORDER BY year)) / (sd * sqrt(n)) ELSE 0 END AS u FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY round(u, 9) DESC, year) AS p, max(u) OVER (PARTITION BY doc_type) AS m FROM u) SELECT doc_type, year, round(m, 6) AS statistic FROM k WHERE p = 1""")
def series_cusum(r: Roles) -> DataFrame:
    return series.cusum(_series(r), ["doc_type"])


@query("""
, s AS (SELECT source, count(*) AS tp FROM records WHERE source IS NOT NULL GROUP BY source), o AS (SELECT *, row_number() OVER (ORDER BY tp, source) AS i, row_number() OVER (ORDER BY tp DESC, source) AS p FROM s), t AS (SELECT count(*) AS n, sum(tp) AS t, sum(tp * i) AS ti, sum(CAST(tp AS DOUBLE) * tp) AS q, sum(tp * log2(tp)) AS l, sum(tp * ln(tp)) AS e, sum(tp) FILTER (p <= 5) AS t5, sum(tp) FILTER (p <= 10) AS t10 FROM o)
SELECT n, CAST(t AS DOUBLE) AS total, round(2 * ti / (n * t) - (n + 1) / n, 6) AS gini, round(q / (CAST(t AS DOUBLE) * t), 6) AS hhi, round(log2(t) - l / t, 6) AS entropy, round((log2(t) - l / t) / log2(n), 6) AS evenness, round(e / t - ln(t / n), 6) AS theil, round(t5 / t, 6) AS top5, round(t10 / t, 6) AS top10 FROM t""")
def source_concentration(r: Roles) -> DataFrame:
    return venues.source_concentration(venues.summary(r.records()))


@query(", k AS (SELECT doc, count(*) AS n FROM authors GROUP BY doc) SELECT doc, author, n AS n_items, round(1.0 / n, 6) AS weight FROM authors JOIN k USING (doc)")
def author_weights(r: Roles) -> DataFrame:
    return descriptive.weighted(r.authors())


@query("SELECT citations, count(*) AS rows FROM records GROUP BY citations")
def citation_histogram(r: Roles) -> DataFrame:
    return descriptive.value_histogram(r.records(), "citations")


_VOCABULARY = ", c AS (SELECT year, keyword, count(*) AS n FROM keywords JOIN records USING (doc) WHERE length(keyword) >= 3 GROUP BY ALL), y AS (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, keyword) AS INTEGER) AS place FROM c), v AS (SELECT * FROM y WHERE place <= 12)"


def _vocabulary(r: Roles) -> DataFrame:
    return topics.yearly_vocabulary(r.keywords(), r.records(), 12)


@query(_VOCABULARY + " SELECT year, keyword, n, place FROM v")
def yearly_vocabulary(r: Roles) -> DataFrame:
    return _vocabulary(r)


@query(_VOCABULARY + """
, s AS (SELECT *, n / sum(n) OVER (PARTITION BY year) AS share FROM v), e AS (SELECT keyword, min(year) AS first_year, max(year) AS last_year, arg_min(share, year) AS a, arg_max(share, year) AS b FROM s GROUP BY keyword), t AS (SELECT *, (b - a) / a AS strength FROM e)
SELECT keyword, first_year, last_year, round(a, 6) AS first_share, round(b, 6) AS last_share, round(strength, 6) AS strength, CASE WHEN strength > 0 THEN 'rising' WHEN strength < 0 THEN 'falling' ELSE 'stable' END AS direction, strength > 0.5 AS emerging FROM t""")
def topic_trends(r: Roles) -> DataFrame:
    return topics.topic_trends(_vocabulary(r))


@query(_VOCABULARY + """
, j AS (SELECT coalesce(a.year, b.year + 1) AS year, a.keyword AS new, b.keyword AS old FROM v a FULL JOIN v b ON a.keyword = b.keyword AND a.year = b.year + 1),
g AS (SELECT year, count(new) AS keywords, count(old) FILTER (new IS NOT NULL) AS kept, count(new) FILTER (old IS NULL) AS came, count(old) FILTER (new IS NULL) AS went FROM j GROUP BY year)
SELECT *, round(CASE WHEN kept + went > 0 THEN kept / (kept + went) END, 6) AS retention FROM g WHERE keywords > 0""")
def keyword_retention(r: Roles) -> DataFrame:
    return topics.retention(_vocabulary(r))


# Screening

@query(_LEDGER + " SELECT doc, 'screening' AS stage, max(decision) FILTER (reviewer = 'r1') AS r1, max(decision) FILTER (reviewer = 'r2') AS r2 FROM l GROUP BY doc")
def screening_matrix(r: Roles) -> DataFrame:
    return screening.decision_matrix(screening.standardise(_ledger(r)), ["r1", "r2"])


@query(_LEDGER + " SELECT 'screening' AS stage, CAST(sum(CASE WHEN i = x THEN 1 ELSE 0 END) AS BIGINT) AS unresolved, round(avg(CASE WHEN i = x THEN 1.0 ELSE 0.0 END), 6) AS share FROM v")
def screening_unresolved(r: Roles) -> DataFrame:
    return screening.unresolved(screening.consensus(screening.standardise(_ledger(r))))


@query("SELECT doc_id AS doc, stage, reviewer, 'pending' AS decision, CAST(NULL AS VARCHAR) AS reason, false AS is_final FROM documents, (VALUES ('screening'), ('eligibility')) s(stage), (VALUES ('r1'), ('r2')) v(reviewer)")
def screening_template(r: Roles) -> DataFrame:
    return screening.template(r.table("documents").select(F.col("doc_id").alias("doc")), ["r1", "r2"], ["screening", "eligibility"])


# Corrections for many tests: the trend of every country

@query(_PANEL + """
, p AS (SELECT a.country, sum(sign(b.articles - a.articles)) AS s FROM panel a JOIN panel b ON a.country = b.country AND a.year < b.year GROUP BY a.country), t AS (SELECT country, abs(s) / 100.0 AS raw FROM p), v AS (SELECT country, 1 / (1 + raw) AS p_value FROM t),
o AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p_value, country) AS r FROM v)
SELECT country, round(p_value, 6) AS p_value, round(least(1, min(p_value * m / r) OVER (ORDER BY p_value DESC, r DESC)), 6) AS p_bh, round(least(1, max(p_value * (m - r + 1)) OVER (ORDER BY p_value, r)), 6) AS p_holm, round(least(1, p_value * m), 6) AS p_bonferroni FROM o""")
def corrected_tests(r: Roles) -> DataFrame:
    tested = series.mann_kendall(_panel(r).select("country", "year", "articles"), ["country"])
    table = tested.select("country", (1 / (1 + F.abs("s") / 100.0)).alias("p_value")).repartition(1).sortWithinPartitions("p_value", "country")
    return stats.benjamini_hochberg(table)


@query("""
, k AS (SELECT doc, count(*) > 1 AS m FROM countries GROUP BY doc), v AS (SELECT citations AS x, m FROM k JOIN records USING (doc)), s AS (SELECT count(x) FILTER (m) AS n1, avg(x) FILTER (m) AS m1, var_samp(x) FILTER (m) AS v1, count(x) FILTER (NOT m) AS n2, avg(x) FILTER (NOT m) AS m2, var_samp(x) FILTER (NOT m) AS v2 FROM v),
d AS (SELECT n1, n2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM s) SELECT n1, n2, round(d, 6) AS d, CASE WHEN abs(d) < 0.2 THEN 'negligible' WHEN abs(d) < 0.5 THEN 'small' WHEN abs(d) < 0.8 THEN 'medium' ELSE 'large' END AS size FROM d""")
def citation_effect_size(r: Roles) -> DataFrame:
    multi = r.countries().groupBy("doc").agg((F.count("*") > 1).alias("multi")).join(r.records(), "doc")
    return stats.cohens_d(multi, "citations", F.col("multi"))


# Text functions over whole columns

@query("SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:\\s*', ''), '\\s+', '', 'g'), '[.;,]+$', ''), '') AS doi_key FROM pages")
def page_doi_keys(r: Roles) -> DataFrame:
    return r.table("pages").select("page_id", T.doi_key(F.col("url")).alias("doi_key"))


@query("SELECT conv_id, turn, nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') AS squeezed FROM conversations")
def squeezed_turns(r: Roles) -> DataFrame:
    return r.table("conversations").select("conv_id", "turn", F.nullif(T.squeeze(F.col("text")), F.lit("")).alias("squeezed"))


_AFFILIATION = "'Department of ' || p_name || ', ' || string_split(p_type, ' ')[1] || CASE p_size % 3 WHEN 0 THEN ' University' WHEN 1 THEN ' Hospital' ELSE ' Inc' END || ', ' || p_brand"


@query(f"SELECT p_partkey, string_split(x, ', ')[2] AS institution, string_split(x, ', ')[1] AS department, CASE p_size % 3 WHEN 0 THEN 'Academic' WHEN 1 THEN 'Healthcare' ELSE 'Corporate' END AS sector FROM (SELECT p_partkey, p_size, {_AFFILIATION} AS x FROM part)")
def affiliation_parts(r: Roles) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, " University").when(F.col("p_size") % 3 == 1, " Hospital").otherwise(" Inc")
    aff = F.concat(F.lit("Department of "), "p_name", F.lit(", "), F.get(F.split("p_type", " "), F.lit(0)), kind, F.lit(", "), "p_brand")
    cut = r.table("part").select("p_partkey", T.institution(aff).alias("institution"), T.department(aff).alias("department"))
    return cut.withColumn("sector", T.sector(F.col("institution")))


# Matching: names are "Word, I" of each turn's first two words, titles the turns

_NAMES = ", names AS (SELECT DISTINCT string_split(text, ' ')[1] || ', ' || upper(string_split(text, ' ')[2][1]) AS value FROM conversations WHERE text IS NOT NULL AND len(string_split(text, ' ')) > 1)"
_PARTS = _NAMES + ", parts AS (SELECT value, regexp_replace(lower(translate(string_split(value, ',')[1], 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝß', 'aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYs')), '[^a-z]', '', 'g') AS last, list_distinct(list_filter(string_split(regexp_replace(lower(translate(string_split(value, ',')[-1], 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝß', 'aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYs')), '[^a-z]+', '', 'g'), ''), lambda c: c <> '')) AS initials FROM names WHERE value <> '')"


def _names(r: Roles) -> DataFrame:
    words = F.split("text", " ")
    cut = r.table("conversations").where(F.col("text").isNotNull() & (F.size(words) > 1))
    return cut.select(F.concat(F.get(words, F.lit(0)), F.lit(", "), T.capital(F.substring(F.get(words, F.lit(1)), 1, 1))).alias("value")).distinct()


@query(_PARTS + """
, w AS (SELECT DISTINCT last FROM parts WHERE last <> ''), e AS (SELECT a.last AS a, b.last AS b, 1 - levenshtein(a.last, b.last) / greatest(length(a.last), length(b.last)) AS similarity FROM w a JOIN w b ON a.last < b.last)
SELECT a, b, round(similarity, 6) AS similarity FROM e WHERE similarity >= 0.7""")
def similar_last_names(r: Roles) -> DataFrame:
    last, _ = matching.author_parts(F.col("value"))
    lasts = _names(r).select(last.alias("value")).where("value <> ''").distinct()
    return matching.similar_by_edits(lasts.select(F.col("value").alias("id"), "value"))


@query(_PARTS + """
, e AS (SELECT a.value AS a, b.value AS b, CASE WHEN greatest(length(a.last), length(b.last)) > 0 THEN 1 - levenshtein(a.last, b.last) / greatest(length(a.last), length(b.last)) ELSE 1 END AS l, len(list_intersect(a.initials, b.initials)) AS i, len(list_distinct(a.initials || b.initials)) AS u FROM parts a JOIN parts b ON a.value < b.value WHERE a.last <> '' AND b.last <> ''),
s AS (SELECT a, b, CASE WHEN l < 0.7 THEN 0.3 * l ELSE 0.6 * l END + 0.4 * CASE WHEN u > 0 THEN i / u ELSE 0 END AS score FROM e)
SELECT a, b, round(score, 6) AS score FROM s WHERE score >= 0.85""")
def similar_author_names(r: Roles) -> DataFrame:
    return matching.similar_authors(_names(r))


_TERMS = """
, titles AS (SELECT conv_id * 1000 + turn AS id, nullif(trim(regexp_replace(regexp_replace(lower(translate(text, 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝß', 'aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYs')), '&amp;|&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '') AS k FROM conversations),
words AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(string_split(k, ' ')) AS token FROM titles WHERE k IS NOT NULL) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM words GROUP BY token), raw AS (SELECT id, token, tf * ln(1 + (SELECT count(*) FROM titles WHERE k IS NOT NULL) / df) AS raw FROM words JOIN df USING (token)),
unit AS (SELECT id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY id)) AS weight FROM raw), cosines AS (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS cosine FROM unit x JOIN unit y USING (token) WHERE x.id < y.id GROUP BY ALL)"""


def _titles(r: Roles) -> DataFrame:
    return r.table("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("title"))


@query(_TERMS + " SELECT a, b, round(cosine, 6) AS cosine FROM cosines WHERE cosine >= 0.25")
def similar_titles_by_terms(r: Roles) -> DataFrame:
    return matching.similar_by_terms(_titles(r), 0.25)


@query(_TERMS + ", sets AS (SELECT id, list_distinct(string_split(k, ' ')) AS w FROM titles WHERE k IS NOT NULL) SELECT a.id AS a, b.id AS b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)), 6) AS jaccard FROM sets a JOIN sets b ON a.id < b.id WHERE len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) >= 0.15")
def similar_titles_by_words(r: Roles) -> DataFrame:
    rows = _titles(r).select("id", F.split(T.title_key(F.col("title")), " ").alias("words")).where("words is not null")
    return matching.similar_by_words(rows, 0.15)


# The star schema and merging, over parts as records: two sources, repeated identifiers

def _library(r: Roles) -> DataFrame:
    part = r.table("part")
    words = F.split(F.lower("p_type"), " ")
    nothing = F.array().cast("array<string>")
    return part.select(
        F.col("p_partkey").alias("doc"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.array("p_brand", F.concat(F.lit("Maker "), F.col("p_size").cast("string"))).alias("authors"),
        (F.lit(1990) + F.col("p_size").cast("int") % 20).cast("int").alias("year"), F.col("p_brand").alias("source"), F.col("p_partkey").cast("long").alias("citations"),
        F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("10.1/P"), (F.col("p_partkey") % 400).cast("string"))).alias("doi"), F.get(words, F.lit(0)).alias("doc_type"), F.lit(None).cast("string").alias("abstract"),
        words.alias("keywords"), F.array("p_name").alias("index_keywords"), nothing.alias("affiliations"), nothing.alias("countries"), F.array(F.concat(F.lit("Smith J, 2001, Journal of "), "p_name", F.lit(", v. 3, p. 7-9"))).alias("references"), nothing.alias("funding"),
        F.lit("en").alias("language"), F.lit(None).cast("string").alias("volume"), F.lit(None).cast("string").alias("pages"), F.when(F.col("p_partkey") % 2 == 0, "SCOPUS").otherwise("WOS").alias("source_db"), F.lit(None).cast("string").alias("source_file"),
    )


_LIBRARY = ", library AS (SELECT p_partkey AS doc, p_name || ' ' || p_type AS title, [p_brand, 'Maker ' || p_size] AS authors, CAST(1990 + p_size % 20 AS INTEGER) AS year, p_brand AS source, p_partkey AS citations, CASE WHEN p_partkey % 3 <> 0 THEN '10.1/P' || (p_partkey % 400) END AS doi, string_split(lower(p_type), ' ') AS keywords, p_name, CASE WHEN p_partkey % 2 = 0 THEN 'SCOPUS' ELSE 'WOS' END AS source_db FROM part)"


@query(_LIBRARY + " SELECT doc, CAST(pos AS INTEGER) AS position, authors[pos] AS author, 2 AS n_authors, 0.5 AS weight FROM library, (VALUES (1), (2)) p(pos)")
def library_author_documents(r: Roles) -> DataFrame:
    return organise.author_documents(_library(r), fractional=True)


@query(_LIBRARY + """
, long AS (SELECT DISTINCT doc, 'author' AS kind, unnest(keywords) AS keyword FROM library UNION SELECT doc, 'index', lower(p_name) FROM library)
SELECT keyword, count(*) AS frequency, count(DISTINCT doc) AS documents, count(*) FILTER (kind = 'author') AS author_hits, count(*) FILTER (kind = 'index') AS index_hits FROM long GROUP BY keyword""")
def library_keywords(r: Roles) -> DataFrame:
    return organise.keywords(organise.keywords_long(_library(r)))


@query(_LIBRARY + " SELECT source, count(*) AS articles, CAST(sum(citations) AS BIGINT) AS citations, min(year) AS first_year, max(year) AS last_year, round(avg(CASE WHEN doi IS NULL THEN 0.0 ELSE 1.0 END), 6) AS doi_coverage FROM library GROUP BY source")
def library_sources(r: Roles) -> DataFrame:
    return organise.sources(_library(r))


@query(_LIBRARY + " SELECT keywords[1] AS doc_type, count(*) AS articles, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM library GROUP BY 1")
def library_doc_types(r: Roles) -> DataFrame:
    return organise.doc_types(_library(r))


@query(_LIBRARY + " SELECT doc, year, 2 AS n_authors, 0 AS n_countries, 'multi_author' AS type, CAST(NULL AS VARCHAR) AS scope FROM library")
def library_collaborations(r: Roles) -> DataFrame:
    return organise.collaborations(_library(r))


@query(_LIBRARY + " SELECT doc, title, year, source, doi, citations, 2 AS n_authors, len(keywords) AS n_keywords, 1 AS n_references, 'ready' AS status FROM library")
def library_documents(r: Roles) -> DataFrame:
    return organise.documents(_library(r)).select("doc", "title", "year", "source", "doi", "citations", "n_authors", "n_keywords", "n_references", "status")


@query(_LIBRARY + " SELECT doc, CAST(0 AS INTEGER) AS position, 'Smith J' AS first_author, 2001 AS year, '3' AS volume, '7-9' AS pages FROM library")
def library_references(r: Roles) -> DataFrame:
    return organise.references(_library(r)).select("doc", "position", "first_author", "year", "volume", "pages")


@query(_LIBRARY + " SELECT count(*) AS references, count(DISTINCT doc) AS citing, CAST(9 AS DOUBLE) AS mean_age, CAST(9 AS DOUBLE) AS half_life, CAST(0 AS DOUBLE) AS price_index, 0 AS with_doi FROM library")
def library_reference_statistics(r: Roles) -> DataFrame:
    return organise.reference_statistics(organise.references(_library(r)), 2010)


@query(_LIBRARY + """
, q AS (SELECT quantile_cont(citations, 0.25) AS q1, quantile_cont(citations, 0.75) AS q3 FROM library), t AS (SELECT sum(n - 1) AS n FROM (SELECT count(*) AS n FROM library GROUP BY trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))))
SELECT count(*) AS records, 0 AS missing_year, 0 AS invalid_year, 0 AS negative_citations, CAST(sum(CASE WHEN citations > q3 + 3 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS extreme_citations, CAST(0 AS DOUBLE) AS country_coverage, CAST(any_value(t.n) AS BIGINT) AS repeated_titles FROM library, q, t""")
def library_quality(r: Roles) -> DataFrame:
    return organise.quality(_library(r), 2020)


_MERGED = _LIBRARY + """
, k AS (SELECT *, lower(doi) AS doi_key, trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) || '|' || year AS ty FROM library), m AS (SELECT coalesce(doi_key, ty) AS key, doi_key, count(*) AS n_merged, max(citations) AS citations, list_sort(list_distinct(list(source_db))) AS sources, list_sort(list_distinct(flatten(list(authors)))) AS authors FROM k GROUP BY 1, 2)"""


@query(_MERGED + " SELECT doi_key, citations, n_merged, array_to_string(sources, ';') AS sources, array_to_string(authors, ';') AS authors, CASE WHEN n_merged > 1 THEN CASE WHEN doi_key IS NULL THEN 'title_year_normalized' ELSE 'doi_exact' END END AS merged_by FROM m")
def merged_records(r: Roles) -> DataFrame:
    merged = dedup.deduplicate(_library(r).drop("doc"))
    return merged.select("doi_key", "citations", "n_merged", F.array_join(F.array_sort("sources"), ";").alias("sources"), F.array_join(F.array_sort("authors"), ";").alias("authors"), "merged_by")


@query(_MERGED + """
, s AS (SELECT (SELECT count(*) FROM library) AS raw, count(*) AS "unique", CAST(sum(CASE WHEN len(sources) > 1 THEN 1 ELSE 0 END) AS BIGINT) AS multi_source, avg(n_merged) AS mean_merged FROM m) SELECT raw, "unique", multi_source, round(mean_merged, 6) AS mean_merged, raw - "unique" AS removed, round((raw - "unique") / raw, 6) AS rate FROM s""")
def merge_summary(r: Roles) -> DataFrame:
    library = _library(r).drop("doc")
    return dedup.summary(library, dedup.deduplicate(library))


# Hypotheses

_SLOPES = _PANEL + ", sl AS (SELECT country, regr_slope(articles, year) AS s FROM panel GROUP BY country)"


@query(_SLOPES + """
, z AS (SELECT articles, s, rank() OVER (ORDER BY articles) + (count(*) OVER (PARTITION BY articles) - 1) / 2.0 AS x, rank() OVER (ORDER BY round(s, 9)) + (count(*) OVER (PARTITION BY round(s, 9)) - 1) / 2.0 AS y FROM totals JOIN sl USING (country)),
cv AS (SELECT year, stddev_samp(articles) / avg(articles) AS cv FROM panel GROUP BY year), m AS (SELECT region, sum(citations) / sum(articles) AS m FROM totals JOIN regions USING (country) GROUP BY region),
h AS (SELECT 'growing_countries' AS id, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) AS v, avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) > 0.5 AS supported FROM sl UNION ALL SELECT 'size_growth', corr(x, y), corr(x, y) > 0 FROM z UNION ALL SELECT 'dominance', max(articles) / sum(articles), max(articles) / sum(articles) > 0.2 FROM totals
      UNION ALL SELECT 'sigma_convergence', regr_slope(cv, year), regr_slope(cv, year) < 0 FROM cv UNION ALL SELECT 'regional_gap', max(m) / min(m), max(m) / min(m) > 1.2 FROM m)
SELECT id, round(v, 6) AS statistic, supported FROM h""")
def hypotheses_of_countries(r: Roles) -> DataFrame:
    return hypotheses.places(_panel(r), r.regions()).select("id", "statistic", "supported")


@query("""
, s AS (SELECT source, count(*) AS tp, sum(citations) / count(*) AS cpp, max(year) - min(year) + 1 AS span FROM records WHERE source IS NOT NULL GROUP BY source), p AS (SELECT source, year, count(*) AS a FROM records WHERE source IS NOT NULL GROUP BY ALL), g AS (SELECT source, CASE WHEN count(*) > 1 THEN regr_slope(a, year) END AS s FROM p GROUP BY source),
z AS (SELECT rank() OVER (ORDER BY tp) + (count(*) OVER (PARTITION BY tp) - 1) / 2.0 AS t, rank() OVER (ORDER BY round(cpp, 9)) + (count(*) OVER (PARTITION BY round(cpp, 9)) - 1) / 2.0 AS c, rank() OVER (ORDER BY span) + (count(*) OVER (PARTITION BY span) - 1) / 2.0 AS l FROM s),
o AS (SELECT tp, row_number() OVER (ORDER BY tp DESC) AS i, count(*) OVER () AS n FROM s), u AS (SELECT avg(cpp) FILTER (g.s > 0) - avg(cpp) FILTER (g.s <= 0) AS gap FROM s JOIN g USING (source)),
r2 AS (SELECT CASE WHEN count(DISTINCT l) > 1 THEN corr(l, t) END AS v FROM z),
h AS (SELECT 'source_concentration' AS id, sum(tp) FILTER (i <= ceil(round(0.2 * n, 9))) / sum(tp) AS v, sum(tp) FILTER (i <= ceil(round(0.2 * n, 9))) / sum(tp) >= 0.5 AS supported FROM o UNION ALL SELECT 'output_quality', corr(t, c), corr(t, c) > 0 FROM z
      UNION ALL SELECT 'growing_sources', avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN s > 0 THEN 1.0 ELSE 0.0 END) > 0.5 FROM g UNION ALL SELECT 'longevity', v, v > 0 FROM r2 UNION ALL SELECT 'growth_impact', gap, gap > 0 FROM u)
SELECT id, round(v, 6) AS statistic, supported FROM h""")
def hypotheses_of_sources(r: Roles) -> DataFrame:
    return hypotheses.venues(venues.summary(r.records()), venues.growth_table(venues.panel(r.records()))).select("id", "statistic", "supported")


@query(_SERIES + """
, q AS (SELECT doc_type, quantile_cont(articles, 0.25) AS q1, quantile_cont(articles, 0.75) AS q3 FROM s GROUP BY doc_type), o AS (SELECT doc_type, CAST(sum(CASE WHEN articles < q1 - 1.5 * (q3 - q1) OR articles > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS DOUBLE) AS v FROM s JOIN q USING (doc_type) GROUP BY doc_type),
pv AS (SELECT a.doc_type, a.year, sum(sign(a.articles - b.articles)) AS v FROM s a JOIN s b ON a.doc_type = b.doc_type GROUP BY ALL), pu AS (SELECT *, abs(sum(v) OVER (PARTITION BY doc_type ORDER BY year)) AS u FROM pv), pc AS (SELECT doc_type, arg_max(year, u * 10000 - year) AS cut FROM pu GROUP BY doc_type),
rd AS (SELECT doc_type, (avg(articles) FILTER (year > cut) - avg(articles) FILTER (year <= cut)) / stddev_samp(articles) AS v FROM s JOIN pc USING (doc_type) GROUP BY doc_type),
fa AS (SELECT s.doc_type, s.year, s.articles AS y, count(*) AS n, arg_max(b.articles, b.year) AS last, arg_min(b.articles, b.year) AS first, avg(b.articles) AS m, avg(b.year) AS x, regr_slope(b.articles, b.year) AS slope FROM s JOIN s b ON s.doc_type = b.doc_type AND b.year < s.year GROUP BY ALL HAVING count(*) >= 4),
fe AS (SELECT doc_type, avg(abs(y - last)) - least(avg(abs(y - last - (last - first) / (n - 1))), avg(abs(y - m)), avg(abs(y - m - slope * (year - x)))) AS v FROM fa GROUP BY doc_type),
cg AS (SELECT doc_type, articles - lag(articles) OVER w AS d, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_type) AS n FROM s WINDOW w AS (PARTITION BY doc_type ORDER BY year)), ac AS (SELECT doc_type, avg(d) FILTER (2 * i > n + 1) - avg(d) FILTER (2 * i <= n + 1) AS v FROM cg GROUP BY doc_type),
x AS (SELECT *, row_number() OVER w AS i, count(*) OVER v AS n, CAST(sum(articles) OVER w AS DOUBLE) AS r, CAST(sum(articles) OVER v AS DOUBLE) AS a FROM s WINDOW w AS (PARTITION BY doc_type ORDER BY year), v AS (PARTITION BY doc_type)), gn AS (SELECT doc_type, max(r * r / i + (a - r) * (a - r) / (n - i) - a * a / n) AS gain FROM x WHERE i < n GROUP BY doc_type),
ln AS (SELECT doc_type, regr_r2(articles, year) AS r2, var_pop(articles) * count(*) AS ss, regr_slope(articles, year) AS b, regr_intercept(articles, year) AS a0 FROM s GROUP BY doc_type), gc AS (SELECT doc_type, r2 - gain / ss AS v FROM gn JOIN ln USING (doc_type)),
e AS (SELECT doc_type, articles - a0 - b * year AS e, lag(articles - a0 - b * year) OVER (PARTITION BY doc_type ORDER BY year) AS e1 FROM s JOIN ln USING (doc_type)), ps AS (SELECT doc_type, sum(e * e1) / sum(e * e) AS v FROM e GROUP BY doc_type),
h AS (SELECT doc_type, 'outliers' AS id, v, v > 0 AS supported FROM o UNION ALL SELECT doc_type, 'regime_difference', v, abs(v) > 0.5 FROM rd UNION ALL SELECT doc_type, 'forecast_superiority', v, v > 0 FROM fe UNION ALL SELECT doc_type, 'acceleration', v, v > 0 FROM ac UNION ALL SELECT doc_type, 'gradual_change', v, v > 0 FROM gc UNION ALL SELECT doc_type, 'persistence', v, v > 0 FROM ps)
SELECT doc_type, id, round(v, 6) AS statistic, supported FROM h""")
def hypotheses_of_series(r: Roles) -> DataFrame:
    return hypotheses.dynamics(_series(r), ["doc_type"])


@query("SELECT 'records' AS check, CAST(count(*) AS DOUBLE) AS value, CAST(100 AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high, count(*) >= 100 AS passed FROM records UNION ALL SELECT 'mean_citations', round(avg(citations), 6), NULL, 1, avg(citations) <= 1 FROM records")
def quality_gate(r: Roles) -> DataFrame:
    measured = r.records().agg(F.count("*").alias("records"), F.avg("citations").alias("mean_citations"))
    return hypotheses.quality_gate(measured, {"records": (100.0, None), "mean_citations": (None, 1.0)})


# More of the star schema

@query(_LIBRARY + " SELECT 'Smith J' AS first_author, count(*) AS mentions, count(DISTINCT doc) AS citing, 1 AS rank FROM library")
def library_reference_authors(r: Roles) -> DataFrame:
    return organise.reference_authors(organise.references(_library(r)))


@query(_LIBRARY + ", w AS (SELECT DISTINCT doc, 'author' AS kind, unnest(keywords) AS k FROM library UNION SELECT doc, 'index', lower(p_name) FROM library) SELECT doc, count(*) AS keywords, count(DISTINCT k) AS different_keywords, 0 AS affiliations, 0 AS institutions, 1 AS references, 1 AS dated_references FROM w GROUP BY doc")
def library_document_summaries(r: Roles) -> DataFrame:
    return organise.document_summaries(_library(r))


@query("SELECT p_partkey, p_brand || CASE WHEN p_size % 2 = 0 THEN ', Smith J' ELSE '' END AS x, 2 AS references, 1 + CAST(p_size % 2 = 0 AS INTEGER) AS own, round((1 + CAST(p_size % 2 = 0 AS INTEGER)) / 2, 6) AS share FROM part")
def self_citations(r: Roles) -> DataFrame:
    even = F.col("p_size") % 2 == 0
    part = r.table("part").withColumn("x", F.concat("p_brand", F.when(even, ", Smith J").otherwise("")))
    records = part.select(F.col("p_partkey").alias("doc"), F.when(even, F.array(F.lit("Smith, J"), "p_brand")).otherwise(F.array("p_brand")).alias("authors"), F.array(F.lit("SMITH J, 2001"), F.concat(F.lit("with "), "p_brand")).alias("references"))
    return organise.self_citations(records).join(part.select(F.col("p_partkey").alias("doc"), "x"), "doc").withColumnRenamed("doc", "p_partkey")


@query("SELECT p_partkey, (CASE WHEN length(p_name || ' ' || p_type) > 20 THEN rtrim(substr(p_name || ' ' || p_type, 1, 17)) || '...' ELSE p_name || ' ' || p_type END) || ', ' || p_brand || ', ' || (1990 + p_size) AS label FROM part")
def display_labels(r: Roles) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_type")
    return r.table("part").select("p_partkey", organise.display_label(title, F.col("p_brand"), (1990 + F.col("p_size")), F.lit(None).cast("string"), 20).alias("label"))


@query(", c AS (SELECT p_name, min(p_size) % 4 AS cluster FROM part GROUP BY p_name), v AS (SELECT p_brand, cluster, count(*) AS n FROM (SELECT DISTINCT p_brand, p_name FROM part) JOIN c USING (p_name) GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, cluster) AS p, sum(n) OVER (PARTITION BY p_brand) AS every FROM v) SELECT p_brand AS doc, cluster, n AS votes, round(n / every, 6) AS share FROM b WHERE p = 1")
def majority_clusters(r: Roles) -> DataFrame:
    part = r.table("part")
    clusters = part.groupBy(F.col("p_name").alias("reference")).agg((F.min("p_size") % 4).alias("cluster"))
    return organise.majority_cluster(part.select(F.col("p_brand").alias("doc"), F.col("p_name").alias("reference")).distinct(), clusters)


@query(_PANEL + ", p AS (SELECT n_name AS country, count(*) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name), a AS (SELECT rank() OVER (ORDER BY articles) + (count(*) OVER (PARTITION BY articles) - 1) / 2.0 AS x, rank() OVER (ORDER BY people) + (count(*) OVER (PARTITION BY people) - 1) / 2.0 AS y FROM totals JOIN p USING (country)) SELECT round(corr(x, y), 6) AS rho, count(*) AS n, round(corr(x, y) * sqrt(count(*) - 1), 6) AS z FROM a")
def country_output_and_people(r: Roles) -> DataFrame:
    people = r.table("customer").join(r.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("people"))
    return stats.spearman(adjust.match_indicators(countries.summary(_panel(r)), people), "articles", "people")
