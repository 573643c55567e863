"""Queries over the driver's tables by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import stats
from .functions import text as T
from .operators import countries, descriptive, modularity, networks, primitives, screening, series, venues
from .plans.roles import PRELUDE, Roles

FLAGSHIP = "annual_production"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of role tables under its name; doubles of its result are rounded to 6 places.

    ``sql`` follows the common table expressions of the roles; it starts with SELECT or with further ones after a comma.
    """

    def registered(made: Callable[[Roles], DataFrame]) -> Callable[[Roles], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            out = made(Roles(spark, folder))
            return out.select(*(F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes))

        QUERIES[made.__name__] = run
        if sql is not None:
            ORACLE_SQL[made.__name__] = PRELUDE + sql
        return made

    return registered


# Descriptive analytics


@query("""
SELECT year, count(*) AS articles, CAST(sum(citations) AS BIGINT) AS citations, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       CAST(sum(count(*)) OVER (ORDER BY year) AS BIGINT) AS cumulative,
       round((count(*) - lag(count(*)) OVER (ORDER BY year)) / CAST(lag(count(*)) OVER (ORDER BY year) AS DOUBLE), 6) AS change
FROM records GROUP BY year""")
def annual_production(r: Roles) -> DataFrame:
    return descriptive.annual(r.records())


@query("""
, a AS (SELECT count(DISTINCT author) AS authors, count(*) AS appearances FROM authors)
SELECT count(*) AS documents, count(DISTINCT source) AS sources, min(year) AS first_year, max(year) AS last_year, round(avg(citations), 6) AS mean_citations,
       CAST(sum(citations) AS BIGINT) AS total_citations, any_value(a.authors) AS authors, any_value(appearances) AS appearances,
       round(count(*) / any_value(a.authors), 6) AS documents_per_author, round(any_value(appearances) / count(*), 6) AS authors_per_document FROM records, a""")
def corpus_overview(r: Roles) -> DataFrame:
    return descriptive.overview(r.records(), r.authors())


@query("""
SELECT doc_type, count(*) AS articles, rank() OVER (ORDER BY count(*) DESC) AS rank, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM records GROUP BY doc_type""")
def document_types(r: Roles) -> DataFrame:
    return descriptive.shares(r.records(), "doc_type")


@query("""
, n AS (SELECT doc, count(*) AS k FROM authors GROUP BY doc)
SELECT author, count(*) AS articles, round(sum(1.0 / k), 6) AS weighted_articles, CAST(sum(citations) AS BIGINT) AS citations, round(sum(citations / k), 6) AS weighted_citations,
       min(year) AS first_year, max(year) AS last_year FROM authors JOIN n USING (doc) JOIN records USING (doc) GROUP BY author""")
def author_productivity(r: Roles) -> DataFrame:
    return descriptive.productivity(r.authors(), r.records(), "author")


_INDICES = """
, p AS (SELECT author, citations, year, row_number() OVER (PARTITION BY author ORDER BY citations DESC) AS rn, sum(citations) OVER (PARTITION BY author ORDER BY citations DESC ROWS UNBOUNDED PRECEDING) AS run
        FROM authors JOIN records USING (doc)),
i AS (SELECT author, count(*) AS n_papers, CAST(sum(citations) AS BIGINT) AS total_citations, count(*) FILTER (citations >= rn) AS h_index, count(*) FILTER (run >= rn * rn) AS g_index,
             count(*) FILTER (citations >= 10) AS i10_index, min(year) AS first_year, max(year) AS last_year FROM p GROUP BY author)"""


@query(_INDICES + """
SELECT i.*, round(h_index / CAST(greatest((SELECT max(year) FROM records) - first_year + 1, 1) AS DOUBLE), 6) AS m_quotient, round(h_index / sqrt(n_papers), 6) AS h_per_root, last_year - first_year + 1 AS active_years FROM i""")
def author_indices(r: Roles) -> DataFrame:
    return descriptive.author_indices(r.authors(), r.records(), "author")


@query(_INDICES + """
SELECT CASE WHEN last_year - first_year + 1 <= 5 THEN 'early' WHEN last_year - first_year + 1 <= 15 THEN 'mid' ELSE 'late' END AS stage, count(*) AS authors, round(avg(h_index), 6) AS mean_h FROM i GROUP BY 1""")
def career_stages(r: Roles) -> DataFrame:
    staged = descriptive.career_stage(descriptive.author_indices(r.authors(), r.records(), "author"))
    return staged.groupBy("stage").agg(F.count("*").alias("authors"), F.avg("h_index").alias("mean_h"))


@query("""
, j AS (SELECT author, year, citations FROM authors JOIN records USING (doc)), b AS (SELECT author FROM j GROUP BY author ORDER BY count(*) DESC, author LIMIT 10),
y AS (SELECT author, year, count(*) AS papers, CAST(sum(citations) AS BIGINT) AS citations FROM j JOIN b USING (author) GROUP BY ALL)
SELECT *, CAST(sum(papers) OVER w AS BIGINT) AS cumulative_papers, CAST(sum(citations) OVER w AS BIGINT) AS cumulative_citations FROM y WINDOW w AS (PARTITION BY author ORDER BY year)""")
def author_trajectories(r: Roles) -> DataFrame:
    return descriptive.trajectories(r.authors(), r.records(), "author")


@query("""
, y AS (SELECT DISTINCT author, year FROM authors JOIN records USING (doc)), g AS (SELECT author, year - lag(year) OVER (PARTITION BY author ORDER BY year) AS gap FROM y)
SELECT author, count(*) FILTER (gap > 1) AS gaps, coalesce(max(gap), 0) AS longest FROM g GROUP BY author""")
def publication_gaps(r: Roles) -> DataFrame:
    return descriptive.publication_gaps(r.authors(), r.records(), "author")


@query("""
SELECT doc, year, citations, round(citations / CAST(greatest((SELECT max(year) FROM records) - year + 1, 1) AS DOUBLE), 6) AS per_year FROM records ORDER BY citations DESC, doc LIMIT 20""")
def most_cited(r: Roles) -> DataFrame:
    return descriptive.most_cited(r.records())


@query("""
, n AS (SELECT records.doc, k FROM records LEFT JOIN (SELECT doc, count(*) AS k FROM authors GROUP BY doc) USING (doc))
SELECT count(k) AS documents, count(*) - count(k) AS without, round(avg(k), 6) AS collaborative_index, round(avg(CASE WHEN k > 1 THEN 1.0 WHEN k = 1 THEN 0.0 END), 6) AS degree_of_collaboration,
       round(avg(1 - 1.0 / k), 6) AS collaborative_coefficient FROM n""")
def collaboration_indices(r: Roles) -> DataFrame:
    return descriptive.collaboration(r.authors(), r.records())


_BY = """
, n AS (SELECT doc, count(*) AS k FROM authors GROUP BY doc)
SELECT {0}, count(*) AS documents, round(avg(k), 6) AS mean_authors, round(median(k), 6) AS median_authors, count(*) FILTER (k <= 1) AS single, count(*) FILTER (k > 1) AS multi,
       round(count(*) FILTER (k > 1) / count(*), 6) AS rate FROM records JOIN n USING (doc) GROUP BY {0}"""


@query(_BY.format("year"))
def collaboration_by_year(r: Roles) -> DataFrame:
    return descriptive.collaboration_by(r.authors(), r.records(), "year")


@query(_BY.format("doc_type"))
def collaboration_by_type(r: Roles) -> DataFrame:
    return descriptive.collaboration_by(r.authors(), r.records(), "doc_type")


@query("""
, c AS (SELECT papers, count(*) AS authors FROM (SELECT author, count(*) AS papers FROM authors GROUP BY author) GROUP BY papers)
SELECT papers, authors, round(authors / sum(authors) OVER (), 6) AS observed FROM c""")
def lotka_histogram(r: Roles) -> DataFrame:
    return descriptive.lotka(r.authors(), "author").select("papers", "authors", "observed")


@query("""
, c AS (SELECT papers, count(*) AS authors FROM (SELECT keyword, count(*) AS papers FROM keywords GROUP BY keyword) GROUP BY papers), t AS (SELECT sum(authors) AS n, sum(authors * ln(papers)) AS logs FROM c),
g AS (SELECT CAST(1.01 AS DOUBLE) + i * CAST(0.01 AS DOUBLE) AS alpha, (SELECT sum(exp(-ln(k) * (CAST(1.01 AS DOUBLE) + i * CAST(0.01 AS DOUBLE)))) FROM range(1, 1001) r(k)) AS zeta FROM range(0, 400) q(i)),
b AS (SELECT arg_max(alpha, -alpha * logs - n * ln(zeta)) AS alpha, arg_max(zeta, -alpha * logs - n * ln(zeta)) AS zeta, any_value(n) AS n FROM g, t),
f AS (SELECT papers, authors, authors / n AS observed, pow(papers, -alpha) / zeta AS expected, alpha FROM c, b), h AS (SELECT *, abs(sum(observed) OVER (ORDER BY papers) - sum(expected) OVER (ORDER BY papers)) AS gap FROM f)
SELECT papers, authors, round(observed, 6) AS observed, round(expected, 6) AS expected, round(alpha, 6) AS alpha, round(max(gap) OVER (), 6) AS ks FROM h""")
def lotka_fit(r: Roles) -> DataFrame:
    return descriptive.lotka(r.keywords(), "keyword")


@query("""
, s AS (SELECT source, count(*) AS articles FROM records WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT *, row_number() OVER (ORDER BY articles DESC, source) AS rank, CAST(sum(articles) OVER (ORDER BY articles DESC, source ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative, sum(articles) OVER () AS t FROM s)
SELECT source, articles, rank, cumulative, CASE WHEN 3 * cumulative <= t THEN 1 WHEN 3 * cumulative <= 2 * t THEN 2 ELSE 3 END AS zone FROM c""")
def bradford_sources(r: Roles) -> DataFrame:
    return primitives.bradford(r.records().where("source is not null").groupBy("source").agg(F.count("*").alias("articles")), "source", "articles")


@query("""
, s AS (SELECT source, count(*) AS articles FROM records WHERE source IS NOT NULL GROUP BY source),
c AS (SELECT *, sum(articles) OVER (ORDER BY articles DESC, source ROWS UNBOUNDED PRECEDING) AS cum, sum(articles) OVER () AS t FROM s),
z AS (SELECT CASE WHEN 3 * cum <= t THEN 1 WHEN 3 * cum <= 2 * t THEN 2 ELSE 3 END AS zone, articles FROM c)
SELECT zone, count(*) AS sources, CAST(sum(articles) AS BIGINT) AS total, round(count(*) / CAST(lag(count(*)) OVER (ORDER BY zone) AS DOUBLE), 6) AS multiplier FROM z GROUP BY zone""")
def bradford_zones(r: Roles) -> DataFrame:
    zoned = primitives.bradford(r.records().where("source is not null").groupBy("source").agg(F.count("*").alias("articles")), "source", "articles")
    return primitives.bradford_zones(zoned, "articles")


@query("""
, p AS (SELECT author, count(*) AS n FROM authors GROUP BY author), o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn, count(*) OVER () AS holders FROM p),
s AS (SELECT any_value(holders) AS holders, CAST(ceil(sqrt(any_value(holders))) AS BIGINT) AS core, sum(n) FILTER (rn <= ceil(sqrt(holders))) / sum(n) AS share FROM o)
SELECT holders, core, round(share, 6) AS share, share BETWEEN 0.4 AND 0.6 AS holds FROM s""")
def price_square_root(r: Roles) -> DataFrame:
    return primitives.square_root_law(r.authors().groupBy("author").agg(F.count("*").alias("n")), "n")


_CONCENTRATION = """
v AS (SELECT g, CAST(x AS DOUBLE) AS x, row_number() OVER (PARTITION BY g ORDER BY x) AS i FROM vals WHERE x IS NOT NULL),
s AS (SELECT g, count(*) AS n, sum(x) AS total, sum(i * x) AS ix, sum(x * x) AS xx, sum(CASE WHEN x > 0 THEN x * log2(x) END) AS xl, sum(CASE WHEN x > 0 THEN x * ln(x) END) AS xn, count(*) FILTER (x > 0) AS pos FROM v GROUP BY g)
SELECT {0} n, round(total, 6) AS total, round(CASE WHEN n > 1 THEN 2 * ix / (n * total) - (n + 1) / n ELSE 0 END, 6) AS gini, round(xx / (total * total), 6) AS hhi, round(log2(total) - xl / total, 6) AS entropy,
       round((log2(total) - xl / total) / log2(n), 6) AS evenness, round(xn / total - ln(total / pos), 6) AS theil FROM s"""


@query(", vals AS (SELECT 0 AS g, count(*) AS x FROM authors GROUP BY author)," + _CONCENTRATION.format(""))
def author_concentration(r: Roles) -> DataFrame:
    return primitives.concentration(r.authors().groupBy("author").agg(F.count("*").alias("n")), [], "n")


@query(", vals AS (SELECT year AS g, count(*) AS x FROM countries JOIN records USING (doc) GROUP BY year, country)," + _CONCENTRATION.format("g AS year,"))
def country_concentration_by_year(r: Roles) -> DataFrame:
    return countries.inequality_by(countries.panel(r.countries(), r.records()), "year", "articles")


@query("""
, p AS (SELECT author, count(*) AS n FROM authors GROUP BY author), o AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn, count(*) OVER () AS a FROM p), f AS (SELECT unnest([0.01, 0.05, 0.1, 0.2]) AS fraction)
SELECT CAST(fraction AS DOUBLE) AS fraction, CAST(ceil(round(fraction * a, 9)) AS BIGINT) AS holders, round(sum(CASE WHEN rn <= ceil(round(fraction * a, 9)) THEN n ELSE 0 END) / sum(n), 6) AS share FROM o, f GROUP BY fraction, a""")
def author_top_shares(r: Roles) -> DataFrame:
    return primitives.top_share(r.authors().groupBy("author").agg(F.count("*").alias("n")), "n", [0.01, 0.05, 0.1, 0.2])


@query("""
, p AS (SELECT source, count(*) AS x FROM records WHERE source IS NOT NULL GROUP BY source), h AS (SELECT x, count(*) AS n FROM p GROUP BY x),
l AS (SELECT sum(n) OVER (ORDER BY x) / sum(n) OVER () AS population, sum(x * n) OVER (ORDER BY x) / sum(x * n) OVER () AS share FROM h)
SELECT round(population, 6) AS population, round(share, 6) AS share FROM l UNION ALL SELECT 0.0, 0.0""")
def source_lorenz(r: Roles) -> DataFrame:
    return primitives.lorenz(r.records().where("source is not null").groupBy("source").agg(F.count("*").alias("x_")), "x_")


@query("""
, i AS (SELECT count(*) AS n, avg(citations) AS mean, median(citations) AS median, stddev_samp(citations) AS sd, max(citations) AS most, avg(CASE WHEN citations = 0 THEN 1.0 ELSE 0.0 END) AS uncited FROM records),
p AS (SELECT citations, row_number() OVER (ORDER BY citations DESC) AS rn, sum(citations) OVER (ORDER BY citations DESC ROWS UNBOUNDED PRECEDING) AS run FROM records),
h AS (SELECT count(*) FILTER (citations >= rn) AS h_index, count(*) FILTER (run >= rn * rn) AS g_index, count(*) FILTER (citations >= 10) AS i10_index FROM p)
SELECT n, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, most, round(uncited, 6) AS uncited, h.* FROM i, h""")
def citation_profile(r: Roles) -> DataFrame:
    return descriptive.citation_profile(r.records())


_AGES = """
, a AS (SELECT (SELECT max(year) FROM records) - year AS age, count(*) AS documents, CAST(sum(citations) AS BIGINT) AS citations FROM records GROUP BY 1),
c AS (SELECT *, sum(citations) OVER (ORDER BY age) / CAST(sum(citations) OVER () AS DOUBLE) AS cumulative_share FROM a)"""


@query(_AGES + "SELECT age, documents, citations, round(cumulative_share, 6) AS cumulative_share FROM c")
def citation_age(r: Roles) -> DataFrame:
    return descriptive.citation_age(r.records())


@query(_AGES + "SELECT min(age) FILTER (cumulative_share >= 0.5) AS half_life, round(sum(citations) FILTER (age <= 5) / sum(citations), 6) AS price_index FROM c")
def citation_half_life(r: Roles) -> DataFrame:
    return descriptive.half_life(descriptive.citation_age(r.records()))


@query("""
, v AS (SELECT year, citations / CAST(greatest((SELECT max(year) FROM records) - year, 1) AS DOUBLE) AS v FROM records)
SELECT year, round(avg(v), 6) AS mean_velocity, round(median(v), 6) AS median_velocity, count(*) AS documents FROM v GROUP BY year""")
def citation_velocity(r: Roles) -> DataFrame:
    return descriptive.citation_velocity(r.records())


@query("SELECT keyword, count(*) AS articles, rank() OVER (ORDER BY count(*) DESC) AS rank, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM keywords GROUP BY keyword")
def keyword_frequency(r: Roles) -> DataFrame:
    return descriptive.shares(r.keywords(), "keyword")


@query("""
, f AS (SELECT keyword, count(*) AS n FROM keywords GROUP BY keyword), k AS (SELECT DISTINCT n, rank() OVER (ORDER BY n DESC) AS rank FROM f)
SELECT round(regr_slope(ln(n), ln(rank)), 6) AS slope, round(regr_intercept(ln(n), ln(rank)), 6) AS intercept, round(regr_r2(ln(n), ln(rank)), 6) AS r2, count(*) AS points FROM k""")
def keyword_zipf(r: Roles) -> DataFrame:
    return descriptive.zipf(r.keywords(), "keyword")


@query("""
, c AS (SELECT keyword, year, count(*) AS n FROM keywords JOIN records USING (doc) GROUP BY ALL), s AS (SELECT min(year) AS a, max(year) AS b FROM records),
g AS (SELECT keyword, CAST(unnest(range(a, b + 1)) AS INTEGER) AS year FROM (SELECT DISTINCT keyword FROM keywords), s)
SELECT keyword, year, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (keyword, year)""")
def keyword_years(r: Roles) -> DataFrame:
    return descriptive.keyword_years(r.keywords(), r.records())


@query()
def keyword_bursts(r: Roles) -> DataFrame:
    return series.bursts(descriptive.keyword_years(r.keywords(), r.records()).withColumnRenamed("n", "articles"), ["keyword"], 1.2)


@query("""
, s AS (SELECT min(year) AS a, max(year) AS b FROM records),
u AS (SELECT CASE least(floor((year - a) * 3 / (b - a + 1)), 2) WHEN 0 THEN 'early' WHEN 1 THEN 'middle' ELSE 'late' END AS period, keyword, count(*) AS uses FROM keywords JOIN records USING (doc), s GROUP BY ALL),
k AS (SELECT *, round(uses / sum(uses) OVER (PARTITION BY period), 6) AS share, CAST(rank() OVER (PARTITION BY period ORDER BY uses DESC) AS INTEGER) AS rank FROM u)
SELECT * FROM k WHERE rank <= 20""")
def thematic_evolution(r: Roles) -> DataFrame:
    return descriptive.thematic_evolution(r.keywords(), r.records())


# Countries

_PANEL = """
, panel AS (SELECT country, year, count(*) AS articles, CAST(sum(citations) AS BIGINT) AS citations FROM countries JOIN records USING (doc) GROUP BY ALL),
totals AS (SELECT country, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(citations) AS BIGINT) AS citations, min(year) AS first_year, max(year) AS last_year FROM panel GROUP BY country)"""


def _panel(r: Roles) -> DataFrame:
    return countries.panel(r.countries(), r.records())


@query("""
, n AS (SELECT doc, count(*) AS k FROM countries GROUP BY doc)
SELECT country, count(*) AS articles, CAST(sum(citations) AS BIGINT) AS citations, round(avg(citations), 6) AS mean_citations, count(*) FILTER (k = 1) AS scp, count(*) FILTER (k > 1) AS mcp,
       round(count(*) FILTER (k > 1) / count(*), 6) AS mcp_ratio FROM countries JOIN n USING (doc) JOIN records USING (doc) GROUP BY country""")
def country_scp_mcp(r: Roles) -> DataFrame:
    return descriptive.country_table(r.countries(), r.records())


@query(_PANEL + """
SELECT country, articles, citations, first_year, last_year, round(articles / sum(articles) OVER (), 6) AS share, CAST(row_number() OVER w AS INTEGER) AS rank,
       round(sum(articles) OVER (w ROWS UNBOUNDED PRECEDING) / sum(articles) OVER (), 6) AS cumulative_share, round(citations / CAST(articles AS DOUBLE), 6) AS mean_citations
FROM totals WINDOW w AS (ORDER BY articles DESC, country)""")
def country_production(r: Roles) -> DataFrame:
    return countries.summary(_panel(r))


@query(_PANEL + """
, m AS (SELECT median(articles) AS ma, median(citations) AS mc FROM totals)
SELECT country, CASE WHEN articles >= ma AND citations >= mc THEN 'leader' WHEN articles >= ma THEN 'producer' WHEN citations >= mc THEN 'influencer' ELSE 'follower' END AS quadrant FROM totals, m""")
def country_quadrants(r: Roles) -> DataFrame:
    return descriptive.quadrants(countries.summary(_panel(r)), "articles", "citations", ("leader", "producer", "influencer", "follower")).select("country", "quadrant")


@query(_PANEL + """
, o AS (SELECT articles AS x, row_number() OVER (ORDER BY articles DESC, country) AS rn, count(*) OVER () AS c FROM totals),
v AS (SELECT CAST(articles AS DOUBLE) AS x, row_number() OVER (ORDER BY articles) AS i FROM totals),
s AS (SELECT count(*) AS n, sum(x) AS total, sum(i * x) AS ix, sum(x * x) AS xx, sum(x * log2(x)) AS xl, sum(x * ln(x)) AS xn FROM v),
t AS (SELECT sum(x) FILTER (rn <= 5) / sum(x) AS top5, sum(x) FILTER (rn <= 10) / sum(x) AS top10, sum(x) FILTER (rn <= ceil(round(c * 0.1, 9))) / sum(x) FILTER (rn > c - floor(round(c * 0.4, 9))) AS palma FROM o)
SELECT n, total, round(2 * ix / (n * total) - (n + 1) / n, 6) AS gini, round(xx / (total * total), 6) AS hhi, round(log2(total) - xl / total, 6) AS entropy, round((log2(total) - xl / total) / log2(n), 6) AS evenness,
       round(xn / total - ln(total / n), 6) AS theil, round(top5, 6) AS top5, round(top10, 6) AS top10, round(palma, 6) AS palma FROM s, t""")
def country_inequality(r: Roles) -> DataFrame:
    return countries.inequality(countries.summary(_panel(r)), "articles")


@query(_PANEL + """
, e AS (SELECT country, min(year) AS first_year, max(year) AS last_year, arg_min(articles, year) AS first_value, arg_max(articles, year) AS last_value, regr_slope(articles, year) AS slope,
               regr_intercept(articles, year) AS intercept, regr_r2(articles, year) AS r2, count(*) AS points FROM panel GROUP BY country),
l AS (SELECT country, year, (articles - lag(articles) OVER w) / CAST(lag(articles) OVER w AS DOUBLE) AS g FROM panel WINDOW w AS (PARTITION BY country ORDER BY year))
SELECT e.country, first_year, last_year, first_value, last_value, round(CASE WHEN last_year > first_year THEN pow(last_value / CAST(first_value AS DOUBLE), 1.0 / (last_year - first_year)) - 1 END, 6) AS cagr,
       round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, points, round(g, 6) AS last_growth FROM e JOIN l ON e.country = l.country AND l.year = last_year""")
def country_growth(r: Roles) -> DataFrame:
    return countries.growth_dynamics(_panel(r))


@query(_PANEL + """
, p AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY year) AS i, count(*) OVER (PARTITION BY country) AS n FROM panel),
h AS (SELECT country, avg(articles) FILTER (i <= ceil(n / 2)) AS mb, avg(articles) FILTER (i > ceil(n / 2)) AS ma, stddev_samp(articles) AS sd, max(year) FILTER (i <= ceil(n / 2)) AS year FROM p GROUP BY country)
SELECT country, round(mb, 6) AS mean_before, round(ma, 6) AS mean_after, round(sd, 6) AS sd, year, coalesce(abs(ma - mb) > sd, false) AS changed FROM h""")
def country_change_points(r: Roles) -> DataFrame:
    return countries.change_points(_panel(r))


@query(_PANEL + """
, p AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY year DESC) <= 3 AS late FROM panel), m AS (SELECT country, avg(articles) FILTER (late) AS a, avg(articles) FILTER (NOT late) AS b FROM p GROUP BY country)
SELECT country, round(a, 6) AS recent_mean, round(b, 6) AS earlier_mean, round(a / b, 6) AS momentum FROM m""")
def country_momentum(r: Roles) -> DataFrame:
    return countries.momentum(_panel(r))


@query(_PANEL + """
, g AS (SELECT region, count(*) AS countries, CAST(sum(articles) AS BIGINT) AS articles, CAST(sum(citations) AS BIGINT) AS citations FROM totals JOIN regions USING (country) GROUP BY region),
x AS (SELECT *, sum(articles) OVER () / count(*) OVER () AS e FROM g)
SELECT region, countries, articles, citations, round(articles / sum(articles) OVER (), 6) AS share, round(sum((articles - e) * (articles - e) / e) OVER (), 6) AS chi_square FROM x""")
def regional_rollup(r: Roles) -> DataFrame:
    return countries.regional(countries.summary(_panel(r)), r.regions())


_RANKS = _PANEL + ", ranks AS (SELECT country, year, articles, citations, CAST(rank() OVER (PARTITION BY year ORDER BY articles DESC) AS INTEGER) AS rank FROM panel)"


@query(_RANKS + "SELECT a.*, a.rank - b.rank AS change FROM ranks a LEFT JOIN ranks b ON a.country = b.country AND a.year = b.year + 1")
def country_yearly_ranks(r: Roles) -> DataFrame:
    return countries.yearly_ranks(_panel(r))


@query(_RANKS + """
, c AS (SELECT a.*, a.rank - b.rank AS change FROM ranks a LEFT JOIN ranks b ON a.country = b.country AND a.year = b.year + 1)
SELECT country, round(avg(abs(change)), 6) AS mean_change, round(stddev_samp(rank), 6) AS volatility, min(rank) AS best, max(rank) AS worst, count(*) AS years FROM c GROUP BY country""")
def country_rank_mobility(r: Roles) -> DataFrame:
    return countries.rank_mobility(_panel(r))


@query(_RANKS + """
, l AS (SELECT year, country FROM ranks WHERE rank <= 5), b AS (SELECT year + 1 AS year, country FROM l WHERE year + 1 IN (SELECT year FROM l))
SELECT b.year, count(*) AS leaders, count(l.country) AS kept, round(count(l.country) / count(*), 6) AS retention FROM b LEFT JOIN l ON b.year = l.year AND b.country = l.country GROUP BY b.year""")
def country_persistence(r: Roles) -> DataFrame:
    return countries.persistence(_panel(r))


@query(_RANKS + """
, m AS (SELECT a.year, a.country, a.rank, b.rank AS old FROM ranks a JOIN ranks b ON a.country = b.country AND a.year = b.year + 1)
SELECT a.year, round(avg(sign(a.rank - b.rank) * sign(a.old - b.old)), 6) AS tau, count(*) AS pairs FROM m a JOIN m b ON a.year = b.year AND a.country < b.country GROUP BY a.year""")
def country_rank_agreement(r: Roles) -> DataFrame:
    return countries.rank_agreement(_panel(r))


@query(_PANEL + """
, s AS (SELECT country, year, CAST(ntile(4) OVER (PARTITION BY year ORDER BY articles, country) AS INTEGER) AS state FROM panel),
m AS (SELECT b.state AS state_before, a.state, count(*) AS n FROM s a JOIN s b ON a.country = b.country AND a.year = b.year + 1 GROUP BY ALL)
SELECT *, round(n / sum(n) OVER (PARTITION BY state_before), 6) AS probability FROM m""")
def country_transitions(r: Roles) -> DataFrame:
    return countries.transitions(_panel(r))


@query(_PANEL + """
, w AS (SELECT min(year) AS a, max(year) AS b, floor((max(year) - min(year) + 1) / 3) AS k FROM panel),
t AS (SELECT country, coalesce(sum(articles) FILTER (year < a + k), 0) AS f, coalesce(sum(articles) FILTER (year > b - k), 0) AS l FROM panel, w GROUP BY country),
s AS (SELECT country, f / sum(f) OVER () AS first_share, l / sum(l) OVER () AS last_share FROM t)
SELECT country, round(first_share, 6) AS first_share, round(last_share, 6) AS last_share, round(last_share - first_share, 6) AS change,
       CASE WHEN first_share = 0 AND last_share > 0 THEN 'entrant' WHEN first_share > 0 AND last_share = 0 THEN 'exit' WHEN last_share > first_share THEN 'rising' WHEN last_share < first_share THEN 'falling' ELSE 'stable' END AS status FROM s""")
def country_share_windows(r: Roles) -> DataFrame:
    return countries.share_windows(_panel(r))


@query(_PANEL + ", f AS (SELECT min(year) AS year FROM panel GROUP BY country) SELECT year, count(*) AS entrants, CAST(sum(count(*)) OVER (ORDER BY year) AS BIGINT) AS cumulative FROM f GROUP BY year")
def country_emergence(r: Roles) -> DataFrame:
    return countries.emergence(_panel(r))


_PAIRS = ", pairs AS (SELECT a.country AS a, b.country AS b, count(*) AS weight FROM countries a JOIN countries b USING (doc) WHERE a.country < b.country GROUP BY ALL), n AS (SELECT country, count(*) AS n FROM countries GROUP BY country)"


@query(_PAIRS + """
SELECT a, b, weight, x.n AS total_a, y.n AS total_b, round(weight / sqrt(x.n * y.n), 6) AS salton, round(weight / (x.n + y.n - weight), 6) AS jaccard, round(weight / x.n, 6) AS affinity_a, round(weight / y.n, 6) AS affinity_b
FROM pairs JOIN n x ON a = x.country JOIN n y ON b = y.country""")
def country_collaboration(r: Roles) -> DataFrame:
    return countries.collaboration(r.countries())


@query(_PAIRS + """
, w AS (SELECT a AS country, b AS partner, weight FROM pairs UNION ALL SELECT b, a, weight FROM pairs), o AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY weight DESC, partner) AS rn FROM w)
SELECT country, count(*) AS partners, CAST(sum(weight) AS BIGINT) AS strength, max(partner) FILTER (rn = 1) AS top_partner, max(weight) AS top_weight FROM o GROUP BY country""")
def country_partners(r: Roles) -> DataFrame:
    return countries.partners(r.countries())


@query(_PAIRS + "SELECT * FROM pairs WHERE weight >= (SELECT quantile_cont(weight, 0.75) FROM pairs)")
def collaboration_backbone(r: Roles) -> DataFrame:
    return countries.backbone(primitives.pair_counts(r.countries(), "doc", "country"))


@query("""
, k AS (SELECT doc, count(*) AS k FROM countries GROUP BY doc), s AS (SELECT k > 1 AS m, citations AS c FROM k JOIN records USING (doc)),
t AS (SELECT count(c) FILTER (m) AS n1, count(c) FILTER (NOT m) AS n2, avg(c) FILTER (m) AS m1, avg(c) FILTER (NOT m) AS m2, var_samp(c) FILTER (m) AS v1, var_samp(c) FILTER (NOT m) AS v2 FROM s)
SELECT n1 AS n_multi, n2 AS n_single, round(m1, 6) AS mean_multi, round(m2, 6) AS mean_single, round(m1 - m2, 6) AS gap, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) AS cohens_d FROM t""")
def collaboration_premium(r: Roles) -> DataFrame:
    return countries.collaboration_premium(r.countries(), r.records())


@query("""
, k AS (SELECT doc, count(*) AS k FROM countries GROUP BY doc)
SELECT year, count(*) AS documents, count(*) FILTER (k > 1) AS mcp, round(count(*) FILTER (k > 1) / count(*), 6) AS mcp_share FROM k JOIN records USING (doc) GROUP BY year""")
def collaboration_share_by_year(r: Roles) -> DataFrame:
    return countries.multi_share_by_year(r.countries(), r.records())


@query("""
, k AS (SELECT doc, count(*) AS k FROM countries GROUP BY doc), c AS (SELECT country, count(*) AS "full", round(sum(1.0 / k), 9) AS fractional FROM countries JOIN k USING (doc) JOIN records USING (doc) GROUP BY country),
r2 AS (SELECT *, CAST(rank() OVER (ORDER BY "full" DESC) AS INTEGER) AS full_rank, CAST(rank() OVER (ORDER BY fractional DESC) AS INTEGER) AS fractional_rank FROM c)
SELECT country, "full", round(fractional, 6) AS fractional, full_rank, fractional_rank, fractional_rank - full_rank AS shift FROM r2""")
def counting_robustness(r: Roles) -> DataFrame:
    return countries.counting_robustness(r.countries(), r.records())


@query(_PANEL + """
, p AS (SELECT country, ln(articles + 1) AS x, ln(citations + 1) AS y FROM totals), l AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p), e AS (SELECT country, y - i - s * x AS e FROM p, l),
z AS (SELECT country, e, (e - avg(e) OVER ()) / stddev_samp(e) OVER () AS z FROM e)
SELECT country, round(e, 6) AS residual, round(z, 6) AS z, abs(z) >= 2 AS outlier FROM z""")
def country_outliers(r: Roles) -> DataFrame:
    return countries.outliers(countries.summary(_panel(r)))


@query(_PANEL + _PAIRS + """
, st AS (SELECT country, sum(weight) AS strength FROM (SELECT a AS country, weight FROM pairs UNION ALL SELECT b, weight FROM pairs) GROUP BY country),
j AS (SELECT country, articles, citations / CAST(articles AS DOUBLE) AS cited, coalesce(strength, 0) AS strength FROM totals LEFT JOIN st USING (country)), q AS (SELECT quantile_cont(articles, 0.8) AS qa, quantile_cont(cited, 0.8) AS qc, quantile_cont(strength, 0.8) AS qs FROM j)
SELECT country, CASE WHEN articles >= qa AND cited >= qc THEN 'leader' WHEN articles >= qa THEN 'producer' WHEN cited >= qc THEN 'influencer' WHEN strength >= qs THEN 'connector' ELSE 'follower' END AS role FROM j, q""")
def country_roles(r: Roles) -> DataFrame:
    return countries.roles(countries.summary(_panel(r)), countries.partners(r.countries()))


@query(_PANEL + """
, e AS (SELECT country, min(year) AS a, max(year) AS b, arg_min(articles, year) AS f, arg_max(articles, year) AS l FROM panel GROUP BY country),
p AS (SELECT ln(f) AS x, ln(l / CAST(f AS DOUBLE)) / (b - a) AS y FROM e WHERE b > a)
SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, count(*) AS points FROM p""")
def beta_convergence(r: Roles) -> DataFrame:
    return countries.beta_convergence(_panel(r))


@query(_PANEL + "SELECT year, round(stddev_samp(articles) / avg(articles), 6) AS cv, count(*) AS countries FROM panel GROUP BY year")
def sigma_convergence(r: Roles) -> DataFrame:
    return countries.sigma_convergence(_panel(r))


@query(_PANEL + """
, v AS (SELECT country, articles AS x, articles - avg(articles) OVER () AS d FROM totals), w AS (SELECT a.country AS a, b.country AS b FROM regions a JOIN regions b USING (region) WHERE a.country <> b.country),
s AS (SELECT count(*) AS w, sum(p.d * q.d) AS cr, sum((p.x - q.x) * (p.x - q.x)) AS gap FROM w JOIN v p ON a = p.country JOIN v q ON b = q.country), t AS (SELECT count(*) AS n, sum(d * d) AS ss FROM v)
SELECT round(n * cr / (w * ss), 6) AS morans_i, round((n - 1) * gap / (2 * w * ss), 6) AS gearys_c, round(-1.0 / (n - 1), 6) AS expected FROM s, t""")
def spatial_autocorrelation(r: Roles) -> DataFrame:
    values = countries.summary(_panel(r)).select("country", F.col("articles").alias("x"))
    return countries.morans_i(values, countries.region_weights(r.regions()))


# Sources


@query("""
, p AS (SELECT source, citations, year, row_number() OVER (PARTITION BY source ORDER BY citations DESC) AS rn, sum(citations) OVER (PARTITION BY source ORDER BY citations DESC ROWS UNBOUNDED PRECEDING) AS run FROM records WHERE source IS NOT NULL),
s AS (SELECT source, count(*) AS tp, CAST(sum(citations) AS BIGINT) AS tc, min(year) AS first_year, max(year) AS last_year, count(*) FILTER (citations >= rn) AS h_index, count(*) FILTER (run >= rn * rn) AS g_index, sum(citations) / CAST(count(*) AS DOUBLE) AS cpp FROM p GROUP BY source)
SELECT source, tp, tc, first_year, last_year, h_index, g_index, round(cpp, 6) AS cpp, round(tp / sum(tp) OVER (), 6) AS share, CAST(rank() OVER (ORDER BY tp DESC) AS INTEGER) AS rank_tp, CAST(rank() OVER (ORDER BY tc DESC) AS INTEGER) AS rank_tc,
       CAST(rank() OVER (ORDER BY round(cpp, 9) DESC) AS INTEGER) AS rank_cpp FROM s""")
def source_summary(r: Roles) -> DataFrame:
    return venues.summary(r.records())


@query("""
, p AS (SELECT source, year, count(*) AS articles FROM records WHERE source IS NOT NULL GROUP BY ALL), m AS (SELECT max(year) AS last FROM p),
e AS (SELECT source, min(year) AS first_year, max(year) AS last_year, arg_min(articles, year) AS first_value, arg_max(articles, year) AS last_value, regr_slope(articles, year) AS slope, regr_r2(articles, year) AS r2,
             CAST(coalesce(sum(articles) FILTER (year > last - 3), 0) AS BIGINT) AS recent FROM p, m GROUP BY source)
SELECT source, first_year, last_year, first_value, last_value, round(CASE WHEN last_year > first_year THEN pow(last_value / CAST(first_value AS DOUBLE), 1.0 / (last_year - first_year)) - 1 END, 6) AS cagr, round(slope, 6) AS slope, round(r2, 6) AS r2, recent FROM e""")
def source_growth(r: Roles) -> DataFrame:
    return venues.growth_table(venues.panel(r.records()))


@query("""
, c AS (SELECT source, keyword, count(*) AS n FROM keywords JOIN records USING (doc) WHERE source IS NOT NULL GROUP BY ALL), o AS (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, keyword) AS INTEGER) AS place FROM c)
SELECT * FROM o WHERE place <= 5""")
def source_keywords(r: Roles) -> DataFrame:
    return venues.source_keywords(r.records(), r.keywords())


@query("""
, c AS (SELECT source, keyword, count(*) AS n FROM keywords JOIN records USING (doc) WHERE source IS NOT NULL GROUP BY ALL), m AS (SELECT source, sqrt(sum(n * n)) AS norm FROM c GROUP BY source)
SELECT x.source AS a, y.source AS b, round(sum((x.n / p.norm) * (y.n / q.norm)), 6) AS cosine FROM c x JOIN c y USING (keyword) JOIN m p ON x.source = p.source JOIN m q ON y.source = q.source WHERE x.source < y.source GROUP BY ALL HAVING cosine >= 0.25""")
def source_similarity(r: Roles) -> DataFrame:
    return venues.similarity(r.records(), r.keywords())


@query(", vals AS (SELECT source AS g, count(*) AS x FROM keywords JOIN records USING (doc) WHERE source IS NOT NULL GROUP BY source, keyword), e AS (SELECT g, count(*) AS k, log2(sum(x)) - sum(x * log2(x)) / sum(x) AS h FROM vals GROUP BY g), i AS (SELECT g AS source, k AS keywords, 1 - coalesce(h / nullif(log2(k), 0), 0) AS s FROM e) SELECT source, keywords, round(s, 6) AS specialization, CASE WHEN s >= 0.66 THEN 'Specialist' WHEN s <= 0.33 THEN 'Generalist' ELSE 'Mixed' END AS scope FROM i")
def source_specialization(r: Roles) -> DataFrame:
    return venues.specialization(r.records(), r.keywords())


@query("""
, p AS (SELECT source, year, count(*) AS articles FROM records WHERE source IS NOT NULL GROUP BY ALL), g AS (SELECT source, min(year) AS f, max(year) AS l, arg_min(articles, year) AS fv, arg_max(articles, year) AS lv, CASE WHEN count(*) > 1 THEN regr_slope(articles, year) END AS s FROM p GROUP BY source),
c AS (SELECT *, CASE WHEN l > f THEN pow(lv / CAST(fv AS DOUBLE), 1.0 / (l - f)) - 1 END AS cagr, max(l) OVER () AS e FROM g)
SELECT source, CASE WHEN e - l > 2 THEN 'dormant' WHEN cagr > 0.10 AND s > 0 THEN 'emerging' WHEN s > 0 THEN 'growing' WHEN s < 0 THEN 'declining' ELSE 'mature' END AS stage, round(greatest(0, lv + coalesce(s, 0)), 6) AS forecast FROM c""")
def source_lifecycle(r: Roles) -> DataFrame:
    return venues.lifecycle(venues.growth_table(venues.panel(r.records())))


@query("""
, s AS (SELECT source, count(*) AS tp, avg(citations) AS cpp FROM records WHERE source IS NOT NULL GROUP BY source), m AS (SELECT median(tp) AS p, median(cpp) AS c FROM s),
d AS (SELECT *, sqrt(pow((tp - avg(tp) OVER ()) / stddev_samp(tp) OVER (), 2) + pow((cpp - avg(cpp) OVER ()) / stddev_samp(cpp) OVER (), 2)) AS distance FROM s), q AS (SELECT quantile_cont(distance, 0.9) AS cut FROM d)
SELECT source, CASE WHEN tp >= p AND cpp >= c THEN 'flagship' WHEN tp >= p THEN 'volume' WHEN cpp >= c THEN 'niche' ELSE 'peripheral' END AS archetype, round(distance, 6) AS distance, distance >= cut AS outlier FROM d, m, q""")
def source_archetypes(r: Roles) -> DataFrame:
    return venues.archetypes(venues.summary(r.records()))


@query()
def source_clusters(r: Roles) -> DataFrame:
    made = venues.features(venues.summary(r.records()), venues.growth_table(venues.panel(r.records())))
    return venues.clusters(made, ["f_tp", "f_tc", "f_h", "cpp", "f_slope"])


# Networks


@query("SELECT a.keyword AS a, b.keyword AS b, count(*) AS weight FROM keywords a JOIN keywords b USING (doc) WHERE a.keyword < b.keyword GROUP BY ALL")
def keyword_cooccurrence(r: Roles) -> DataFrame:
    return networks.cooccurrence(r.keywords(), "keyword")


_EDGES = ", e AS (SELECT a.keyword AS a, b.keyword AS b, count(*) AS weight FROM keywords a JOIN keywords b USING (doc) WHERE a.keyword < b.keyword GROUP BY ALL), w AS (SELECT a AS node, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e), d AS (SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM w GROUP BY node)"


@query(_EDGES + "SELECT * FROM d")
def keyword_degrees(r: Roles) -> DataFrame:
    return networks.degrees(networks.cooccurrence(r.keywords(), "keyword"))


@query(_EDGES + ", x AS (SELECT count(*) AS nodes, avg(degree) AS m FROM d), y AS (SELECT count(*) AS edges, avg(weight) AS w, max(weight) AS max_weight FROM e) SELECT nodes, round(m, 6) AS mean_degree, edges, round(w, 6) AS mean_weight, max_weight, round(2.0 * edges / (nodes * (nodes - 1)), 6) AS density FROM x, y")
def keyword_network_summary(r: Roles) -> DataFrame:
    return networks.network_summary(networks.cooccurrence(r.keywords(), "keyword"))


_COAUTHORS = ", e AS (SELECT a.author AS a, b.author AS b, count(*) AS weight FROM authors a JOIN authors b USING (doc) WHERE a.author < b.author GROUP BY ALL HAVING count(*) >= 3), w AS (SELECT a AS node, b AS other, weight FROM e UNION ALL SELECT b, a, weight FROM e), d AS (SELECT node, count(*) AS degree FROM w GROUP BY node)"


def _coauthors(r: Roles) -> DataFrame:
    return networks.cooccurrence(r.authors(), "author").where("weight >= 3")


@query(_COAUTHORS + """
, t AS (SELECT x.node, count(*) / 2 AS t FROM w x JOIN w y ON x.node = y.node JOIN w z ON x.other = z.node AND y.other = z.other WHERE x.other <> y.other GROUP BY x.node)
SELECT node, degree, CAST(coalesce(t, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM d LEFT JOIN t USING (node)""")
def coauthor_clustering(r: Roles) -> DataFrame:
    return networks.clustering(_coauthors(r))


@query(_COAUTHORS + ", reach(node, other) AS (SELECT node, node FROM d UNION SELECT reach.node, w.other FROM reach JOIN w ON reach.other = w.node) SELECT node, min(other) AS component FROM reach GROUP BY node")
def coauthor_components(r: Roles) -> DataFrame:
    return networks.components(_coauthors(r))


@query()
def keyword_communities(r: Roles) -> DataFrame:
    return networks.communities(networks.cooccurrence(r.keywords(), "keyword"))


@query()
def keyword_thematic_map(r: Roles) -> DataFrame:
    edges = networks.cooccurrence(r.keywords(), "keyword")
    return networks.thematic_map(edges, modularity.communities(edges))


@query(_EDGES + """
, mx AS (SELECT a.node, list(coalesce(w.weight, 0)::DOUBLE ORDER BY b.node) AS row FROM d a CROSS JOIN d b LEFT JOIN w ON w.node = a.node AND w.other = b.node GROUP BY a.node), al AS (SELECT list(row ORDER BY node) AS m, list(node ORDER BY node) AS nodes FROM mx),
pw AS (SELECT 0 AS i, m, nodes, list_transform(nodes, lambda x: 1.0::DOUBLE) AS v FROM al UNION ALL
  SELECT i + 1, m, nodes, list_transform(z, lambda x: x / list_max(z)) FROM (SELECT i, m, nodes, list_transform(m, lambda r, k: list_dot_product(r, v) + v[k]) AS z FROM pw WHERE i < 300))
SELECT unnest(nodes) AS node, round(unnest(v), 6) AS score FROM pw WHERE i = 300""")
def keyword_eigenvector(r: Roles) -> DataFrame:
    return networks.eigenvector(networks.cooccurrence(r.keywords(), "keyword"))


_HOPS = _EDGES + ", r(s, n, h) AS (SELECT node, node, 0 FROM d UNION SELECT s, other, h + 1 FROM r JOIN w ON n = node WHERE h < 12), m AS (SELECT s, n, min(h) AS h FROM r GROUP BY ALL)"


@query(_HOPS + " SELECT s AS node, count(*) AS reached, round(avg(h), 6) AS mean_distance, round(count(*) / sum(h), 6) AS closeness FROM m WHERE h > 0 GROUP BY s")
def keyword_closeness(r: Roles) -> DataFrame:
    edges = networks.cooccurrence(r.keywords(), "keyword")
    return networks.closeness(edges, networks.degrees(edges).select("node"))


@query(_HOPS + """
, p(s, n, h, c) AS (SELECT node, node, 0, CAST(1 AS DOUBLE) FROM d UNION ALL SELECT p.s, w.other, p.h + 1, sum(p.c) FROM p JOIN w ON p.n = w.node JOIN m ON m.s = p.s AND m.n = w.other AND m.h = p.h + 1 GROUP BY p.s, w.other, p.h + 1),
b AS (SELECT v.n AS node, sum(v.c * u.c / t.c) / 2 AS b FROM p v JOIN p u ON u.s = v.n JOIN p t ON t.s = v.s AND t.n = u.n AND t.h = v.h + u.h WHERE v.s <> v.n AND u.s <> u.n AND v.s <> u.n GROUP BY v.n)
SELECT node, round(coalesce(b, 0), 6) AS betweenness FROM d LEFT JOIN b USING (node)""")
def keyword_betweenness(r: Roles) -> DataFrame:
    edges = networks.cooccurrence(r.keywords(), "keyword")
    return networks.betweenness(edges, networks.degrees(edges).select("node"))


@query("""
, a AS (SELECT DISTINCT p_name, p_brand FROM lines), o AS (SELECT p_name, count(*) AS out FROM a GROUP BY p_name), k AS (SELECT (SELECT count(*) FROM o)::DOUBLE AS n, (SELECT count(DISTINCT p_brand) FROM a)::DOUBLE AS b),
u AS (SELECT 0.15 / (n + b) / (1 - 0.85 * (b + 0.85 * n) / (n + b)) AS u FROM k)
SELECT p_name AS node, round(u, 6) AS rank FROM o, u UNION ALL SELECT p_brand, round(any_value(u) * (1 + 0.85 * sum(1.0 / out)), 6) FROM a JOIN o USING (p_name), u GROUP BY p_brand""")
def brand_pagerank(r: Roles) -> DataFrame:
    arcs = r.lines().select(F.col("p_name").alias("src"), F.col("p_brand").alias("dst")).distinct()
    return networks.pagerank(arcs)


@query(", h AS (SELECT DISTINCT p_brand AS doc, p_name AS reference FROM part) SELECT a.doc AS a, b.doc AS b, count(*) AS weight FROM h a JOIN h b USING (reference) WHERE a.doc < b.doc GROUP BY ALL")
def bibliographic_coupling(r: Roles) -> DataFrame:
    return networks.coupling(r.table("part").select(F.col("p_brand").alias("doc"), F.col("p_name").alias("reference")).distinct())


@query(", h AS (SELECT DISTINCT p_brand AS doc, p_name AS reference FROM part) SELECT a.reference AS a, b.reference AS b, count(*) AS weight FROM h a JOIN h b USING (doc) WHERE a.reference < b.reference GROUP BY ALL")
def cocitation(r: Roles) -> DataFrame:
    return networks.cocitation(r.table("part").select(F.col("p_brand").alias("doc"), F.col("p_name").alias("reference")).distinct())


# Annual series: one a document type

_SERIES = ", s AS (SELECT doc_type, year, count(*) AS articles FROM records GROUP BY ALL)"


def _series(r: Roles) -> DataFrame:
    return r.records().groupBy("doc_type", "year").agg(F.count("*").alias("articles"))


@query(_SERIES + """
SELECT doc_type, count(*) AS years, CAST(sum(articles) AS BIGINT) AS total, arg_max(year, articles * 10000 - year) AS peak_year, max(articles) AS peak, round(avg(articles), 6) AS mean, round(median(articles), 6) AS median, round(stddev_samp(articles), 6) AS sd,
       min(year) AS first_year, max(year) AS last_year, round(pow(arg_max(articles, year) / CAST(arg_min(articles, year) AS DOUBLE), 1.0 / (max(year) - min(year))) - 1, 6) AS cagr, round(stddev_samp(articles) / avg(articles), 6) AS cv FROM s GROUP BY doc_type""")
def series_description(r: Roles) -> DataFrame:
    return series.describe(_series(r), ["doc_type"])


@query(_SERIES + """
SELECT *, round(CASE WHEN count(*) OVER w3 = 3 THEN avg(articles) OVER w3 END, 6) AS ma3, round(CASE WHEN count(*) OVER w5 = 5 THEN avg(articles) OVER w5 END, 6) AS ma5 FROM s
WINDOW w3 AS (PARTITION BY doc_type ORDER BY year ROWS 2 PRECEDING), w5 AS (PARTITION BY doc_type ORDER BY year ROWS 4 PRECEDING)""")
def series_moving_averages(r: Roles) -> DataFrame:
    return series.smoothed(_series(r), ["doc_type"], (3, 5))


@query(_SERIES + """
, z AS (SELECT *, (articles - avg(articles) OVER w) / stddev_samp(articles) OVER w AS z FROM s WINDOW w AS (PARTITION BY doc_type)), q AS (SELECT doc_type, quantile_cont(articles, 0.25) AS q1, quantile_cont(articles, 0.75) AS q3 FROM s GROUP BY doc_type)
SELECT doc_type, year, articles, round(z, 6) AS z, abs(z) > 3 AS anomaly, articles < q1 - 1.5 * (q3 - q1) OR articles > q3 + 1.5 * (q3 - q1) AS outlier FROM z JOIN q USING (doc_type)""")
def series_anomalies(r: Roles) -> DataFrame:
    return series.anomalies(_series(r), ["doc_type"])


@query(_SERIES + """
, p AS (SELECT a.doc_type, sum(sign(b.articles - a.articles)) AS s, median((b.articles - a.articles) / (b.year - a.year)) AS sen FROM s a JOIN s b ON a.doc_type = b.doc_type AND a.year < b.year GROUP BY a.doc_type),
t AS (SELECT doc_type, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT doc_type, articles, count(*) AS t FROM s GROUP BY ALL) GROUP BY doc_type),
v AS (SELECT doc_type, s, sen, n, (n * (n - 1) * (2 * n + 5) - ties) / 18.0 AS variance FROM p JOIN t USING (doc_type))
SELECT doc_type, CAST(s AS DOUBLE) AS s, round(sen, 6) AS sen_slope, CAST(n AS BIGINT) AS n, round(variance, 6) AS variance, round((s - sign(s)) / sqrt(variance), 6) AS z FROM v""")
def series_mann_kendall(r: Roles) -> DataFrame:
    return series.mann_kendall(_series(r), ["doc_type"])


@query(_SERIES + """
, v AS (SELECT a.doc_type, a.year, sum(sign(a.articles - b.articles)) AS v, count(*) AS n FROM s a JOIN s b ON a.doc_type = b.doc_type GROUP BY ALL), u AS (SELECT *, abs(sum(v) OVER (PARTITION BY doc_type ORDER BY year)) AS u FROM v)
SELECT doc_type, CAST(max(u) AS DOUBLE) AS k, arg_max(year, u * 10000 - year) AS year, max(n) AS n, round(least(1, 2 * exp(-6 * max(u) * max(u) / (pow(max(n), 3) + pow(max(n), 2)))), 6) AS p_value FROM u GROUP BY doc_type""")
def series_pettitt(r: Roles) -> DataFrame:
    return series.pettitt(_series(r), ["doc_type"])


_SHIFT = _SERIES + ", x AS (SELECT *, row_number() OVER w AS i, count(*) OVER v AS n, CAST(sum(articles) OVER w AS DOUBLE) AS r, CAST(sum(articles) OVER v AS DOUBLE) AS a, sum(articles * articles) OVER v AS q FROM s WINDOW w AS (PARTITION BY doc_type ORDER BY year), v AS (PARTITION BY doc_type)), g AS (SELECT *, r * r / i + (a - r) * (a - r) / (n - i) - a * a / n AS gain FROM x WHERE i < n), b AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY round(gain, 9) DESC, year) AS p FROM g)"


@query(_SHIFT + " SELECT doc_type, year, round(gain, 6) AS gain, round(gain * (n - 2) / (q - a * a / n - gain), 6) AS f FROM b WHERE p = 1")
def series_mean_shift(r: Roles) -> DataFrame:
    return series.mean_shift(_series(r), ["doc_type"])


@query(_SHIFT + """
, pv AS (SELECT a.doc_type, a.year, sum(sign(a.articles - b.articles)) AS v FROM s a JOIN s b ON a.doc_type = b.doc_type GROUP BY ALL), pu AS (SELECT *, abs(sum(v) OVER (PARTITION BY doc_type ORDER BY year)) AS u FROM pv),
cd AS (SELECT *, articles - avg(articles) OVER (PARTITION BY doc_type) AS d FROM s), cu AS (SELECT *, abs(sum(d) OVER (PARTITION BY doc_type ORDER BY year)) AS u FROM cd), cs AS (SELECT c.doc_type, c.year, round(u / (stddev_samp(articles) OVER (PARTITION BY c.doc_type) * sqrt(count(*) OVER (PARTITION BY c.doc_type))), 9) AS u FROM cu c),
found AS (SELECT doc_type, year, 'mean_shift' AS method FROM b WHERE p = 1 UNION ALL SELECT doc_type, arg_max(year, u * 10000 - year), 'pettitt' FROM pu GROUP BY doc_type
          UNION ALL SELECT doc_type, year, 'cusum' FROM (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY u DESC, year) AS p FROM cs) WHERE p = 1)
SELECT f.doc_type, f.method, f.year, count(*) AS votes, count(*) >= 2 AS consensus FROM found f JOIN found o ON f.doc_type = o.doc_type AND abs(f.year - o.year) <= 2 GROUP BY ALL""")
def series_change_consensus(r: Roles) -> DataFrame:
    return series.change_consensus(_series(r), ["doc_type"])


@query(_SERIES + """
, c AS (SELECT *, articles - avg(articles) OVER (PARTITION BY doc_type) AS d FROM s), p AS (SELECT *, sum(d) OVER (PARTITION BY doc_type ORDER BY year) AS c FROM c)
SELECT doc_type, count(*) AS n, round(ln((max(c) - min(c)) / stddev_samp(articles)) / ln(count(*)), 6) AS hurst FROM p GROUP BY doc_type""")
def series_hurst(r: Roles) -> DataFrame:
    return series.hurst(_series(r), ["doc_type"])


@query(_SERIES + """
, l AS (SELECT doc_type, regr_slope(articles, year) AS b, regr_intercept(articles, year) AS a FROM s GROUP BY doc_type), e AS (SELECT doc_type, year, articles - a - b * year AS e, lag(articles - a - b * year) OVER (PARTITION BY doc_type ORDER BY year) AS e1 FROM s JOIN l USING (doc_type)),
t AS (SELECT doc_type, count(*) AS n, sum(e * e) AS ss, sum(e * e1) AS cr, sum((e - e1) * (e - e1)) AS df, regr_r2(e * e, year) AS r2 FROM e GROUP BY doc_type)
SELECT doc_type, n, round(df / ss, 6) AS durbin_watson, round(cr / ss, 6) AS lag1, round(n * (n + 2) * (cr / ss) * (cr / ss) / (n - 1), 6) AS ljung_box, round(n * r2, 6) AS breusch_pagan FROM t""")
def series_residual_checks(r: Roles) -> DataFrame:
    return series.residual_checks(_series(r), ["doc_type"])


@query(_SERIES + """
, x AS (SELECT *, lag(articles) OVER w AS l, row_number() OVER w - 1 AS n, avg(articles) OVER (PARTITION BY doc_type ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, first_value(articles) OVER w AS f FROM s WINDOW w AS (PARTITION BY doc_type ORDER BY year)),
y AS (SELECT doc_type, n, abs(articles - l) AS step, articles, 'naive' AS model, CAST(l AS DOUBLE) AS p FROM x UNION ALL SELECT doc_type, n, abs(articles - l), articles, 'mean', m FROM x UNION ALL SELECT doc_type, n, abs(articles - l), articles, 'drift', l + CASE WHEN n <> 1 THEN (l - f) / CAST(n - 1 AS DOUBLE) ELSE 0 END FROM x)
SELECT doc_type, model, count(*) FILTER (n >= 3) AS folds, round(avg(abs(articles - p)) FILTER (n >= 3), 6) AS mae, round(sqrt(avg((articles - p) * (articles - p)) FILTER (n >= 3)), 6) AS rmse, round(avg(abs(articles - p)) FILTER (n >= 3) / avg(step), 6) AS mase FROM y GROUP BY doc_type, model""")
def series_rolling_baselines(r: Roles) -> DataFrame:
    return series.rolling_baselines(_series(r), ["doc_type"], 3)


@query(_SERIES + """
, v AS (SELECT doc_type, CAST(articles AS DOUBLE) AS y, row_number() OVER (PARTITION BY doc_type ORDER BY year) AS i FROM s),
h(doc_type, i, l, b) AS (SELECT a.doc_type, CAST(1 AS BIGINT), a.y, o.y - a.y FROM v a JOIN v o ON a.doc_type = o.doc_type AND a.i = 1 AND o.i = 2
   UNION ALL SELECT h.doc_type, v.i, 0.3 * y + 0.7 * (l + b), 0.1 * (0.3 * y + 0.7 * (l + b) - l) + 0.9 * b FROM h JOIN v ON v.doc_type = h.doc_type AND v.i = h.i + 1),
e AS (SELECT doc_type, arg_max(l, i) AS l, arg_max(b, i) AS b FROM h GROUP BY doc_type), z AS (SELECT doc_type, max(year) AS y FROM s GROUP BY doc_type)
SELECT doc_type, CAST(y + k AS INTEGER) AS year, round(l + k * b, 6) AS forecast FROM e JOIN z USING (doc_type), range(1, 6) r(k)""")
def series_holt_forecast(r: Roles) -> DataFrame:
    return series.holt_forecast(_series(r), ["doc_type"])


@query()
def series_curves(r: Roles) -> DataFrame:
    return series.fit_curves(_series(r), ["doc_type"]).select("doc_type", "model", "r2", "adj_r2", "rmse", "mae", "aic", "bic", "weight", "rank")


@query(_SERIES + """
, l AS (SELECT doc_type, regr_slope(articles, year) AS b, regr_intercept(articles, year) AS a FROM s GROUP BY doc_type), e AS (SELECT doc_type, articles - a - b * year AS e, row_number() OVER (PARTITION BY doc_type ORDER BY year) - 1 AS t, count(*) OVER (PARTITION BY doc_type) AS n FROM s JOIN l USING (doc_type)),
f AS (SELECT doc_type, k AS frequency, n, sum(e * cos(2 * pi() * k * t / n)) AS c, sum(e * sin(2 * pi() * k * t / n)) AS q FROM e, range(1, 1000) r(k) WHERE n >= 4 AND k <= n // 2 GROUP BY ALL), w AS (SELECT doc_type, frequency, n / frequency AS period, (c * c + q * q) / n AS power FROM f)
SELECT doc_type, CAST(frequency AS INTEGER) AS frequency, round(period, 6) AS period, round(power, 6) AS power, round(power / sum(power) OVER (PARTITION BY doc_type), 6) AS share FROM w""")
def series_spectrum(r: Roles) -> DataFrame:
    return series.spectrum(_series(r), ["doc_type"])


@query(_SERIES + "SELECT doc_type, count(*) AS n, round(avg(articles), 6) AS mean, round(var_samp(articles) / avg(articles), 6) AS dispersion FROM s GROUP BY doc_type")
def series_dispersion(r: Roles) -> DataFrame:
    return series.poisson_dispersion(_series(r), ["doc_type"])


# Tests


@query("""
, k AS (SELECT doc, count(*) > 1 AS m FROM countries GROUP BY doc), v AS (SELECT citations AS v, m AS g FROM k JOIN records USING (doc)), a AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM v),
s AS (SELECT count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n2, sum(r) FILTER (g) AS w FROM a)
SELECT n1, n2, round(w - n1 * (n1 + 1) / 2, 6) AS u FROM s""")
def citation_rank_sum(r: Roles) -> DataFrame:
    multi = r.countries().groupBy("doc").agg((F.count("*") > 1).alias("multi")).join(r.records(), "doc")
    return stats.rank_sum(multi, "citations", F.col("multi")).select("n1", "n2", "u")


@query("""
, v AS (SELECT citations AS v, doc_type AS g FROM records), a AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM v),
s AS (SELECT g, sum(r) AS r, count(*) AS k FROM a GROUP BY g), q AS (SELECT sum(r * r / k) AS q, sum(k) AS n, count(*) - 1 AS df FROM s), t AS (SELECT sum(CAST(t AS DOUBLE) * t * t - t) AS ties FROM (SELECT v, count(*) AS t FROM v GROUP BY v)),
h AS (SELECT n, df, (12 / (CAST(n AS DOUBLE) * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (CAST(n AS DOUBLE) * n * n - n)) AS h FROM q, t)
SELECT CAST(n AS BIGINT) AS n, df, round(h, 6) AS h, round(h / (n - 1), 6) AS epsilon_squared FROM h""")
def citations_kruskal(r: Roles) -> DataFrame:
    return stats.kruskal(r.records(), "citations", "doc_type").select("n", "df", "h", "epsilon_squared")


@query(_PANEL + """
, a AS (SELECT rank() OVER (ORDER BY articles) + (count(*) OVER (PARTITION BY articles) - 1) / 2.0 AS x, rank() OVER (ORDER BY citations) + (count(*) OVER (PARTITION BY citations) - 1) / 2.0 AS y FROM totals)
SELECT round(corr(x, y), 6) AS rho, count(*) AS n, round(corr(x, y) * sqrt(count(*) - 1), 6) AS z FROM a""")
def production_impact_spearman(r: Roles) -> DataFrame:
    return stats.spearman(countries.summary(_panel(r)), "articles", "citations")


@query("""
, d AS (SELECT CAST(substr(CAST(citations AS VARCHAR), 1, 1) AS INTEGER) AS digit, count(*) AS n FROM records WHERE citations > 0 GROUP BY 1), g AS (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS digit),
j AS (SELECT digit, coalesce(n, 0) AS n, log10(1 + 1.0 / digit) AS e, sum(coalesce(n, 0)) OVER () AS t FROM g LEFT JOIN d USING (digit))
SELECT digit, n, round(n / t, 6) AS observed, round(e, 6) AS expected, round(sum((n - e * t) * (n - e * t) / (e * t)) OVER (), 6) AS chi_square FROM j""")
def citations_benford(r: Roles) -> DataFrame:
    return stats.benford(r.records(), "citations")


@query("""
, m AS (SELECT doc_type, median(citations) AS m FROM records GROUP BY doc_type), d AS (SELECT doc_type, abs(citations - m) AS d FROM records JOIN m USING (doc_type)), g AS (SELECT doc_type, count(*) AS n, avg(d) AS m, sum(d * d) AS q FROM d GROUP BY doc_type),
s AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m * m) AS b, sum(n * m) AS t, sum(q) AS q FROM g)
SELECT k - 1 AS df1, CAST(n - k AS BIGINT) AS df2, round(((b - t * t / n) / (k - 1)) / ((q - b) / (n - k)), 6) AS f FROM s""")
def citations_levene(r: Roles) -> DataFrame:
    return stats.levene(r.records(), "citations", "doc_type")


@query()
def citations_bootstrap(r: Roles) -> DataFrame:
    return stats.bootstrap_mean(r.records(), "citations")


# Text functions over documents


@query("SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(lower(translate(text, 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝß', 'aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYs')), '&amp;|&', ' and ', 'g'), '[^a-z0-9]+', ' ', 'g')), '') AS title_key FROM documents")
def title_keys(r: Roles) -> DataFrame:
    return r.table("documents").select("doc_id", T.title_key(F.col("text")).alias("title_key"))


@query("""
, p AS (SELECT lang, text, ' ' || regexp_replace(lower(text), '[^\\p{L}]+', '  ', 'g') || ' ' AS w FROM documents),
h AS (SELECT lang, text, """ + ", ".join(f"len(regexp_extract_all(w, ' ({'|'.join(words)}) ')) AS {name}" for name, words in T.STOP_WORDS.items()) + """, len(regexp_extract_all(text, '[一-鿿]')) AS ideographs FROM p), m AS (SELECT *, greatest(en, es, fr, de) AS most FROM h)
SELECT lang, CASE WHEN ideographs > 0.3 * length(text) THEN 'chinese' WHEN most = 0 THEN 'unknown' WHEN en = most THEN 'en' WHEN es = most THEN 'es' WHEN fr = most THEN 'fr' WHEN de = most THEN 'de' END AS found, count(*) AS documents FROM m GROUP BY ALL""")
def language_by_stop_words(r: Roles) -> DataFrame:
    found = r.table("documents").select("lang", T.language(F.col("text")).alias("found"))
    return found.groupBy("lang", "found").agg(F.count("*").alias("documents"))


@query("SELECT doc_id, list_sort(list_distinct(regexp_extract_all(lower(text), '([a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,})', 1)))::VARCHAR AS emails FROM documents WHERE text IS NOT NULL AND regexp_matches(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,}')")
def email_addresses(r: Roles) -> DataFrame:
    found = r.table("documents").select("doc_id", F.array_sort(T.emails(F.col("text"))).alias("e")).where(F.size("e") > 0)
    return found.select("doc_id", F.concat(F.lit("["), F.array_join("e", ", "), F.lit("]")).alias("emails"))


# Screening: labels as the decisions of two reviewers, quality and toxicity


def _ledger(r: Roles) -> DataFrame:
    label = r.table("labels")
    quality = label.select(F.col("doc_id").alias("doc"), F.lit("screening").alias("stage"), F.lit("r1").alias("reviewer"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"), F.lit("low quality").alias("reason"), F.lit(False).alias("is_final"))
    return quality.unionByName(label.select(F.col("doc_id").alias("doc"), F.lit("screening").alias("stage"), F.lit("r2").alias("reviewer"), F.when(F.col("toxic") == 0, "include").otherwise("exclude").alias("decision"), F.lit("toxic").alias("reason"), F.lit(False).alias("is_final")))


_LEDGER = ", l AS (SELECT doc_id AS doc, 'r1' AS reviewer, CASE WHEN quality = 1 THEN 'include' ELSE 'exclude' END AS decision FROM labels UNION ALL SELECT doc_id, 'r2', CASE WHEN toxic = 0 THEN 'include' ELSE 'exclude' END FROM labels), v AS (SELECT doc, count(*) FILTER (decision = 'include') AS i, count(*) FILTER (decision = 'exclude') AS x FROM l GROUP BY doc)"


@query(_LEDGER + " SELECT 'screening' AS stage, CASE WHEN i = x THEN 'conflict' WHEN i > x THEN 'include' ELSE 'exclude' END AS decision, count(*) AS documents FROM v GROUP BY ALL")
def screening_decisions(r: Roles) -> DataFrame:
    return screening.decision_counts(screening.consensus(screening.standardise(_ledger(r))))


@query(_LEDGER + """
, p AS (SELECT a.doc, a.decision AS da, b.decision AS db FROM (SELECT doc, max(decision) AS decision FROM l WHERE reviewer = 'r1' GROUP BY doc) a JOIN (SELECT doc, max(decision) AS decision FROM l WHERE reviewer = 'r2' GROUP BY doc) b USING (doc)),
s AS (SELECT count(*) AS n, avg(CASE WHEN da = db THEN 1.0 ELSE 0.0 END) AS o, avg(CASE WHEN da = 'include' THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN db = 'include' THEN 1.0 ELSE 0.0 END) AS b FROM p), k AS (SELECT *, a * b + (1 - a) * (1 - b) AS e FROM s)
SELECT 'screening' AS stage, 'r1' AS reviewer_a, 'r2' AS reviewer_b, n, round(o, 6) AS agreement, round((o - e) / (1 - e), 6) AS kappa FROM k""")
def screening_kappa(r: Roles) -> DataFrame:
    return screening.cohens_kappa(screening.standardise(_ledger(r))).drop("level")


@query(_LEDGER + """
, k AS (SELECT doc, decision, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT doc, sum(n) AS m, sum(n * (n - 1)) AS same FROM k GROUP BY doc HAVING sum(n) > 1), o AS (SELECT avg(same / (m * (m - 1))) AS observed, count(*) AS documents FROM g),
e AS (SELECT decision, sum(n) AS n FROM k JOIN g USING (doc) GROUP BY decision), c AS (SELECT sum(p * p) AS chance FROM (SELECT n / sum(n) OVER () AS p FROM e))
SELECT 'screening' AS stage, round(observed, 6) AS observed, documents, round(chance, 6) AS chance, round(CASE WHEN chance < 1 THEN (observed - chance) / (1 - chance) ELSE 1 END, 6) AS kappa FROM o, c""")
def screening_fleiss(r: Roles) -> DataFrame:
    return screening.fleiss_kappa(_ledger(r))


@query(_LEDGER + """
, k AS (SELECT doc, decision, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT *, sum(n) OVER (PARTITION BY doc) AS m FROM k), u AS (SELECT * FROM g WHERE m > 1), d AS (SELECT sum(n * (m - n) / (m - 1)) AS differ, sum(n) AS ratings FROM u), t AS (SELECT sum(n) * sum(n) - sum(n * n) AS pairs FROM (SELECT decision, sum(n) AS n FROM u GROUP BY decision))
SELECT 'screening' AS stage, CAST(ratings AS BIGINT) AS ratings, round(CASE WHEN pairs > 0 THEN 1 - differ / (pairs / (ratings - 1)) ELSE 1 END, 6) AS alpha FROM d, t""")
def screening_alpha(r: Roles) -> DataFrame:
    return screening.krippendorff_alpha(_ledger(r))


@query(_LEDGER + """
, c AS (SELECT count(DISTINCT doc) AS screened, count(DISTINCT CASE WHEN x > i THEN doc END) AS excluded FROM v), i AS (SELECT count(*) AS identified FROM documents)
SELECT identified, screened, excluded AS screening_excluded, 0 AS assessed, 0 AS eligibility_excluded, 0 AS included, identified >= screened AS monotone FROM i, c""")
def screening_prisma(r: Roles) -> DataFrame:
    return screening.prisma(screening.consensus(screening.standardise(_ledger(r))), r.table("documents"))


from . import catalog_models, catalog_more, catalog_profiles  # noqa: E402, F401  registers further queries
