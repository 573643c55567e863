"""Queries of fitted models: regressions, lag models, break points, networks by permutation, distributions.

Registered with those of ``catalog``, which imports this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _PANEL, _SERIES, _panel, _series, query
from .functions import stats
from .operators import goodness, hypotheses, modularity, networks, permutation, regression, segments
from .plans.roles import Roles


def ols_sql(name: str, source: str, keys: list[str], y: str, xs: list[str]) -> str:
    """Common table expressions ``<name>`` with the normal equations of ``source`` solved by elimination: per key ``n, my`` and ``mx``
    (means), ``sst``, ``sse``, ``m`` (the eliminated [C | c | I], so m[i][p + 1] is the i-th coefficient), ``used`` (which predictors do
    not depend on those before them) and ``rank`` (how many)."""
    p, by = len(xs), ", ".join(keys)
    known = " AND ".join(f"{c} IS NOT NULL" for c in (y, *xs))
    d = [f"(r.{x} - mx[{i}])" for i, x in enumerate(xs, 1)]
    rows = ", ".join("[" + ", ".join([*(f"sum({a} * {b})" for b in d), f"sum({a} * (r.{y} - my))", *(f"{int(i == j)}::DOUBLE" for j in range(p))]) + "]" for i, a in enumerate(d))
    return f"""
, {name}_r AS (SELECT {by}, {y}::DOUBLE AS {y}, {", ".join(f"{x}::DOUBLE AS {x}" for x in xs)} FROM {source} WHERE {known}),
{name}_a AS (SELECT {by}, count(*) AS n, avg({y}) AS my, [{", ".join(f"avg({x})" for x in xs)}] AS mx FROM {name}_r GROUP BY {by}),
{name}_g AS (SELECT {by}, any_value(n) AS n, any_value(my) AS my, any_value(mx) AS mx, sum((r.{y} - my) ** 2) AS sst, [{rows}] AS m FROM {name}_r r JOIN {name}_a USING ({by}) GROUP BY {by}),
{name}_e AS (SELECT {by}, n, my, mx, sst, m AS g, 0 AS k, m, CAST([] AS BOOLEAN[]) AS used FROM {name}_g UNION ALL
  SELECT {by}, n, my, mx, sst, g, k + 1, CASE WHEN m[k + 1][k + 1] > 1e-10 * g[k + 1][k + 1] THEN list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[k + 1]) ELSE list_transform(row, lambda v, j: v - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) ELSE m END,
    list_append(used, m[k + 1][k + 1] > 1e-10 * g[k + 1][k + 1]) FROM {name}_e WHERE k < {p}),
{name} AS (SELECT {by}, n, my, mx, sst, m, used, len(list_filter(used, lambda u: u)) AS rank, sst - {" - ".join(f"CASE WHEN used[{i}] THEN m[{i}][{p + 1}] * g[{i}][{p + 1}] ELSE 0 END" for i in range(1, p + 1))} AS sse FROM {name}_e WHERE k = {p})"""


def coefficients_sql(name: str, keys: list[str], xs: list[str]) -> str:
    """A SELECT of ``keys, term, coefficient, std_error, t`` from ``ols_sql``'s table."""
    p, by = len(xs), ", ".join(keys)
    s2 = "sse / (n - rank - 1)"
    quad = " + ".join(f"CASE WHEN used[{i}] AND used[{j}] THEN mx[{i}] * mx[{j}] * m[{i}][{p + 1 + j}] ELSE 0 END" for i in range(1, p + 1) for j in range(1, p + 1))
    constant = "my - " + " - ".join(f"CASE WHEN used[{i}] THEN m[{i}][{p + 1}] * mx[{i}] ELSE 0 END" for i in range(1, p + 1))
    terms = [f"SELECT {by}, 'constant' AS term, {constant} AS b, sqrt({s2} * (1.0 / n + {quad})) AS e FROM {name}"]
    terms += [f"SELECT {by}, '{x}', CASE WHEN used[{i}] THEN m[{i}][{p + 1}] END, CASE WHEN used[{i}] THEN sqrt({s2} * m[{i}][{p + 1 + i}]) END FROM {name}" for i, x in enumerate(xs, 1)]
    return f"SELECT {by}, term, round(b, 6) AS coefficient, round(e, 6) AS std_error, round(b / e, 6) AS t FROM ({' UNION ALL '.join(terms)})"


# Regressions with several predictors

_FEATURES = """
, na AS (SELECT doc, count(*) AS authors FROM authors GROUP BY doc), nc AS (SELECT doc, count(*) AS places FROM countries GROUP BY doc), nk AS (SELECT doc, count(*) AS keywords FROM keywords GROUP BY doc),
ft AS (SELECT DISTINCT region, doc, citations, authors, places, keywords, year FROM records JOIN na USING (doc) JOIN nc USING (doc) JOIN nk USING (doc) JOIN countries USING (doc) JOIN regions USING (country))"""
_XS = ["authors", "places", "keywords", "year"]


def _features(r: Roles) -> DataFrame:
    """Per region and document of it: citations, authors, countries, keywords, year."""
    counted = r.records().select("doc", "citations", "year")
    for table, name in ((r.authors(), "authors"), (r.countries(), "places"), (r.keywords(), "keywords")):
        counted = counted.join(table.groupBy("doc").agg(F.count("*").alias(name)), "doc")
    regions = r.countries().join(r.regions(), "country").select("doc", "region").distinct()
    return counted.join(regions, "doc").select("region", "doc", "citations", *_XS)


@query(_FEATURES + ols_sql("o", "ft", ["region"], "citations", _XS) + coefficients_sql("o", ["region"], _XS))
def regression_by_region(r: Roles) -> DataFrame:
    return regression.coefficients(_features(r), ["region"], "citations", _XS).drop("p_value")


@query(_FEATURES + ols_sql("o", "ft", ["region"], "citations", _XS) + """
SELECT region, n, CAST(rank AS INTEGER) AS df1, n - rank - 1 AS df2, round(sse, 4) AS sse, round(1 - sse / sst, 6) AS r2, round(1 - sse / sst * (n - 1) / (n - rank - 1), 6) AS adjusted_r2, round(sqrt(sse / (n - rank - 1)), 6) AS sigma, round((sst - sse) / rank / (sse / (n - rank - 1)), 6) AS f FROM o""")
def regression_fits_by_region(r: Roles) -> DataFrame:
    return regression.summary(_features(r), ["region"], "citations", _XS).drop("p_value").withColumn("sse", F.round("sse", 4))


@query(_FEATURES + ols_sql("o", "ft", ["region"], "citations", ["authors", "keywords"]) + ols_sql("l", "ft", ["region"], "citations", ["authors", "keywords", "places", "year"]) + """
SELECT o.region, o.n, round(o.sse, 4) AS sse_small, round(l.sse, 4) AS sse_large, CAST(l.rank - o.rank AS INTEGER) AS df1, o.n - l.rank - 1 AS df2, round((o.sse - l.sse) / (l.rank - o.rank) / (l.sse / (o.n - l.rank - 1)), 6) AS f FROM o JOIN l USING (region)""")
def nested_regressions(r: Roles) -> DataFrame:
    """Do countries and year say more of citations than authors and keywords do."""
    out = regression.nested_f(_features(r), ["region"], "citations", ["authors", "keywords"], ["places", "year"])
    return out.drop("p_value").withColumns({"sse_small": F.round("sse_small", 4), "sse_large": F.round("sse_large", 4)})


_POWERS = ", b0 AS (SELECT country, articles AS y, year - min(year) OVER (PARTITION BY country) AS t FROM panel), b AS (SELECT country, y, t AS x1, t ** 2 AS x2, t ** 3 AS x3 FROM b0)"


@query(_PANEL + _POWERS + ols_sql("d1", "b", ["country"], "y", ["x1"]) + ols_sql("d2", "b", ["country"], "y", ["x1", "x2"]) + ols_sql("d3", "b", ["country"], "y", ["x1", "x2", "x3"]) + """
, f AS (SELECT country, 1 AS degree, n, sst, sse, sst AS below FROM d1 UNION ALL SELECT d2.country, 2, d2.n, d2.sst, d2.sse, d1.sse FROM d2 JOIN d1 USING (country) UNION ALL SELECT d3.country, 3, d3.n, d3.sst, d3.sse, d2.sse FROM d3 JOIN d2 USING (country)),
g AS (SELECT country, degree, n, 1 - sse / sst AS r2, 1 - sse / sst * (n - 1) / (n - degree - 1) AS adjusted_r2, (below - sse) / (sse / (n - degree - 1)) AS f FROM f)
SELECT country, degree, n, round(r2, 6) AS r2, round(adjusted_r2, 6) AS adjusted_r2, round(f, 5) AS f, row_number() OVER (PARTITION BY country ORDER BY round(adjusted_r2, 9) DESC, degree) = 1 AS best FROM g""")
def polynomial_trends(r: Roles) -> DataFrame:
    return regression.polynomial_trends(_panel(r), ["country"]).drop("f_p").withColumn("f", F.round("f", 5))


_RIDGE = """
, b AS (SELECT doc_type, articles::DOUBLE AS y, (year - min(year) OVER (PARTITION BY doc_type))::DOUBLE AS x, year % 5 AS fold FROM s),
q AS (SELECT doc_type, fold, y, x, x * x AS z FROM b),
top AS (SELECT doc_type, greatest(abs(sum(y)), abs(sum(x * y)), abs(sum(z * y))) / count(*) AS top FROM q GROUP BY doc_type),
pen AS (SELECT doc_type, k, top * exp(k * ln(0.0001) / 99) AS penalty FROM top, range(100) t(k)),
folds AS (SELECT DISTINCT doc_type, fold FROM q),
train AS (SELECT f.doc_type, f.fold, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy FROM folds f JOIN q ON q.doc_type = f.doc_type AND q.fold <> f.fold GROUP BY ALL),
fit AS (SELECT doc_type, fold, k, penalty, mx, mz, my, (xy * (zz + penalty) - zy * xz) / ((xx + penalty) * (zz + penalty) - xz * xz) AS b1, (zy * (xx + penalty) - xy * xz) / ((xx + penalty) * (zz + penalty) - xz * xz) AS b2 FROM train JOIN pen USING (doc_type)),
er AS (SELECT doc_type, fold, k, penalty, avg((y - my - b1 * (x - mx) - b2 * (z - mz)) ** 2) AS mse FROM fit JOIN q USING (doc_type, fold) GROUP BY ALL),
cv AS (SELECT doc_type, k, penalty, avg(mse) AS cv_error FROM er GROUP BY ALL), best AS (SELECT * FROM cv QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY round(cv_error, 9), k) = 1),
al AS (SELECT doc_type, avg(x) AS mx, avg(z) AS mz, avg(y) AS my, var_pop(x) * count(*) AS xx, var_pop(z) * count(*) AS zz, covar_pop(x, z) * count(*) AS xz, covar_pop(x, y) * count(*) AS xy, covar_pop(z, y) * count(*) AS zy, var_pop(y) * count(*) AS yy FROM q GROUP BY doc_type),
w AS (SELECT al.*, penalty, cv_error, (xy * (zz + penalty) - zy * xz) / ((xx + penalty) * (zz + penalty) - xz * xz) AS b1, (zy * (xx + penalty) - xy * xz) / ((xx + penalty) * (zz + penalty) - xz * xz) AS b2 FROM al JOIN best USING (doc_type))
SELECT doc_type, round(penalty, 5) AS penalty, round(my - b1 * mx - b2 * mz, 5) AS "constant", round(b1, 6) AS b1, round(b2, 6) AS b2, round(1 - (yy - 2 * b1 * xy - 2 * b2 * zy + b1 * b1 * xx + 2 * b1 * b2 * xz + b2 * b2 * zz) / yy, 6) AS r2, round(cv_error, 4) AS cv_error FROM w"""


@query(_SERIES + _RIDGE)
def ridge_polynomials(r: Roles) -> DataFrame:
    out = regression.ridge_polynomial(_series(r), ["doc_type"])
    return out.withColumns({"penalty": F.round("penalty", 5), "constant": F.round("constant", 5), "cv_error": F.round("cv_error", 4)})


@query(_SERIES + """
, b AS (SELECT doc_type, articles::DOUBLE AS y, row_number() OVER w AS t, count(*) OVER (PARTITION BY doc_type) AS n FROM s WINDOW w AS (PARTITION BY doc_type ORDER BY year)),
l AS (SELECT doc_type, regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM b GROUP BY doc_type), e AS (SELECT doc_type, t, n, y, y - a - b * t AS e, lag(y - a - b * t) OVER v AS e1, lag(y) OVER v AS y1 FROM b JOIN l USING (doc_type) WINDOW v AS (PARTITION BY doc_type ORDER BY t)),
p AS (SELECT doc_type, sum(e * e1) / sum(e * e) AS rho, sum(e * e) AS sse, max(n) AS n, arg_max(e, t) AS last FROM e GROUP BY doc_type),
c AS (SELECT doc_type, regr_slope(y - rho * y1, t - rho * (t - 1)) AS slope, regr_intercept(y - rho * y1, t - rho * (t - 1)) / (1 - any_value(rho)) AS intercept FROM e JOIN p USING (doc_type) WHERE t > 1 GROUP BY doc_type)
SELECT doc_type, round(intercept, 5) AS intercept, round(slope, 6) AS slope, round(rho, 6) AS rho, round(n * ln(sse / n) + 4, 6) AS aic, round(intercept + slope * (n + 1) + rho * last, 5) AS next, round(intercept + slope * (n + 5) + rho ** 5 * last, 5) AS fifth FROM c JOIN p USING (doc_type)""")
def dynamic_trends(r: Roles) -> DataFrame:
    out = regression.dynamic_trend(_series(r), ["doc_type"])
    return out.select("doc_type", F.round("intercept", 5).alias("intercept"), "slope", "rho", "aic", F.round(F.col("forecast")[0], 5).alias("next"), F.round(F.col("forecast")[4], 5).alias("fifth"))


@query(_SERIES + ", i AS (SELECT doc_type, articles AS y, year AS t, CAST(year >= 1998 AS INTEGER) AS level, CASE WHEN year >= 1998 THEN year - 1998 ELSE 0 END AS since FROM s)" + ols_sql("o", "i", ["doc_type"], "y", ["t", "level", "since"]) + coefficients_sql("o", ["doc_type"], ["t", "level", "since"]).replace("round(b, 6)", "round(b, 4)").replace("round(e, 6)", "round(e, 4)"))
def interrupted_series(r: Roles) -> DataFrame:
    out = regression.interrupted(_series(r), ["doc_type"], 1998)
    return out.select("doc_type", "term", F.round("coefficient", 4).alias("coefficient"), F.round("std_error", 4).alias("std_error"), "t")


# Lag models

_DRIVEN = ", p AS (SELECT country, year, articles AS y, citations AS x, lag(articles) OVER w AS y1, lag(citations) OVER w AS x1 FROM panel WINDOW w AS (PARTITION BY country ORDER BY year)), q AS (SELECT * FROM p WHERE x1 IS NOT NULL)"


@query(_PANEL + _DRIVEN + ols_sql("o", "q", ["country"], "y", ["y1"]) + ols_sql("l", "q", ["country"], "y", ["y1", "x1"]) + """
SELECT o.country, o.n, round(o.sse, 4) AS sse_small, round(l.sse, 4) AS sse_large, 1 AS df1, o.n - 3 AS df2, round((o.sse - l.sse) / (l.sse / (o.n - 3)), 5) AS f FROM o JOIN l USING (country)""")
def granger_citations_output(r: Roles) -> DataFrame:
    """Do a country's citations of the year before say more of its output than its own past."""
    out = regression.granger(_panel(r), ["country"], "articles", "citations")
    return out.select("country", "n", F.round("sse_small", 4).alias("sse_small"), F.round("sse_large", 4).alias("sse_large"), "df1", "df2", F.round("f", 5).alias("f"))


def _root_sql(name: str, key: str, p: int, surfaces: tuple) -> str:
    """A SELECT of ``unit_root``'s columns from ``ols_sql``'s table whose first predictor is the past level."""
    limit = lambda s: f"({s[0]} + {s[1]} / n + {s[2]} / (n * n))"
    one, five, ten = map(limit, surfaces)
    return f""", u AS (SELECT {key}, n::DOUBLE AS n, m[1][{p + 1}] AS gamma, m[1][{p + 1}] / sqrt(sse / (n - {p} - 1) * m[1][{p + 2}]) AS t FROM {name})
SELECT {key}, n, round(gamma, 6) AS gamma, round(t, 6) AS t, round({one}, 6) AS critical_1, round({five}, 6) AS critical_5, round({ten}, 6) AS critical_10, CASE WHEN t <= {one} THEN 0.01 WHEN t <= {five} THEN 0.05 WHEN t <= {ten} THEN 0.1 END AS level, t <= {five} AS stationary FROM u"""


@query(_PANEL + ", c AS (SELECT country, year, articles::DOUBLE AS v, lag(articles) OVER w AS past FROM panel WINDOW w AS (PARTITION BY country ORDER BY year)), e AS (SELECT country, v - past AS d, past, lag(v - past) OVER (PARTITION BY country ORDER BY year) AS d1 FROM c)" + ols_sql("o", "e", ["country"], "d", ["past", "d1"]) + _root_sql("o", "country", 2, regression.UNIT_ROOT))
def unit_roots(r: Roles) -> DataFrame:
    return regression.unit_root(_panel(r), ["country"]).withColumn("n", F.col("n").cast("double"))


@query(_PANEL + ", rl AS (SELECT country, regr_slope(articles, citations) AS b, regr_intercept(articles, citations) AS a FROM panel GROUP BY country), c AS (SELECT country, year, articles - a - b * citations AS v FROM panel JOIN rl USING (country)), d AS (SELECT country, v - lag(v) OVER w AS d, lag(v) OVER w AS past FROM c WINDOW w AS (PARTITION BY country ORDER BY year))" + ols_sql("o", "d", ["country"], "d", ["past"]) + _root_sql("o", "country", 1, regression.RESIDUAL_ROOT))
def cointegrated_output(r: Roles) -> DataFrame:
    """Output and citations of a country: Engle and Granger."""
    return regression.cointegration(_panel(r), ["country"], "articles", "citations").withColumn("n", F.col("n").cast("double"))


# Break points of monthly series

_MONTHS = ", s AS (SELECT o_orderpriority AS doc_type, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS INTEGER) AS year, count(*) AS articles FROM orders GROUP BY ALL)"
_PREFIX = """
, mn AS (SELECT doc_type, avg(articles) AS m, count(*) AS n FROM s GROUP BY doc_type),
pr AS (SELECT doc_type, year, row_number() OVER w AS i, sum(articles - m) OVER w AS s, sum((articles - m) ** 2) OVER w AS q FROM s JOIN mn USING (doc_type) WINDOW w AS (PARTITION BY doc_type ORDER BY year)),
ar AS (SELECT doc_type, any_value(n) AS n, list_prepend(0.0, list(pr.s ORDER BY i)) AS s, list_prepend(0.0, list(pr.q ORDER BY i)) AS q, list(year ORDER BY i) AS years FROM pr JOIN mn USING (doc_type) GROUP BY doc_type)"""
_SQUARES = "greatest(0.0, q[{b}+1] - q[{a}+1] - (s[{b}+1] - s[{a}+1]) ** 2 / ({b} - {a}))"


def _months(r: Roles) -> DataFrame:
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate")
    return r.table("orders").groupBy(F.col("o_orderpriority").alias("doc_type"), month.alias("year")).agg(F.count("*").alias("articles"))


def _partition_sql() -> str:
    """The same partition by a programme over all cuts, none given up: ``pt(doc_type, n, cost, cuts)``."""
    squares = _SQUARES.format(a="c", b="(t + 1)")
    cost = f"(t + 1 - c) / 2.0 * (ln(2 * pi()) + ln(greatest({squares} / (t + 1 - c), 1.0 / 12)) + {squares} / (t + 1 - c) / greatest({squares} / (t + 1 - c), 1.0 / 12))"
    return _PREFIX + f"""
, dp AS (SELECT doc_type, n, s, q, years, 0 AS t, [-ln(n)] AS f, [0] AS back FROM ar UNION ALL
  SELECT doc_type, n, s, q, years, t + 1, list_append(f, coalesce(b.v, 'inf'::DOUBLE)), list_append(back, coalesce(b.c, 0)) FROM (
    SELECT *, list_min(list_transform(range(0, t), lambda c: {{'v': round(f[c + 1] + {cost} + ln(n), 9), 'c': CAST(c AS INTEGER)}})) AS b FROM dp WHERE t < n)),
bt AS (SELECT doc_type, n, years, back, f[n + 1] AS cost, back[n + 1] AS cut, CAST([] AS INTEGER[]) AS cuts FROM dp WHERE t = n UNION ALL SELECT doc_type, n, years, back, cost, back[cut + 1], list_prepend(cut, cuts) FROM bt WHERE cut > 0),
pt AS (SELECT doc_type, n, cost, cuts, list_transform(cuts, lambda c: years[c]) AS breaks FROM bt WHERE cut = 0)"""


@query(_MONTHS + _partition_sql() + "SELECT doc_type, CAST(n AS INTEGER) AS n, round(cost, 6) AS cost, array_to_string(breaks, ',') AS breaks FROM pt")
def monthly_partitions(r: Roles) -> DataFrame:
    out = segments.optimal_partition(_months(r), ["doc_type"])
    return out.select("doc_type", "n", "cost", F.array_join("breaks", ",").alias("breaks"))


@query(_MONTHS + _partition_sql() + """
, nb AS (SELECT s.doc_type, year, articles, 1 + len(list_filter(breaks, lambda b: b < year)) AS segment FROM s JOIN pt USING (doc_type)),
a AS (SELECT doc_type, segment, min(year) AS start_year, max(year) AS end_year, count(*) AS n, avg(articles) AS mean, stddev_samp(articles) AS sd, regr_slope(articles, year) AS slope, regr_r2(articles, year) AS r2 FROM nb GROUP BY ALL)
SELECT doc_type, CAST(segment AS INTEGER) AS segment, start_year, end_year, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(slope, 6) AS slope, round(r2, 6) AS r2, round(100 * slope / mean, 6) AS growth_rate,
       CASE WHEN slope / mean > 0.1 THEN 'rapid_growth' WHEN slope / mean > 0.03 THEN 'growth' WHEN slope / mean < -0.03 THEN 'decline' ELSE 'stagnation' END AS phase FROM a""")
def monthly_phases(r: Roles) -> DataFrame:
    months = _months(r)
    return segments.segment_phases(months, ["doc_type"], segments.optimal_partition(months, ["doc_type"]))


def _breaks_sql(most: int = 5) -> str:
    """Least squares of a given number of breaks by layers: a table a layer."""
    parts = [_PREFIX, ", hh AS (SELECT *, CAST(ceil(round(0.15 * n, 9)) AS INTEGER) AS h FROM ar), g0 AS (SELECT doc_type, t, " + _SQUARES.format(a="0", b="t") + " AS v, CAST([] AS INTEGER[]) AS cuts FROM hh, range(1, 10000) r(t) WHERE t <= n AND t >= h)"]
    for m in range(1, most + 1):
        parts.append(f", g{m} AS (SELECT doc_type, t, x.v AS v, list_append(x.cuts, CAST(x.c AS INTEGER)) AS cuts FROM (SELECT hh.doc_type, r.t, min({{'v': round(g.v + {_SQUARES.format(a='g.t', b='r.t')}, 9), 'c': g.t, 'cuts': g.cuts}}) AS x FROM hh JOIN g{m - 1} g ON g.doc_type = hh.doc_type JOIN range(1, 10000) r(t) ON r.t <= hh.n AND r.t - g.t >= hh.h GROUP BY ALL))")
    every = " UNION ALL ".join(f"SELECT hh.doc_type, {m} AS m, n, v AS ssr, list_transform(cuts, lambda c: years[c]) AS breaks FROM g{m} JOIN hh ON hh.doc_type = g{m}.doc_type AND t = n" for m in range(most + 1))
    return "".join(parts) + f", br AS ({every})"


@query(_MONTHS + _breaks_sql() + """
, z AS (SELECT b.doc_type, b.m, b.n, b.ssr, b.breaks, o.ssr AS none, b.n * ln(b.ssr / b.n) + (2 * b.m + 1) * ln(b.n) AS bic FROM br b JOIN br o ON o.doc_type = b.doc_type AND o.m = 0)
SELECT doc_type, m, round(ssr, 6) AS ssr, round(CASE WHEN m > 0 THEN (none - ssr) / m / (ssr / (n - m - 1)) END, 6) AS f, round(bic, 6) AS bic, array_to_string(breaks, ',') AS breaks, row_number() OVER (PARTITION BY doc_type ORDER BY round(bic, 9), m) = 1 AS best FROM z""")
def monthly_mean_breaks(r: Roles) -> DataFrame:
    out = segments.mean_breaks(_months(r), ["doc_type"])
    return out.withColumn("breaks", F.array_join("breaks", ",")).drop("p_value")


def _binary_sql(levels: int = 5, least: int = 5) -> str:
    parts = [", r0 AS (SELECT doc_type, year, articles::DOUBLE AS y, row_number() OVER (PARTITION BY doc_type ORDER BY year) AS i, 1 AS seg FROM s)"]
    for k in range(levels):
        parts.append(f"""
, w{k} AS (SELECT *, count(*) OVER run AS k, count(*) OVER own AS n, var_pop(y) OVER run AS v1, var_pop(y) OVER rest AS v2, var_pop(y) OVER own AS v FROM r{k} WINDOW own AS (PARTITION BY doc_type, seg), run AS (PARTITION BY doc_type, seg ORDER BY i), rest AS (PARTITION BY doc_type, seg ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
b{k} AS (SELECT doc_type, seg, i AS cut, year, n * ln(v + 1) - round(k * ln(v1 + 1) + (n - k) * ln(v2 + 1), 9) AS gain, {k} AS level FROM w{k} WHERE n > {2 * least} AND k > {least} AND n - k >= {least} QUALIFY row_number() OVER (PARTITION BY doc_type, seg ORDER BY round(k * ln(v1 + 1) + (n - k) * ln(v2 + 1), 9), i) = 1),
r{k + 1} AS (SELECT doc_type, r.year, y, i, 2 * seg + CAST(i > cut AS INTEGER) AS seg FROM r{k} r JOIN b{k} USING (doc_type, seg))""")
    return "".join(parts) + ", bs AS (" + " UNION ALL ".join(f"SELECT * FROM b{k}" for k in range(levels)) + "), bo AS (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY level, cut) AS break_no FROM bs)"


@query(_MONTHS + _binary_sql() + "SELECT doc_type, CAST(break_no AS INTEGER) AS break_no, year, round(gain, 6) AS gain FROM bo WHERE break_no <= 5")
def monthly_binary_segments(r: Roles) -> DataFrame:
    return segments.binary_segmentation(_months(r), ["doc_type"])


@query(_MONTHS + _partition_sql() + _binary_sql() + """
, cd AS (SELECT doc_type, year, sum(articles - m) OVER (PARTITION BY doc_type ORDER BY year) AS c, sd, n FROM s JOIN (SELECT doc_type, avg(articles) AS m, stddev_samp(articles) AS sd, count(*) AS n FROM s GROUP BY doc_type) USING (doc_type)),
cu AS (SELECT doc_type, year FROM cd WHERE abs(c) / (sd * sqrt(n)) > 1.143 QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY round(abs(c / (sd * sqrt(n))), 9) DESC, year) = 1),
sg AS (SELECT a.doc_type, a.year, sum(sign(a.articles - b.articles)) AS v FROM s a JOIN s b ON a.doc_type = b.doc_type GROUP BY ALL), pu AS (SELECT doc_type, year, abs(sum(v) OVER (PARTITION BY doc_type ORDER BY year)) AS u, count(*) OVER (PARTITION BY doc_type) AS n FROM sg),
pe AS (SELECT doc_type, year FROM pu WHERE least(1.0, 2 * exp(-6 * u * u / (n ** 3 + n ** 2))) < 0.05 QUALIFY row_number() OVER (PARTITION BY doc_type ORDER BY u DESC, year) = 1),
ev AS (SELECT doc_type, unnest(breaks) AS year, 'pelt' AS method FROM pt UNION ALL SELECT doc_type, year, 'binseg' FROM bo WHERE break_no <= 5 UNION ALL SELECT doc_type, year, 'cusum' FROM cu UNION ALL SELECT doc_type, year, 'pettitt' FROM pe)
SELECT a.doc_type, a.method, a.year, count(DISTINCT b.method) AS votes, count(DISTINCT b.method) >= 2 AS consensus FROM ev a JOIN ev b ON a.doc_type = b.doc_type AND abs(a.year - b.year) <= 2 GROUP BY ALL""")
def monthly_change_points(r: Roles) -> DataFrame:
    return segments.change_points(_months(r), ["doc_type"])


# Networks by permutation

_NETWORKS = """
, ce AS (SELECT a.country AS a, b.country AS b, count(*)::DOUBLE AS w FROM countries a JOIN countries b USING (doc) WHERE a.country < b.country GROUP BY ALL),
tr AS (SELECT least(c.n_name, s.n_name) AS a, greatest(c.n_name, s.n_name) AS b, count(*)::DOUBLE AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation c ON c.n_nationkey = c_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation s ON s.n_nationkey = s_nationkey WHERE c.n_name <> s.n_name GROUP BY ALL),
sr AS (SELECT a.country AS a, b.country AS b, 1.0::DOUBLE AS w FROM regions a JOIN regions b USING (region) WHERE a.country < b.country),
nd AS (SELECT n_name AS node FROM nation), pl AS (SELECT r, node, row_number() OVER (PARTITION BY r ORDER BY CASE WHEN r = 0 THEN '' ELSE md5(r || '-42-' || node) END, node) AS place FROM nd, range(201) t(r)),
mv AS (SELECT p.r, o.node, p.node AS target FROM pl p JOIN pl o ON o.r = 0 AND o.place = p.place), n AS (SELECT count(*) * (count(*) - 1) / 2 AS d FROM nd),
pe AS (SELECT x.r, least(x.target, y.target) AS a, greatest(x.target, y.target) AS b, w FROM ce JOIN mv x ON x.node = ce.a JOIN mv y ON y.node = ce.b AND y.r = x.r)"""


def _networks(r: Roles) -> dict[str, DataFrame]:
    """Countries that write together, that trade, and that share a region; and all countries."""
    nation = r.table("nation").select("n_nationkey", "n_name")
    side = lambda c, key: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(c))
    line = r.table("lineitem").select("l_orderkey", "l_suppkey").join(r.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = line.join(r.table("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(r.table("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    trade = line.groupBy("c_nationkey", "s_nationkey").agg(F.count("*").alias("weight")).join(side("a", "c_nationkey"), "c_nationkey").join(side("b", "s_nationkey"), "s_nationkey").select("a", "b", "weight")
    region = r.regions()
    same = region.select(F.col("country").alias("a"), "region").join(region.select(F.col("country").alias("b"), "region"), "region").where("a < b").select("a", "b", F.lit(1.0).alias("weight"))
    return {"together": networks.cooccurrence(r.countries(), "country"), "trade": trade, "region": same, "nodes": nation.select(F.col("n_name").alias("node"))}


@query(_NETWORKS + """
, xy AS (SELECT r, sum(pe.w * tr.w) AS xy FROM pe JOIN tr USING (a, b) GROUP BY r), sx AS (SELECT sum(w) AS s, sum(w * w) AS q FROM ce), sy AS (SELECT sum(w) AS s, sum(w * w) AS q FROM tr),
c AS (SELECT g.r, (d * coalesce(xy, 0) - sx.s * sy.s) / sqrt((d * sx.q - sx.s * sx.s) * (d * sy.q - sy.s * sy.s)) AS v FROM range(201) g(r) LEFT JOIN xy USING (r), n, sx, sy), o AS (SELECT v AS o FROM c WHERE r = 0)
SELECT (SELECT count(*) FROM nd) AS nodes, count(*) AS rounds, round(any_value(o), 6) AS correlation, avg(CASE WHEN round(v, 9) >= round(o, 9) THEN 1.0 ELSE 0.0 END) AS p_one,
       least(1.0, 2 * least(avg(CASE WHEN round(v, 9) >= round(o, 9) THEN 1.0 ELSE 0.0 END), avg(CASE WHEN round(v, 9) <= round(o, 9) THEN 1.0 ELSE 0.0 END))) AS p_two, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM c, o WHERE r > 0""")
def networks_correlated(r: Roles) -> DataFrame:
    """Do countries write with those that they trade with."""
    of = _networks(r)
    return permutation.qap(of["together"], of["trade"], 200, nodes=of["nodes"])


@query(_NETWORKS + """
, gr AS (SELECT sum(t) AS s1, sum(g) AS s2, sum(t * t) AS q11, sum(t * g) AS q12, sum(g * g) AS q22 FROM (SELECT coalesce(tr.w, 0) AS t, coalesce(sr.w, 0) AS g FROM tr FULL JOIN sr USING (a, b))), yy AS (SELECT sum(w) AS ys, sum(w * w) AS yq FROM ce),
x1 AS (SELECT r, sum(pe.w * tr.w) AS x FROM pe JOIN tr USING (a, b) GROUP BY r), x2 AS (SELECT r, sum(pe.w * sr.w) AS x FROM pe JOIN sr USING (a, b) GROUP BY r),
c AS (SELECT g.r, q11 - s1 * s1 / d AS a, q12 - s1 * s2 / d AS b, q22 - s2 * s2 / d AS e, coalesce(x1.x, 0) - s1 * ys / d AS u, coalesce(x2.x, 0) - s2 * ys / d AS v, yq - ys * ys / d AS t, s1, s2, ys, d FROM range(201) g(r) LEFT JOIN x1 USING (r) LEFT JOIN x2 USING (r), gr, yy, n),
f AS (SELECT r, (u * e - v * b) / (a * e - b * b) AS b1, (v * a - u * b) / (a * e - b * b) AS b2, u, v, t, s1, s2, ys, d FROM c), h AS (SELECT *, (b1 * u + b2 * v) / t AS r2, (ys - b1 * s1 - b2 * s2) / d AS b0 FROM f),
l AS (SELECT r, r2, 'constant' AS term, b0 AS x FROM h UNION ALL SELECT r, r2, 'trade', b1 FROM h UNION ALL SELECT r, r2, 'region', b2 FROM h), o AS (SELECT term, x AS o, r2 AS fit FROM l WHERE r = 0)
SELECT term, round(any_value(o), 6) AS coefficient, round(stddev_samp(x), 6) AS std_error, least(1.0, 2 * least(avg(CASE WHEN round(x, 9) >= round(o, 9) THEN 1.0 ELSE 0.0 END), avg(CASE WHEN round(x, 9) <= round(o, 9) THEN 1.0 ELSE 0.0 END))) AS p_value, round(any_value(fit), 6) AS r2 FROM l JOIN o USING (term) WHERE r > 0 GROUP BY term""")
def networks_regressed(r: Roles) -> DataFrame:
    """Writing together by trade and region."""
    of = _networks(r)
    return permutation.mrqap(of["together"], {"trade": of["trade"], "region": of["region"]}, 200, nodes=of["nodes"])


# Communities, distributions and tails


@query()
def keyword_modularity_communities(r: Roles) -> DataFrame:
    return modularity.communities(networks.cooccurrence(r.keywords(), "keyword"))


def _normal_sql(source: str, keep: str) -> str:
    """Table ``<source>_p`` of ``keep`` and ``p``, the normal distribution function at the column ``z``, by the same approximation of erfc."""
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    power = repr(c[-1])
    for x in c[-2::-1]:
        power = f"({x} + k * {power})"
    return f"""
, {source}_t AS (SELECT *, -z / sqrt(2) AS u, 1.0 / (1.0 + 0.5 * abs(z) / sqrt(2)) AS k FROM {source}),
{source}_p AS (SELECT {keep}, 0.5 * CASE WHEN u >= 0 THEN k * exp(-u * u + {power}) ELSE 2 - k * exp(-u * u + {power}) END AS p FROM {source}_t)"""


_PLACED = """
, h AS (SELECT doc_type, citations::DOUBLE AS x, count(*) AS n FROM records WHERE citations > 0 GROUP BY ALL), pc AS (SELECT doc_type, x, n, sum(n) OVER w - n AS b, sum(n) OVER (PARTITION BY doc_type) AS t FROM h WINDOW w AS (PARTITION BY doc_type ORDER BY x))"""


@query(_PLACED + """
, m AS (SELECT doc_type, count(*) AS rows, avg(citations) AS m, stddev_pop(citations) AS s, avg(ln(citations)) AS ml, stddev_pop(ln(citations)) AS sl, stddev_samp(ln(citations)) AS sn FROM records WHERE citations > 0 GROUP BY doc_type),
z AS (SELECT pc.*, 'normal' AS family, m AS first, s AS second, (x - m) / s AS z FROM pc JOIN m USING (doc_type) UNION ALL SELECT pc.*, 'log_normal', ml, sl, (ln(x) - ml) / sl FROM pc JOIN m USING (doc_type))""" + _normal_sql("z", "doc_type, n, b, t, family, first, second") + """
, f AS (SELECT doc_type, family, first, second, n, b, t, p FROM z_p UNION ALL SELECT doc_type, 'exponential', 1 / m, NULL, n, b, t, 1 - exp(-x / m) FROM pc JOIN m USING (doc_type)
      UNION ALL SELECT doc_type, 'weibull', pi() / (sn * sqrt(6)), exp(ml + 0.5772156649015329 * sn * sqrt(6) / pi()), n, b, t, 1 - exp(-((x / exp(ml + 0.5772156649015329 * sn * sqrt(6) / pi())) ** (pi() / (sn * sqrt(6))))) FROM pc JOIN m USING (doc_type))
SELECT doc_type, family, CAST(max(t) AS BIGINT) AS n, round(any_value(first), 6) AS first, round(any_value(second), 6) AS second, round(max(greatest(abs((b + n) / t - p), abs(b / t - p))), 6) AS statistic FROM f GROUP BY doc_type, family""")
def citations_by_family(r: Roles) -> DataFrame:
    """Kolmogorov-Smirnov distances of citations to the families that SQL can say (not gamma)."""
    return goodness.ks_families(r.records(), ["doc_type"], "citations").where("family <> 'gamma'").drop("p_value")


@query(_PLACED + ", m AS (SELECT doc_type, avg(citations) AS m, stddev_samp(citations) AS s FROM records WHERE citations > 0 GROUP BY doc_type), z AS (SELECT pc.*, (x - m) / s AS z FROM pc JOIN m USING (doc_type))" + _normal_sql("z", "doc_type, x") + ", y AS (SELECT doc_type, x, -z AS z FROM z)" + _normal_sql("y", "doc_type, x") + """
, a AS (SELECT doc_type, any_value(t) AS n, -any_value(t) - sum(n * (2 * b + n) * ln(z_p.p) + n * (2 * (t - b) - n) * ln(y_p.p)) / any_value(t) AS a FROM pc JOIN z_p USING (doc_type, x) JOIN y_p USING (doc_type, x) GROUP BY doc_type)
SELECT doc_type, CAST(n AS BIGINT) AS n, round(a, 4) AS statistic, round(a * (1 + 0.75 / n + 2.25 / (n * n)), 4) AS adjusted FROM a""")
def citations_normality(r: Roles) -> DataFrame:
    out = goodness.anderson_darling(r.records().where("citations > 0"), ["doc_type"], "citations")
    return out.select("doc_type", "n", F.round("statistic", 4).alias("statistic"), F.round("adjusted", 4).alias("adjusted"))


@query(""", k AS (SELECT doc, count(*) > 1 AS many FROM countries GROUP BY doc), v AS (SELECT citations AS x, many FROM k JOIN records USING (doc)), n AS (SELECT count(*) FILTER (many) AS n1, count(*) FILTER (NOT many) AS n2 FROM v),
h AS (SELECT x, count(*) FILTER (many) AS a, count(*) FILTER (NOT many) AS b FROM v GROUP BY x), c AS (SELECT sum(a) OVER (ORDER BY x) AS a, sum(b) OVER (ORDER BY x) AS b FROM h) SELECT any_value(n1) AS n1, any_value(n2) AS n2, round(max(abs(a / n1 - b / n2)), 6) AS statistic FROM c, n""")
def citations_of_one_and_many_countries(r: Roles) -> DataFrame:
    many = r.countries().groupBy("doc").agg((F.count("*") > 1).alias("many"))
    return goodness.ks_two_samples(r.records().join(many, "doc"), "citations", F.col("many")).drop("p_value")


@query(", c AS (SELECT doc_type, count(*) AS n FROM records GROUP BY doc_type), t AS (SELECT sum(n) AS a, count(*) AS k FROM c) SELECT CAST(any_value(a) AS BIGINT) AS n, round(sum((n - a / k) ** 2 / (a / k)), 6) AS statistic, CAST(any_value(k) - 1 AS BIGINT) AS df FROM c, t")
def document_types_even(r: Roles) -> DataFrame:
    return goodness.chi_square_fit(r.records(), "doc_type").drop("p_value")


@query(""", h AS (SELECT citations::DOUBLE AS x, count(*) AS n FROM records WHERE citations > 0 GROUP BY ALL), p AS (SELECT x, n, sum(n) OVER (ORDER BY x) - n AS b, sum(n) OVER () AS t FROM h),
c AS (SELECT a.x AS x_min, any_value(a.t - a.b) AS k, any_value(a.b) AS b, sum(p.n * ln(p.x / a.x)) AS l FROM p a JOIN p ON p.x >= a.x WHERE a.t - a.b >= 10 GROUP BY a.x HAVING sum(p.n * ln(p.x / a.x)) > 1e-12), d AS (SELECT *, 1 + k / l AS alpha FROM c),
e AS (SELECT x_min, any_value(k) AS k, any_value(alpha) AS alpha, max(abs((p.b + p.n - d.b) / k - (1 - (x_min / x) ** (alpha - 1)))) AS ks FROM d JOIN p ON x >= x_min GROUP BY x_min)
SELECT x_min, CAST(k AS BIGINT) AS n_tail, round(alpha, 6) AS alpha, round(ks, 6) AS ks, row_number() OVER (ORDER BY round(ks, 9), x_min) = 1 AS best FROM e""")
def citations_power_law(r: Roles) -> DataFrame:
    """Every number of citations as the least value of a power law."""
    return goodness.power_law_scan(r.records(), "citations", candidates=100_000)


@query(", v AS (SELECT citations AS x, row_number() OVER (ORDER BY citations DESC) AS i FROM records WHERE citations > 0) SELECT count(*) AS n, round(regr_slope(ln(x), ln(i)), 6) AS slope, round(regr_r2(ln(x), ln(i)), 6) AS r2, abs(regr_slope(ln(x), ln(i)) + 1) <= 0.5 AS power_law FROM v")
def citations_rank_size(r: Roles) -> DataFrame:
    return goodness.rank_size_slope(r.records(), "citations")


@query()
def citations_bca(r: Roles) -> DataFrame:
    """Bias-corrected and accelerated intervals of mean, median and Gini of citations."""
    records = r.records()
    parts = [stats.bca(records, "citations", kind, 400).withColumn("statistic", F.lit(kind)) for kind in stats.BCA]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_TESTED = _MONTHS + ", b AS (SELECT doc_type, year, articles AS y, year - min(year) OVER (PARTITION BY doc_type) AS x1, (year - min(year) OVER (PARTITION BY doc_type)) ** 2 AS x2, lag(articles) OVER (PARTITION BY doc_type ORDER BY year) AS y1 FROM s)" + ols_sql("l", "b", ["doc_type"], "y", ["x1"]) + ols_sql("q", "b", ["doc_type"], "y", ["x1", "x2"]) + ols_sql("g", "b", ["doc_type"], "y", ["y1"]) + _breaks_sql(1) + """
, sg AS (SELECT a.doc_type, a.year, sum(sign(a.articles - b.articles)) AS v, count(*) AS n FROM s a JOIN s b ON a.doc_type = b.doc_type GROUP BY ALL), pu AS (SELECT doc_type, n, abs(sum(v) OVER (PARTITION BY doc_type ORDER BY year)) AS u FROM sg), pk AS (SELECT doc_type, any_value(n) AS n, max(u) AS k FROM pu GROUP BY doc_type),
mp AS (SELECT a.doc_type, sum(sign(b.articles - a.articles)) AS s FROM s a JOIN s b ON a.doc_type = b.doc_type AND a.year < b.year GROUP BY ALL), ti AS (SELECT doc_type, sum(t) AS n, sum(t * (t - 1) * (2 * t + 5)) AS ties FROM (SELECT doc_type, articles, count(*) AS t FROM s GROUP BY ALL) GROUP BY doc_type),
mk AS (SELECT doc_type, n, s, (s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18.0) AS z FROM mp JOIN ti USING (doc_type)),
h AS (SELECT doc_type, articles::DOUBLE AS x, count(*) AS n FROM s GROUP BY ALL), pc AS (SELECT doc_type, x, n, sum(n) OVER w - n AS b, sum(n) OVER (PARTITION BY doc_type) AS t FROM h WINDOW w AS (PARTITION BY doc_type ORDER BY x)), m AS (SELECT doc_type, avg(articles) AS m, stddev_samp(articles) AS s FROM s GROUP BY doc_type), z AS (SELECT pc.*, (x - m) / s AS z FROM pc JOIN m USING (doc_type))""" + _normal_sql("z", "doc_type, x") + ", y AS (SELECT doc_type, x, -z AS z FROM z)" + _normal_sql("y", "doc_type, x") + """
, a AS (SELECT doc_type, any_value(t) AS n, -any_value(t) - sum(n * (2 * b + n) * ln(z_p.p) + n * (2 * (t - b) - n) * ln(y_p.p)) / any_value(t) AS a FROM pc JOIN z_p USING (doc_type, x) JOIN y_p USING (doc_type, x) GROUP BY doc_type),
r AS (SELECT doc_type, 'trend' AS id, z AS statistic, 2 * s / (n * (n - 1)) AS effect FROM mk UNION ALL SELECT doc_type, 'line', (sst - sse) / (sse / (n - 2)), 1 - sse / sst FROM l UNION ALL SELECT q.doc_type, 'curve', (l.sse - q.sse) / (q.sse / (q.n - 3)), (l.sse - q.sse) / l.sse FROM q JOIN l USING (doc_type)
      UNION ALL SELECT doc_type, 'regime', k, 4 * k / (n * n) FROM pk UNION ALL SELECT x.doc_type, 'mean_break', (o.ssr - x.ssr) / (x.ssr / (x.n - 2)), 1 - x.ssr / o.ssr FROM br x JOIN br o ON o.doc_type = x.doc_type AND o.m = 0 WHERE x.m = 1
      UNION ALL SELECT doc_type, 'persistence', (sst - sse) / (sse / (n - 2)), 1 - sse / sst FROM g UNION ALL SELECT doc_type, 'normal_values', a * (1 + 0.75 / n + 2.25 / (n * n)), a * (1 + 0.75 / n + 2.25 / (n * n)) FROM a)
SELECT doc_type, id, round(statistic, 4) AS statistic, round(effect, 4) AS effect FROM r"""


@query(_TESTED)
def hypotheses_measured(r: Roles) -> DataFrame:
    """Statistics and effects of the tests of monthly series."""
    out = hypotheses.tested(_months(r), ["doc_type"])
    return out.select("doc_type", "id", F.round("statistic", 4).alias("statistic"), F.round("effect", 4).alias("effect"))


@query()
def hypotheses_corrected(r: Roles) -> DataFrame:
    """The same with their p values, corrected together."""
    out = stats.benjamini_hochberg(hypotheses.tested(_months(r), ["doc_type"]))
    return out.withColumn("decision", stats.decision(F.col("p_bh")))
