"""Hypotheses about a corpus as rows of one table: ``id, statement, statistic, p_value, supported, decision``.

A rule-based hypothesis has no p; its decision follows from ``supported``. Tables of several are united and corrected
together by ``citeloom.functions.stats.benjamini_hochberg``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from . import countries, descriptive, fits, goodness, primitives, regression, segments, series


def _row(df: DataFrame, key: str, statement: str, statistic: Column, supported: Column, p: Column | None = None) -> DataFrame:
    decision = F.when(supported.isNull(), "inconclusive").when(supported, "supported").otherwise("not_supported")
    return df.select(F.lit(key).alias("id"), F.lit(statement).alias("statement"), statistic.cast("double").alias("statistic"), (F.lit(None) if p is None else p).cast("double").alias("p_value"), supported.alias("supported"), decision.alias("decision"))


def corpus(records: DataFrame, authors: DataFrame, pairs: DataFrame, keywords: DataFrame) -> DataFrame:
    """The laws of production and citation: Lotka, Zipf, Price, Bradford, concentration, collaboration, types."""
    per_author = authors.groupBy("author").agg(F.count("*").alias("n"))
    per_keyword = keywords.groupBy("keyword").agg(F.count("*").alias("n"))
    lotka = descriptive.lotka(authors, "author").agg(F.max("alpha").alias("alpha"), F.max("ks").alias("ks"))
    zipf = descriptive.zipf(keywords, "keyword")
    price = primitives.square_root_law(per_author, "n")
    zoned = primitives.bradford_zones(primitives.bradford(records.where("source is not null").groupBy("source").agg(F.count("*").alias("n")), "source", "n"), "n")
    multiplier = zoned.agg(F.max(F.when(F.col("zone") == 2, F.col("multiplier"))).alias("k"))
    cited = primitives.concentration(records, [], "citations")
    dominant = primitives.top_share(per_author, "n", [0.1])
    words = primitives.top_share(per_keyword, "n", [0.2])
    types = descriptive.shares(records, "doc_type").agg(F.max("share").alias("share"))
    trend = primitives.trend(descriptive.collaboration_by(authors, records, "year"), [], "year", "rate")
    multi = pairs.groupBy("doc").agg((F.count("*") > 1).alias("multi")).join(records, "doc")
    tested = stats.rank_sum(multi, "citations", F.col("multi"))
    expected = F.col("n1") * F.col("n2") / 2
    rows = [
        _row(lotka, "lotka", "papers per author follow an inverse square", F.col("alpha"), F.abs(F.col("alpha") - 2) < 0.3),
        _row(zipf, "zipf", "keyword frequency falls as the inverse of rank", F.col("slope"), F.abs(F.col("slope") + 1) < 0.5),
        _row(price, "price", "the square root of all authors writes half", F.col("share"), F.col("holds")),
        _row(multiplier, "bradford", "the second zone has at least twice the sources of the first", F.col("k"), F.col("k") >= 2),
        _row(cited, "citation_gini", "citations are concentrated (Gini over 0.7)", F.col("gini"), F.col("gini") > 0.7),
        _row(dominant, "author_dominance", "a tenth of the authors writes over 40 %", F.col("share"), F.col("share") > 0.4),
        _row(words, "keyword_concentration", "a fifth of the keywords holds over 70 %", F.col("share"), F.col("share") > 0.7),
        _row(types, "document_type", "one type has over half of the documents", F.col("share"), F.col("share") > 0.5),
        _row(trend, "collaboration_trend", "collaboration rises over the years", F.col("slope"), F.when(F.col("points") >= 5, F.col("slope") > 0)),
        _row(tested, "international_impact", "documents of several countries are cited more", F.col("u"), F.when((F.col("n1") >= 5) & (F.col("n2") >= 5), (F.col("p_value") < 0.05) & (F.col("u") > expected)), F.col("p_value")),
    ]
    return reduce(DataFrame.unionByName, rows)


def growth(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: monotone trend, structural break, overdispersion, autocorrelated residuals, constant growth."""
    trend = series.with_p_values(series.mann_kendall(df, keys))
    broken, spread, checked, line = series.pettitt(df, keys), series.poisson_dispersion(df, keys), series.residual_checks(df, keys), primitives.trend(df, keys, "year", "articles")
    one = F.lit(1.0)
    named = [
        (trend, "monotone_trend", "articles have a monotone trend", F.col("z"), F.col("p_value") < 0.05, F.col("p_value")),
        (broken, "structural_break", "the level changes at a year", F.col("k").cast("double"), F.col("p_value") < 0.05, F.col("p_value")),
        (spread, "overdispersion", "counts vary more than a Poisson rate", F.col("dispersion"), F.col("dispersion") > 1.5, F.lit(None)),
        (checked, "residual_independence", "residuals of the line are uncorrelated", F.col("ljung_box"), stats.chi_square_tail(F.col("ljung_box"), one) > 0.05, stats.chi_square_tail(F.col("ljung_box"), one)),
        (checked, "constant_variance", "residuals of the line have one variance", F.col("breusch_pagan"), stats.chi_square_tail(F.col("breusch_pagan"), one) > 0.05, stats.chi_square_tail(F.col("breusch_pagan"), one)),
        (line, "linear_growth", "a line explains over 90 % of the variance", F.col("r2"), F.col("r2") > 0.9, F.lit(None)),
    ]
    return reduce(DataFrame.unionByName, (table.select(*keys, F.lit(k).alias("id"), F.lit(s).alias("statement"), x.cast("double").alias("statistic"), p.cast("double").alias("p_value"), ok.alias("supported")) for table, k, s, x, ok, p in named))


def geography(panel: DataFrame, pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Countries: output against impact, convergence, leaders that stay, concentration, premium of collaboration."""
    totals = countries.summary(panel)
    rho = stats.spearman(totals, "articles", "citations")
    beta, kept = countries.beta_convergence(panel), countries.persistence(panel).agg(F.avg("retention").alias("r"))
    gini = primitives.trend(countries.inequality_by(panel, "year", "articles"), [], "year", "gini")
    premium = countries.collaboration_premium(pairs, records)
    p = stats.normal_two_sided(F.col("z"))
    rows = [
        _row(rho, "output_impact", "output and citations of countries rise together", F.col("rho"), (p < 0.05) & (F.col("rho") > 0), p),
        _row(beta, "beta_convergence", "countries with less output grow faster", F.col("slope"), F.when(F.col("points") >= 8, F.col("slope") < 0)),
        _row(kept, "leader_persistence", "over 60 % of the leaders stay from year to year", F.col("r"), F.col("r") > 0.6),
        _row(gini, "concentration_stability", "the yearly Gini does not move by over 0.01 a year", F.col("slope"), F.abs(F.col("slope")) <= 0.01),
        _row(premium, "collaboration_premium", "documents of several countries have a higher mean", F.col("gap"), F.col("gap") > 0),
    ]
    return reduce(DataFrame.unionByName, rows)


def claims(table: DataFrame) -> DataFrame:
    """Supported hypotheses as claims with the strength of their p (rule: by rule alone)."""
    strength = F.when(F.col("p_value").isNull(), "rule").otherwise(stats.claim_strength(F.col("p_value")))
    return table.where("supported").select("id", "statement", "statistic", "p_value", strength.alias("strength"))


def venues(summary: DataFrame, growth_: DataFrame) -> DataFrame:
    """Sources (``venues.summary`` and ``venues.growth_table``): concentration, quality, growth, age and life cycle."""
    share = primitives.top_share(summary, "tp", [0.2])
    rho = stats.spearman(summary, "tp", "cpp")
    aged = summary.withColumn("span", F.col("last_year") - F.col("first_year") + 1)
    old = stats.spearman(aged, "span", "tp")
    slopes = growth_.agg(F.avg((F.col("slope") > 0).cast("double")).alias("up"))
    staged = summary.join(growth_.select("source", "slope"), "source").agg((F.avg(F.when(F.col("slope") > 0, F.col("cpp"))) - F.avg(F.when(F.col("slope") <= 0, F.col("cpp")))).alias("gap"))
    rows = [
        _row(share, "source_concentration", "a fifth of the sources has half of the articles", F.col("share"), F.col("share") >= 0.5),
        _row(rho, "output_quality", "sources with more articles are cited more an article", F.col("rho"), F.col("rho") > 0),
        _row(slopes, "growing_sources", "over half of the sources grow", F.col("up"), F.col("up") > 0.5),
        _row(old, "longevity", "sources of more years have more articles", F.col("rho"), F.col("rho") > 0),
        _row(staged, "growth_impact", "growing sources are cited more an article than others", F.col("gap"), F.col("gap") > 0),
    ]
    return reduce(DataFrame.unionByName, rows)


def places(panel: DataFrame, regions: DataFrame) -> DataFrame:
    """Countries (``countries.panel``) and their regions: growth, size, dominance, convergence and regional gaps."""
    totals = countries.summary(panel)
    slopes = primitives.trend(panel, ["country"], "year", "articles").select("country", "slope")
    growing = slopes.agg(F.avg((F.col("slope") > 0).cast("double")).alias("up"))
    size = stats.spearman(totals.join(slopes, "country"), "articles", "slope")
    largest = totals.agg(F.max("share").alias("share"))
    spread = primitives.trend(countries.sigma_convergence(panel), [], "year", "cv")
    means = totals.join(regions, "country").groupBy("region").agg((F.sum("citations") / F.sum("articles")).alias("m")).agg(primitives.ratio(F.max("m"), F.min("m")).alias("ratio"))
    rows = [
        _row(growing, "growing_countries", "over half of the countries grow", F.col("up"), F.col("up") > 0.5),
        _row(size, "size_growth", "larger countries grow by more articles a year", F.col("rho"), F.col("rho") > 0),
        _row(largest, "dominance", "one country has over a fifth of all articles", F.col("share"), F.col("share") > 0.2),
        _row(spread, "sigma_convergence", "the yearly spread over countries falls", F.col("slope"), F.col("slope") < 0),
        _row(means, "regional_gap", "a region is cited over a fifth more an article than another", F.col("ratio"), F.col("ratio") > 1.2),
    ]
    return reduce(DataFrame.unionByName, rows)


def dynamics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per series ``id, statistic, supported``: outliers, regimes, forecasts, acceleration, shape and persistence."""
    own = Window.partitionBy(*keys)
    order = own.orderBy("year")
    flagged = series.anomalies(df, keys).groupBy(*keys).agg(F.sum(F.col("outlier").cast("int")).cast("double").alias("s"))
    cut = series.pettitt(df, keys).select(*keys, F.col("year").alias("_cut"))
    sides = df.join(cut, keys).groupBy(*keys).agg(primitives.ratio(F.avg(F.when(F.col("year") > F.col("_cut"), F.col("articles"))) - F.avg(F.when(F.col("year") <= F.col("_cut"), F.col("articles"))), F.stddev_samp("articles")).alias("s"))
    errors = fits.expanding_errors(df, keys).groupBy(*keys).agg((F.min(F.when(F.col("model") == "naive", F.col("mae"))) - F.min(F.when(F.col("model") != "naive", F.col("mae")))).alias("s"))
    changes = df.select(*keys, (F.col("articles") - F.lag("articles").over(order)).alias("d"), F.row_number().over(order).alias("i"), F.count("*").over(own).alias("n"))
    faster = changes.groupBy(*keys).agg((F.avg(F.when(2 * F.col("i") > F.col("n") + 1, F.col("d"))) - F.avg(F.when(2 * F.col("i") <= F.col("n") + 1, F.col("d")))).alias("s"))
    line = primitives.trend(df, keys, "year", "articles").select(*keys, "r2")
    total = df.groupBy(*keys).agg((F.var_pop("articles") * F.count("*")).alias("_ss"))
    shape = series.mean_shift(df, keys).join(line, keys).join(total, keys).select(*keys, (F.col("r2") - primitives.ratio(F.col("gain"), F.col("_ss"))).alias("s"))
    lagged = series.residual_checks(df, keys).select(*keys, F.col("lag1").alias("s"))
    named = [(flagged, "outliers", F.col("s") > 0), (sides, "regime_difference", F.abs("s") > 0.5), (errors, "forecast_superiority", F.col("s") > 0), (faster, "acceleration", F.col("s") > 0), (shape, "gradual_change", F.col("s") > 0), (lagged, "persistence", F.col("s") > 0)]
    return reduce(DataFrame.unionByName, (t.select(*keys, F.lit(k).alias("id"), F.col("s").alias("statistic"), ok.alias("supported")) for t, k, ok in named))


def tested(df: DataFrame, keys: list[str]) -> DataFrame:
    """Per series (``keys, year, articles``) the hypotheses that have a test: ``id, statistic, effect, p_value``.

    ``trend``: Mann-Kendall z, tau. ``line``: F of the line over years, r2. ``curve``: F of the square beyond the line, its share of
    what the line leaves. ``regime``: Pettitt's K, its share of n**2 / 4. ``mean_break``: F of the best split into two means, share
    of the variance it takes. ``persistence``: F of the year before, r2. ``normal_values``: Anderson-Darling's adjusted statistic,
    which is also the effect. The null is no trend, no line and so on; a series too short for a test has no row of it.
    ``stats.benjamini_hochberg`` corrects all of them together.
    """
    years = df.groupBy(*keys).agg(F.min("year").alias("_first"))
    base = regression.with_powers(df.join(years, keys).withColumn("t", F.col("year") - F.col("_first")), "t", 2)
    out = lambda t, name, statistic, effect, p: t.select(*keys, F.lit(name).alias("id"), statistic.cast("double").alias("statistic"), effect.cast("double").alias("effect"), p.cast("double").alias("p_value"))
    ranked = series.mann_kendall(df, keys)
    line = regression.summary(base, keys, "articles", ["x1"])
    curve = regression.nested_f(base, keys, "articles", ["x1"], ["x2"])
    regime = series.pettitt(df, keys)
    broken = segments.mean_breaks(df, keys, most=1)
    none = broken.where("m = 0").select(*keys, F.col("ssr").alias("_all"))
    split = broken.where("m = 1").join(none, keys)
    past = regression.summary(regression.lagged(df, keys, ["articles"]), keys, "articles", ["articles_lag1"])
    shape = goodness.anderson_darling(df, keys, "articles")
    rows = [
        out(ranked, "trend", F.col("z"), primitives.ratio(2 * F.col("s"), F.col("n") * (F.col("n") - 1)), stats.normal_two_sided(F.col("z"))),
        out(line, "line", F.col("f"), F.col("r2"), F.col("p_value")),
        out(curve, "curve", F.col("f"), primitives.ratio(F.col("sse_small") - F.col("sse_large"), F.col("sse_small")), F.col("p_value")),
        out(regime, "regime", F.col("k"), primitives.ratio(4 * F.col("k"), F.col("n") * F.col("n")), F.col("p_value")),
        out(split, "mean_break", F.col("f"), 1 - primitives.ratio(F.col("ssr"), F.col("_all")), F.col("p_value")),
        out(past, "persistence", F.col("f"), F.col("r2"), F.col("p_value")),
        out(shape, "normal_values", F.col("adjusted"), F.col("adjusted"), F.col("p_value")),
    ]
    return reduce(DataFrame.unionByName, rows).where("statistic is not null")


def quality_gate(measured: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """``check, value, low, high, passed`` for columns of the one row of ``measured``; a null value does not pass."""
    rows = F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).cast("double").alias("value"), F.lit(low).cast("double").alias("low"), F.lit(high).cast("double").alias("high")) for c, (low, high) in limits.items()))
    out = measured.select(F.explode(rows).alias("r")).select("r.*")
    inside = F.coalesce(F.col("value") >= F.coalesce("low", F.lit(float("-inf"))), F.lit(False)) & F.coalesce(F.col("value") <= F.coalesce("high", F.lit(float("inf"))), F.lit(False))
    return out.withColumn("passed", inside)
