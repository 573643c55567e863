"""Descriptive analytics: production of authors, sources, countries, types and keywords, and their laws.

Inputs are a record table (``doc, year, citations, source, doc_type``) and exploded (``doc``, item) tables with each pair
once. Full counting gives an item one for each document, fractional counting 1 / (items of the document).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .primitives import citation_indices, histogram, ranked, ratio, trend




def overview(records: DataFrame, authors: DataFrame) -> DataFrame:
    """One row: documents, sources, authors, years spanned, mean citations, documents per author."""
    of_records = records.agg(
        F.count("*").alias("documents"),
        F.count_distinct("source").alias("sources"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.avg("citations").alias("mean_citations"),
        F.sum("citations").alias("total_citations"),
    )
    of_authors = authors.agg(F.count_distinct("author").alias("authors"), F.count("*").alias("appearances"))
    return of_records.crossJoin(of_authors).withColumn("documents_per_author", ratio(F.col("documents"), F.col("authors"))).withColumn("authors_per_document", ratio(F.col("appearances"), F.col("documents")))


def annual(records: DataFrame) -> DataFrame:
    """Articles and citations a year, their shares, cumulative counts and change on the row before."""
    order = Window.orderBy("year")
    years = records.where(F.col("year").isNotNull()).groupBy("year").agg(F.count("*").alias("articles"), F.sum("citations").alias("citations"))
    before = F.lag("articles").over(order)
    return years.withColumns(
        {
            "share": ratio(F.col("articles"), F.sum("articles").over(Window.partitionBy())),
            "cumulative": F.sum("articles").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "change": ratio(F.col("articles") - before, before),
        }
    )


def shares(df: DataFrame, item: str, weight: str | None = None) -> DataFrame:
    """``item``, ``articles`` (or the sum of ``weight``), ``share`` of all and competition ``rank``."""
    amount = F.count("*") if weight is None else F.sum(weight)
    counted = df.where(F.col(item).isNotNull()).groupBy(item).agg(amount.alias("articles"))
    total = counted.agg(F.sum("articles").alias("_all"))
    return ranked(counted, "articles").crossJoin(F.broadcast(total)).withColumn("share", ratio(F.col("articles"), F.col("_all"))).drop("_all")


def weighted(items: DataFrame) -> DataFrame:
    """``items`` with ``n_items`` of its document and fractional ``weight`` 1 / n_items."""
    sizes = items.groupBy("doc").agg(F.count("*").alias("n_items"))
    return items.join(sizes, "doc").withColumn("weight", 1.0 / F.col("n_items"))


def productivity(items: DataFrame, records: DataFrame, item: str) -> DataFrame:
    """Per item: articles (full), weighted articles, citations, weighted citations, first and last year."""
    joined = weighted(items).join(records.select("doc", "year", "citations"), "doc")
    return joined.groupBy(item).agg(
        F.count("*").alias("articles"),
        F.sum("weight").alias("weighted_articles"),
        F.sum("citations").alias("citations"),
        F.sum(F.col("weight") * F.col("citations")).alias("weighted_citations"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def author_indices(items: DataFrame, records: DataFrame, item: str, as_of_year: int | None = None) -> DataFrame:
    """Per item n, citations, h, g, i10, and m = h / years since the first paper (1 at least), as of ``as_of_year``.

    ``as_of_year``: the last year of the data unless given.
    """
    joined = items.join(records.select("doc", "year", "citations"), "doc")
    first = joined.groupBy(item).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    as_of = records.agg(F.max("year").alias("as_of")) if as_of_year is None else records.sparkSession.range(1).select(F.lit(as_of_year).alias("as_of"))
    indexed = citation_indices(joined, [item], "citations").join(first, item).crossJoin(F.broadcast(as_of))
    age = F.greatest(F.col("as_of") - F.col("first_year") + 1, F.lit(1))
    return indexed.withColumns({"m_quotient": ratio(F.col("h_index"), age), "h_per_root": ratio(F.col("h_index"), F.sqrt(F.col("n_papers").cast("double"))), "active_years": F.col("last_year") - F.col("first_year") + 1}).drop("as_of")


def career_stage(indices: DataFrame) -> DataFrame:
    """``indices`` with the stage by active years: early to 5, mid to 15, then late."""
    years = F.col("active_years")
    return indices.withColumn("stage", F.when(years <= 5, "early").when(years <= 15, "mid").otherwise("late"))


def trajectories(items: DataFrame, records: DataFrame, item: str, top: int = 10) -> DataFrame:
    """Papers and citations a year, with running totals, of the ``top`` items by papers (ties by name)."""
    joined = items.join(records.select("doc", "year", "citations"), "doc")
    best = joined.groupBy(item).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), item).limit(top).select(item)
    years = joined.join(F.broadcast(best), item).groupBy(item, "year").agg(F.count("*").alias("papers"), F.sum("citations").alias("citations"))
    run = Window.partitionBy(item).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return years.withColumn("cumulative_papers", F.sum("papers").over(run)).withColumn("cumulative_citations", F.sum("citations").over(run))


def publication_gaps(items: DataFrame, records: DataFrame, item: str) -> DataFrame:
    """Per item, gaps of more than a year between years with papers: how many and the longest."""
    years = items.join(records.select("doc", "year"), "doc").select(item, "year").distinct()
    gap = F.col("year") - F.lag("year").over(Window.partitionBy(item).orderBy("year"))
    return years.withColumn("gap", gap).groupBy(item).agg(F.sum(F.when(F.col("gap") > 1, 1).otherwise(0)).alias("gaps"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest"))


def most_cited(records: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` documents by citations (ties by id) with citations a year of age, 1 at least, as of the last year."""
    last = records.agg(F.max("year").alias("_last"))
    age = F.greatest(F.col("_last") - F.col("year") + 1, F.lit(1))
    best = records.crossJoin(F.broadcast(last)).withColumn("per_year", ratio(F.col("citations"), age))
    return best.orderBy(F.desc("citations"), "doc").limit(top).select("doc", "year", "citations", "per_year")


def collaboration(authors: DataFrame, records: DataFrame) -> DataFrame:
    """Collaborative index, degree and coefficient over documents with authors; ``without`` counts the others."""
    sizes = authors.groupBy("doc").agg(F.count("*").alias("k"))
    per_doc = records.select("doc").join(sizes, "doc", "left")
    k = F.col("k")
    return per_doc.agg(
        F.count("k").alias("documents"),
        F.sum(F.when(k.isNull(), 1).otherwise(0)).alias("without"),
        F.avg("k").alias("collaborative_index"),
        F.avg(F.when(k > 1, 1.0).when(k == 1, 0.0)).alias("degree_of_collaboration"),
        F.avg(1 - 1.0 / k).alias("collaborative_coefficient"),
    )


def collaboration_by(authors: DataFrame, records: DataFrame, group: str) -> DataFrame:
    """Per ``group`` (year, type): documents, mean and median authors, single and multi, rate of multi."""
    sizes = authors.groupBy("doc").agg(F.count("*").alias("k"))
    joined = records.select("doc", group).join(sizes, "doc")
    multi = F.sum(F.when(F.col("k") > 1, 1).otherwise(0))
    return joined.groupBy(group).agg(F.count("*").alias("documents"), F.avg("k").alias("mean_authors"), F.median("k").alias("median_authors"), (F.count("*") - multi).alias("single"), multi.alias("multi"), ratio(multi, F.count("*")).alias("rate"))


def lotka(items: DataFrame, item: str) -> DataFrame:
    """Papers-per-author histogram with observed and expected shares under the fitted inverse power law.

    The exponent is the most likely of 400 values from 1.01 to 5, a hundredth apart, over the bounded sums of the histogram;
    the constant is 1 over the sum of k^-alpha for k to 1000.
    """
    papers = items.groupBy(item).agg(F.count("*").alias("papers"))
    return fit_lotka(papers.groupBy("papers").agg(F.count("*").alias("authors")))


def fit_lotka(counted: DataFrame) -> DataFrame:
    """``counted`` (papers, authors) with ``observed``, ``expected``, ``alpha`` and the largest gap ``ks`` of the sums."""
    sums = counted.agg(F.sum("authors").alias("n"), F.sum(F.col("authors") * F.log("papers")).alias("logs"))
    grid = F.transform(F.sequence(F.lit(0), F.lit(399)), lambda i: F.lit(1.01) + i * F.lit(0.01))
    ranks = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.log(k.cast("double")))
    scored = sums.select("n", "logs", F.explode(grid).alias("alpha")).withColumn("zeta", F.aggregate(ranks, F.lit(0.0), lambda acc, x: acc + F.exp(-x * F.col("alpha"))))
    likelihood = -F.col("alpha") * F.col("logs") - F.col("n") * F.log("zeta")
    best = scored.agg(F.max_by(F.struct("alpha", "zeta", "n"), likelihood).alias("best"))
    run = Window.orderBy("papers").rowsBetween(Window.unboundedPreceding, 0)
    fitted = counted.crossJoin(F.broadcast(best)).select("papers", "authors", ratio(F.col("authors"), F.col("best.n")).alias("observed"), (F.pow(F.col("papers").cast("double"), -F.col("best.alpha")) / F.col("best.zeta")).alias("expected"), F.col("best.alpha").alias("alpha"))
    gap = F.abs(F.sum("observed").over(run) - F.sum("expected").over(run))
    return fitted.withColumn("_gap", gap).withColumn("ks", F.max("_gap").over(Window.partitionBy())).drop("_gap")


def country_table(countries: DataFrame, records: DataFrame) -> DataFrame:
    """Per country: articles, citations, means, single- and multi-country papers and the multi share."""
    joined = weighted(countries).join(records.select("doc", "citations"), "doc")
    multi = F.sum(F.when(F.col("n_items") > 1, 1).otherwise(0))
    return joined.groupBy("country").agg(
        F.count("*").alias("articles"),
        F.sum("citations").alias("citations"),
        F.avg("citations").alias("mean_citations"),
        (F.count("*") - multi).alias("scp"),
        multi.alias("mcp"),
        ratio(multi, F.count("*")).alias("mcp_ratio"),
    )


def quadrants(df: DataFrame, x: str, y: str, names: tuple[str, str, str, str]) -> DataFrame:
    """``df`` with ``quadrant`` by the medians of x and y: names for (high, high), (high, low), (low, high), (low, low)."""
    cuts = df.agg(F.median(x).alias("_mx"), F.median(y).alias("_my"))
    high_x, high_y = F.col(x) >= F.col("_mx"), F.col(y) >= F.col("_my")
    label = F.when(high_x & high_y, names[0]).when(high_x, names[1]).when(high_y, names[2]).otherwise(names[3])
    return df.crossJoin(F.broadcast(cuts)).withColumn("quadrant", label).drop("_mx", "_my")


def citation_profile(records: DataFrame) -> DataFrame:
    """Moments of the citations, share uncited, and the corpus's h, g and i10."""
    moments = records.agg(F.count("citations").alias("n"), F.avg("citations").alias("mean"), F.median("citations").alias("median"), F.stddev_samp("citations").alias("sd"), F.max("citations").alias("most"), F.avg((F.col("citations") == 0).cast("double")).alias("uncited"))
    return moments.crossJoin(citation_indices(records, [], "citations").select("h_index", "g_index", "i10_index"))


def citation_age(records: DataFrame) -> DataFrame:
    """Citations by age of the document (years before the last, from 0), with running share of all."""
    last = records.agg(F.max("year").alias("_last"))
    ages = records.crossJoin(F.broadcast(last)).where(F.col("year").isNotNull()).groupBy((F.col("_last") - F.col("year")).alias("age")).agg(F.count("*").alias("documents"), F.sum("citations").alias("citations"))
    run = Window.orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    return ages.withColumn("cumulative_share", ratio(F.sum("citations").over(run), F.sum("citations").over(Window.partitionBy())))


def half_life(ages: DataFrame) -> DataFrame:
    """From ``citation_age``: the least age that reaches half of all citations, and the share of age at most 5."""
    return ages.agg(F.min(F.when(F.col("cumulative_share") >= 0.5, F.col("age"))).alias("half_life"), ratio(F.sum(F.when(F.col("age") <= 5, F.col("citations")).otherwise(0)), F.sum("citations"), 0.0).alias("price_index"))


def citation_velocity(records: DataFrame) -> DataFrame:
    """Citations a year of age (1 at least) by year of publication: mean, median, documents."""
    last = records.agg(F.max("year").alias("_last"))
    speed = ratio(F.col("citations"), F.greatest(F.col("_last") - F.col("year"), F.lit(1)))
    return records.crossJoin(F.broadcast(last)).withColumn("velocity", speed).groupBy("year").agg(F.avg("velocity").alias("mean_velocity"), F.median("velocity").alias("median_velocity"), F.count("*").alias("documents"))


def zipf(items: DataFrame, item: str) -> DataFrame:
    """Slope, intercept and R2 of ln frequency on ln rank over the distinct frequencies' highest ranks."""
    freq = ranked(items.groupBy(item).agg(F.count("*").alias("n")), "n").select("n", "rank").distinct()
    return trend(freq.select(F.log("rank").alias("x"), F.log("n").alias("y")), [], "x", "y")


def keyword_years(keywords: DataFrame, records: DataFrame) -> DataFrame:
    """Documents with each keyword a year, with zero for the years in between and around."""
    counted = keywords.join(records.select("doc", "year"), "doc").groupBy("keyword", "year").agg(F.count("*").alias("n"))
    span = records.agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
    grid = keywords.select("keyword").distinct().crossJoin(F.broadcast(span)).select("keyword", F.explode(F.sequence("_a", "_b")).alias("year"))
    return grid.join(counted, ["keyword", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def thematic_evolution(keywords: DataFrame, records: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` keywords of each third of the years: share of the period's uses and rank."""
    span = records.agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
    third = F.least(F.floor((F.col("year") - F.col("_a")) * 3 / (F.col("_b") - F.col("_a") + 1)), F.lit(2))
    joined = keywords.join(records.select("doc", "year"), "doc").crossJoin(F.broadcast(span))
    named = joined.withColumn("period", F.element_at(F.array(F.lit("early"), F.lit("middle"), F.lit("late")), (third + 1).cast("int")))
    counted = named.groupBy("period", "keyword").agg(F.count("*").alias("uses"))
    own = Window.partitionBy("period")
    out = counted.withColumn("share", ratio(F.col("uses"), F.sum("uses").over(own))).withColumn("rank", F.rank().over(own.orderBy(F.desc("uses"))))
    return out.where(F.col("rank") <= top)


def value_histogram(df: DataFrame, value: str) -> DataFrame:
    """How many rows have each value."""
    return histogram(df, [], value).withColumnsRenamed({"x": value, "n": "rows"})
