"""Country analytics over exploded (doc, country) pairs and country-year panels.

A panel has ``country, year, articles, citations``: an aggregate with a row a country and year. Windows run over panels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .descriptive import weighted
from .primitives import clamp, concentration, growth, pair_counts, pair_similarity, ratio, trend




def panel(countries: DataFrame, records: DataFrame, fractional: bool = False) -> DataFrame:
    """Articles and citations by country and year, in full or fractional counts."""
    joined = weighted(countries).join(records.select("doc", "year", "citations"), "doc").where(F.col("year").isNotNull())
    one = F.col("weight") if fractional else F.lit(1)
    return joined.groupBy("country", "year").agg(F.sum(one).alias("articles"), F.sum(one * F.col("citations")).alias("citations"))


def summary(panel_: DataFrame) -> DataFrame:
    """Per country totals, share, rank and cumulative share by descending articles (ties by name)."""
    totals = panel_.groupBy("country").agg(F.sum("articles").alias("articles"), F.sum("citations").alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    order = Window.orderBy(F.desc("articles"), "country")
    every = F.sum("articles").over(Window.partitionBy())
    return totals.withColumns(
        {
            "share": ratio(F.col("articles"), every),
            "rank": F.row_number().over(order),
            "cumulative_share": ratio(F.sum("articles").over(order.rowsBetween(Window.unboundedPreceding, 0)), every),
            "mean_citations": ratio(F.col("citations"), F.col("articles")),
        }
    )


def inequality(totals: DataFrame, value: str) -> DataFrame:
    """Gini, HHI, entropy, evenness and Theil of a total over countries, with top-5, top-10 and Palma shares."""
    down = Window.orderBy(F.desc(value), "country")
    n = F.count("*").over(Window.partitionBy())
    placed = totals.select(value, F.row_number().over(down).alias("_r"), n.alias("_n"))
    x = F.col(value)
    tenth, forty = F.ceil(F.round(F.col("_n") * 0.1, 9)), F.floor(F.round(F.col("_n") * 0.4, 9))
    of = lambda test: F.sum(F.when(test, x).otherwise(0))
    tops = placed.agg(ratio(of(F.col("_r") <= 5), F.sum(x)).alias("top5"), ratio(of(F.col("_r") <= 10), F.sum(x)).alias("top10"), ratio(of(F.col("_r") <= tenth), of(F.col("_r") > F.col("_n") - forty)).alias("palma"))
    return concentration(totals, [], value).crossJoin(tops)


def inequality_by(panel_: DataFrame, group: str, value: str) -> DataFrame:
    """Concentration of ``value`` over countries for each year or other group."""
    return concentration(panel_.groupBy(group, "country").agg(F.sum(value).alias(value)), [group], value)


def growth_dynamics(panel_: DataFrame) -> DataFrame:
    """Per country CAGR over the span of years, slope, and growth of the last year on the one before in the panel."""
    order = Window.partitionBy("country").orderBy("year")
    last = panel_.withColumn("_b", F.lag("articles").over(order)).groupBy("country").agg(F.max_by(F.struct("articles", "_b"), "year").alias("_l"))
    step = last.select("country", ratio(F.col("_l.articles") - F.col("_l._b"), F.col("_l._b")).alias("last_growth"))
    return growth(panel_, ["country"], "year", "articles").join(trend(panel_, ["country"], "year", "articles"), "country").join(step, "country")


def change_points(panel_: DataFrame) -> DataFrame:
    """Per country the means of both halves of its years and whether they differ by over a standard deviation."""
    own = Window.partitionBy("country")
    placed = panel_.withColumn("_i", F.row_number().over(own.orderBy("year"))).withColumn("_n", F.count("*").over(own))
    first = F.col("_i") <= F.ceil(F.col("_n") / 2)
    halves = placed.groupBy("country").agg(
        F.avg(F.when(first, F.col("articles"))).alias("mean_before"),
        F.avg(F.when(~first, F.col("articles"))).alias("mean_after"),
        F.stddev_samp("articles").alias("sd"),
        F.max(F.when(first, F.col("year"))).alias("year"),
    )
    return halves.withColumn("changed", F.coalesce(F.abs(F.col("mean_after") - F.col("mean_before")) > F.col("sd"), F.lit(False)))


def momentum(panel_: DataFrame, recent: int = 3) -> DataFrame:
    """Per country mean articles of its last ``recent`` years over the mean of those before."""
    place = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("year")))
    split = panel_.withColumn("_r", place <= recent)
    means = split.groupBy("country").agg(F.avg(F.when(F.col("_r"), F.col("articles"))).alias("recent_mean"), F.avg(F.when(~F.col("_r"), F.col("articles"))).alias("earlier_mean"))
    return means.withColumn("momentum", ratio(F.col("recent_mean"), F.col("earlier_mean")))


def regional(totals: DataFrame, regions: DataFrame) -> DataFrame:
    """Totals by region with share, and chi-square of articles against equal shares (the same in every row)."""
    rolled = totals.join(regions, "country").groupBy("region").agg(F.count("*").alias("countries"), F.sum("articles").alias("articles"), F.sum("citations").alias("citations"))
    every, n = F.sum("articles").over(Window.partitionBy()), F.count("*").over(Window.partitionBy())
    expected = every / n
    deviation = (F.col("articles") - expected) * (F.col("articles") - expected) / expected
    return rolled.withColumns({"share": ratio(F.col("articles"), every), "chi_square": F.sum(deviation).over(Window.partitionBy())})


def yearly_ranks(panel_: DataFrame) -> DataFrame:
    """``panel`` with competition ``rank`` in the year and its ``change`` on the country's year before."""
    ranks = panel_.withColumn("rank", F.rank().over(Window.partitionBy("year").orderBy(F.desc("articles"))))
    before = ranks.select("country", (F.col("year") + 1).alias("year"), F.col("rank").alias("_b"))
    return ranks.join(before, ["country", "year"], "left").withColumn("change", F.col("rank") - F.col("_b")).drop("_b")


def rank_mobility(panel_: DataFrame) -> DataFrame:
    """Per country mean absolute change, volatility and range of its yearly ranks."""
    return yearly_ranks(panel_).groupBy("country").agg(
        F.avg(F.abs("change")).alias("mean_change"), F.stddev_samp("rank").alias("volatility"), F.min("rank").alias("best"), F.max("rank").alias("worst"), F.count("*").alias("years")
    )


def persistence(panel_: DataFrame, top: int = 5) -> DataFrame:
    """Per year how many of the ``top`` countries of the year before (rank at most ``top``) stay there."""
    leaders = yearly_ranks(panel_).where(F.col("rank") <= top).select("year", "country")
    before = leaders.select((F.col("year") + 1).alias("year"), "country")
    kept = before.join(leaders, ["year", "country"]).groupBy("year").agg(F.count("*").alias("kept"))
    had = before.groupBy("year").agg(F.count("*").alias("leaders")).join(leaders.select("year").distinct(), "year")
    return had.join(kept, "year", "left").select("year", "leaders", F.coalesce("kept", F.lit(0)).alias("kept")).withColumn("retention", ratio(F.col("kept"), F.col("leaders")))


def rank_agreement(panel_: DataFrame) -> DataFrame:
    """Kendall's tau-a of consecutive years' ranks over the countries in both."""
    ranks = yearly_ranks(panel_).select("year", "country", "rank")
    before = ranks.select((F.col("year") + 1).alias("year"), "country", F.col("rank").alias("old"))
    both = ranks.join(before, ["year", "country"])
    a, b = both.alias("a"), both.alias("b")
    pairs = a.join(b, (F.col("a.year") == F.col("b.year")) & (F.col("a.country") < F.col("b.country")))
    sign = F.signum((F.col("a.rank") - F.col("b.rank")).cast("double")) * F.signum((F.col("a.old") - F.col("b.old")).cast("double"))
    return pairs.groupBy(F.col("a.year").alias("year")).agg(F.avg(sign).alias("tau"), F.count("*").alias("pairs"))


def transitions(panel_: DataFrame) -> DataFrame:
    """Quartile of a country's articles in a year against its quartile the year before: count and probability."""
    state = F.ntile(4).over(Window.partitionBy("year").orderBy("articles", "country"))
    states = panel_.withColumn("state", state).select("country", "year", "state")
    before = states.select("country", (F.col("year") + 1).alias("year"), F.col("state").alias("state_before"))
    moved = states.join(before, ["country", "year"]).groupBy("state_before", "state").agg(F.count("*").alias("n"))
    return moved.withColumn("probability", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("state_before"))))


def share_windows(panel_: DataFrame) -> DataFrame:
    """Share of all articles by country in the first and the last third of the years, and the change."""
    span = panel_.agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
    width = F.floor((F.col("_b") - F.col("_a") + 1) / 3)
    placed = panel_.crossJoin(F.broadcast(span))
    first, last = F.col("year") < F.col("_a") + width, F.col("year") > F.col("_b") - width
    sums = placed.groupBy("country").agg(F.sum(F.when(first, F.col("articles")).otherwise(0)).alias("_f"), F.sum(F.when(last, F.col("articles")).otherwise(0)).alias("_l"))
    shared = sums.select("country", ratio(F.col("_f"), F.sum("_f").over(Window.partitionBy()), 0.0).alias("first_share"), ratio(F.col("_l"), F.sum("_l").over(Window.partitionBy()), 0.0).alias("last_share"))
    change = F.col("last_share") - F.col("first_share")
    status = F.when((F.col("first_share") == 0) & (F.col("last_share") > 0), "entrant").when((F.col("first_share") > 0) & (F.col("last_share") == 0), "exit").when(change > 0, "rising").when(change < 0, "falling").otherwise("stable")
    return shared.withColumn("change", change).withColumn("status", status)


def emergence(panel_: DataFrame) -> DataFrame:
    """Countries by first year with articles, and the running number."""
    first = panel_.groupBy("country").agg(F.min("year").alias("year")).groupBy("year").agg(F.count("*").alias("entrants"))
    return first.withColumn("cumulative", F.sum("entrants").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def collaboration(countries: DataFrame) -> DataFrame:
    """Country pairs with joint documents, Salton, Jaccard and affinity indices."""
    totals = countries.groupBy("country").agg(F.count("*").alias("n"))
    return pair_similarity(pair_counts(countries, "doc", "country"), totals, "country", "n")


def partners(countries: DataFrame) -> DataFrame:
    """Per country: partners, joint documents over all partners, and the strongest partner (ties by name)."""
    pairs = pair_counts(countries, "doc", "country")
    both = pairs.select(F.col("a").alias("country"), F.col("b").alias("partner"), "weight").unionByName(pairs.select(F.col("b").alias("country"), F.col("a").alias("partner"), "weight"))
    top = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("weight"), "partner"))
    return both.withColumn("_r", top).groupBy("country").agg(F.count("*").alias("partners"), F.sum("weight").alias("strength"), F.max(F.when(F.col("_r") == 1, F.col("partner"))).alias("top_partner"), F.max("weight").alias("top_weight"))


def backbone(pairs: DataFrame, quantile: float = 0.75) -> DataFrame:
    """Pairs with at least the ``quantile`` of all weights (linear interpolation)."""
    cut = pairs.agg(F.percentile("weight", F.lit(quantile)).alias("_cut"))
    return pairs.crossJoin(F.broadcast(cut)).where(F.col("weight") >= F.col("_cut")).drop("_cut")


def collaboration_premium(countries: DataFrame, records: DataFrame) -> DataFrame:
    """Mean citations of documents of several countries and of one, their gap, and Cohen's d with pooled deviation."""
    sizes = countries.groupBy("doc").agg(F.count("*").alias("k")).join(records.select("doc", "citations"), "doc")
    multi, c = F.col("k") > 1, F.col("citations")
    of = lambda f, test: f(F.when(test, c))
    out = sizes.agg(of(F.count, multi).alias("n_multi"), of(F.count, ~multi).alias("n_single"), of(F.avg, multi).alias("mean_multi"), of(F.avg, ~multi).alias("mean_single"), of(F.var_samp, multi).alias("_vm"), of(F.var_samp, ~multi).alias("_vs"))
    pooled = F.sqrt(((F.col("n_multi") - 1) * F.col("_vm") + (F.col("n_single") - 1) * F.col("_vs")) / (F.col("n_multi") + F.col("n_single") - 2))
    gap = F.col("mean_multi") - F.col("mean_single")
    return out.withColumn("gap", gap).withColumn("cohens_d", ratio(gap, pooled)).drop("_vm", "_vs")


def multi_share_by_year(countries: DataFrame, records: DataFrame) -> DataFrame:
    """Share of documents with several countries a year, over documents with any."""
    sizes = countries.groupBy("doc").agg(F.count("*").alias("k")).join(records.select("doc", "year"), "doc")
    return sizes.groupBy("year").agg(F.count("*").alias("documents"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).alias("mcp")).withColumn("mcp_share", ratio(F.col("mcp"), F.col("documents")))


def counting_robustness(countries: DataFrame, records: DataFrame) -> DataFrame:
    """Per country rank by full and by fractional counts and the difference."""
    counts = weighted(countries).join(records.select("doc"), "doc").groupBy("country").agg(F.count("*").alias("full"), F.round(F.sum("weight"), 9).alias("fractional"))
    by = lambda c: F.rank().over(Window.orderBy(F.desc(c)))
    return counts.withColumns({"full_rank": by("full"), "fractional_rank": by("fractional")}).withColumn("shift", F.col("fractional_rank") - F.col("full_rank"))


def outliers(totals: DataFrame, least_z: float = 2.0) -> DataFrame:
    """Residuals of ln(citations + 1) on ln(articles + 1) over countries, their z and whether it reaches ``least_z``."""
    logs = totals.select("country", F.log1p(F.col("articles").cast("double")).alias("x"), F.log1p(F.col("citations").cast("double")).alias("y"))
    line = trend(logs, [], "x", "y")
    residual = logs.crossJoin(F.broadcast(line)).withColumn("residual", F.col("y") - F.col("intercept") - F.col("slope") * F.col("x"))
    z = ratio(F.col("residual") - F.avg("residual").over(Window.partitionBy()), F.stddev_samp("residual").over(Window.partitionBy()), 0.0)
    return residual.withColumn("z", z).withColumn("outlier", F.abs("z") >= least_z).select("country", "residual", "z", "outlier")


def roles(totals: DataFrame, partners_: DataFrame) -> DataFrame:
    """A role a country by 80th percentiles: leader (output and impact), producer, influencer, connector or follower."""
    joined = totals.join(partners_.select("country", "strength"), "country", "left").withColumn("strength", F.coalesce("strength", F.lit(0)))
    cut = lambda c: F.percentile(c, F.lit(0.8))
    cuts = joined.agg(cut("articles").alias("_a"), cut("mean_citations").alias("_c"), cut("strength").alias("_s"))
    big, cited, linked = F.col("articles") >= F.col("_a"), F.col("mean_citations") >= F.col("_c"), F.col("strength") >= F.col("_s")
    role = F.when(big & cited, "leader").when(big, "producer").when(cited, "influencer").when(linked, "connector").otherwise("follower")
    return joined.crossJoin(F.broadcast(cuts)).select("country", role.alias("role"))


def beta_convergence(panel_: DataFrame) -> DataFrame:
    """Line of log growth over the span on log initial articles across countries: a negative slope is convergence."""
    ends = growth(panel_, ["country"], "year", "articles").where((F.col("first_value") > 0) & (F.col("last_value") > 0) & (F.col("last_year") > F.col("first_year")))
    points = ends.select(F.log(F.col("first_value").cast("double")).alias("x"), (F.log(F.col("last_value") / F.col("first_value")) / (F.col("last_year") - F.col("first_year"))).alias("y"))
    return trend(points, [], "x", "y")


def sigma_convergence(panel_: DataFrame) -> DataFrame:
    """Coefficient of variation of articles over countries a year."""
    return panel_.groupBy("year").agg(ratio(F.stddev_samp("articles"), F.avg("articles")).alias("cv"), F.count("*").alias("countries"))


def haversine(lat1, lon1, lat2, lon2):
    """Great-circle kilometres between two points in degrees, on a sphere of radius 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(clamp(a, 0.0, 1.0)))


def morans_i(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Moran's I and Geary's C of ``values`` (country, x) under ``weights`` (a, b, w), and I's expectation."""
    centred = values.withColumn("d", F.col("x") - F.avg("x").over(Window.partitionBy())).select("country", "x", "d")
    base = centred.agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    a = centred.select(F.col("country").alias("a"), F.col("d").alias("da"), F.col("x").alias("xa"))
    b = centred.select(F.col("country").alias("b"), F.col("d").alias("db"), F.col("x").alias("xb"))
    sums = weights.join(a, "a").join(b, "b").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("da") * F.col("db")).alias("cross"), F.sum(F.col("w") * F.pow(F.col("xa") - F.col("xb"), 2)).alias("gap"))
    n, w = F.col("n"), F.col("w")
    return sums.crossJoin(base).select(ratio(n * F.col("cross"), w * F.col("ss")).alias("morans_i"), ratio((n - 1) * F.col("gap"), 2 * w * F.col("ss")).alias("gearys_c"), (-1.0 / (n - 1)).alias("expected"))


def region_weights(regions: DataFrame) -> DataFrame:
    """Weight 1 for ordered pairs of countries of one region."""
    a, b = regions.select("region", F.col("country").alias("a")), regions.select("region", F.col("country").alias("b"))
    return a.join(b, "region").where("a <> b").select("a", "b", F.lit(1.0).alias("w"))


def local_statistics(values: DataFrame, weights: DataFrame) -> DataFrame:
    """Per country of ``values`` (country, x) under ``weights`` (a, b, w): local Moran's ``moran``, Getis and Ord's ``g_star`` (its own
    weight 1 included, as a z score), and the ``quadrant`` of its value and its neighbours' mean (high or low each)."""
    every = Window.partitionBy()
    centred = values.select("country", F.col("x").cast("double").alias("x"), (F.col("x") - F.avg("x").over(every)).alias("d"), F.count("*").over(every).alias("n"), F.avg("x").over(every).alias("mean"), F.sqrt(F.var_pop("x").over(every)).alias("s"))
    around = weights.join(centred.select(F.col("country").alias("b"), F.col("d").alias("db"), F.col("x").alias("xb")), "b").groupBy(F.col("a").alias("country")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("w") * F.col("db")).alias("wd"), F.sum(F.col("w") * F.col("xb")).alias("wx"))
    joined = centred.join(around, "country", "left").fillna(0.0, ["w", "ww", "wd", "wx"])
    n, s, w, ww = F.col("n"), F.col("s"), F.col("w") + 1, F.col("ww") + 1
    below = s * F.sqrt((n * ww - w * w) / (n - 1))
    side = lambda x: F.when(x >= 0, "high").otherwise("low")
    return joined.select("country", ratio(F.col("d") * F.col("wd"), s * s).alias("moran"), ratio(F.col("wx") + F.col("x") - F.col("mean") * w, below).alias("g_star"), F.concat(side(F.col("d")), F.lit("-"), side(F.col("wd"))).alias("quadrant"))


def gravity(pairs: DataFrame, totals: DataFrame) -> DataFrame:
    """The line of ln joint documents (``pairs``: a, b, weight) on the sum of the logs of both countries' articles."""
    mass = totals.select("country", F.log("articles").alias("_m"))
    both = pairs.join(mass.withColumnsRenamed({"country": "a", "_m": "_ma"}), "a").join(mass.withColumnsRenamed({"country": "b", "_m": "_mb"}), "b")
    logged = both.where("weight > 0").select((F.col("_ma") + F.col("_mb")).alias("x"), F.log("weight").alias("y"))
    return trend(logged, [], "x", "y")


def small_world(edges: DataFrame) -> DataFrame:
    """Mean clustering and mean distance of a network against those of a random one with as many nodes and edges (degree over
    nodes, and ln nodes over ln degree), and ``sigma``, the ratio of the two ratios. For small networks: all distances."""
    from . import networks

    of = networks.network_summary(edges).select("nodes", "mean_degree")
    clustered = networks.transitivity(edges).select("mean_clustering")
    far = networks.distances(edges, networks.degrees(edges).select("node")).where("hops > 0").agg(F.avg("hops").alias("mean_distance"))
    joined = of.crossJoin(clustered).crossJoin(far)
    random_clustering = ratio(F.col("mean_degree"), F.col("nodes"))
    random_distance = ratio(F.log("nodes"), F.log("mean_degree"))
    return joined.select("nodes", "mean_degree", "mean_clustering", "mean_distance", random_clustering.alias("random_clustering"), random_distance.alias("random_distance"), ratio(F.col("mean_clustering") / random_clustering, F.col("mean_distance") / random_distance).alias("sigma"))
