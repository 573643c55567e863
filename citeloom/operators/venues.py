"""Source (venue) analytics over ``records`` (doc, year, citations, source) and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .primitives import citation_indices, concentration, growth, pair_counts, ranked, ratio, trend




def panel(records: DataFrame) -> DataFrame:
    """Articles and citations by source and year."""
    return records.where(F.col("source").isNotNull()).groupBy("source", "year").agg(F.count("*").alias("articles"), F.sum("citations").alias("citations"))


def summary(records: DataFrame) -> DataFrame:
    """Per source: output, citations, citations per paper, h and g, years, share and ranks by each."""
    known = records.where(F.col("source").isNotNull())
    totals = known.groupBy("source").agg(F.count("*").alias("tp"), F.sum("citations").alias("tc"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    indexed = totals.join(citation_indices(known, ["source"], "citations").select("source", "h_index", "g_index"), "source")
    every = totals.agg(F.sum("tp").alias("_all"))
    out = indexed.withColumn("cpp", ratio(F.col("tc"), F.col("tp"))).crossJoin(F.broadcast(every)).withColumn("share", ratio(F.col("tp"), F.col("_all"))).drop("_all")
    for column in ("tp", "tc", "cpp"):
        out = ranked(out, column, f"rank_{column}")
    return out


def growth_table(panel_: DataFrame, recent: int = 3) -> DataFrame:
    """Per source slope, CAGR over its span, and articles of the last ``recent`` years of all data."""
    last = panel_.agg(F.max("year").alias("_last"))
    late = panel_.crossJoin(F.broadcast(last)).groupBy("source").agg(F.sum(F.when(F.col("year") > F.col("_last") - recent, F.col("articles")).otherwise(0)).alias("recent"))
    return growth(panel_, ["source"], "year", "articles").join(trend(panel_, ["source"], "year", "articles").select("source", "slope", "r2"), "source").join(late, "source")


def source_concentration(summary_: DataFrame) -> DataFrame:
    """Gini, HHI and entropy of output over sources and the share of the five and ten largest."""
    first = summary_.orderBy(F.desc("tp"), "source").select("tp", "source").limit(10)
    place = F.row_number().over(Window.orderBy(F.desc("tp"), "source"))
    top = first.select("tp", place.alias("_r")).agg(F.sum(F.when(F.col("_r") <= 5, F.col("tp"))).alias("_5"), F.sum("tp").alias("_10"))
    return concentration(summary_, [], "tp").crossJoin(top).withColumns({"top5": ratio(F.col("_5"), F.col("total")), "top10": ratio(F.col("_10"), F.col("total"))}).drop("_5", "_10")


def source_keywords(records: DataFrame, keywords: DataFrame, top: int = 5) -> DataFrame:
    """The ``top`` keywords of each source by documents (ties by word)."""
    counted = keywords.join(records.select("doc", "source"), "doc").where(F.col("source").isNotNull()).groupBy("source", "keyword").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "keyword"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def similarity(records: DataFrame, keywords: DataFrame, least: float = 0.25, sources: int = 50, words: int = 250) -> DataFrame:
    """Cosine of keyword counts between the ``sources`` largest sources over the ``words`` commonest keywords.

    The two bounds are part of the measure. Pairs under ``least`` are left out.
    """
    known = records.where(F.col("source").isNotNull())
    big = known.groupBy("source").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "source").limit(sources).select("source")
    common = keywords.groupBy("keyword").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "keyword").limit(words).select("keyword")
    counted = keywords.join(common, "keyword").join(known.select("doc", "source"), "doc").join(big, "source").groupBy("source", "keyword").agg(F.count("*").alias("n"))
    norms = counted.groupBy("source").agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("norm"))
    normed = counted.join(norms, "source").select("keyword", "source", (F.col("n") / F.col("norm")).alias("w"))
    a, b = normed.select("keyword", F.col("source").alias("a"), F.col("w").alias("wa")), normed.select("keyword", F.col("source").alias("b"), F.col("w").alias("wb"))
    cosine = a.join(b, "keyword").where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return cosine.where(F.col("cosine") >= least)


def specialization(records: DataFrame, keywords: DataFrame) -> DataFrame:
    """Per source 1 - evenness of its keywords: Specialist from .66, Generalist to .33, else Mixed."""
    counted = keywords.join(records.select("doc", "source"), "doc").where(F.col("source").isNotNull()).groupBy("source", "keyword").agg(F.count("*").alias("n"))
    index = 1 - F.coalesce(F.col("evenness"), F.lit(0.0))
    out = concentration(counted, ["source"], "n").select("source", F.col("n").alias("keywords"), index.alias("specialization"))
    return out.withColumn("scope", F.when(F.col("specialization") >= 0.66, "Specialist").when(F.col("specialization") <= 0.33, "Generalist").otherwise("Mixed"))


def lifecycle(growth_: DataFrame) -> DataFrame:
    """A stage a source: dormant (silent over two years), emerging (CAGR over 10 %), growing, declining or mature."""
    last = growth_.agg(F.max("last_year").alias("_end"))
    stage = (
        F.when(F.col("_end") - F.col("last_year") > 2, "dormant")
        .when((F.col("cagr") > 0.10) & (F.col("slope") > 0), "emerging")
        .when(F.col("slope") > 0, "growing")
        .when(F.col("slope") < 0, "declining")
        .otherwise("mature")
    )
    forecast = F.greatest(F.lit(0.0), F.col("last_value") + F.coalesce("slope", F.lit(0.0)))
    return growth_.crossJoin(F.broadcast(last)).withColumns({"stage": stage, "forecast": forecast}).select("source", "stage", "forecast")


def archetypes(summary_: DataFrame) -> DataFrame:
    """Sources by median output and impact: flagship, volume, niche or peripheral, with an outlier flag.

    An outlier is at or over the 90th percentile of the length of (z of output, z of impact).
    """
    z = lambda c: ratio(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"), 0.0)
    cuts = summary_.agg(F.median("tp").alias("_p"), F.median("cpp").alias("_c"), *(f(c).alias(f"_{n}_{c}") for c in ("tp", "cpp") for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    big, cited = F.col("tp") >= F.col("_p"), F.col("cpp") >= F.col("_c")
    label = F.when(big & cited, "flagship").when(big, "volume").when(cited, "niche").otherwise("peripheral")
    scored = summary_.crossJoin(F.broadcast(cuts)).withColumns({"archetype": label, "distance": F.sqrt(F.pow(z("tp"), 2) + F.pow(z("cpp"), 2))})
    cut = scored.agg(F.percentile("distance", F.lit(0.9)).alias("_cut"))
    return scored.crossJoin(F.broadcast(cut)).select("source", "archetype", "distance", (F.col("distance") >= F.col("_cut")).alias("outlier"))


def features(summary_: DataFrame, growth_: DataFrame) -> DataFrame:
    """Numeric features a source for clustering and classifiers: logs of output, citations and h, cpp, slope."""
    joined = summary_.join(growth_.select("source", "slope"), "source")
    return joined.select("source", F.log1p(F.col("tp").cast("double")).alias("f_tp"), F.log1p(F.col("tc").cast("double")).alias("f_tc"), F.log1p(F.col("h_index").cast("double")).alias("f_h"), "cpp", F.coalesce("slope", F.lit(0.0)).alias("f_slope"))


def clusters(features_: DataFrame, columns: list[str], k: int = 3, seed: int = 123) -> DataFrame:
    """k-means cluster and two principal components of standardised features, by Spark ML with a fixed seed."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    stages = [
        VectorAssembler(inputCols=columns, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        PCA(k=2, inputCol="_scaled", outputCol="_components"),
        KMeans(k=k, seed=seed, featuresCol="_scaled", predictionCol="cluster"),
    ]
    out = Pipeline(stages=stages).fit(features_).transform(features_)
    pair = vector_to_array("_components")
    return out.withColumns({"pc1": pair[0], "pc2": pair[1]}).drop("_raw", "_scaled", "_components")


def high_impact_classifier(features_: DataFrame, columns: list[str], label: str, folds: int = 3, seed: int = 123) -> DataFrame:
    """Area under the ROC curve of a logistic regression by cross-validation: ``auc``, ``folds``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features_).withColumn("label", F.col(label).cast("double"))
    model = LogisticRegression(regParam=0.01)
    check = BinaryClassificationEvaluator()
    fitted = CrossValidator(estimator=model, estimatorParamMaps=ParamGridBuilder().build(), evaluator=check, numFolds=folds, seed=seed).fit(rows)
    return features_.sparkSession.createDataFrame([(float(fitted.avgMetrics[0]), folds)], "auc double, folds int")


def coupling(records: DataFrame, keywords: DataFrame) -> DataFrame:
    """Source pairs by shared distinct keywords."""
    held = keywords.join(records.select("doc", "source"), "doc").where(F.col("source").isNotNull()).select("keyword", "source").distinct()
    return pair_counts(held, "keyword", "source", blocked=True)
