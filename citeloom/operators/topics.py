"""Topics: keyword vocabularies over the years, and latent Dirichlet allocation by Spark ML."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .primitives import ratio


def yearly_vocabulary(keywords: DataFrame, records: DataFrame, top: int = 50, least_length: int = 3) -> DataFrame:
    """The ``top`` keywords of each year by documents (ties by word), of ``least_length`` letters or more."""
    counted = keywords.where(F.length("keyword") >= least_length).join(records.select("doc", "year"), "doc").groupBy("year", "keyword").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "keyword"))
    return counted.withColumn("place", place).where(F.col("place") <= top)


def topic_trends(vocabulary: DataFrame) -> DataFrame:
    """Per keyword change of its yearly share from its first year to its last, over the first: emerging over one half."""
    shared = vocabulary.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy("year"))))
    ends = shared.groupBy("keyword").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("share", "year").alias("first_share"), F.max_by("share", "year").alias("last_share"))
    strength = ratio(F.col("last_share") - F.col("first_share"), F.col("first_share"), 0.0)
    direction = F.when(strength > 0, "rising").when(strength < 0, "falling").otherwise("stable")
    return ends.withColumns({"strength": strength, "direction": direction, "emerging": strength > 0.5})


def retention(vocabulary: DataFrame) -> DataFrame:
    """Per year how many of the keywords of the year before stay, come and go."""
    words = vocabulary.select("year", "keyword")
    before = words.select((F.col("year") + 1).alias("year"), "keyword", F.lit(1).alias("old"))
    both = words.withColumn("new", F.lit(1)).join(before, ["year", "keyword"], "full")
    sums = both.groupBy("year").agg(F.count("new").alias("keywords"), F.count(F.when(F.col("new").isNotNull(), F.col("old"))).alias("kept"), F.count(F.when(F.col("old").isNull(), F.col("new"))).alias("came"), F.count(F.when(F.col("new").isNull(), F.col("old"))).alias("went"))
    return sums.where("keywords > 0").withColumn("retention", ratio(F.col("kept"), F.col("kept") + F.col("went")))


def lda(keywords: DataFrame, topics: int = 5, terms: int = 10, least: int = 2, seed: int = 12345, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """Terms of each topic (``topic, place, term, weight``) and weights of each document (``doc, topic, weight``).

    A term is in ``least`` documents or more. The fit is seeded; it is not reproducible across partitionings.
    """
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    docs = keywords.groupBy("doc").agg(F.sort_array(F.collect_list("keyword")).alias("terms"))
    vectorizer = CountVectorizer(inputCol="terms", outputCol="features", minDF=float(least)).fit(docs)
    counted = vectorizer.transform(docs)
    model = LDA(k=topics, maxIter=rounds, seed=seed, featuresCol="features").fit(counted)
    vocabulary = F.array(*(F.lit(v) for v in vectorizer.vocabulary))
    described = model.describeTopics(terms).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    listed = described.select("topic", (F.col("place") + 1).alias("place"), F.get(vocabulary, F.col("t.termIndices")).alias("term"), F.col("t.termWeights").alias("weight"))
    weights = model.transform(counted).select("doc", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight"))
    return listed, weights


def topic_prevalence(weights: DataFrame, records: DataFrame) -> DataFrame:
    """Mean weight of each topic a year, and documents in which it dominates."""
    best = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), "topic")) == 1
    joined = weights.withColumn("dominant", best).join(records.select("doc", "year"), "doc")
    return joined.groupBy("year", "topic").agg(F.avg("weight").alias("prevalence"), F.sum(F.col("dominant").cast("int")).alias("documents"))


def coherence(listed: DataFrame, keywords: DataFrame) -> DataFrame:
    """UMass coherence of each topic: mean of ln((joint documents + 1) / documents of the earlier term) over term pairs."""
    a = listed.select("topic", F.col("place").alias("pa"), F.col("term").alias("a"))
    b = listed.select("topic", F.col("place").alias("pb"), F.col("term").alias("b"))
    pairs = a.join(b, "topic").where("pa < pb")
    used = keywords.join(listed.select(F.col("term").alias("keyword")).distinct(), "keyword", "left_semi")
    single = used.groupBy(F.col("keyword").alias("a")).agg(F.count("*").alias("n"))
    left, right = used.select("doc", F.col("keyword").alias("a")), used.select("doc", F.col("keyword").alias("b"))
    joint = left.join(right, "doc").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("joint"))
    scored = pairs.join(single, "a").join(joint, ["a", "b"], "left")
    return scored.groupBy("topic").agg(F.avg(F.log((F.coalesce("joint", F.lit(0)) + 1) / F.col("n"))).alias("coherence"))
