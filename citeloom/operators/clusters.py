"""Profiles of a few hundred items (countries, sources): standard scores, principal components, distances and hierarchical clusters.

The distance table has a row for every two items, which is what is asked for; items are countries or sources, not documents.
Clusters merge in rounds: every cluster finds its nearest one, and all pairs that are each other's nearest merge at once. With
complete linkage a merge never brings others nearer, so this gives the same tree as merging one pair at a time. Distances are
compared to nine places; of equal ones the pair of smaller names is nearer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise, shared_dir
from .networks import connected


def standardised(df: DataFrame, item: str, features: Sequence[str]) -> DataFrame:
    """``item`` and its features less their means over their deviations (n - 1); a feature without spread is 0. Items with a null
    feature are left out."""
    known = df.select(item, *(F.col(c).cast("double").alias(c) for c in features)).dropna()
    moments = known.agg(*(f(c).alias(f"_{n}_{c}") for c in features for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    score = lambda c: F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0)
    return known.crossJoin(F.broadcast(moments)).select(item, *(score(c).alias(c) for c in features))


def distances(scores: DataFrame, item: str, features: Sequence[str]) -> DataFrame:
    """``a, b`` (a before b), ``distance`` (Euclidean) and ``similarity`` 1 / (1 + distance) of every two items."""
    left = scores.select(F.col(item).alias("a"), *(F.col(c).alias(f"_a_{c}") for c in features))
    right = scores.select(F.col(item).alias("b"), *(F.col(c).alias(f"_b_{c}") for c in features))
    square = sum((F.pow(F.col(f"_a_{c}") - F.col(f"_b_{c}"), 2) for c in features), F.lit(0.0))
    far = left.join(right, F.col("a") < F.col("b")).select("a", "b", F.sqrt(square).alias("distance"))
    return far.withColumn("similarity", 1 / (1 + F.col("distance")))


def complete_linkage(pairs: DataFrame) -> DataFrame:
    """The tree of ``pairs`` (``a, b, distance`` of every two items): ``left, right`` (clusters by their smallest item, left before
    right), ``height`` and ``size`` of the merged one. One row fewer than items."""
    spark = pairs.sparkSession
    folder = shared_dir(spark)
    table = materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").groupBy("a", "b").agg(F.max("distance").alias("distance")), folder, "pairs-0")
    sizes = materialise(table.select("a").unionByName(table.select(F.col("b").alias("a"))).distinct().select(F.col("a").alias("item"), F.lit(1).cast("long").alias("size")), folder, "sizes-0")
    merges, turn = None, 0
    while not table.isEmpty():
        turn += 1
        order = F.struct(F.round("distance", 9).alias("d"), "a", "b")
        near = table.select(F.explode(F.array("a", "b")).alias("item"), order.alias("o"), "distance").groupBy("item").agg(F.min("o").alias("o"), F.min_by("distance", "o").alias("height"))
        mutual = near.groupBy("o.a", "o.b").agg(F.count("*").alias("_n"), F.max("height").alias("height")).where("_n = 2")
        of = lambda c, name: sizes.select(F.col("item").alias(c), F.col("size").alias(name))
        made = materialise(mutual.join(of("a", "_sa"), "a").join(of("b", "_sb"), "b").select(F.col("a").alias("left"), F.col("b").alias("right"), "height", (F.col("_sa") + F.col("_sb")).alias("size")), folder, f"merges-{turn}")
        merges = made if merges is None else merges.unionByName(made)
        moved = made.select(F.col("right").alias("_old"), F.col("left").alias("_new"))
        end = lambda t, c: t.join(moved, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_new", c)).drop("_old", "_new")
        renamed = end(end(table, "a"), "b").where("a <> b")
        table = materialise(renamed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("distance").alias("distance")), folder, f"pairs-{turn}")
        kept = sizes.join(made.select(F.explode(F.array("left", "right")).alias("item")), "item", "left_anti")
        sizes = materialise(kept.unionByName(made.select(F.col("left").alias("item"), "size")), folder, f"sizes-{turn}")
    if merges is None:
        kind = pairs.schema["a"].dataType.simpleString()
        return spark.createDataFrame([], f"left {kind}, right {kind}, height double, size long")
    return merges


def cut(tree: DataFrame, clusters: int) -> DataFrame:
    """``item, cluster`` (its smallest item) once all but the ``clusters - 1`` highest merges are made; ties by name."""
    folder = shared_dir(tree.sparkSession)
    tree = materialise(tree, folder, "tree")
    top = tree.orderBy(F.desc(F.round("height", 9)), F.desc("left"), F.desc("right")).limit(max(clusters - 1, 0))
    made = tree.join(F.broadcast(top.select("left", "right")), ["left", "right"], "left_anti")
    items = tree.select(F.explode(F.array("left", "right")).alias("item")).distinct()
    labels = connected(made.select(F.col("left").alias("u"), F.col("right").alias("v")), folder, "cut")
    return items.join(labels, F.col("item") == F.col("node"), "left").select("item", F.coalesce("label", "item").alias("cluster"))


def principal_components(scores: DataFrame, item: str, features: Sequence[str], components: int = 2) -> tuple[DataFrame, list[dict]]:
    """``item, pc1 ..`` and, per component, ``share`` of the variance and ``loadings`` by feature.

    The covariance is one aggregation; its few numbers, features squared, are decomposed on the driver. Signs make the largest
    loading positive.
    """
    k = len(features)
    sums = scores.agg(*(F.covar_samp(F.col(features[i]), F.col(features[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k))).first()
    matrix = np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values)[:components]
    total = float(values.sum())
    described, columns = [], []
    for place, c in enumerate(order, 1):
        loading = vectors[:, c] * (1 if vectors[np.argmax(np.abs(np.round(vectors[:, c], 9))), c] >= 0 else -1)
        described.append({"component": place, "share": float(values[c]) / total if total > 0 else None, "loadings": dict(zip(features, loading.tolist(), strict=True))})
        columns.append(sum((F.col(f) * float(v) for f, v in zip(features, loading, strict=True)), F.lit(0.0)).alias(f"pc{place}"))
    return scores.select(item, *columns), described


def country_features(countries: DataFrame, records: DataFrame) -> DataFrame:
    """``country, articles, citations, average, single, several``: documents, their citations in sum and mean, and how many are of one
    country and of more. ``countries`` has each (doc, country) once."""
    many = countries.groupBy("doc").agg(F.count("*").alias("_k"))
    joined = countries.join(records.select("doc", "citations"), "doc").join(many, "doc")
    return joined.groupBy("country").agg(F.count("*").alias("articles"), F.sum("citations").alias("citations"), F.avg("citations").alias("average"), F.count_if(F.col("_k") == 1).alias("single"), F.count_if(F.col("_k") > 1).alias("several"))
