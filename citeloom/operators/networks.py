"""Networks as edge tables ``a, b, weight`` (a before b): co-occurrence, coupling, co-citation and graph measures.

No matrix is ever made dense. Iterative measures write each round to the shared folder, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialise, shared_dir
from .primitives import pair_counts, ratio


def cooccurrence(items: DataFrame, item: str, top: int | None = None) -> DataFrame:
    """Documents that two items share; with ``top``, between the ``top`` most frequent items only (part of the measure)."""
    if top is not None:
        best = items.groupBy(item).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), item).limit(top).select(item)
        items = items.join(best, item, "left_semi")
    return pair_counts(items, "doc", item)


def coupling(references: DataFrame) -> DataFrame:
    """Bibliographic coupling: document pairs by shared references (``doc, reference``, each once)."""
    return pair_counts(references, "reference", "doc", blocked=True)


def cocitation(references: DataFrame) -> DataFrame:
    """Reference pairs by documents that cite both."""
    return pair_counts(references, "doc", "reference")


def both_ways(edges: DataFrame) -> DataFrame:
    """``node, other, weight`` for each end of each edge."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Per node ``degree`` and ``strength`` (summed weights)."""
    return both_ways(edges).groupBy("node").agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def network_summary(edges: DataFrame) -> DataFrame:
    """Nodes, edges, density, mean degree, mean and greatest weight."""
    nodes = degrees(edges).agg(F.count("*").alias("nodes"), F.avg("degree").alias("mean_degree"))
    of_edges = edges.agg(F.count("*").alias("edges"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight"))
    return nodes.crossJoin(of_edges).withColumn("density", ratio(2 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1), 0.0))


def triangles(edges: DataFrame) -> DataFrame:
    """Per node the triangles it is in. Edges point from the end of lower (degree, name), so a hub opens few wedges.

    ``edges`` is read several times; callers whose edges are costly write them first, as ``clustering`` does.
    """
    d = degrees(edges).select("node", "degree")
    placed = edges.select("a", "b").join(d.withColumnsRenamed({"node": "a", "degree": "da"}), "a").join(d.withColumnsRenamed({"node": "b", "degree": "db"}), "b")
    forward = F.struct("da", "a") < F.struct("db", "b")
    arcs = placed.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedges = arcs.select("u", F.col("v").alias("x")).join(arcs.select("u", F.col("v").alias("y")), "u").where("x < y")
    closed = wedges.join(edges.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"])
    corners = closed.select(F.explode(F.array("u", "x", "y")).alias("node"))
    return corners.groupBy("node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient per node: triangles over possible ones, 0 for degree under 2."""
    edges = materialise(edges.select("a", "b", "weight"), shared_dir(edges.sparkSession), "edges")
    joined = degrees(edges).join(triangles(edges), "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return joined.select("node", "degree", "triangles", ratio(2 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1), 0.0).alias("clustering"))


def transitivity(edges: DataFrame) -> DataFrame:
    """Closed over all connected triples of the whole network."""
    return clustering(edges).agg(ratio(2 * F.sum("triangles"), F.sum(F.col("degree") * (F.col("degree") - 1)), 0.0).alias("transitivity"), F.avg("clustering").alias("mean_clustering"))


def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Connected components of ``edges`` (columns ``u``, ``v``): one row ``node, label`` per node with an edge.

    ``label`` is the smallest node of the component. Alternates large-star and small-star steps (Kiveris et al.,
    2014) until all edges go from a leaf to the centre of its star: every step is a map-side combined minimum and an
    equi-join whose skew AQE can split, and rounds grow with the logarithm of the longest path. Each round is written to
    ``folder``.
    """
    both = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(both, folder, f"{name}-0")
    turn = 0
    while not _stars(edges):
        turn += 1
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, folder, f"{name}-{turn}-large")
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small, folder, f"{name}-{turn}")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether no node of ``edges`` (distinct, ``u > v``) has two edges down, or one down and one up."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not each.where("down > 1 OR down = 1 AND up = 1").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node that it reaches)."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    return connected(pairs, shared_dir(edges.sparkSession), "components").withColumnRenamed("label", "component")


def communities(edges: DataFrame) -> DataFrame:
    """``node, community``: label propagation until every node has a best label.

    Each round a node takes the label of the greatest summed weight among its neighbours and itself (its own strongest
    edge's weight), smallest label first; in a round only a half of the nodes moves, another one by hash each time, which
    prevents swapping for ever.
    """
    folder = shared_dir(edges.sparkSession)
    around = materialise(both_ways(edges), folder, "around")
    own = around.groupBy("node").agg(F.max("weight").alias("weight")).select("node", F.col("node").alias("other"), "weight")
    heard_from = materialise(around.unionByName(own), folder, "with-self")
    labels, turn = materialise(around.select("node", F.col("node").alias("community")).distinct(), folder, "community-0"), 0
    while True:
        turn += 1
        votes = heard_from.join(labels.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("_w"))
        best = votes.groupBy("node").agg(F.max("_w").alias("_m"))
        least = votes.join(best, "node").where("_w = _m").groupBy("node").agg(F.min("community").alias("_best"))
        moves = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        voted = materialise(labels.join(least, "node"), folder, f"votes-{turn}")
        if voted.where("community <> _best").isEmpty():
            return labels
        labels = voted.select("node", F.when(moves, F.col("_best")).otherwise(F.col("community")).alias("community"))


def modularity(edges: DataFrame, membership: DataFrame, label: str) -> DataFrame:
    """Weighted modularity of a membership (``node``, ``label``)."""
    of = membership.select("node", F.col(label).alias("_l"))
    inside = edges.join(of.withColumnsRenamed({"node": "a", "_l": "_la"}), "a").join(of.withColumnsRenamed({"node": "b", "_l": "_lb"}), "b").where("_la = _lb").groupBy(F.col("_la").alias("_l")).agg(F.sum("weight").alias("_in"))
    held = degrees(edges).join(of, "node").groupBy("_l").agg(F.sum("strength").alias("_k"))
    total = edges.agg(F.sum("weight").alias("_m"))
    each = held.join(inside, "_l", "left").crossJoin(F.broadcast(total))
    part = F.coalesce("_in", F.lit(0)) / F.col("_m") - F.pow(F.col("_k") / (2 * F.col("_m")), 2)
    return each.agg(F.sum(part).alias("modularity"), F.count("*").alias("communities"))


def pagerank(arcs: DataFrame, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """PageRank of directed ``src, dst`` arcs, until the ranks move by at most ``tolerance`` in sum; the rank of sinks is
    spread over all nodes. The change shrinks by ``damping`` a round, so the rounds are bounded by the tolerance."""
    folder = shared_dir(arcs.sparkSession)
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    arcs = materialise(arcs.join(out, "src"), folder, "arcs")
    nodes = arcs.select(F.col("src").alias("node")).unionByName(arcs.select(F.col("dst").alias("node"))).distinct().join(out.withColumnRenamed("src", "node"), "node", "left")
    nodes = materialise(nodes, folder, "nodes")
    n = nodes.count()
    ranks, turn = nodes.withColumn("rank", F.lit(1.0 / max(n, 1))), 0
    while n:
        turn += 1
        sent = arcs.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0)).alias("lost"))
        fresh = F.lit((1 - damping) / n) + F.lit(damping) * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / F.lit(n))
        moved = materialise(ranks.withColumnRenamed("rank", "old").join(sent, "node", "left").crossJoin(F.broadcast(lost)).select("node", "out", "old", fresh.alias("rank")), folder, f"ranks-{turn}")
        ranks = moved.select("node", "out", "rank")
        if moved.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] <= tolerance:
            break
    return ranks.select("node", "rank")


def eigenvector(edges: DataFrame, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """Eigenvector centrality by power iteration on weights plus the identity, scaled to a greatest value of 1, until no
    score moves by more than ``tolerance``; an error after ``rounds`` without that (two equal leading eigenvalues)."""
    folder = shared_dir(edges.sparkSession)
    around = materialise(both_ways(edges), folder, "around")
    scores = around.select("node", F.lit(1.0).alias("score")).distinct()
    for turn in range(rounds):
        got = around.join(scores.select(F.col("node").alias("other"), F.col("score").alias("_s")), "other").groupBy("node").agg(F.sum(F.col("weight") * F.col("_s")).alias("_got"))
        raw = materialise(scores.join(got, "node").select("node", F.col("score").alias("old"), (F.col("score") + F.col("_got")).alias("score")), folder, f"scores-{turn}")
        most = raw.agg(F.max("score")).first()[0]
        scaled = raw.select("node", "old", (F.col("score") / F.lit(most)).alias("score"))
        scores = scaled.select("node", "score")
        if most is None or scaled.agg(F.max(F.abs(F.col("score") - F.col("old")))).first()[0] <= tolerance:
            return scores
    raise ArithmeticError(f"no convergence in {rounds} rounds")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """``source, node, hops`` for every node that each source reaches, breadth first by joins until a layer is empty.

    The table has a row for each source and node: all nodes as sources are for small networks; of large ones a sample of
    sources gives estimates (see ``sampled_sources``).
    """
    folder = shared_dir(edges.sparkSession)
    around = materialise(both_ways(edges).select("node", "other").distinct(), folder, "around")
    found = materialise(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")), folder, "hops-0")
    edge, hops = found, 0
    while True:
        hops += 1
        steps = edge.select("source", "node").join(around, "node").select("source", F.col("other").alias("node")).distinct()
        edge = materialise(steps.join(found, ["source", "node"], "left_anti").withColumn("hops", F.lit(hops)), folder, f"hops-{hops}")
        if edge.isEmpty():
            return found
        found = found.unionByName(edge)


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source: nodes reached, mean distance and closeness (reached over summed distance), exact for each source."""
    far = distances(edges, sources).where("hops > 0")
    return far.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("reached"), F.avg("hops").alias("mean_distance"), ratio(F.count("*"), F.sum("hops")).alias("closeness"))


def sampled_sources(edges: DataFrame, many: int, seed: int = 42) -> DataFrame:
    """About ``many`` nodes picked by a hash, as sources of ``betweenness`` on large networks: n / many times its result is an
    unbiased estimate, whose relative error falls with the square root of ``many``."""
    nodes = both_ways(edges).select("node").distinct()
    n = nodes.count()
    return nodes.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, many / max(n, 1))))


def betweenness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """Brandes' betweenness over the shortest paths from ``sources``, by breadth-first layers and back-propagation.

    With all nodes as sources it is exact; each unordered pair counts once. Layers end where one is empty.
    """
    folder = shared_dir(edges.sparkSession)
    around = materialise(both_ways(edges).select("node", "other").distinct(), folder, "around")
    layer = materialise(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.lit(1.0).alias("paths")), folder, "layer-0")
    layers, found = [layer], layer.select("source", "node")
    while True:
        steps = layers[-1].join(around, "node").groupBy("source", F.col("other").alias("node")).agg(F.sum("paths").alias("paths"))
        layer = materialise(steps.join(found, ["source", "node"], "left_anti").withColumn("hops", F.lit(len(layers))).select("source", "node", "hops", "paths"), folder, f"layer-{len(layers)}")
        if layer.isEmpty():
            break
        layers.append(layer)
        found = found.unionByName(layer.select("source", "node"))
    share = None
    total = layers[0].select("source", "node", F.lit(0.0).alias("depends"))
    for depth in range(len(layers) - 2, -1, -1):
        upper, lower = layers[depth], layers[depth + 1]
        below = lower.withColumn("depends", F.lit(0.0)) if share is None else lower.join(share, ["source", "node"], "left").withColumn("depends", F.coalesce("depends", F.lit(0.0)))
        sent = below.select("source", F.col("node").alias("other"), F.col("paths").alias("_p"), "depends")
        back = upper.join(around, "node").join(sent, ["source", "other"]).groupBy("source", "node").agg(F.sum(F.col("paths") / F.col("_p") * (1 + F.col("depends"))).alias("depends"))
        share = materialise(back, folder, f"back-{depth}")
        total = total.unionByName(share.where("source <> node"))
    return total.groupBy("node").agg((F.sum("depends") / 2).alias("betweenness"))


def citation_arcs(references: DataFrame) -> DataFrame:
    """``src, dst`` arcs from a document to what it cites, with citations a document gets."""
    return references.select(F.col("doc").alias("src"), F.col("reference").alias("dst")).distinct()


def citation_bursts(arcs: DataFrame, years: DataFrame) -> DataFrame:
    """Years (of the citing document: ``doc, year``) in which a cited item gets over twice its mean a year."""
    counted = arcs.join(years, arcs["src"] == years["doc"]).groupBy("dst", "year").agg(F.count("*").alias("n"))
    mean = F.avg("n").over(Window.partitionBy("dst"))
    return counted.withColumn("mean", mean).where(F.col("n") > 2 * F.col("mean"))


def thematic_map(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Per community: centrality (weight to others), density (weight inside over possible edges), quadrant by medians."""
    of = membership.select("node", "community")
    ends = edges.join(of.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(of.withColumnsRenamed({"node": "b", "community": "cb"}), "b")
    inside = ends.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").alias("_in"))
    cross = ends.where("ca <> cb")
    outside = cross.select(F.col("ca").alias("community"), "weight").unionByName(cross.select(F.col("cb").alias("community"), "weight")).groupBy("community").agg(F.sum("weight").alias("centrality"))
    sizes = of.groupBy("community").agg(F.count("*").alias("size"))
    joined = sizes.join(inside, "community", "left").join(outside, "community", "left").fillna(0, ["_in", "centrality"])
    themes = joined.withColumn("density", ratio(2 * F.col("_in"), F.col("size") * (F.col("size") - 1), 0.0)).drop("_in")
    cuts = themes.agg(F.median("centrality").alias("_c"), F.median("density").alias("_d"))
    central, dense = F.col("centrality") >= F.col("_c"), F.col("density") >= F.col("_d")
    label = F.when(central & dense, "motor").when(central, "basic").when(dense, "niche").otherwise("emerging")
    return themes.crossJoin(F.broadcast(cuts)).withColumn("quadrant", label).drop("_c", "_d")


def document_map(edges: DataFrame, records: DataFrame, membership: DataFrame, least_size: int = 5, top: int = 10) -> DataFrame:
    """Documents of communities of ``least_size`` or more, ranked inside by degree and age-normalised citations.

    The score is half the min-max scaled weighted degree and half that of citations a year of age; ``top`` a community.
    """
    sizes = membership.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") >= least_size)
    last = records.agg(F.max("year").alias("_last"))
    joined = membership.join(sizes, "community").join(degrees(edges), "node").join(records.withColumnRenamed("doc", "node"), "node").crossJoin(F.broadcast(last))
    per_year = ratio(F.col("citations"), F.greatest(F.col("_last") - F.col("year") + 1, F.lit(1)), 0.0)
    scored = joined.withColumn("per_year", per_year)
    scaled = lambda c: ratio(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), 0.0)
    bounds = scored.agg(*(f(c).alias(f"_{n}_{c}") for c in ("strength", "per_year") for n, f in (("lo", F.min), ("hi", F.max))))
    ranked = scored.crossJoin(F.broadcast(bounds)).withColumn("score", 0.5 * scaled("strength") + 0.5 * scaled("per_year"))
    place = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("score"), "node"))
    return ranked.withColumn("place", place).where(F.col("place") <= top).select("community", "size", "node", "strength", "per_year", "score", "place")
