"""Communities by modularity: moves to the best neighbouring community, then the quotient graph, level by level.

A level is an edge table and a node table with strengths. In a turn the nodes of one part (by hash) work out, from the summed weights to
each neighbouring community and from the communities' strengths, which one raises modularity most, and move there together; a turn
that does not raise modularity is not taken, and if no part's moves do, parts are halved, so in the end nodes move all but alone.
Modularity never falls. When no node has a better community the communities become the nodes of the next level, their inner
weight a loop; levels go on until one joins nothing.

Every turn is two aggregations by node and one by community, combined map-side, and a written table; a hub's edges are many rows
of its key, which AQE splits in joins. Gains are compared to nine places, ties go to the smaller name. Edges are undirected
(``a, b, weight``, weights over 0); several rows of a pair add up, loops count as inner weight. Nodes without edges have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialise, shared_dir

#: Parts of the nodes that move in turns: at first, and at most.
PARTS, MOST_PARTS = 2, 64


def _score(around: DataFrame, nodes: DataFrame, labels: DataFrame, total: float) -> float:
    """Modularity of ``labels``; ``total`` is the sum of strengths."""
    of = labels.select("node", "community")
    inside = around.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("community").alias("_c")), "other").groupBy("community").agg(F.sum(F.when(F.col("community") == F.col("_c"), F.col("weight")).otherwise(0.0)).alias("w"))
    held = nodes.join(of, "node").groupBy("community").agg(F.sum("loop").alias("l"), F.sum("k").alias("k"))
    part = (F.coalesce("w", F.lit(0.0)) + F.col("l")) / total - F.pow(F.col("k") / total, 2)
    return held.join(inside, "community", "left").agg(F.sum(part)).first()[0] or 0.0


def _moves(around: DataFrame, nodes: DataFrame, labels: DataFrame, total: float, tolerance: float) -> DataFrame:
    """``labels`` with ``best``, the community of greatest gain, null where none is better than a node's own."""
    of = labels.select("node", "community")
    strength = nodes.join(of, "node").groupBy("community").agg(F.sum("k").alias("_t"))
    votes = around.join(of.select(F.col("node").alias("other"), "community"), "other").groupBy("node", "community").agg(F.sum("weight").alias("_w"))
    own = of.join(nodes.select("node", "k"), "node").withColumnRenamed("community", "_own")
    stay = own.select("node", F.col("_own").alias("community"), F.lit(0.0).alias("_w"))
    tried = votes.unionByName(stay).groupBy("node", "community").agg(F.sum("_w").alias("_w")).join(own, "node").join(strength, "community")
    others = F.col("_t") - F.when(F.col("community") == F.col("_own"), F.col("k")).otherwise(0.0)
    gain = F.round((F.col("_w") - F.col("k") * others / total) / total, 12)
    scored = tried.withColumn("_g", gain)
    best = scored.groupBy("node").agg(F.max("_g").alias("_m"), F.max(F.when(F.col("community") == F.col("_own"), F.col("_g"))).alias("_s"))
    chosen = scored.join(best, "node").where((F.col("_g") == F.col("_m")) & (F.col("_m") > F.col("_s") + tolerance)).groupBy("node").agg(F.min("community").alias("best"))
    return of.join(chosen, "node", "left")


def _settled(around: DataFrame, nodes: DataFrame, total: float, tolerance: float, folder: str, level: int) -> tuple[DataFrame, bool]:
    """Labels that no part's moves improve, and whether any node has moved."""
    labels = materialise(nodes.select("node", F.col("node").alias("community")), folder, f"labels-{level}")
    score, parts, turn, moved = _score(around, nodes, labels, total), PARTS, 0, False
    part = lambda n: F.pmod(F.xxhash64("node", F.lit(n)), F.lit(n))
    while True:
        turn += 1
        tried = materialise(_moves(around, nodes, labels, total, tolerance), folder, f"moves-{level}-{turn}")
        wanting = tried.where("best is not null")
        reached = None
        while reached is None and parts <= MOST_PARTS:
            ready = [r[0] for r in wanting.select(part(parts)).distinct().collect()]
            if not ready:
                return labels, moved
            for mine in sorted(ready, key=lambda p: (p - turn) % parts):
                fresh = tried.select("node", F.when(part(parts) == mine, F.coalesce("best", "community")).otherwise(F.col("community")).alias("community"))
                raised = _score(around, nodes, fresh, total)
                if raised > score + tolerance:
                    reached = raised
                    break
            else:
                parts *= 2
        if reached is None:
            return labels, moved
        labels, score, moved = materialise(fresh, folder, f"labels-{level}-{turn}"), reached, True


def communities(edges: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """``node, community``; a community is named by its smallest node."""
    folder = shared_dir(edges.sparkSession)
    weight = F.col("weight").cast("double")
    both = edges.where("a is not null and b is not null and weight > 0").select("a", "b", weight.alias("weight"))
    around = both.where("a <> b").select(F.col("a").alias("node"), F.col("b").alias("other"), "weight").unionByName(both.where("a <> b").select(F.col("b").alias("node"), F.col("a").alias("other"), "weight")).groupBy("node", "other").agg(F.sum("weight").alias("weight"))
    around = materialise(around, folder, "around")
    loops = both.where("a = b").select(F.col("a").alias("node"), (2 * F.col("weight")).alias("loop"))
    strengths = around.select("node", "weight", F.lit(0.0).alias("loop")).unionByName(loops.select("node", F.lit(0.0).alias("weight"), "loop"))
    nodes = materialise(strengths.groupBy("node").agg((F.sum("weight") + F.sum("loop")).alias("k"), F.sum("loop").alias("loop")), folder, "nodes")
    total = nodes.agg(F.sum("k")).first()[0]
    member = nodes.select("node", F.col("node").alias("community"))
    level = 0
    while total:
        labels, moved = _settled(around, nodes, total, tolerance, folder, level)
        if not moved:
            break
        member = materialise(member.join(labels.select(F.col("node").alias("community"), F.col("community").alias("_next")), "community").select("node", F.col("_next").alias("community")), folder, f"member-{level}")
        of = labels.select("node", "community")
        joined = around.join(of, "node").join(of.select(F.col("node").alias("other"), F.col("community").alias("_c")), "other")
        sums = materialise(joined.groupBy(F.col("community").alias("node"), F.col("_c").alias("other")).agg(F.sum("weight").alias("weight")), folder, f"quotient-{level}")
        held = nodes.join(of, "node").groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("_l")).withColumnRenamed("community", "node")
        inner = sums.where("node = other").select("node", "weight")
        level += 1
        nodes = materialise(held.join(inner, "node", "left").select("node", "k", (F.col("_l") + F.coalesce("weight", F.lit(0.0))).alias("loop")), folder, f"nodes-{level}")
        around = sums.where("node <> other")
    names = member.groupBy("community").agg(F.min("node").alias("_name"))
    return member.join(names, "community").select("node", F.col("_name").alias("community"))
