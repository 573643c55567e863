"""Tests of networks by permutation of their nodes: correlation of two (QAP) and regression on several (MRQAP).

Networks are undirected edge tables ``a, b, weight``; a pair without a row has weight 0 and is never written down. Moving the nodes of
a network leaves its sums as they are, so a round needs only the products over pairs that both networks have: the edges with
their ends renamed by round, joined to the other network's edges, one sum a round. All rounds go through one such join.

Round 0 leaves every node where it is. In the others node i goes to the place of the node that is i-th by md5 of round, seed and
name, the same on every run. Several rows of a pair add up; loops and null ends are left out. ``nodes`` (a column ``node``) adds
nodes without edges. Under two distinct weights of pairs in a network correlations are null.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import ratio
from .regression import _add, sweep

#: Networks of up to so many nodes can be tested against every permutation.
EXHAUSTIVE = 8


def dyads(edges: DataFrame) -> DataFrame:
    """``a`` before ``b`` and the summed ``weight`` of every pair."""
    return edges.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.col("weight").cast("double")).alias("weight")).where("weight <> 0")


def all_nodes(*networks: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    parts = [e.select(F.explode(F.array("a", "b")).alias("node")) for e in networks]
    out = parts[0]
    for part in (*parts[1:], *([] if nodes is None else [nodes.select("node")])):
        out = out.unionByName(part)
    return out.where("node is not null").distinct()


def permutations(nodes: DataFrame, rounds: int, seed: int = 42) -> DataFrame:
    """``round, node, target`` for rounds 0 to ``rounds``."""
    dealt = nodes.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    key = F.when(F.col("round") == 0, F.lit("")).otherwise(F.md5(F.concat_ws("-", F.col("round").cast("string"), F.lit(str(seed)), F.col("node").cast("string"))))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy("round").orderBy(key, "node")))
    base = placed.where("round = 0").select(F.col("node").alias("from"), "place")
    return placed.join(base, "place").select("round", F.col("from").alias("node"), F.col("node").alias("target"))


def every_permutation(nodes: DataFrame) -> DataFrame:
    """``permutations`` of all orders, of networks of at most ``EXHAUSTIVE`` nodes; round 0 is the order by name."""
    n = nodes.count()
    if n > EXHAUSTIVE:
        raise ValueError(f"{n} nodes have too many orders to try each; at most {EXHAUSTIVE}")
    rounds = 1
    for k in range(2, n + 1):
        rounds *= k
    start = F.struct(F.col("pool"), F.array().cast(nodes.select(F.array("node").alias("n")).schema["n"].dataType).alias("out"), F.col("round").cast("int").alias("left"))

    def step(acc: Column, k: Column) -> Column:
        size = F.size(acc["pool"])
        at = (acc["left"] % size).cast("int")
        picked = acc["pool"][at]
        return F.struct(F.filter(acc["pool"], lambda x: x != picked).alias("pool"), F.concat(acc["out"], F.array(picked)).alias("out"), F.floor(acc["left"] / size).cast("int").alias("left"))

    pool = nodes.agg(F.array_sort(F.collect_list("node")).alias("pool"))
    tried = pool.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    order = tried.withColumn("order", F.aggregate(F.sequence(F.lit(1), F.size("pool")), start, step)["out"])
    return order.select("round", F.explode(F.arrays_zip(F.col("pool").alias("node"), F.col("order").alias("target"))).alias("m")).select("round", "m.node", "m.target")


def moved(edges: DataFrame, moves: DataFrame) -> DataFrame:
    """``round, a, b, weight``: the dyads of ``edges`` under every round's renaming."""
    one = edges.join(moves.select("round", F.col("node").alias("a"), F.col("target").alias("_a")), "a")
    both = one.join(moves.select("round", F.col("node").alias("b"), F.col("target").alias("_b")), ["round", "b"])
    return both.select("round", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "weight")


def _ranks(pairs: DataFrame, total: Column) -> DataFrame:
    """Weights (over 0) as average ranks less that of the pairs without weight; ``total`` pairs in all."""
    counted = pairs.groupBy("weight").agg(F.count("*").alias("_n"))
    empty = (total - F.sum("_n").over(Window.partitionBy())).cast("double")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("weight").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counted.select("weight", (empty + before + (F.col("_n") + 1) / 2 - F.when(empty > 0, (empty + 1) / 2).otherwise(0.0)).alias("_r"))
    return pairs.join(places, "weight").select("a", "b", F.col("_r").alias("weight"))


def _two_sided(value: str, observed: str) -> tuple[Column, Column]:
    """Shares of rounds that reach and that do not pass the observed value, to nine places."""
    x, o = F.round(value, 9), F.round(observed, 9)
    known = F.count(F.when(F.col("round") > 0, x))
    return ratio(F.count_if((F.col("round") > 0) & (x >= o)), known), ratio(F.count_if((F.col("round") > 0) & (x <= o)), known)


def qap(first: DataFrame, second: DataFrame, rounds: int = 1000, seed: int = 42, method: str = "pearson", nodes: DataFrame | None = None, moves: DataFrame | None = None) -> DataFrame:
    """One row: ``nodes, rounds, correlation`` over all pairs of nodes, ``p_one`` (share of rounds with at least it), ``p_two``, and
    ``mean`` and ``sd`` of the rounds. ``spearman`` ranks the weights first; they must be over 0 then."""
    if method not in ("pearson", "spearman"):
        raise ValueError(f"unknown method {method!r}")
    a, b = dyads(first), dyads(second)
    every = all_nodes(a, b, nodes=nodes)
    n = F.broadcast(every.agg(F.count("*").alias("nodes")))
    if method == "spearman":
        size = every.count()
        a, b = (_ranks(e, F.lit(size * (size - 1) // 2)) for e in (a, b))
    moves = permutations(every, rounds, seed) if moves is None else moves
    sums = lambda e, p: e.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias(f"{p}s"), F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias(f"{p}q"))
    met = moved(a, moves).join(b.withColumnRenamed("weight", "other"), ["a", "b"]).groupBy("round").agg(F.sum(F.col("weight") * F.col("other")).alias("xy"))
    table = moves.select("round").distinct().join(met, "round", "left").crossJoin(n).crossJoin(F.broadcast(sums(a, "x"))).crossJoin(F.broadcast(sums(b, "y")))
    d = F.col("nodes") * (F.col("nodes") - 1) / 2
    spread = (d * F.col("xq") - F.col("xs") * F.col("xs")) * (d * F.col("yq") - F.col("ys") * F.col("ys"))
    r = F.when(spread > 0, (d * F.coalesce("xy", F.lit(0.0)) - F.col("xs") * F.col("ys")) / F.sqrt(spread))
    valued = table.select("round", "nodes", r.alias("r")).withColumn("o", F.max(F.when(F.col("round") == 0, F.col("r"))).over(Window.partitionBy()))
    above, below = _two_sided("r", "o")
    return valued.agg(F.max("nodes").alias("nodes"), F.count_if(F.col("round") > 0).alias("rounds"), F.max("o").alias("correlation"), above.alias("p_one"), F.least(F.lit(1.0), 2 * F.least(above, below)).alias("p_two"), F.avg(F.when(F.col("round") > 0, F.col("r"))).alias("mean"), F.stddev_samp(F.when(F.col("round") > 0, F.col("r"))).alias("sd"))


def mrqap(dependent: DataFrame, predictors: Mapping[str, DataFrame], rounds: int = 1000, seed: int = 42, nodes: DataFrame | None = None, moves: DataFrame | None = None) -> DataFrame:
    """Per term (``constant`` and predictors) ``coefficient``, ``std_error`` (deviation over rounds), ``p_value`` (two-sided) and the
    fit's ``r2``. The dependent network is permuted; the predictors' Gram matrix is the same in every round."""
    names = list(predictors)
    k = len(names)
    y, xs = dyads(dependent), {name: dyads(e) for name, e in predictors.items()}
    every = all_nodes(y, *xs.values(), nodes=nodes)
    moves = permutations(every, rounds, seed) if moves is None else moves
    long = None
    for name, e in xs.items():
        part = e.select("a", "b", F.lit(name).alias("name"), F.col("weight").alias("x"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy("a", "b").agg(*(F.sum(F.when(F.col("name") == c, F.col("x")).otherwise(0.0)).alias(f"x{i}") for i, c in enumerate(names)))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    gram = wide.agg(F.array(*(some(F.col(f"x{i}")) for i in range(k))).alias("s"), F.array(*(F.array(*(some(F.col(f"x{i}") * F.col(f"x{j}")) for j in range(k))) for i in range(k))).alias("q"))
    own = y.agg(some(F.col("weight")).alias("ys"), some(F.col("weight") * F.col("weight")).alias("yq"))
    met = moved(y, moves).join(long, ["a", "b"]).groupBy("round").agg(F.array(*(F.sum(F.when(F.col("name") == c, F.col("x") * F.col("weight")).otherwise(0.0)) for c in names)).alias("xy"))
    table = moves.select("round").distinct().join(met, "round", "left").withColumn("xy", F.coalesce("xy", F.array(*[F.lit(0.0)] * k)))
    for one in (gram, own, every.agg((F.count("*") * (F.count("*") - 1) / 2).alias("d"))):
        table = table.crossJoin(F.broadcast(one))
    s, q, d, ys = F.col("s"), F.col("q"), F.col("d"), F.col("ys")
    rows = [F.array(*(q[i][j] - s[i] * s[j] / d for j in range(k)), F.col("xy")[i] - s[i] * ys / d) for i in range(k)]
    last = F.array(*(F.col("xy")[i] - s[i] * ys / d for i in range(k)), F.col("yq") - ys * ys / d)
    fits = table.withColumn("c", F.array(*rows, last)).withColumn("w", sweep(F.col("c"), k))
    b = [F.when(F.col("w.used")[i], F.col("w.m")[i][k]) for i in range(k)]
    constant = (ys - _add([F.coalesce(b[i], F.lit(0.0)) * s[i] for i in range(k)])) / d
    terms = [F.struct(F.lit(name).alias("term"), v.alias("v")) for name, v in zip(["constant", *names], [constant, *b], strict=True)]
    r2 = F.when(F.col("c")[k][k] > 0, 1.0 - F.col("w.m")[k][k] / F.col("c")[k][k])
    valued = fits.select("round", r2.alias("r2"), F.explode(F.array(*terms)).alias("e")).select("round", "r2", "e.*")
    valued = valued.withColumn("o", F.max(F.when(F.col("round") == 0, F.col("v"))).over(Window.partitionBy("term")))
    above, below = _two_sided("v", "o")
    return valued.groupBy("term").agg(F.max("o").alias("coefficient"), F.stddev_samp(F.when(F.col("round") > 0, F.col("v"))).alias("std_error"), F.least(F.lit(1.0), 2 * F.least(above, below)).alias("p_value"), F.max(F.when(F.col("round") == 0, F.col("r2"))).alias("r2"))
