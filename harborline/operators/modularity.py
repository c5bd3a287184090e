"""Communities by modularity: local moves of all nodes together, then the communities as nodes of a smaller graph, level by level.

Everything is integer arithmetic on link weights, so results do not depend on the order of sums. With M the sum of all degrees,
a node of degree k that has weight w to a community of total degree t (itself aside) scores M w - k t there; it wants
to move where it scores more than where it is.

In even rounds nodes move only to communities of smaller name, in odd rounds only to those of larger name, so two nodes never
swap. All moves of a round are made if modularity rises; if their sum does not help, only those are made that are the best
of both the community they leave and the one they join. Such moves touch separate communities, so their gains add up and
modularity rises in any case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialized

LEVELS, ROUNDS = 8, 6
#: Products of weights go beyond 64 bits on large graphs.
WIDE = "decimal(38,0)"


def _numerator(links: DataFrame, labels: DataFrame, total: int) -> int:
    """M^2 times the modularity of labels(node, community, degree, loop)."""
    at = lambda end, name: labels.select(F.col("node").alias(end), F.col("community").alias(name))
    inside = links.join(at("a", "ca"), "a").join(at("b", "cb"), "b").where("ca = cb").agg(F.sum("w").cast(WIDE)).first()[0] or 0
    own = labels.groupBy("community").agg(F.sum("degree").cast(WIDE).alias("t"), F.sum("loop").cast(WIDE).alias("l")).agg(F.sum("l"), F.sum(F.col("t") * F.col("t"))).first()
    return total * (int(inside) + int(own[0] or 0)) - int(own[1] or 0)


def _moves(links: DataFrame, labels: DataFrame, total: int, even: bool) -> DataFrame:
    """(node, here, there, gain): where each node would rather be."""
    own = labels.select(F.col("node").alias("a"), F.col("community").alias("here"), "degree")
    to = links.join(labels.select(F.col("node").alias("b"), F.col("community").alias("c")), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
    with_own = to.unionByName(own.select("a", F.col("here").alias("c"), F.lit(0).cast("long").alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
    t = labels.groupBy(F.col("community").alias("c")).agg(F.sum("degree").alias("t"))
    d = F.col("degree").cast(WIDE)
    score = F.lit(total).cast(WIDE) * F.col("w") - d * (F.col("t") - F.when(F.col("c") == F.col("here"), F.col("degree")).otherwise(0))
    scored = with_own.join(own, "a").join(t, "c").select("a", "here", "c", score.alias("s"))
    side = F.col("c") < F.col("here") if even else F.col("c") > F.col("here")
    stay, go = F.max(F.when(F.col("c") == F.col("here"), F.col("s"))), F.when(side, F.struct(-F.col("s"), "c"))
    best = scored.groupBy("a", "here").agg(stay.alias("stay"), F.min(go).alias("go"))
    gain = -F.col("go.col1") - F.col("stay")
    return best.where(gain > 0).select(F.col("a").alias("node"), "here", F.col("go.c").alias("there"), gain.alias("gain"))


def _apart(moves: DataFrame) -> DataFrame:
    """Those moves that are the best of every community they touch."""
    touched = moves.select("node", "gain", F.explode(F.array("here", "there")).alias("c"))
    first = touched.groupBy("c").agg(F.min(F.struct((-F.col("gain")).alias("g"), "node")).alias("best"))
    return moves.join(first.select(F.col("c").alias("here"), F.col("best.node").alias("n1")), "here").join(first.select(F.col("c").alias("there"), F.col("best.node").alias("n2")), "there").where("node = n1 and node = n2").select("node", "here", "there", "gain")


def _applied(labels: DataFrame, moves: DataFrame) -> DataFrame:
    return labels.join(moves.select("node", "there"), "node", "left").select("node", F.coalesce("there", "community").alias("community"), "degree", "loop")


def communities(edges: DataFrame, nodes: DataFrame, levels: int = LEVELS, rounds: int = ROUNDS) -> DataFrame:
    """(node, community): a community is named after one of its nodes.

    edges(a, b, w): undirected links of whole weights, each pair once, in any order of its ends; a node's link to itself counts
    for it. nodes(node): nodes without links stay alone; links of other nodes are left out. Nulls are left out. Each round
    writes a row per node; of the graph only three sums reach the driver.
    """
    nodes = nodes.where("node is not null").select("node").distinct()
    known = edges.where("a is not null and b is not null and w > 0").join(nodes.withColumnRenamed("node", "a"), "a", "left_semi").join(nodes.withColumnRenamed("node", "b"), "b", "left_semi")
    ordered = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("w").cast("long").alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    both = materialized(ordered.where("a <> b").select("a", "b", "w").union(ordered.where("a <> b").select("b", "a", "w")), "links")
    loops = ordered.where("a = b").select(F.col("a").alias("node"), (2 * F.col("w")).alias("loop"))
    members = nodes.select("node", F.col("node").alias("community"))
    for _ in range(levels):
        degree = both.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d"))
        start = members.select(F.col("community").alias("node")).distinct().join(loops, "node", "left").join(degree, "node", "left")
        start = start.select("node", F.col("node").alias("community"), (F.coalesce("d", F.lit(0)) + F.coalesce("loop", F.lit(0))).alias("degree"), F.coalesce("loop", F.lit(0)).alias("loop"))
        labels = materialized(start, "labels")
        total = labels.agg(F.sum("degree")).first()[0] or 0
        if not total:
            break
        now, quiet, moved = _numerator(both, labels, total), 0, False
        for number in range(rounds):
            moves = materialized(_moves(both, labels, total, number % 2 == 0), "moves")
            if not moves.limit(1).count():
                quiet += 1
                if quiet == 2:
                    break
                continue
            quiet, moved = 0, True
            after = materialized(_applied(labels, moves), "labels")
            value = _numerator(both, after, total)
            if value <= now:
                after = materialized(_applied(labels, _apart(moves)), "labels")
                value = _numerator(both, after, total)
            labels, now = after, value
        if not moved:
            break
        into = labels.select(F.col("node").alias("community"), F.col("community").alias("into"))
        members = materialized(members.join(into, "community").select("node", F.col("into").alias("community")), "members")
        at = lambda end, name: labels.select(F.col("node").alias(end), F.col("community").alias(name))  # noqa: B023, E731
        merged = both.join(at("a", "ca"), "a").join(at("b", "cb"), "b").groupBy("ca", "cb").agg(F.sum("w").alias("w"))
        merged = materialized(merged.select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"), "links")
        kept = labels.groupBy(F.col("community").alias("node")).agg(F.sum("loop").alias("l0"))
        loops = materialized(kept.join(merged.where("a = b").select(F.col("a").alias("node"), F.col("w").alias("l1")), "node", "left").select("node", (F.col("l0") + F.coalesce("l1", F.lit(0))).alias("loop")), "loops")
        both = merged.where("a <> b")
    return members


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row (communities, modularity) of members(node, community) on edges(a, b, w), each pair once; 0 without links."""
    e = edges.join(members.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(members.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = e.select(F.explode(F.array(F.struct(F.col("ca").alias("c"), F.when(F.col("ca") == F.col("cb"), 2 * F.col("w")).otherwise(0).alias("inside"), F.col("w").alias("d")), F.struct(F.col("cb").alias("c"), F.lit(0).alias("inside"), F.col("w").alias("d")))).alias("x")).select("x.*")
    by = ends.groupBy("c").agg(F.sum("inside").cast(WIDE).alias("inside"), F.sum("d").cast(WIDE).alias("d"))
    s = by.agg(F.sum("inside").alias("i"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum("d").alias("m"))
    m = F.col("m").cast("double")
    q = F.coalesce(F.col("i").cast("double") / m - F.col("dd").cast("double") / (m * m), F.lit(0.0))
    return s.crossJoin(members.agg(F.countDistinct("community").alias("communities"))).select("communities", q.alias("modularity"))
