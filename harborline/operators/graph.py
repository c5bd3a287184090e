"""Propagation over the supply graph: breadth-first levels as DataFrame steps, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialized

#: Share of the impact that passes along a relation, and the hours it takes.
DECAY = {"AFFECTS": (1.0, 0.0), "SUPPLIES": (0.8, 24.0), "SHIPS_VIA": (0.9, 48.0), "PASSES_THROUGH": (0.7, 72.0), "LOCATED_IN": (0.6, 12.0), "MANUFACTURES": (0.85, 48.0), "OPERATES_ON": (0.75, 36.0)}
OTHER, LEAST_IMPACT, MAX_DEPTH = (0.5, 48.0), 0.1, 5
EXPANDS = ("supplier", "port", "chokepoint")


def supply_edges(t) -> DataFrame:
    """(src, src_type, rel, dst, dst_type): the typed edges of the domain tables, ids prefixed by their type."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}-"), F.col(c).cast("string"))
    edge = lambda df, a, ac, rel, b, bc: df.select(node(a, ac).alias("src"), F.lit(a).alias("src_type"), F.lit(rel).alias("rel"), node(b, bc).alias("dst"), F.lit(b).alias("dst_type"))
    return (
        edge(t.supplies, "supplier", "src", "SUPPLIES", "supplier", "dst")
        .union(edge(t.ships_via, "supplier", "supplier_id", "SHIPS_VIA", "port", "port_id"))
        .union(edge(t.ports, "port", "port_id", "PASSES_THROUGH", "chokepoint", "chokepoint_id"))
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from both ends, once: (node, node_type, rel, next, next_type)."""
    out = edges.select(F.col("src").alias("node"), F.col("src_type").alias("node_type"), "rel", F.col("dst").alias("next"), F.col("dst_type").alias("next_type"))
    back = edges.select(F.col("dst").alias("node"), F.col("dst_type").alias("node_type"), "rel", F.col("src").alias("next"), F.col("src_type").alias("next_type"))
    return out.union(back).distinct()


def _by_relation(which: int) -> Column:
    c = F.lit(OTHER[which])
    for rel, v in DECAY.items():
        c = F.when(F.col("rel") == rel, v[which]).otherwise(c)
    return c


def propagate(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Breadth-first spread from starts(run_id, node, node_type, impact): one row per run and reached node.

    run_id, node, node_type, depth, impact, delay_hours, via, parent. A node is taken at the first depth at which an arrival
    has an impact of .1 or more (depths below max_depth); among those the parent that was taken first, then relation, then
    node decide. step numbers order the visits. All runs advance together, one join a level.
    """
    near = materialized(undirected(edges), "edges")
    begin = F.struct(F.lit(0).cast("long").alias("parent_step"), F.lit("").alias("via"), F.lit(None).cast("string").alias("parent"))
    arrivals = starts.select("run_id", "node", "node_type", F.lit(0).alias("depth"), F.col("impact").cast("double"), F.lit(0.0).alias("delay_hours"), begin.alias("o")).select("run_id", "node", "node_type", "depth", "impact", "delay_hours", "o.*")
    done = None
    for depth in range(max_depth):
        arrivals = arrivals.where(F.col("impact") >= LEAST_IMPACT)
        if done is not None:
            arrivals = arrivals.join(done.select("run_id", "node"), ["run_id", "node"], "left_anti")
        first = Window.partitionBy("run_id", "node").orderBy("parent_step", "via", "node")
        taken = arrivals.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        level = Window.partitionBy("run_id").orderBy("parent_step", "via", "node")
        before = F.lit(0).cast("long") if done is None else F.coalesce("_before", F.lit(0))
        if done is not None:
            taken = taken.join(done.groupBy("run_id").agg(F.count("*").alias("_before")), "run_id", "left")
        taken = materialized(taken.withColumn("step", F.row_number().over(level) + before).drop("_before", "parent_step"), f"level{depth}")
        done = taken if done is None else done.union(taken)
        if depth + 1 == max_depth or not taken.limit(1).count():
            break
        out = taken.where(F.col("node_type").isin(*EXPANDS)).select("run_id", "node", "impact", "delay_hours", "step").join(near.drop("node_type"), "node")
        arrivals = out.select("run_id", F.col("next").alias("node"), F.col("next_type").alias("node_type"), F.lit(depth + 1).alias("depth"), (F.col("impact") * _by_relation(0)).alias("impact"), (F.col("delay_hours") + _by_relation(1)).alias("delay_hours"), F.col("step").alias("parent_step"), F.col("rel").alias("via"), F.col("node").alias("parent"))
    return done


def revenue(skus: Column) -> Column:
    """Revenue at risk of n listed products: each max(50 000, 250 000 (1 - .05 i)) for i from 0."""
    falling = F.least(skus, F.lit(16))
    return falling * 250000.0 - 12500.0 * falling * (falling - 1) / 2 + (skus - falling) * 50000.0


def recovery_days(delay_hours: Column, suppliers: Column, skus: Column) -> Column:
    """Whole days: delay / 24 + 7 + min(.5 suppliers, 14) or min(.1 products, 21), whichever is more."""
    return F.floor(delay_hours / 24 + 7 + F.greatest(F.least(0.5 * suppliers, F.lit(14.0)), F.least(0.1 * skus, F.lit(21.0)))).cast("int")


def impact_summary(spread: DataFrame, skus: DataFrame) -> DataFrame:
    """Per run: nodes reached, suppliers, products of those suppliers, revenue, recovery. skus(node, n)."""
    s = spread.join(skus, "node", "left")
    n = F.coalesce(F.sum("n"), F.lit(0)).alias("skus")
    agg = s.groupBy("run_id").agg(F.count("*").alias("steps"), F.max("depth").alias("depth"), F.count_if(F.col("node_type") == "supplier").alias("suppliers"), F.max("delay_hours").alias("max_delay"), n)
    return agg.select("run_id", "steps", "depth", "suppliers", "skus", revenue(F.col("skus")).alias("revenue_at_risk"), recovery_days(F.col("max_delay"), F.col("suppliers"), F.col("skus")).alias("recovery_days"))


def critical_paths(edges: DataFrame, sources: DataFrame, target: str, skus: DataFrame) -> DataFrame:
    """For each source node the step that reaches ``target`` at depth 3 or less from impact .5, with its path risk and priority.

    The risk is .4 of the impact and .5 of the revenue of the target's products (skus(node, n); a million counts full), less .05 a
    step.
    """
    runs = sources.select(F.col("node").alias("run_id"), "node", "node_type", F.lit(0.5).alias("impact"))
    hit = propagate(edges, runs, 3).where(F.col("node") == target).join(skus.select("node", "n"), "node", "left")
    at_risk = revenue(F.coalesce("n", F.lit(0)))
    risk = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * F.col("impact") + 0.5 * F.least(at_risk / 1e6, F.lit(1.0)) - 0.05 * F.col("step")))
    out = hit.select(F.col("run_id").alias("source"), "step", "depth", "impact", at_risk.alias("revenue_at_risk"), risk.alias("risk"))
    return out.withColumn("priority", F.when(F.col("risk") > 0.7, "HIGH").otherwise("MEDIUM"))


def paths(edges: DataFrame, starts: DataFrame, depth: int = 3, best: int = 3) -> DataFrame:
    """(start, node, rank, hops, path, impact): paths of ``depth`` undirected links at most that visit no node twice; starts(node).

    impact is the product of what the strongest relation of each link passes on. For each start and node the ``best`` paths by impact, then
    fewer hops, then the nodes' names; a frontier carries its path and keeps as many for each (start, node) at every hop, so it
    has at most ``best`` rows for each pair however many paths there are.
    """
    shares = undirected(edges).groupBy("node", "next").agg(F.max(_by_relation(0)).alias("share"))
    near = materialized(shares, "links")
    first = Window.partitionBy("start", "node").orderBy(F.desc("impact"), F.array_join("path", ">"))
    frontier = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"), F.lit(1.0).alias("impact"))
    found = None
    for hop in range(1, depth + 1):
        grown = frontier.join(near, "node").where(~F.array_contains("path", F.col("next")))
        grown = grown.select("start", F.col("next").alias("node"), F.lit(hop).alias("hops"), F.array_append("path", F.col("next")).alias("path"), F.round(F.col("impact") * F.col("share"), 9).alias("impact"))
        frontier = materialized(grown.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= best).drop("_n"), "paths")
        found = frontier if found is None else found.unionByName(frontier)
    order = Window.partitionBy("start", "node").orderBy(F.desc("impact"), "hops", F.array_join("path", ">"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("start", "node", "rank", "hops", F.array_join("path", ">").alias("path"), "impact")


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, hops): nodes within ``depth`` undirected hops, at their least distance; starts(node)."""
    near = undirected(edges).select("node", "next").distinct()
    found = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    edge = found
    for hop in range(1, depth + 1):
        edge = edge.join(near, "node").select("start", F.col("next").alias("node"), F.lit(hop).alias("hops")).distinct().join(found.select("start", "node"), ["start", "node"], "left_anti")
        edge = materialized(edge, "hops")
        found = found.union(edge)
    return found


def communities(edges: DataFrame, nodes: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): label propagation, each node taking its neighbours' most frequent label (ties: the smallest)."""
    near = undirected(edges).select("node", "next").distinct()
    labels = nodes.select("node", F.col("node").alias("community"))
    for _ in range(rounds):
        votes = near.join(labels.withColumnRenamed("node", "next"), "next").groupBy("node", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy("node").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("new"))
        labels = materialized(labels.join(best, "node", "left").select("node", F.coalesce("new", "community").alias("community")), "labels")
    return labels
