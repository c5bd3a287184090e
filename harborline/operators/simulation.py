"""Monte Carlo over the supply graph: every iteration of every scenario is a row, and their spreads are one breadth-first search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import point
from ..materialize import materialized
from . import graph


def iterations(scenarios: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(scenario_id, iteration, fires, severity, u, z): n draws for each scenario(scenario_id, node, node_type, severity, probability, duration_days).

    Draws are hashes of (seed, scenario, iteration, use), so any executor that repeats them gets the same.
    """
    n = max(1000, n)
    uniform = lambda use: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed).cast("string"), "scenario_id", F.col("iteration").cast("string"), F.lit(str(use))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    normal = lambda use: F.sqrt(-2 * F.log(uniform(use))) * F.cos(6.283185307179586 * uniform(use + 100))
    rows = scenarios.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    drawn = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("severity") + 0.1 * normal(2)))
    return rows.withColumn("fires", uniform(1) <= F.col("probability")).withColumn("drawn", drawn).withColumn("noise", normal(3)).withColumn("revenue_u", uniform(4))


def severity_steps(relations: list[str], depth: int = graph.MAX_DEPTH) -> list[float]:
    """Severities at which the spread can change, ascending: those that a path of fewer than ``depth`` steps brings to the least impact.

    Impacts are a severity times the shares of the relations on the way, so between two of these every severity reaches
    the same nodes.
    """
    shares = {graph.DECAY.get(r, graph.OTHER)[0] for r in relations}
    factors = {1.0}
    for _ in range(depth - 1):
        factors |= {round(f * s, 12) for f in factors for s in shares}
    return sorted({graph.LEAST_IMPACT / f for f in factors if graph.LEAST_IMPACT / f <= 1.0})


def simulate(edges: DataFrame, scenarios: DataFrame, skus: DataFrame, n: int = 1000, seed: int = 42) -> DataFrame:
    """One row per iteration: outcome, suppliers, products, duration in days, revenue. skus(node, n).

    Every iteration spreads with its own severity. Those between the same two ``severity_steps`` reach the same nodes and share
    one search. Below .3 a disruption stays contained and lasts half its time.
    """
    steps = severity_steps([r[0] for r in edges.select("rel").distinct().collect()])  # a row of each relation
    runs = iterations(scenarios, n, seed).withColumn("step", F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col("drawn") + 1e-12)))
    starts = runs.where("fires and drawn >= 0.3").groupBy("scenario_id", "node", "node_type", "step").agg(F.max("drawn").alias("impact"))
    starts = starts.select(F.concat_ws("|", "scenario_id", F.col("step").cast("string")).alias("run_id"), "node", "node_type", "impact")
    reached = graph.impact_summary(graph.propagate(edges, starts), skus).select("run_id", "suppliers", "skus")
    joined = runs.withColumn("run_id", F.concat_ws("|", "scenario_id", F.col("step").cast("string"))).join(reached, "run_id", "left")
    contained = F.col("drawn") < 0.3
    suppliers = F.when(F.col("fires") & ~contained, F.coalesce("suppliers", F.lit(0))).otherwise(0)
    products = F.when(F.col("fires") & ~contained, F.coalesce("skus", F.lit(0))).otherwise(0)
    outcome = F.when(~F.col("fires"), "none").when(contained, "contained").otherwise("disrupted")
    days = F.when(~F.col("fires"), 0).when(contained, F.greatest(F.lit(1), F.floor(0.5 * F.col("duration_days")))).otherwise(F.greatest(F.lit(1), F.floor(F.col("duration_days") * (1 + 0.1 * F.coalesce("suppliers", F.lit(0))) * (1 + 0.2 * F.col("noise")))))
    return joined.select("scenario_id", "iteration", outcome.alias("outcome"), suppliers.alias("suppliers"), products.alias("skus"), days.cast("long").alias("days"), (products * (100000.0 + 900000.0 * F.col("revenue_u"))).alias("revenue"))


def summary(runs: DataFrame) -> DataFrame:
    """Per scenario: probability, means, and 10th, 50th, 90th percentiles over the disrupted iterations (0 without any)."""
    hit = lambda c: F.when(F.col("outcome") == "disrupted", F.col(c))
    pct = lambda c: [F.coalesce(F.percentile(hit(c), F.lit(p / 100.0)), F.lit(0.0)).alias(f"{c}_p{p}") for p in (10, 50, 90)]
    return runs.groupBy("scenario_id").agg(F.count("*").alias("iterations"), F.avg((F.col("outcome") == "disrupted").cast("double")).alias("probability"), F.coalesce(F.avg(hit("suppliers")), F.lit(0.0)).alias("suppliers"), F.coalesce(F.avg(hit("skus")), F.lit(0.0)).alias("skus"), F.coalesce(F.avg(hit("days")), F.lit(0.0)).alias("days"), F.coalesce(F.avg(hit("revenue")), F.lit(0.0)).alias("revenue"), *pct("days"), *pct("revenue"))


def ranked(summaries: DataFrame) -> DataFrame:
    """Scenarios by risk: .4 probability + .4 impact (.3 suppliers + .1 products + .4 revenue in millions, at most 1) + .2 of days / 30."""
    impact = F.least(F.lit(1.0), 0.3 * F.col("suppliers") + 0.1 * F.col("skus") + 0.4 * F.col("revenue") / 1e6)
    risk = 0.4 * F.col("probability") + 0.4 * impact + 0.2 * F.least(F.col("days") / 30.0, F.lit(1.0))
    return summaries.withColumn("risk", F.round(risk, 6)).orderBy(F.desc("risk"), "scenario_id")


def sensitivity(scenario: DataFrame, parameter: str, values: list[float]) -> DataFrame:
    """The scenario with one parameter set to each value: a scenario of its own each."""
    varied = scenario.withColumn("_v", F.explode(F.array(*map(F.lit, values))))
    return varied.withColumn("scenario_id", F.concat_ws("@", "scenario_id", F.col("_v").cast("string"))).withColumn(parameter, F.col("_v").cast(scenario.schema[parameter].dataType)).drop("_v")


def compare(summaries: DataFrame) -> DataFrame:
    """Scenarios by probability, then suppliers."""
    return summaries.orderBy(F.desc("probability"), F.desc("suppliers"), "scenario_id")


def frequent(edges: DataFrame, scenarios: DataFrame, n: int = 1000, seed: int = 42, share: float = 0.1, most: int = 10) -> DataFrame:
    """(scenario_id, rank, node, runs): suppliers that more than ``share`` of a scenario's disrupted iterations reach, by how many."""
    steps = severity_steps([r[0] for r in edges.select("rel").distinct().collect()])
    runs = iterations(scenarios, n, seed).where("fires and drawn >= 0.3").withColumn("step", F.size(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.col("drawn") + 1e-12)))
    groups = runs.groupBy("scenario_id", "node", "node_type", "step").agg(F.max("drawn").alias("impact"), F.count("*").alias("times")).withColumn("run_id", F.concat_ws("|", "scenario_id", F.col("step").cast("string")))
    groups = materialized(groups, "groups")
    spread = graph.propagate(edges, groups.select("run_id", "node", "node_type", "impact")).where("node_type = 'supplier'").select("run_id", F.col("node").alias("reached"))
    total = groups.groupBy("scenario_id").agg(F.sum("times").alias("all"))
    hit = spread.join(groups.select("run_id", "scenario_id", "times"), "run_id").groupBy("scenario_id", "reached").agg(F.sum("times").alias("runs"))
    rank = F.row_number().over(Window.partitionBy("scenario_id").orderBy(F.desc("runs"), "reached"))
    return hit.join(total, "scenario_id").where(F.col("runs") > share * F.col("all")).withColumn("rank", rank).where(F.col("rank") <= most).select("scenario_id", "rank", F.col("reached").alias("node"), "runs")


def overlay(spread: DataFrame, suppliers: DataFrame, most: int = 25) -> DataFrame:
    """(run_id, role, id, feature): the places of a spread as map points: its epicentre and the first suppliers it reaches.

    spread: ``graph.propagate``; nodes without a place are left out of the map, after the first ones were taken.
    """
    place = suppliers.select(F.concat(F.lit("supplier-"), F.col("supplier_id").cast("string")).alias("node"), "name", "lat", "lon", "risk_score")
    first = Window.partitionBy("run_id").orderBy("step")
    hit = spread.where("node_type = 'supplier' and depth > 0").withColumn("n", F.row_number().over(first)).where(F.col("n") <= most).withColumn("role", F.lit("affected_supplier"))
    rows = hit.select("run_id", "node", "role").unionByName(spread.where("depth = 0").select("run_id", "node", F.lit("epicenter").alias("role")))
    shown = rows.join(place, "node").where("lat is not null")
    return shown.select("run_id", "role", F.col("node").alias("id"), point(F.col("lon"), F.col("lat"), name=F.col("name"), risk_score=F.col("risk_score"), role=F.col("role")).alias("feature"))
