"""Roll-ups, digests, map layers and evaluation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import band_map, point

#: Distinct values up to so many are put in order by one task.
BRACKETED = 1_000_000

#: Words that place a supplier in a sector.
SECTORS = {
    "semiconductors": ["semiconductor", "electronics", "chip", "taiwan"],
    "energy": ["energy", "oil", "lng", "chemical", "rotterdam"],
    "automotive": ["auto", "motor", "vehicle", "parts"],
    "shipping": ["port", "shipping", "maritime", "logistics"],
}


def sector_rollup(suppliers: DataFrame, top: int = 5) -> DataFrame:
    """A row per sector: suppliers, mean and largest risk, critical ones, and the ``top`` riskiest by name; empty sectors too.

    A supplier may be in several sectors. The best names are ranked by a window, not gathered.
    """
    spark = suppliers.sparkSession
    dim = F.broadcast(spark.createDataFrame(list(SECTORS.items()), "sector string, words array<string>"))
    text = F.lower(F.concat_ws(" ", "name", "industry"))
    member = suppliers.withColumn("_text", text).join(dim, F.exists("words", lambda w: F.col("_text").contains(w))).select("sector", "name", "supplier_id", "risk_score", "critical")
    rank = Window.partitionBy("sector").orderBy(F.desc("risk_score"), "supplier_id")
    best = member.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= top).groupBy("sector").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("top_suppliers"))
    agg = member.groupBy("sector").agg(F.count("*").alias("suppliers"), F.round(F.avg("risk_score"), 3).alias("avg_risk"), F.max("risk_score").alias("max_risk"), F.count_if("critical").alias("critical"))
    return dim.select("sector").join(agg, "sector", "left").join(best, "sector", "left").select("sector", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("avg_risk", F.lit(0.0)).alias("avg_risk"), F.coalesce("max_risk", F.lit(0.0)).alias("max_risk"), F.coalesce("critical", F.lit(0)).alias("critical"), F.coalesce("top_suppliers", F.lit("")).alias("top_suppliers"))


def graph_health(suppliers: DataFrame, events: DataFrame, affects: DataFrame, ships_via: DataFrame, supplies: DataFrame) -> DataFrame:
    """One row of counts and the completeness: .35 places, .25 events, .25 ports, .15 deeper tiers, to three places."""
    s = suppliers.agg(F.count("*").alias("suppliers"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("missing_geo"))
    no_port = suppliers.join(ships_via, "supplier_id", "left_anti").agg(F.count("*").alias("without_ports"))
    linked = affects.agg(F.countDistinct("supplier_id").alias("with_events"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), F.count("confidence").alias("links"))
    tiers = supplies.where("tier >= 2").agg(F.count("*").alias("tier2_links"))
    row = s.crossJoin(no_port).crossJoin(linked).crossJoin(tiers).crossJoin(events.agg(F.count("*").alias("events")))  # one row each
    n = F.greatest(F.col("suppliers"), F.lit(1))
    score = 0.35 * (1 - F.col("missing_geo") / n) + 0.25 * F.col("with_events") / n + 0.25 * (1 - F.col("without_ports") / n) + 0.15 * F.least(F.col("tier2_links") / n, F.lit(1.0))
    return row.withColumn("completeness", F.when(F.col("suppliers") > 0, F.round(score, 3)).otherwise(0.0)).withColumn("status", F.when(F.col("suppliers") > 0, "healthy").otherwise("empty"))


def weekly_types(events: DataFrame, as_of, days: int = 7, top: int = 5) -> DataFrame:
    """The most frequent kinds of the last days."""
    recent = events.where(F.col("ts") > F.lit(as_of) - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(top)


def digest(events: DataFrame, affects: DataFrame, suppliers: DataFrame, as_of, days: int = 7) -> DataFrame:
    """One row: events, critical ones, suppliers hit, the leading kind, and a sentence about them."""
    recent = events.where(F.col("ts") > F.lit(as_of) - F.make_dt_interval(F.lit(days)))
    hit = affects.join(recent.select("event_id"), "event_id", "left_semi").agg(F.countDistinct("supplier_id").alias("suppliers_hit"))
    kinds = recent.groupBy("kind").agg(F.count("*").alias("n")).agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("leading"))
    row = recent.agg(F.count("*").alias("events"), F.count_if(F.col("severity") >= 0.75).alias("critical")).crossJoin(hit).crossJoin(kinds)
    return row.withColumn("summary", F.concat(F.col("events").cast("string"), F.lit(" events, "), F.col("critical").cast("string"), F.lit(" critical, mostly "), F.coalesce("leading", F.lit("none"))))


def timeline(events: DataFrame, affects: DataFrame, suppliers: DataFrame, limit: int = 50, names: int = 3) -> DataFrame:
    """The severest events with the first supplier names each touches."""
    best = events.orderBy(F.desc("severity"), "event_id").limit(limit)
    hit = affects.select("event_id", "supplier_id").distinct().join(F.broadcast(best.select("event_id")), "event_id").join(suppliers.select("supplier_id", "name"), "supplier_id")
    rank = Window.partitionBy("event_id").orderBy("name", "supplier_id")
    first = hit.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= names).groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]), ",").alias("suppliers"))
    return best.join(first, "event_id", "left").select("event_id", "ts", "kind", "severity", F.coalesce("suppliers", F.lit("")).alias("suppliers"))


def risk_points(suppliers: DataFrame, least: float = 0.0, limit: int = 500) -> DataFrame:
    """GeoJSON points of the riskiest suppliers that have a place, with their map band."""
    s = suppliers.where((F.col("risk_score") >= least) & F.col("lat").isNotNull() & F.col("lon").isNotNull()).orderBy(F.desc("risk_score"), "supplier_id").limit(limit)
    return s.select("supplier_id", "lat", "lon", "risk_score", band_map(F.col("risk_score")).alias("band"), point(F.col("lon"), F.col("lat"), name=F.col("name"), risk=F.col("risk_score")).alias("feature"))


def trade_routes(suppliers: DataFrame, ships_via: DataFrame, ports: DataFrame, chokepoints: DataFrame, limit: int = 50) -> DataFrame:
    """Supplier-port and port-chokepoint lines, each kind limited on its own."""
    a = ships_via.where("is_primary").join(suppliers.select("supplier_id", "name"), "supplier_id").join(ports.select("port_id", "port_name"), "port_id").orderBy("supplier_id").limit(limit).select(F.lit("ships_via").alias("kind"), F.col("name").alias("origin"), F.col("port_name").alias("target"))
    b = ports.join(chokepoints, "chokepoint_id").orderBy("port_id").limit(limit).select(F.lit("passes_through").alias("kind"), F.col("port_name").alias("origin"), F.col("chokepoint_name").alias("target"))
    return a.unionByName(b).distinct()


def network(suppliers: DataFrame, edges: DataFrame, top: int = 50) -> DataFrame:
    """Edges touching the riskiest suppliers, once each, with the types of their ends."""
    best = suppliers.orderBy(F.desc("risk_score"), "supplier_id").limit(top).select(F.concat(F.lit("supplier-"), F.col("supplier_id").cast("string")).alias("node"))
    return edges.join(F.broadcast(best), (F.col("src") == F.col("node")) | (F.col("dst") == F.col("node"))).select("src", "src_type", "rel", "dst", "dst_type").distinct()


def best_per_key(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """One row per key: the highest score, the later one on ties."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), F.desc(order)))).where("_n = 1").drop("_n")


def backtest(scored_labels: DataFrame, cut: float = 0.5, k: int = 20) -> DataFrame:
    """One row of confusion counts, precision, recall, median lead days (the upper one) and precision at k.

    scored_labels(id, disrupted, score, lead_days); a missing score counts as not flagged.
    """
    d, s = F.col("disrupted") == 1, F.coalesce("score", F.lit(0.0)) >= cut
    c = scored_labels.agg(F.count_if(d & s).alias("tp"), F.count_if(~d & s).alias("fp"), F.count_if(d & ~s).alias("fn"), F.count_if(~d & ~s).alias("tn"))
    leads = scored_labels.where(d & s & F.col("lead_days").isNotNull())
    median = value_at(leads, "lead_days", lambda n: n // 2).withColumnRenamed("value", "median_lead")
    best = scored_labels.where("score is not null").orderBy(F.desc("score"), "id").limit(k).agg((F.count_if(d) / F.greatest(F.count("*"), F.lit(1))).alias("precision_at_k"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return c.withColumn("precision", F.round(ratio("tp", "fp"), 6)).withColumn("recall", F.round(ratio("tp", "fn"), 6)).crossJoin(median).crossJoin(best)


def value_at(rows: DataFrame, value: str, rank) -> DataFrame:
    """One row (value): what stands at rank(n) from 0 among the n non-null values in order; null where there are none.

    Counts per value come first. Where these are many, a bracket of two approximate quantiles is taken, and only what lies
    inside it is counted up in order: about a thousandth of the values.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    total, values = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    if not total:
        return counts.agg(F.min("value").alias("value"))
    want, below = min(max(int(rank(total)), 0), total - 1), 0
    if values > BRACKETED:
        at = want / total
        low, high = rows.agg(F.percentile_approx(value, [max(0.0, at - 0.0005), min(1.0, at + 0.0005)], 100_000)).first()[0]
        below = counts.where(F.col("value") < low).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        inside = counts.where(F.col("value").between(low, high))
        if below <= want < below + inside.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]:
            counts = inside
        else:
            below = 0
    upto = F.sum("n").over(Window.orderBy("value")) + below
    return counts.withColumn("upto", upto).where(F.col("upto") > want).agg(F.min("value").alias("value"))


def quantile_higher(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The value at rank ceil(q (n - 1)) from 0, without interpolation."""
    return value_at(rows, value, lambda n: math.ceil(q * (n - 1))).withColumnRenamed("value", "quantile")


def conformal(rows: DataFrame, score: str, label: str, order: str, q: float = 0.9) -> DataFrame:
    """Score bands within 0 to 1 from absolute residuals of the last 30 % of labelled rows (five at least); below ten: none.

    Rows that share the place where the last ones begin all count among them.
    """
    labelled = rows.where(F.col(label).isNotNull())
    n = labelled.count()
    first = value_at(labelled, order, lambda m: m - max(int(m * 0.3), 5))
    last = labelled.join(F.broadcast(first), F.col(order) >= F.col("value")) if n >= 10 else labelled.limit(0)  # one row
    width = quantile_higher(last.withColumn("residual", F.abs(F.col(score) - F.col(label))), "residual", q)
    known = F.col("quantile").isNotNull()
    return rows.crossJoin(width).withColumn("low", F.when(known, F.greatest(F.lit(0.0), F.col(score) - F.col("quantile")))).withColumn("high", F.when(known, F.least(F.lit(1.0), F.col(score) + F.col("quantile")))).drop("quantile")


def pearson(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null where a side does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: pairs, Pearson's r, and what it supports: below 5 insufficient_data, else association_only."""
    return pairs.agg(F.count("*").alias("n"), pearson(a, b).alias("r")).withColumn("verdict", F.when(F.col("n") < 5, "insufficient_data").otherwise("association_only"))


def bootstrap_correlation(pairs: DataFrame, a: str, b: str, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """95 % interval of r by the Poisson bootstrap: each row weighs Poisson(1) in each replicate, so sums of one pass suffice."""

    def sums(batches):
        total = np.zeros((replicates, 6))
        for batch in batches:
            x, y = batch[a].to_numpy(float), batch[b].to_numpy(float)
            for lo in range(0, len(x), 4096):
                u, v = x[lo : lo + 4096], y[lo : lo + 4096]
                keys = pd.util.hash_pandas_object(pd.DataFrame({"u": u, "v": v, "i": batch["_i"].to_numpy()[lo : lo + 4096]}), index=False).to_numpy()
                w = np.random.default_rng([seed, int(keys[0]) & 0x7FFFFFFF]).poisson(1.0, (replicates, len(u)))
                total += w @ np.stack([np.ones(len(u)), u, v, u * u, v * v, u * v], 1)
        yield pd.DataFrame({"rep": np.arange(replicates), **{f"s{i}": total[:, i] for i in range(6)}})

    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double"), F.col(b).cast("double"), F.xxhash64(a, b).alias("_i"))
    part = rows.mapInPandas(sums, "rep long, s0 double, s1 double, s2 double, s3 double, s4 double, s5 double")
    s = part.groupBy("rep").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(6)])
    n, x, y, xx, yy, xy = (F.col(f"s{i}") for i in range(6))
    r = (n * xy - x * y) / F.sqrt((n * xx - x * x) * (n * yy - y * y))
    ok = s.where(((n * xx - x * x) > 0) & ((n * yy - y * y) > 0)).select(r.alias("r"))
    return ok.agg(F.percentile("r", F.lit(0.025)).alias("low"), F.percentile("r", F.lit(0.975)).alias("high"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per tier, unused tiers with 0."""
    tiers = alerts.sparkSession.createDataFrame([("critical",), ("warning",), ("info",)], "tier string")
    return tiers.join(alerts.groupBy("tier").agg(F.count("*").alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def page(rows: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(skip).limit(limit)
