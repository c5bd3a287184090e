"""Supplier features, pillars and rule scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import band_api

WEIGHTS = {"proximity": 0.25, "single_source": 0.20, "critical_events": 0.20, "history": 0.15, "congestion": 0.10, "weather": 0.10}


def event_signals(events: DataFrame, as_of, days: int = 30) -> DataFrame:
    """supplier_id, recent_events, critical_events (severity .75 or more), max_severity within ``days`` before as_of."""
    recent = events.where(F.col("ts") > F.lit(as_of) - F.make_dt_interval(F.lit(days)))
    return recent.groupBy("supplier_id").agg(F.count("*").alias("recent_events"), F.count_if(F.col("severity") >= 0.75).alias("critical_events"), F.max("severity").alias("max_severity"))


def congestion(ships_via: DataFrame, ports: DataFrame, chokepoints: DataFrame) -> DataFrame:
    """supplier_id, vessels: the busiest chokepoint behind any of its ports."""
    lanes = ships_via.join(ports.select("port_id", "chokepoint_id"), "port_id").join(chokepoints.select("chokepoint_id", "vessel_count"), "chokepoint_id")
    return lanes.groupBy("supplier_id").agg(F.max("vessel_count").alias("vessels"))


def features(suppliers: DataFrame, signals: DataFrame, lanes: DataFrame, countries: DataFrame, history: DataFrame) -> DataFrame:
    """Suppliers with their model features. countries: country, stability, weather, sanctions (missing: .5, 0, 0); history:
    supplier_id, disruptions (missing: 0).

    A critical supplier has one critical event at least; proximity is .1 without events and at least .6 of the sanctions.
    """
    joined = suppliers.join(signals, "supplier_id", "left").join(lanes, "supplier_id", "left").join(countries, "country", "left").join(history, "supplier_id", "left")
    zero = F.lit(0.0)
    critical = F.coalesce("critical_events", F.lit(0))
    return joined.select(
        "supplier_id",
        "name",
        "country",
        F.greatest(F.least(F.coalesce("max_severity", F.lit(0.1)), F.lit(1.0)), F.coalesce("sanctions", zero) * 0.6).alias("proximity"),
        F.coalesce("stability", F.lit(0.5)).alias("stability"),
        F.least(F.coalesce("vessels", F.lit(0)) / 20.0, F.lit(1.0)).alias("congestion"),
        F.coalesce("weather", zero).alias("weather"),
        F.coalesce("recent_events", F.lit(0)).alias("recent_events"),
        F.when(F.col("critical") & (critical == 0), 1).otherwise(critical).cast("long").alias("critical_events"),
        "single_source",
        F.when(F.col("critical"), 0.35).otherwise(0.65).alias("financial_health"),
        F.coalesce("disruptions", F.lit(0)).alias("disruptions"),
    )


def share(count: Column, full: float) -> Column:
    return F.least(count / full, F.lit(1.0))


def vector(f: DataFrame) -> DataFrame:
    """The thirteen model inputs in order; depth, alternatives, volatility and resolution default to 1, 0, .3 and 0."""
    inputs = [
        F.col("proximity"), F.col("stability"), F.col("congestion"), F.col("weather"), share(F.col("recent_events"), 10.0), share(F.col("critical_events"), 5.0), F.lit(1 / 5.0),
        F.col("single_source").cast("double"), F.lit(0.0), F.col("financial_health"), F.lit(0.3), share(F.col("disruptions"), 5.0), F.lit(0.0),
    ]
    return f.select("supplier_id", F.array(*[x.cast("double") for x in inputs]).alias("vector"))


def pillars(f: DataFrame, depth: int = 1) -> DataFrame:
    """Four indices of 0 to 1, to three places."""
    half = lambda a, b: F.round(F.least(F.lit(1.0), (a + b) / 2.0), 3)
    return f.select(
        "supplier_id",
        half(F.col("proximity"), 1.0 - F.col("stability")).alias("geographic"),
        half(F.col("congestion"), F.col("weather")).alias("operational"),
        half(F.col("single_source").cast("double"), F.least(F.lit(depth / 5.0), F.lit(1.0))).alias("network"),
        half(share(F.col("recent_events"), 10.0), share(F.col("critical_events"), 5.0)).alias("event_load"),
    )


def disruptions(labels: DataFrame) -> DataFrame:
    """(supplier_id, disruptions): how often each supplier's labels say that it was disrupted; labels(supplier_id, disrupted)."""
    return labels.where("disrupted = 1").groupBy("supplier_id").agg(F.count("*").alias("disruptions"))


def rescored(scores: DataFrame, links: DataFrame, as_of, hours: int) -> DataFrame:
    """The scores of suppliers that got a link in the last ``hours``; links(supplier_id, linked_at)."""
    recent = links.where(F.col("linked_at") > F.lit(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))).select("supplier_id")
    return scores.join(recent, "supplier_id", "left_semi")


def contributions(f: DataFrame, top: int = 5) -> DataFrame:
    """(supplier_id, rank, feature, contribution): the weighted terms of the rule score, by absolute value, ties by name."""
    w = WEIGHTS
    value = {"proximity": F.col("proximity"), "single_source": F.col("single_source").cast("double"), "critical_events": share(F.col("critical_events"), 5.0), "history": share(F.col("disruptions"), 5.0), "congestion": F.col("congestion"), "weather": F.col("weather")}
    terms = F.array_sort(F.array(*[F.struct((-F.abs(w[k] * v)).alias("key"), F.lit(k).alias("feature"), (w[k] * v).alias("contribution")) for k, v in value.items()]))
    return f.select("supplier_id", F.posexplode(F.slice(terms, 1, top)).alias("at", "t")).select("supplier_id", (F.col("at") + 1).alias("rank"), "t.feature", "t.contribution")


def rule_score(f: DataFrame) -> DataFrame:
    """Weighted sum of the features within 0 to 1, its band, and why: the factors that raise it."""
    w = WEIGHTS
    total = w["proximity"] * F.col("proximity") + w["single_source"] * F.col("single_source").cast("double") + w["critical_events"] * share(F.col("critical_events"), 5.0) + w["history"] * share(F.col("disruptions"), 5.0) + w["congestion"] * F.col("congestion") + w["weather"] * F.col("weather")
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))
    factors = F.filter(F.array(F.when(F.col("proximity") > 0.5, F.lit("conflict_proximity")), F.when(F.col("single_source"), F.lit("single_source"))), lambda x: x.isNotNull())
    return f.withColumn("score", score).withColumn("category", band_api(F.col("score"))).withColumn("factors", F.array_join(factors, ","))


def provenance(f: DataFrame, static_countries: DataFrame) -> DataFrame:
    """Where each supplier's inputs come from, and how many are live of thirteen."""
    known = static_countries.select("country", F.lit(True).alias("known"))
    live = [F.col("recent_events") > 0, F.col("critical_events") > 0, F.col("proximity") > 0.1, F.col("congestion") > 0, F.coalesce("known", F.lit(False)), F.col("single_source")]
    return f.join(known, "country", "left").select("supplier_id", F.when(F.coalesce("known", F.lit(False)), "cached").otherwise("static_fallback").alias("stability_source"), F.concat(F.size(F.filter(F.array(*live), lambda x: x)).cast("string"), F.lit("/13")).alias("live"))
