"""Watching entities: combined weak signals, stand-in rates, padded rates, model status, community and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import signals


def weak_signals(counts: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """(key, signal, strength): a changepoint in the daily counts, and a rise of the scores.

    counts, scores: (key, series). A rise counts from seven scores on, if it is increasing with a strength above .5.
    """
    jump = signals.changepoint(counts, key).where("detected").select(key, F.lit("changepoint").alias("signal"), F.col("statistic").alias("strength"))
    rise = signals.trend(scores.where(F.size("series") >= 7), key).where("direction = 'increasing' and strength > 0.5").select(key, F.lit("trend").alias("signal"), "strength")
    return jump.unionByName(rise)


def monitor_ports(counts: DataFrame, key: str) -> DataFrame:
    """(key, signal, strength) of ports: their changepoints. Their forecasts raise no signal."""
    return signals.changepoint(counts, key).where("detected").select(key, F.lit("changepoint").alias("signal"), F.col("statistic").alias("strength"))


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on parts alone, the same on any executor."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def stand_in_rates(zones: DataFrame, days: int = 30, seed: int = 7) -> DataFrame:
    """(zone, day_no, rate) where no events are known: .85 of the zone's severity, rising from nine tenths, with noise of .06."""
    base = F.coalesce(F.col("severity") * 0.85, F.lit(0.35))
    rows = zones.withColumn("day_no", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    noise = F.sqrt(-2 * F.log(uniform(F.lit(seed), F.col("zone"), F.col("day_no"), F.lit(1)))) * F.cos(6.283185307179586 * uniform(F.lit(seed), F.col("zone"), F.col("day_no"), F.lit(2)))
    line = base * (0.9 + 0.1 * F.col("day_no") / (days - 1))
    return rows.select("zone", "day_no", F.greatest(F.lit(0.05), F.least(F.lit(1.0), line + 0.06 * noise)).alias("rate"))


def left_padded(series: DataFrame, days: int = 30) -> DataFrame:
    """Series of exactly ``days`` values: the first one repeated in front (.3 without any), or the last ones."""
    missing = F.greatest(F.lit(days) - F.size("series"), F.lit(0))
    filler = F.array_repeat(F.coalesce(F.try_element_at("series", F.lit(1)), F.lit(0.3)), missing)
    return series.withColumn("series", F.slice(F.concat(filler, F.col("series")), -days, days))


def monitored(daily: DataFrame, scores: DataFrame, key: str, value: str = "n", contamination: float = 0.1) -> DataFrame:
    """(key, signal, strength, confidence): anomalous windows, changepoints and rises of each entity, together.

    daily(key, day, value), scores(key, series). A window is anomalous if its isolation score is above all but ``contamination`` of
    the entity's own; an entity has one anomaly signal, of its strongest window.
    """
    w = signals.window_features(daily, key, value).na.fill(0.0)
    found = signals.anomalies(w, key, ["mean", "std", "top", "slope"]).withColumn("cut", F.percentile("score", F.lit(1 - contamination)).over(Window.partitionBy(key)))
    odd = found.where(F.col("score") > F.col("cut")).groupBy(key).agg(F.least(F.lit(1.0), F.max("score")).alias("strength"))
    rest = weak_signals(signals.as_series(daily, key, value), scores, key)
    sure = F.when(F.col("signal") == "anomaly", 0.7).when(F.col("signal") == "trend", 0.6).otherwise(F.lit(0.8))
    return odd.select(key, F.lit("anomaly").alias("signal"), "strength").unionByName(rest.select(key, "signal", F.col("strength").cast("double").alias("strength"))).withColumn("confidence", sure)


def risk_summary(scored: DataFrame, recent: DataFrame) -> DataFrame:
    """(supplier_id, name, country, score, category, recent_events, statistic, jump, direction, forecast) of each supplier.

    scored(supplier_id, name, country, score, category), recent(supplier_id, recent_events). Where no daily counts are kept, a
    supplier's month is three quiet weeks and one of a seventh of its events a day (one at least), and its scores are .3.
    """
    s = scored.join(recent.select("supplier_id", F.col("recent_events").alias("_n")), "supplier_id", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    week = F.greatest(F.lit(1), F.floor(F.col("_n") / 7)).cast("double")
    jump = signals.changepoint(s.select("supplier_id", F.concat(F.array_repeat(F.lit(0.0), 21), F.array_repeat(week, 7)).alias("series")), "supplier_id")
    rise = signals.trend(s.select("supplier_id", F.array_repeat(F.lit(0.3), 14).alias("series")), "supplier_id")
    out = s.join(jump.select("supplier_id", "statistic", F.col("detected").alias("jump")), "supplier_id").join(rise.select("supplier_id", "direction", F.element_at("forecast", -1).alias("forecast")), "supplier_id")
    return out.select("supplier_id", "name", "country", "score", "category", F.col("_n").alias("recent_events"), "statistic", "jump", "direction", "forecast")


def model_status(rows: DataFrame, loaded: bool, least: int = 10) -> DataFrame:
    """One row about a model: whether it is loaded, and whether its labels are enough to call it trained and calibrated.

    rows(label, held_out): training needs both classes among the rows that are not held out, calibration ``least`` labelled rows.
    """
    a = rows.agg(F.count("label").alias("labels"), F.countDistinct(F.when(~F.col("held_out"), F.col("label"))).alias("_classes"))
    trained = F.lit(loaded) & (F.col("_classes") > 1)
    status = lambda ok: F.when(ok, "validated").otherwise("demo")
    return a.select("labels", F.lit(loaded).alias("model_loaded"), status(trained).alias("training_status"), status(trained & (F.col("labels") >= least)).alias("calibration_status"))


def community_summary(members: DataFrame, names: int = 5) -> DataFrame:
    """Per community: suppliers, mean risk, its countries and industries in order, and the first names.

    members(community, supplier_id, name, country, industry, risk_score). Names are cut before they are gathered.
    """
    total = members.groupBy("community").agg(F.count("*").alias("suppliers"), F.round(F.avg("risk_score"), 6).alias("avg_risk"), F.array_join(F.array_sort(F.collect_set("country")), ",").alias("countries"), F.array_join(F.array_sort(F.collect_set("industry")), ",").alias("industries"))
    first = members.withColumn("n", F.row_number().over(Window.partitionBy("community").orderBy("name", "supplier_id"))).where(F.col("n") <= names)
    few = first.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name"))), lambda x: x["name"]), ",").alias("names"))
    return total.join(few, "community", "left")


def zipped(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both sides side by side by their place in each key's order; the longer side's rest is left out."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order))
    a = left.withColumn("place", place).drop(order)
    b = right.withColumn("place", place).drop(order)
    return a.join(b, [key, "place"])
