"""Writers: upserts by key, link merges, counters, histories, snapshots, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the last of each key by ``order``; on ties new rows win."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_new")


def without(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """rows less those with a key in gone(id), in any of the columns: a detaching delete."""
    for k in keys:
        rows = rows.join(gone.select(F.col("id").alias(k)), k, "left_anti").select(rows.columns)
    return rows


def updated(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows with the non-null fields of changes; the key and created_at do not change."""
    c = changes.select(*[F.col(x).alias(f"_{x}") for x in changes.columns])
    joined = rows.join(c, rows[key] == c[f"_{key}"], "left")
    return joined.select(*[F.coalesce(f"_{x}", x).alias(x) if x in changes.columns and x not in (key, "created_at") else F.col(x) for x in rows.columns])


def counted(old: DataFrame, arrivals: DataFrame, key: str, counter: str) -> DataFrame:
    """old with the counter raised by each key's arrivals."""
    new = arrivals.groupBy(key).agg(F.count("*").alias("_more"))
    return old.join(new, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("_more", F.lit(0))).select(old.columns)


def append_history(rows: DataFrame, path: str, time: str = "scored_at") -> None:
    """Append to a Parquet history partitioned by day."""
    rows.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)


def as_messages(rows: DataFrame, source: str, kind: Column, key: Column) -> DataFrame:
    """(topic, key, value) for a message sink: the topic is named by source and kind, the value is JSON with metadata."""
    body = F.struct(*[F.col(c) for c in rows.columns], F.struct(F.lit(source).alias("source"), kind.alias("type")).alias("_metadata"))
    return rows.select(F.concat(F.lit(f"events.{source}."), kind).alias("topic"), key.cast("string").alias("key"), F.to_json(body).alias("value"))


def export_snapshot(suppliers: DataFrame, signals: DataFrame, folder: str, day: str) -> None:
    """One day's snapshot as CSV in name order: suppliers with the events of the last 30 days (none: 0)."""
    rows = suppliers.join(signals, "supplier_id", "left").select("supplier_id", "name", "risk_score", F.coalesce("recent_events", F.lit(0)).alias("events"), F.coalesce("max_severity", F.lit(0.0)).alias("max_severity"))
    rows.orderBy("name", "supplier_id").write.mode("overwrite").option("header", True).csv(f"{folder}/snapshot_date={day}")


def publish(messages: DataFrame, servers: str) -> None:
    """Send (topic, key, value) rows; each goes to the topic it names, acknowledged by all replicas."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("kafka.compression.type", "gzip").save()


def scored_history(scores: DataFrame, version: str, at: Column) -> DataFrame:
    """Scores as history rows: (supplier_id, risk_score, risk_category, model_version, feature_snapshot, scored_at)."""
    others = [c for c in scores.columns if c not in ("supplier_id", "score", "category")]
    return scores.select("supplier_id", F.col("score").alias("risk_score"), F.col("category").alias("risk_category"), F.lit(version).alias("model_version"), F.to_json(F.struct(*others)).alias("feature_snapshot"), at.alias("scored_at"))


def written_back(suppliers: DataFrame, scores: DataFrame) -> DataFrame:
    """suppliers with the new scores; those without one keep theirs."""
    new = scores.select("supplier_id", F.col("score").alias("_score"))
    return suppliers.join(new, "supplier_id", "left").withColumn("risk_score", F.coalesce("_score", "risk_score")).drop("_score")


def links_once(links: DataFrame) -> DataFrame:
    """One link per (src, kind, dst), however often it was made."""
    return links.select("src", "kind", "dst").distinct()


#: The scenario that a supplier's country takes part in.
SCENARIO_COUNTRIES = {"DIS-001": ["TW"], "DIS-002": ["EG"], "DIS-003": ["SA", "YE", "EG", "IL", "JO"]}


def scenario_links(suppliers: DataFrame, countries: dict[str, list[str]] | None = None) -> DataFrame:
    """(scenario_id, supplier_id): suppliers of the countries of each scenario; a country may be in several."""
    found = F.filter(F.array(*[F.when(F.upper("country").isin(c), F.lit(s)) for s, c in (countries or SCENARIO_COUNTRIES).items()]), lambda x: x.isNotNull())
    return suppliers.select(F.explode(found).alias("scenario_id"), "supplier_id")


def seeded(old: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """old with the seeds merged in by key: a seed's fields win, and seeding twice changes nothing."""
    return updated(old, seeds.dropDuplicates([key]), key).unionByName(seeds.dropDuplicates([key]).join(old, key, "left_anti"), allowMissingColumns=True)


def newest_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """The newest pairs for export, by time, then by id."""
    return pairs.orderBy(F.desc("ingested_at"), "event_id").limit(most)


def digest_markdown(facts: DataFrame) -> DataFrame:
    """One Markdown text of a digest: facts(events, critical, suppliers_hit, leading)."""
    lines = F.concat_ws("\n", F.lit("# Weekly digest"), F.lit(""), F.concat(F.lit("- Events: "), F.col("events").cast("string")), F.concat(F.lit("- Critical: "), F.col("critical").cast("string")), F.concat(F.lit("- Suppliers hit: "), F.col("suppliers_hit").cast("string")), F.concat(F.lit("- Leading type: "), F.coalesce("leading", F.lit("none"))))
    return facts.select(lines.alias("markdown"))


def pairs_summary(pairs: DataFrame, at: Column) -> DataFrame:
    """One JSON text beside an export of pairs: when, how many, and how many of them can be correlated."""
    told = F.struct(at.alias("exported_at"), F.col("pair_count"), F.col("correlation_pairs"))
    both = F.col("severity").isNotNull() & F.col("risk_score").isNotNull()
    return pairs.agg(F.count("*").alias("pair_count"), F.count_if(both).alias("correlation_pairs")).select(F.to_json(told).alias("summary"))


def export_pairs(pairs: DataFrame, path: str, at: Column) -> None:
    """Pairs as CSV in ``path`` and their summary as JSON in ``path.summary``."""
    pairs.write.mode("overwrite").option("header", True).csv(path)
    pairs_summary(pairs, at).withColumnRenamed("summary", "value").write.mode("overwrite").text(f"{path}.summary")


def vectors_upserted(old: DataFrame, documents: DataFrame, embed) -> DataFrame:
    """old(id, text, source, vector, version) with the documents(id, text, source, version) put in by id, each embedded once.

    embed: a function of a table with text that adds vector. Only documents that are new or have another text are embedded.
    """
    known = old.select("id", F.col("text").alias("_text"))
    changed = documents.join(known, "id", "left").where(~F.col("_text").eqNullSafe(F.col("text"))).drop("_text")
    return upserted(old, embed(changed.select("id", "text", "source", "version")).select(old.columns), "id", "version")


def keep_alerts(alerts: DataFrame, path: str, most: int = 2000) -> None:
    """Add alerts(alert_id, ts, ...) to the store and keep the newest ``most``; an alert that comes again replaces itself.

    The kept rows are written beside the store and take its place, so a store is whole at any time; ``most`` rows are one task.
    """
    spark = alerts.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    where, beside = hadoop(path), hadoop(f"{path}.new")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    every = alerts.unionByName(spark.read.parquet(path), allowMissingColumns=True) if fs.exists(where) else alerts
    every.dropDuplicates(["alert_id"]).orderBy(F.desc("ts"), F.desc("alert_id")).limit(most).write.mode("overwrite").parquet(f"{path}.new")
    fs.delete(where, True)
    fs.rename(beside, where)
