"""Structured Streaming: decode, upsert, link, count and gate; each batch function is also the batch twin that tests use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from ..materialize import materialized
from ..operators import alerts, reports, text
from ..sources import feeds
from ..sources.sinks import upserted

#: Buckets of an upserted table, and the column that tells them.
BUCKETS, BUCKET = 64, "key_bucket"
#: One event message.
MESSAGE = "event_id long, ts timestamp, kind string, severity double, supplier_id long, text string"


def from_topic(spark: SparkSession, servers: str, topic: str, per_trigger: int = 50_000) -> DataFrame:
    """A message topic from its beginning, in bounded batches."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").option("maxOffsetsPerTrigger", per_trigger).load()


def from_folder(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Landed files with a JSON message a line, as (value)."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)


def decoded(raw: DataFrame, schema: str = MESSAGE) -> DataFrame:
    """Messages as columns; those that are not JSON or lack an id are dropped."""
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*").where("event_id is not null")


def merge_into(path: str, key: str, merge: Callable[[DataFrame | None, DataFrame, int], DataFrame], buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that puts ``merge(old rows or None, batch, number)`` in place of the buckets that a batch touches.

    Keys are dealt to ``buckets`` by hash. The new rows are written under the batch's number; ``current`` reads each bucket from
    the last whole version that has it, so a batch that was lost halfway was never there, and one that comes twice changes
    nothing. Versions of which nothing is current any more are deleted.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark, version = batch.sparkSession, f"{path}/version={number:012d}"
        if version in _versions(spark, path):
            return  # the batch was merged before, whole
        new = batch.withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        old = _read(spark, path, {b: p for b, p in _newest(spark, path).items() if b in touched})
        merge(old, new, number).write.mode("overwrite").partitionBy(BUCKET).parquet(version)
        used = {p.rsplit("/", 1)[0] for p in _newest(spark, path).values()}
        for done in _versions(spark, path):
            if done not in used:
                _path(spark, done)[1].delete(_path(spark, done)[0], True)

    return run


#: What each consumer of a topic reads of a message: its key, and its fields; metadata and other fields are passed over.
CONSUMERS = {
    "graph_loader": ("event_id", "event_id string, ts timestamp, event_type string, lat double, lon double, country string, region string, description string, actors array<string>, goldstein double"),
    "vessel_loader": ("mmsi", "mmsi string, name string, ship_type string, lat double, lon double, speed double, ts timestamp, chokepoint string"),
    "entity_resolution": ("event_id", "event_id string, description string, notes string, headline string, news_title string, title string, raw_data struct<description:string,notes:string,title:string,source_url:string>"),
    "rag_indexer": ("event_id", "event_id string, event_type string, region string, country string, description string, actors array<string>"),
}


def consumed(raw: DataFrame, consumer: str) -> DataFrame:
    """Messages (value) as a consumer's columns; what is not JSON or lacks its key is dropped."""
    key, schema = CONSUMERS[consumer]
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*").where(F.col(key).isNotNull())


def handled(raw: DataFrame, consumer: str) -> DataFrame:
    """What a consumer makes of its messages, a stream or a table: graph events, vessels, entities of the texts, or documents."""
    rows = consumed(raw, consumer)
    if consumer == "graph_loader":
        return feeds.with_graph_fields(rows)
    if consumer == "vessel_loader":
        return feeds.vessel_properties(rows)
    if consumer == "entity_resolution":
        return text.rule_entities(rows.select("event_id", text.message_text({f: F.col(f) for f in text.MESSAGE_FIELDS}).alias("text")))
    return reports.message_documents(rows)


def upsert_into(path: str, key: str, order: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that merges a batch into a Parquet table: the last row of each key by ``order`` stays."""
    return merge_into(path, key, lambda old, new, number: upserted(new.limit(0) if old is None else old, new, key, order), buckets)


def count_into(path: str, key: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function that adds a batch's rows to the totals (key, n, batch) of each key.

    batch is the ledger: the number of the batch that a row's bucket has counted last, in the same file as the totals. A batch
    is added where that number is lower, so totals are right though a version is deleted and its batch comes again.
    """

    def merge(old: DataFrame | None, new: DataFrame, number: int) -> DataFrame:
        more = new.where(F.col(key).isNotNull()).groupBy(key, BUCKET).agg(F.count("*").alias("n"))
        if old is None:
            return more.withColumn("batch", F.lit(number).cast("long"))
        done = old.groupBy(BUCKET).agg(F.max("batch").alias("_done"))  # a row for each bucket
        fresh = more.join(done, BUCKET, "left").where(F.coalesce("_done", F.lit(-1)) < number).select(key, BUCKET, "n")
        every = old.select(key, BUCKET, "n", "batch").unionByName(fresh.withColumn("batch", F.lit(number).cast("long")))
        last = F.max("batch").over(Window.partitionBy(BUCKET))
        return every.groupBy(key, BUCKET).agg(F.sum("n").alias("n"), F.max("batch").alias("batch")).withColumn("batch", last)

    return merge_into(path, key, merge, buckets)


def vessels_into(folder: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """A batch function for vessel reports (mmsi, ts, chokepoint, ...): the vessel's last report, its TRANSITING link to each
    chokepoint, and the chokepoints' counters. Each of the three tables takes a batch once, so a batch that fails between two of
    them is completed when it comes again.
    """
    vessels = upsert_into(f"{folder}/vessels", "mmsi", "ts", buckets)
    links, counts = upsert_into(f"{folder}/transiting", "link", "ts", buckets), count_into(f"{folder}/chokepoints", "chokepoint", buckets)

    def run(batch: DataFrame, number: int) -> None:
        rows = materialized(batch.where("mmsi is not null"), "vessels")
        vessels(rows, number)
        near = rows.where("chokepoint is not null").select(F.concat_ws("|", F.col("mmsi").cast("string"), "chokepoint").alias("link"), "mmsi", F.lit("TRANSITING").alias("kind"), "chokepoint", "ts")
        links(near, number)
        counts(near.select("chokepoint"), number)

    return run


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Whole versions, newest first."""
    where, fs = _path(spark, path)
    found = [f"{path}/{s.getPath().getName()}" for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted((p for p in found if fs.exists(_path(spark, f"{p}/_SUCCESS")[0])), reverse=True)


def _newest(spark: SparkSession, path: str) -> dict[int, str]:
    """Each bucket's folder in the newest whole version that has it."""
    out: dict[int, str] = {}
    for version in _versions(spark, path):
        where, fs = _path(spark, version)
        for s in fs.listStatus(where):
            name = s.getPath().getName()
            if name.startswith(f"{BUCKET}="):
                out.setdefault(int(name.split("=")[1]), f"{version}/{name}")
    return out


def _read(spark: SparkSession, path: str, folders: dict[int, str]) -> DataFrame | None:
    """Rows of these buckets with their bucket."""
    if not folders:
        return None
    parts = spark.read.option("basePath", path).parquet(*folders.values())
    return parts.drop("version").withColumn(BUCKET, F.col(BUCKET).cast("int"))


def current(spark: SparkSession, path: str) -> DataFrame | None:
    """The upserted table as it is now, or None."""
    rows = _read(spark, path, _newest(spark, path))
    return None if rows is None else rows.drop(BUCKET)


def run_upsert(events: DataFrame, path: str, checkpoint: str, key: str = "event_id", order: str = "ts") -> StreamingQuery:
    """All available messages into the table, then stop."""
    return events.writeStream.foreachBatch(upsert_into(path, key, order)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events and largest severity per kind and window; later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity")).select(F.col("window.start").alias("start"), "kind", "n", "max_severity")


def running_counts(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"))


def gated_alerts(events: DataFrame, least: float = 0.75) -> DataFrame:
    """High events as alerts through the stateful gate."""
    a = events.where(F.col("severity") >= least).select(F.col("event_id").alias("alert_id"), "ts", alerts.tier_of(F.col("severity")).alias("tier"), F.col("supplier_id").cast("string").alias("entity_id"), F.col("text").alias("title"))
    return alerts.gate_stream(a)


def batch_metadata(batch: DataFrame, run_id: str) -> DataFrame:
    """One row about a batch."""
    b = materialized(batch, "batch")
    return b.agg(F.lit(run_id).alias("run_id"), F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def vessel_sessions(reports: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(mmsi, start, end, reports, max_speed): runs of a vessel's reports with less than ``gap`` between two.

    reports(mmsi, ts, speed), a stream or a table. end is the last report plus the gap, when a stream tells the session; what is
    later than the watermark is dropped, and the state of told sessions goes.
    """
    s = reports.withWatermark("ts", late).groupBy("mmsi", F.session_window("ts", gap)).agg(F.count("*").alias("reports"), F.max("speed").alias("max_speed"))
    return s.select("mmsi", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "reports", "max_speed")


def sliding_counts(events: DataFrame, width: str = "24 hours", step: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Events and largest severity per kind and sliding window."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", width, step), "kind").agg(F.count("*").alias("n"), F.max("severity").alias("max_severity"))
    return out.select(F.col("window.start").alias("start"), "kind", "n", "max_severity")


def reports_after_events(reports: DataFrame, events: DataFrame, hours: int = 2, late: str = "1 hour") -> DataFrame:
    """(event_id, mmsi, event_ts, report_ts): reports of vessels in an event's country up to ``hours`` after it.

    reports(mmsi, country, ts), events(event_id, country, ts), two streams or two tables. Both sides have a watermark and the
    times bound each other, so each side's rows leave the state once no partner can come.
    """
    r = reports.select("mmsi", F.col("country").alias("r_country"), F.col("ts").alias("report_ts")).withWatermark("report_ts", late)
    e = events.select("event_id", F.col("country").alias("e_country"), F.col("ts").alias("event_ts")).withWatermark("event_ts", late)
    near = F.expr(f"r_country = e_country and report_ts >= event_ts and report_ts <= event_ts + interval {hours} hours")
    if not (reports.isStreaming or events.isStreaming):  # tables meet by stretches of time too; a stream's state holds each row once
        r = r.withColumn("r_stretch", _stretch(r, "report_ts", hours))
        e = e.withColumn("e_stretch", F.explode(F.array(_stretch(e, "event_ts", hours), _stretch(e, "event_ts", hours) + 1)))
        near &= F.col("r_stretch") == F.col("e_stretch")
    return r.join(e, near).select("event_id", "mmsi", "event_ts", "report_ts")


def _stretch(rows: DataFrame, ts: str, hours: int) -> Column:
    """The number of the stretch of ``hours`` that a time lies in."""
    t = F.col(ts)
    if isinstance(rows.schema[ts].dataType, TimestampNTZType):  # by its own fields, whatever the session's time zone
        seconds = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60 + F.floor(F.second(t))
    else:
        seconds = F.unix_seconds(t)
    return F.floor(seconds / (hours * 3600)).cast("long")


def report_counts(reports: DataFrame, events: DataFrame, hours: int = 2) -> DataFrame:
    """(event_id, reports, first, last): what ``reports_after_events`` finds for each event, counted without making the pairs.

    Tables only. An event's ``hours`` begin in one stretch of time and end in the next: of the first its reports are those from the
    event on, of the second those up to the end, so running counts from either side give both.
    """
    r = reports.where("country is not null and ts is not null").groupBy("country", "ts").agg(F.count("*").alias("n"))
    r = r.select("country", _stretch(r, "ts", hours).alias("stretch"), F.col("ts").alias("at"), "n", F.col("ts").alias("report"), F.lit(0).alias("side"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"))
    e = events.where("country is not null and ts is not null").select("country", _stretch(events, "ts", hours).alias("stretch"), "ts", "event_id")
    ends = F.array(F.struct(F.col("stretch"), F.col("ts").alias("at"), F.lit(1).alias("side")), F.struct((F.col("stretch") + 1).alias("stretch"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(hours))).alias("at"), F.lit(2).alias("side")))
    e = e.select("country", "event_id", F.explode(ends).alias("p")).select("country", "p.stretch", "p.at", F.lit(0).cast("long").alias("n"), F.lit(None).cast(r.schema["at"].dataType).alias("report"), "p.side", "event_id")
    here = Window.partitionBy("country", "stretch")
    on, up = (here.orderBy(o).rangeBetween(Window.unboundedPreceding, Window.currentRow) for o in (F.desc("at"), F.asc("at")))
    told = lambda f, c: F.when(F.col("side") == 1, f(c).over(on)).otherwise(f(c).over(up))
    seen = r.unionByName(e).select("event_id", "side", told(F.sum, "n").alias("n"), told(F.min, "report").alias("first"), told(F.max, "report").alias("last")).where("side > 0 and n > 0")
    return seen.groupBy("event_id").agg(F.sum("n").alias("reports"), F.min("first").alias("first"), F.max("last").alias("last"))
