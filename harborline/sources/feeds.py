"""Readers of the raw feeds, and their mapping to one event shape. Bad rows are split off or dropped as each docstring says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import number, root_type, severity, slug, title, truthy

#: The column order of the event export without a header.
EXPORT_COLUMNS = [
    "GLOBALEVENTID", "SQLDATE", "MonthYear", "Year", "FractionDate", "Actor1Code", "Actor1Name", "Actor1CountryCode", "Actor1KnownGroupCode", "Actor1EthnicCode",
    "Actor1Religion1Code", "Actor1Religion2Code", "Actor1Type1Code", "Actor1Type2Code", "Actor1Type3Code", "Actor2Code", "Actor2Name", "Actor2CountryCode", "Actor2KnownGroupCode", "Actor2EthnicCode",
    "Actor2Religion1Code", "Actor2Religion2Code", "Actor2Type1Code", "Actor2Type2Code", "Actor2Type3Code", "IsRootEvent", "EventCode", "EventBaseCode", "EventRootCode", "QuadClass",
    "GoldsteinScale", "NumMentions", "NumSources", "NumArticles", "AvgTone", "Actor1Geo_Type", "Actor1Geo_FullName", "Actor1Geo_CountryCode", "Actor1Geo_ADM1Code", "Actor1Geo_Lat",
    "Actor1Geo_Long", "Actor1Geo_FeatureID", "Actor2Geo_Type", "Actor2Geo_FullName", "Actor2Geo_CountryCode", "Actor2Geo_ADM1Code", "Actor2Geo_Lat", "Actor2Geo_Long", "Actor2Geo_FeatureID", "ActionGeo_Type",
    "ActionGeo_FullName", "ActionGeo_CountryCode", "ActionGeo_ADM1Code", "ActionGeo_Lat", "ActionGeo_Long", "ActionGeo_FeatureID", "DATEADDED", "SOURCEURL",
]
EVENT = "event_id string, ts timestamp, source string, event_type string, lat double, lon double, country string, region string, description string, actors array<string>, fatalities int, goldstein double"


def export_rows(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated export lines as columns; lines with too few fields are dropped, further fields ignored."""
    parts = spark.read.text(path).select(F.split("value", "\t", -1).alias("p")).where(F.size("p") >= len(EXPORT_COLUMNS))
    return parts.select(*[F.col("p")[i].alias(c) for i, c in enumerate(EXPORT_COLUMNS)])


def export_events(rows: DataFrame) -> DataFrame:
    """Export rows as events; without coordinates, or at exactly (0, 0), a row is dropped."""
    lat, lon = F.col("ActionGeo_Lat").try_cast("double"), F.col("ActionGeo_Long").try_cast("double")
    kept = rows.where(lat.isNotNull() & lon.isNotNull() & ~((lat == 0) & (lon == 0)))
    actors = F.filter(F.array("Actor1Name", "Actor2Name"), lambda a: a.isNotNull() & (a != ""))
    return kept.select(
        F.concat(F.lit("gdelt-"), "GLOBALEVENTID").alias("event_id"),
        F.try_to_timestamp(F.substring("SQLDATE", 1, 8), F.lit("yyyyMMdd")).alias("ts"),
        F.lit("gdelt").alias("source"),
        root_type(F.col("EventCode")).alias("event_type"),
        lat.alias("lat"),
        lon.alias("lon"),
        F.col("ActionGeo_CountryCode").alias("country"),
        F.col("ActionGeo_FullName").alias("region"),
        F.col("SOURCEURL").alias("description"),
        actors.alias("actors"),
        F.lit(0).alias("fatalities"),
        F.col("GoldsteinScale").try_cast("double").alias("goldstein"),
    )


def conflict_records(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON records of the conflict API, all text."""
    names = "event_id_cnty event_id event_date event_type sub_event_type actor1 actor2 assoc_actor_1 assoc_actor_2 country region location latitude longitude fatalities notes".split()
    return spark.read.schema(", ".join(f"{n} string" for n in names)).json(path)


#: The conflict API's event types and ours.
RECORD_TYPES = {"Battles": "conflict", "Explosions/Remote violence": "conflict", "Violence against civilians": "assault", "Protests": "protest", "Riots": "protest_violence", "Strategic developments": "other"}


def conflict_events(records: DataFrame, start=None, end=None) -> DataFrame:
    """API records as events, between two dates where given; records without coordinates are dropped, actors are sorted and distinct."""
    lat, lon = F.col("latitude").try_cast("double"), F.col("longitude").try_cast("double")
    kept = records.where(lat.isNotNull() & lon.isNotNull())
    if start is not None and end is not None:
        kept = kept.where(F.col("event_date").between(str(start), str(end)))
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in RECORD_TYPES.items() for x in p]), F.col("event_type")), F.lit("other"))
    actors = F.array_sort(F.array_distinct(F.filter(F.array("actor1", "actor2", "assoc_actor_1", "assoc_actor_2"), lambda a: a.isNotNull() & (a != ""))))
    return kept.select(
        F.concat(F.lit("acled-"), F.coalesce("event_id_cnty", "event_id")).alias("event_id"),
        F.try_to_timestamp("event_date", F.lit("yyyy-MM-dd")).alias("ts"),
        F.lit("acled").alias("source"),
        kind.alias("event_type"),
        lat.alias("lat"),
        lon.alias("lon"),
        "country",
        F.coalesce("region", "location").alias("region"),
        F.substring("notes", 1, 500).alias("description"),
        actors.alias("actors"),
        F.coalesce(F.col("fatalities").try_cast("int"), F.lit(0)).alias("fatalities"),
        F.lit(None).cast("double").alias("goldstein"),
    )


def vessel_reports(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Landed vessel JSON, a list or an object with ``vessels``; within (south, west, north, east) where given."""
    kind = "mmsi string, name string, ship_type string, lat double, lon double, speed double, heading double, destination string, eta string, ts timestamp"
    both = spark.read.schema(f"{kind}, vessels array<struct<{kind.replace(' ', ':').replace(',:', ',')}>>").json(path)
    nested = both.where("vessels is not null").select(F.explode("vessels").alias("v")).select("v.*")
    rows = both.where("vessels is null").drop("vessels").unionByName(nested).where("mmsi is not null and lat is not null and lon is not null")
    return rows if box is None else rows.where(F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3]))


def sentences(lines: DataFrame) -> DataFrame:
    """Raw receiver lines (value) with seven fields or more as (talker, total, number, channel, payload)."""
    p = F.split("value", ",")
    return lines.where(F.size(p) >= 7).select(p[0].alias("talker"), p[1].try_cast("int").alias("total"), p[2].try_cast("int").alias("number"), p[4].alias("channel"), p[5].alias("payload"))


def with_graph_fields(events: DataFrame) -> DataFrame:
    """Events as the graph stores them: severity, title, a description of 500 characters, region or country or Unknown."""
    region = F.coalesce(F.when(F.col("region") != "", F.col("region")), F.when(F.col("country") != "", F.col("country")), F.lit("Unknown"))
    kept = events.where("event_id is not null and lat is not null and lon is not null")
    return kept.withColumn("severity", severity(F.col("goldstein"), F.col("event_type"))).withColumn("title", title(F.col("event_type"), F.col("actors"), region)).withColumn("description", F.substring("description", 1, 500)).withColumn("region", region)


#: The header names each supplier field may have; the first one present counts.
ALIASES = {
    "name": ["name", "supplier_name", "company", "company_name"],
    "country": ["country", "country_iso", "country_code", "iso"],
    "city": ["city", "location"],
    "tier": ["tier", "supplier_tier"],
    "industry": ["industry", "sector"],
    "annual_revenue_usd": ["annual_revenue_usd", "revenue", "annual_revenue"],
    "employee_count": ["employee_count", "employees"],
    "latitude": ["latitude", "lat"],
    "longitude": ["longitude", "lon", "lng"],
    "single_source_flag": ["single_source_flag", "single_source"],
    "critical_flag": ["critical_flag", "critical"],
}
MISSING = ("", "NULL", "null", "NA", "na")


def supplier_upload(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of an uploaded CSV. Name and country are needed; other fields that do not parse are null."""
    raw = spark.read.option("header", True).csv(path)
    present = {c.strip().lower(): c for c in raw.columns}

    def field(name: str) -> Column:
        found = next((present[a] for a in ALIASES[name] if a in present), None)
        c = F.trim(F.col(f"`{found}`")) if found else F.lit(None).cast("string")
        return F.when(~c.isin(*MISSING), c)

    bounded = lambda c, lo, hi: F.when(c.between(lo, hi), c)
    rows = raw.select(
        field("name").alias("name"),
        F.upper(field("country")).alias("country"),
        field("city").alias("city"),
        F.coalesce(bounded(number(field("tier")).cast("int"), 1, 5), F.lit(1)).alias("tier"),
        field("industry").alias("industry"),
        number(field("annual_revenue_usd")).alias("annual_revenue_usd"),
        number(field("employee_count")).cast("int").alias("employee_count"),
        bounded(number(field("latitude")), -90, 90).alias("latitude"),
        bounded(number(field("longitude")), -180, 180).alias("longitude"),
        F.coalesce(truthy(field("single_source_flag")), F.lit(False)).alias("single_source"),
        F.coalesce(truthy(field("critical_flag")), F.lit(False)).alias("critical"),
    ).withColumn("supplier_id", slug(F.col("name")))
    good = F.col("name").isNotNull() & F.col("country").isNotNull()
    return rows.where(good), rows.where(~good).withColumn("reason", F.when(F.col("name").isNull(), "name is required").otherwise("country is required"))


def upload_statistics(accepted: DataFrame, rejected: DataFrame) -> DataFrame:
    a, r = accepted.agg(F.count("*").alias("accepted")), rejected.agg(F.count("*").alias("rejected"))
    return a.crossJoin(r).withColumn("success_rate", F.when(F.col("accepted") + F.col("rejected") > 0, F.round(F.col("accepted") / (F.col("accepted") + F.col("rejected")), 4)).otherwise(0.0))


def erp_tiers(spark: SparkSession, path: str) -> DataFrame:
    """Parent-child rows; those lacking either are dropped, the tier is 2 by default."""
    raw = spark.read.option("header", True).csv(path)
    return raw.where("coalesce(parent_supplier_id, '') <> '' and coalesce(child_supplier_id, '') <> ''").select("parent_supplier_id", "child_supplier_id", F.coalesce(F.col("tier").try_cast("int"), F.lit(2)).alias("tier"), "notes")


def stub_suppliers(tiers: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Suppliers that tiers name but the table lacks, with country XX."""
    named = tiers.select(F.col("parent_supplier_id").alias("supplier_id")).union(tiers.select("child_supplier_id")).distinct()
    return named.join(suppliers, "supplier_id", "left_anti").select("supplier_id", F.col("supplier_id").alias("name"), F.lit("XX").alias("country"))


def disruption_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select("supplier_id", "supplier_name", F.col("event_date").try_cast("date").alias("event_date"), F.col("disrupted_30d").try_cast("int").alias("disrupted"), "source", F.col("delay_days").try_cast("int").alias("delay_days"), F.col("volume_impact_pct").try_cast("double").alias("volume_impact_pct"))


def label_per_supplier(labels: DataFrame) -> DataFrame:
    return labels.groupBy("supplier_id").agg(F.max("disrupted").alias("disrupted"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """All supplier_snapshot_YYYYMMDD.csv files with the date from the name; a missing or bad score is .5, other files are skipped."""
    raw = spark.read.option("header", True).schema("supplier_id string, name string, risk_score string, events string, max_severity string").csv(f"{folder}/supplier_snapshot_*.csv")
    day = F.try_to_timestamp(F.regexp_extract(F.input_file_name(), r"supplier_snapshot_(\d{8})\.csv", 1), F.lit("yyyyMMdd")).cast("date")
    return raw.withColumn("snapshot_date", day).where("snapshot_date is not null").select("snapshot_date", "supplier_id", "name", F.coalesce(F.col("risk_score").try_cast("double"), F.lit(0.5)).alias("risk_score"), F.coalesce(F.col("events").try_cast("int"), F.lit(0)).alias("events"), F.coalesce(F.col("max_severity").try_cast("double"), F.lit(0.0)).alias("max_severity"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """One term a line, # comments and blanks aside."""
    line = F.trim(F.regexp_replace("value", "#.*", ""))
    return spark.read.text(path).select(F.lower(line).alias("term")).where("term <> ''").distinct()


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Whole Markdown files as (path, text)."""
    return spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


#: Root types of the daily load, and of the backfill by date.
LOADED_TYPES = ["conflict", "protest", "fight", "assault", "mass_violence"]
BACKFILL_TYPES = ["conflict", "protest", "fight", "assault"]


def export_of_day(spark: SparkSession, folder: str, day: str) -> DataFrame:
    """Events of one day's export (``<folder>/<yyyymmdd>*``), those of the backfill's types."""
    return export_events(export_rows(spark, f"{folder}/{day.replace('-', '')}*")).where(F.col("event_type").isin(BACKFILL_TYPES))


def seed_suppliers(spark: SparkSession, path: str) -> DataFrame:
    """The seed list of suppliers with port, volume and risk; ids are slugs of the names, rows without a name are dropped."""
    raw = spark.read.option("header", True).csv(path)
    return raw.where("coalesce(trim(name), '') <> ''").select(slug(F.col("name")).alias("supplier_id"), F.trim("name").alias("name"), F.upper("country_iso").alias("country"), "city", F.col("latitude").try_cast("double").alias("lat"), F.col("longitude").try_cast("double").alias("lon"), F.upper("port_code").alias("port_code"), F.coalesce(F.col("annual_volume_usd").try_cast("double"), F.lit(0.0)).alias("annual_volume_usd"), F.coalesce(F.col("risk_score").try_cast("double"), F.lit(0.5)).alias("risk_score"), F.coalesce(truthy(F.col("critical")), F.lit(False)).alias("critical"))


def stability_table(spark: SparkSession, path: str, static: DataFrame) -> DataFrame:
    """static(country, stability) with the cached indices over it. The cache is JSON, one object of country and index."""
    cached = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", "map<string,double>")).alias("country", "cached"))
    both = static.join(cached, "country", "full")
    return both.select("country", F.coalesce("cached", "stability").alias("stability"), F.when(F.col("cached").isNotNull(), "cached").otherwise("static_fallback").alias("stability_source"))


def backtest_report(spark: SparkSession, path: str) -> DataFrame:
    """A saved backtest's figures; one row with status not_run where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([("not_run",)], "status string")
    return spark.read.option("multiLine", True).json(path)


def vessel_properties(vessels: DataFrame) -> DataFrame:
    """Vessels as the graph stores them: those without mmsi or place are dropped, a missing name is Unknown Vessel."""
    name = F.when(F.coalesce(F.trim("name"), F.lit("")) != "", F.trim("name")).otherwise("Unknown Vessel")
    return vessels.where("mmsi is not null and lat is not null and lon is not null").select(F.concat(F.lit("vessel-"), "mmsi").alias("vessel_id"), "mmsi", name.alias("name"), F.coalesce("ship_type", F.lit("unknown")).alias("ship_type"), "lat", "lon", F.coalesce("speed", F.lit(0.0)).alias("speed"))


def first_errors(rows: DataFrame, rules: list[tuple[str, Column]], key: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, the first ``most`` others by key with the first rule they break). A rule that is null is broken."""
    broken = F.lit(None).cast("string")
    for name, ok in reversed(rules):
        broken = F.when(~F.coalesce(ok, F.lit(False)), name).otherwise(broken)
    judged = rows.withColumn("reason", broken)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").orderBy(key).limit(most)


def csv_template() -> list[str]:
    """Header and example line of the supplier upload."""
    return [",".join(["name", "country_iso", "region", "city", "tier", "industry", "annual_revenue_usd", "employee_count", "latitude", "longitude", "single_source_flag", "critical_flag"]), "Example Components,TW,,Hsinchu,1,semiconductors,1000000,250,24.8,120.97,true,false"]
