"""Readers, writers and streams on files of a temporary folder."""

import datetime as dt
import json

from pyspark.sql import functions as F

from harborline.sources import feeds, sinks
from harborline.streaming import pipelines


def test_export_lines(spark, tmp_path):
    def line(**v):
        return "\t".join(str(v.get(c, "")) for c in feeds.EXPORT_COLUMNS)

    full = dict(GLOBALEVENTID=1, SQLDATE="20240105", EventCode="190", GoldsteinScale="-8.5", Actor1Name="X", ActionGeo_FullName="Aden", ActionGeo_CountryCode="YE", ActionGeo_Lat="12.8", ActionGeo_Long="45.0")
    (tmp_path / "a.tsv").write_text("\n".join([line(**full), line(**full | {"GLOBALEVENTID": 2, "ActionGeo_Lat": "0", "ActionGeo_Long": "0"}), line(**full | {"GLOBALEVENTID": 3, "ActionGeo_Lat": ""}), "too\tshort", line(**full | {"GLOBALEVENTID": 4, "Actor1Name": "", "GoldsteinScale": ""}) + "\textra"]))
    rows = feeds.with_graph_fields(feeds.export_events(feeds.export_rows(spark, str(tmp_path / "a.tsv")))).orderBy("event_id").collect()
    assert [(r.event_id, r.event_type, r.severity, r.title) for r in rows] == [("gdelt-1", "force_conflict", 0.85, "Force Conflict — X (Aden)"), ("gdelt-4", "force_conflict", 0.5, "Force Conflict in Aden")]
    assert rows[0].ts == dt.datetime(2024, 1, 5)


def test_conflict_records(spark, tmp_path):
    base = dict(event_id_cnty="Y1", event_date="2024-01-05", event_type="Battles", actor1="B", actor2="A", assoc_actor_1="", country="Yemen", latitude="1.5", longitude="2.5", fatalities="3", notes="n" * 900)
    (tmp_path / "a.json").write_text("\n".join(json.dumps(x) for x in (base, base | {"event_id_cnty": "Y2", "latitude": None}, base | {"event_id_cnty": "Y3", "event_type": "Protests", "event_date": "2025-01-01", "fatalities": "?"})))
    rows = feeds.conflict_events(feeds.conflict_records(spark, str(tmp_path)), "2024-01-01", "2024-12-31").collect()
    assert [(r.event_id, r.event_type, r.actors, r.fatalities, len(r.description)) for r in rows] == [("acled-Y1", "conflict", ["A", "B"], 3, 500)]


def test_vessels(spark, tmp_path):
    v = dict(mmsi="1", lat=1.0, lon=2.0, speed=3.0)
    (tmp_path / "a.json").write_text("\n".join([json.dumps(v), json.dumps({"vessels": [v | {"mmsi": "2"}, v | {"mmsi": None}, v | {"mmsi": "3", "lat": 50.0}]})]))
    assert sorted(r.mmsi for r in feeds.vessel_reports(spark, str(tmp_path), (0, 0, 10, 10)).collect()) == ["1", "2"]
    lines = spark.createDataFrame([("!AIVDM,1,1,,A,payload,0*1C",), ("bad,line",)], "value string")
    assert [r.payload for r in feeds.sentences(lines).collect()] == ["payload"]


def test_supplier_upload(spark, tmp_path):
    (tmp_path / "s.csv").write_text(' Company ,ISO,Revenue,critical,lat,tier\nAcme & Co,tw,"$1,200.50",YES,91,2.9\n,us,1,no,1,1\nBeta,NA,x,1,5,\n')
    good, bad = feeds.supplier_upload(spark, str(tmp_path / "s.csv"))
    r = good.first()
    assert (r.name, r.country, r.annual_revenue_usd, r.critical, r.latitude, r.tier, r.supplier_id, r.city) == ("Acme & Co", "TW", 1200.5, True, None, 2, "acme-co", None)
    assert sorted(x.reason for x in bad.collect()) == ["country is required", "name is required"]
    assert feeds.upload_statistics(good, bad).first().success_rate == 0.3333


def test_tiers_labels_snapshots_vocabulary(spark, tmp_path):
    (tmp_path / "t.csv").write_text("parent_supplier_id,child_supplier_id,tier,notes\na,b,,x\n,c,1,y\n")
    tiers = feeds.erp_tiers(spark, str(tmp_path / "t.csv"))
    assert [tuple(r) for r in tiers.collect()] == [("a", "b", 2, "x")]
    assert [r.supplier_id for r in feeds.stub_suppliers(tiers, spark.createDataFrame([("a",)], "supplier_id string")).collect()] == ["b"]
    (tmp_path / "l.csv").write_text("supplier_id,supplier_name,event_date,disrupted_30d,source,delay_days,volume_impact_pct\na,A,2024-01-01,0,s,,\na,A,2024-02-01,1,s,6,12.0\nb,B,bad,0,s,,\n")
    assert {r[0]: r[1] for r in feeds.label_per_supplier(feeds.disruption_labels(spark, str(tmp_path / "l.csv"))).collect()} == {"a": 1, "b": 0}
    (tmp_path / "snap").mkdir()
    (tmp_path / "snap/supplier_snapshot_20260201.csv").write_text("supplier_id,name,risk_score,events,max_severity\na,A,,3,0.5\n")
    (tmp_path / "snap/supplier_snapshot_bad.csv").write_text("supplier_id,name,risk_score,events,max_severity\nz,Z,1,3,0.5\n")
    assert [(str(r.snapshot_date), r.risk_score) for r in feeds.snapshots(spark, str(tmp_path / "snap")).collect()] == [("2026-02-01", 0.5)]
    (tmp_path / "v.txt").write_text("Suez Canal\n# no\n\n suez canal # twice\n")
    assert [r.term for r in feeds.vocabulary(spark, str(tmp_path / "v.txt")).collect()] == ["suez canal"]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, t int, v string")
    new = spark.createDataFrame([(1, 1, "c"), (3, 0, None)], "id int, t int, v string")
    assert sorted(map(tuple, sinks.upserted(old, new, "id", "t").collect())) == [(1, 1, "c"), (2, 1, "b"), (3, 0, None)]
    assert sorted(map(tuple, sinks.updated(old, spark.createDataFrame([(1, None, "z")], "id int, t int, v string"), "id").collect())) == [(1, 1, "z"), (2, 1, "b")]
    assert sinks.without(old, spark.createDataFrame([(2,)], "id int"), "id").count() == 1
    assert {r.id: r.t for r in sinks.counted(old, spark.createDataFrame([(1,), (1,)], "id int"), "id", "t").collect()} == {1: 3, 2: 1}
    m = sinks.as_messages(old, "feed", F.lit("kind"), F.col("id")).first()
    assert m.topic == "events.feed.kind" and json.loads(m.value)["_metadata"]["source"] == "feed"
    sinks.append_history(old.withColumn("scored_at", F.lit("2024-01-02").cast("timestamp")), str(tmp_path / "h"))
    sinks.append_history(old.withColumn("scored_at", F.lit("2024-01-03").cast("timestamp")), str(tmp_path / "h"))
    assert spark.read.parquet(str(tmp_path / "h")).where("day = '2024-01-02'").count() == 2


def message(i, minute, severity=0.9, kind="attack", text="t", supplier=1):
    ts = (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)).isoformat() + "Z"
    return json.dumps(dict(event_id=i, ts=ts, kind=kind, severity=severity, supplier_id=supplier, text=text))


def test_stream_upsert_is_idempotent(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([message(1, 0), message(2, 1), "broken", message(1, 5, 0.5)]))
    run = lambda: pipelines.run_upsert(pipelines.decoded(pipelines.from_folder(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/2.json").write_text(message(3, 2))
    run()
    rows = {r.event_id: r.severity for r in pipelines.current(spark, str(tmp_path / "out")).collect()}
    assert rows == {1: 0.5, 2: 0.9, 3: 0.9}
    again = spark.createDataFrame([(3, dt.datetime(2024, 1, 1, 0, 2), "attack", 0.9, 1, "t")], pipelines.MESSAGE)
    pipelines.upsert_into(str(tmp_path / "out"), "event_id", "ts")(again, 1)
    assert pipelines.current(spark, str(tmp_path / "out")).count() == 3


def test_stream_counts_and_gate(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("\n".join([message(1, 0), message(2, 1), message(3, 70), message(4, 71, 0.1)]))
    events = pipelines.decoded(pipelines.from_folder(spark, str(tmp_path / "in")))
    q = pipelines.gated_alerts(events).writeStream.format("memory").queryName("gated").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert {r.alert_id: r.outcome for r in spark.table("gated").collect()} == {1: "sent", 2: "duplicate", 3: "sent"}
    q = pipelines.windowed_counts(events).writeStream.format("memory").queryName("counts").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("counts").collect()) == [2, 2]
