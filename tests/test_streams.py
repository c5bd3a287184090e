"""Sessions, interval joins, counters and the gate over streams: late rows, state that goes, and batches that come again."""

import collections
import datetime as dt
import json
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from harborline.operators import alerts
from harborline.streaming import pipelines

START = dt.datetime(2024, 1, 1)
KIND = "mmsi long, ts timestamp, country string, speed double, event_id long"


def at(minute):
    return (START + dt.timedelta(minutes=minute)).isoformat() + "Z"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{name}.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (1.7e9 + name, 1.7e9 + name))  # files are read in order of their times


def stream(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(folder))


def run(df, name, tmp_path, mode="append"):
    """All files one after another; returns the query's progress records."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else p for p in q.recentProgress]


def test_sessions_close_late_rows_drop_and_state_goes(spark, tmp_path):
    row = lambda m, minute, speed=1.0: {"mmsi": m, "ts": at(minute), "speed": speed}
    land(tmp_path / "in", 1, [row(1, 0), row(1, 20, 5.0), row(2, 5)])
    land(tmp_path / "in", 2, [row(1, 60 * 9)])  # the watermark goes to hour 8
    land(tmp_path / "in", 3, [row(3, 60 * 9)])
    land(tmp_path / "in", 4, [row(2, 6), row(4, 60 * 40)])  # vessel 2's is late
    land(tmp_path / "in", 5, [row(4, 60 * 40 + 1)])
    progress = run(pipelines.vessel_sessions(stream(spark, tmp_path / "in")), "sessions", tmp_path)
    got = {(r.mmsi, r.start): (r.end, r.reports, r.max_speed) for r in spark.table("sessions").collect()}
    hour = lambda h, minute=0: START + dt.timedelta(hours=h, minutes=minute)
    assert got == {(1, hour(0)): (hour(6, 20), 2, 5.0), (2, hour(0, 5)): (hour(6, 5), 1, 1.0), (1, hour(9)): (hour(15), 1, 1.0), (3, hour(9)): (hour(15), 1, 1.0)}
    state = [p["stateOperators"][0] for p in progress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1
    assert max(s["numRowsTotal"] for s in state) >= 2 and state[-1]["numRowsTotal"] == 1  # only vessel 4's is open


def test_interval_join_meets_both_ways_and_forgets(spark, tmp_path):
    row = lambda i, minute, country="YE": {"mmsi": i, "event_id": i, "ts": at(minute), "country": country}
    far = 60 * 100
    land(tmp_path / "events", 1, [row(1, 0), row(2, 10, "EG"), row(3, 30)])
    land(tmp_path / "events", 2, [row(4, far)])
    land(tmp_path / "events", 3, [row(5, far + 1)])
    land(tmp_path / "reports", 1, [row(11, 120), row(12, 121), row(13, 5, "EG"), row(14, 15, "EG")])
    land(tmp_path / "reports", 2, [row(15, far)])
    land(tmp_path / "reports", 3, [row(16, far + 1)])
    joined = pipelines.reports_after_events(stream(spark, tmp_path / "reports"), stream(spark, tmp_path / "events"))
    progress = run(joined, "near", tmp_path)
    got = {(r.event_id, r.mmsi) for r in spark.table("near").collect()}
    assert got == {(1, 11), (3, 11), (3, 12), (2, 14), (4, 15), (4, 16), (5, 16)}
    state = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(state) >= 7 and state[-1] <= 4  # those of the last hours


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_counts_of_reports_are_those_of_the_pairs(spark, kind):
    rng = random.Random(3)
    row = lambda i: (rng.randrange(40), i, rng.choice(["YE", "EG", None]), START + dt.timedelta(minutes=rng.choice([0, 60, 120, 121, rng.randrange(-900, 900)])) if rng.random() < 0.95 else None)
    reports, events = (spark.createDataFrame([row(i) for i in range(300)], f"event_id long, mmsi long, country string, ts {kind}") for _ in "re")
    plain = collections.defaultdict(list)
    for e in events.collect():
        plain[e.event_id] += [r.ts for r in reports.collect() if r.country and r.country == e.country and r.ts and e.ts and e.ts <= r.ts <= e.ts + dt.timedelta(hours=2)] if e.event_id < 12 else []
    pairs = collections.Counter(r.event_id for r in pipelines.reports_after_events(reports, events).collect())
    got = {r.event_id: (r.reports, r.first, r.last) for r in pipelines.report_counts(reports, events).collect()}
    assert {k: v[0] for k, v in got.items()} == pairs
    assert {k: v for k, v in got.items() if k < 12} == {k: (len(v), min(v), max(v)) for k, v in plain.items() if v}


def test_reports_of_a_busy_hour_are_counted_without_pairs(spark):
    n = 100_000
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("mmsi"), F.lit("YE").alias("country"), F.timestamp_micros(F.col("id") * 1000).alias("ts"))
    got = pipelines.report_counts(rows, rows)
    assert got.count() == n and got.where(F.col("reports") != n - F.col("event_id")).count() == 0


REPORTS = "mmsi long, ts timestamp, chokepoint string, speed double"


def reports(spark, rows):
    return spark.createDataFrame([(m, START + dt.timedelta(minutes=t), c, 1.0) for m, t, c in rows], REPORTS)


def tables(spark, folder):
    now = lambda name: pipelines.current(spark, f"{folder}/{name}")
    return (
        {r.mmsi: r.ts.minute for r in now("vessels").collect()},
        {(r.mmsi, r.chokepoint) for r in now("transiting").collect()},
        {r.chokepoint: r.n for r in now("chokepoints").collect()},
    )


def test_a_batch_that_comes_again_counts_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "t")
    first, second = reports(spark, [(1, 0, "suez"), (2, 1, "suez"), (3, 2, None), (None, 3, "suez")]), reports(spark, [(1, 5, "suez"), (1, 4, "hormuz")])
    into = pipelines.vessels_into(folder, 4)
    into(first, 0)
    into(first, 0)
    assert tables(spark, folder) == ({1: 0, 2: 1, 3: 2}, {(1, "suez"), (2, "suez")}, {"suez": 2})
    into(second, 1)
    want = ({1: 5, 2: 1, 3: 2}, {(1, "suez"), (2, "suez"), (1, "hormuz")}, {"suez": 3, "hormuz": 1})
    assert tables(spark, folder) == want
    into(second, 1)
    into(first, 0)  # an old batch, whose versions may be gone
    assert tables(spark, folder) == want


def test_a_crash_before_the_commit_changes_nothing(spark, tmp_path):
    folder = tmp_path / "t"
    into = pipelines.vessels_into(str(folder), 4)
    into(reports(spark, [(1, 0, "suez")]), 0)
    more = reports(spark, [(2, 1, "suez"), (3, 1, "suez")])
    for name in ("vessels", "transiting", "chokepoints"):  # files of a version that was never committed
        shutil.copytree(folder / name / "version=000000000000", folder / name / "version=000000000001")
        (folder / name / "version=000000000001/_SUCCESS").unlink()
    with pytest.raises(Exception):  # the batch fails after its first table
        pipelines.vessels_into(str(folder), 4)(more.withColumn("chokepoint", F.raise_error(F.lit("lost"))), 1)
    with pytest.raises(Exception):  # and while its totals are made
        pipelines.count_into(str(folder / "chokepoints"), "chokepoint", 4)(more.withColumn("chokepoint", F.raise_error(F.lit("lost"))), 1)
    assert tables(spark, str(folder))[2] == {"suez": 1}
    into(more, 1)
    assert tables(spark, str(folder)) == ({1: 0, 2: 1, 3: 1}, {(1, "suez"), (2, "suez"), (3, "suez")}, {"suez": 3})


def test_the_stream_gate_equals_the_fold_and_forgets(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, START + dt.timedelta(minutes=m), rng.choice(["critical", "warning"]), str(rng.randrange(3)), "t" * rng.randrange(3)) for i, m in enumerate(sorted(rng.uniform(0, 400) for _ in range(120)))]
    kind = "alert_id long, ts timestamp, tier string, entity_id string, title string"
    want = {r.alert_id: r.outcome for r in alerts.gate(spark.createDataFrame(rows, kind)).collect()}
    last = [(900 + k, START + dt.timedelta(minutes=5000 + k), "critical", "9", "x") for k in (0, 1)]  # long after: what was kept can go
    for n, part in enumerate([rows[:30], rows[30:70], rows[70:], last[:1], last[1:]]):
        land(tmp_path / "in", n, [dict(alert_id=i, ts=t.isoformat() + "Z", tier=a, entity_id=e, title=x) for i, t, a, e, x in part])
    df = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = alerts.gate_stream(df).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.alert_id: r.outcome for r in spark.table("gate").collect()}
    assert {i: o for i, o in got.items() if i < 900} == want and set(want.values()) == {"sent", "duplicate", "rate_limited"}
    assert got[900] == "sent" and got[901] == "duplicate"
    kept = spark.read.format("statestore").option("path", str(tmp_path / "cp")).option("stateVarName", "sent").load()
    assert kept.count() == 1  # the last alert's key; those of the first day are gone
