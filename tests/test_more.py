"""Later operators on small inputs: name matching without lost pairs, exact simulation steps, monitoring, readers and writers."""

import json
import math
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from harborline.operators import analytics, features, graph, monitoring, names, simulation, text
from harborline.plans import landed
from harborline.sources import feeds, sinks
from harborline.streaming import pipelines


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_by_bits():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abcd é") for _ in range(rng.randint(0, 40))) for _ in range(2))
        assert text.common_length(a, b) == plain_common(a, b)


def test_no_similar_name_is_lost(spark):
    rng = random.Random(2)
    words = ["aurora", "hyundai", "taiwan", "steel", "motor", "works", "gmbh", "é漢", "x"]

    def slip(w):
        i = rng.randrange(len(w))
        return w[:i] + rng.choice("abcxyz") + w[i + rng.randint(0, 1) :]

    names = [" ".join(slip(rng.choice(words)) if rng.random() < 0.5 else rng.choice(words) for _ in range(rng.randint(1, 3))) for _ in range(150)]
    mentions = ["Avrora", "Hundai", "", None, *names[:40]]
    got = {}
    for r in text.fuzzy_match(spark.createDataFrame([(m,) for m in mentions], "mention string"), spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3), top=200).collect():
        got.setdefault(r.mention, set()).add((r.id, r.score))
    for m in {m for m in mentions if m}:
        want = {(i, s) for i, n in enumerate(names) if (s := text.token_set_ratio(m, n)) >= 70}
        assert got.get(m, set()) == want
    one = text.fuzzy_match(spark.createDataFrame([("Avrora",)], "mention string"), spark.createDataFrame([(1, "Aurora"), (2, "Boreas")], "id long, name string")).collect()
    assert [(r.id, r["rank"]) for r in one] == [(1, 1)]
    assert text.fuzzy_match(spark.createDataFrame([], "mention string"), spark.createDataFrame([(1, "a")], "id long, name string")).count() == 0


def test_iterations_that_share_a_search_spread_alike(spark):
    rng = random.Random(3)
    kinds = ["supplier", "port", "chokepoint"]
    nodes = [(f"n{i}", rng.choice(kinds)) for i in range(30)]
    rows = [(a, at, rng.choice(["SUPPLIES", "SHIPS_VIA", "PASSES_THROUGH"]), b, bt) for (a, at), (b, bt) in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(60)) if a != b]
    edges = spark.createDataFrame(rows, "src string, src_type string, rel string, dst string, dst_type string")
    severities = [rng.uniform(0.1, 1.0) for _ in range(40)]
    start = nodes[0]
    runs = spark.createDataFrame([(str(i), start[0], start[1], s) for i, s in enumerate(severities)], "run_id string, node string, node_type string, impact double")
    reached = {}
    for r in graph.propagate(edges, runs).select("run_id", "node").collect():
        reached.setdefault(int(r.run_id), set()).add(r.node)
    steps = simulation.severity_steps(["SUPPLIES", "SHIPS_VIA", "PASSES_THROUGH"])
    step = [sum(x <= s + 1e-12 for x in steps) for s in severities]
    assert len(set(step)) > 3
    for i in range(40):
        for j in range(40):
            assert step[i] != step[j] or reached[i] == reached[j]


def test_every_iteration_has_its_own_severity(spark):
    edges = spark.createDataFrame([("c", "chokepoint", "PASSES_THROUGH", "p", "port"), ("p", "port", "SHIPS_VIA", "s1", "supplier"), ("s1", "supplier", "SUPPLIES", "s2", "supplier"), ("s2", "supplier", "SUPPLIES", "s3", "supplier")], "src string, src_type string, rel string, dst string, dst_type string")
    scenario = spark.createDataFrame([("a", "c", "chokepoint", 0.35, 0.9, 10)], "scenario_id string, node string, node_type string, severity double, probability double, duration_days int")
    skus = spark.createDataFrame([("s1", 3)], "node string, n int")
    drawn = {r.iteration: (r.fires, r.drawn) for r in simulation.iterations(scenario, 1000).collect()}
    for r in simulation.simulate(edges, scenario, skus).collect():
        fires, d = drawn[r.iteration]
        spread = sum(d * f >= 0.1 for f in (0.7 * 0.9, 0.7 * 0.9 * 0.8, 0.7 * 0.9 * 0.8 * 0.8))
        assert r.suppliers == (spread if fires and d >= 0.3 else 0)
        assert r.outcome == ("none" if not fires else "contained" if d < 0.3 else "disrupted")
    often = simulation.frequent(edges, scenario, 1000).collect()
    assert [r.node for r in often][:1] == ["s1"] and all(r.runs > 0.1 * sum(f and d >= 0.3 for f, d in drawn.values()) for r in often)


def test_rank_values_with_and_without_brackets(spark, monkeypatch):
    rng = random.Random(4)
    values = [round(rng.random(), 3) for _ in range(3000)] + [None] * 5
    rows = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    want = sorted(v for v in values if v is not None)
    for most in 10**6, 10:
        monkeypatch.setattr(analytics, "BRACKETED", most)
        for q in 0.0, 0.1, 0.9, 1.0:
            assert analytics.quantile_higher(rows, "v", q).first()[0] == want[math.ceil(q * (len(want) - 1))]
    assert analytics.quantile_higher(rows.limit(0), "v", 0.5).first()[0] is None


def test_weak_signals_and_padding(spark):
    counts = spark.createDataFrame([("a", [1.0, 1.0, 1.0, 1.0, 8.0, 10.0, 12.0]), ("b", [1.0] * 7), ("c", [])], "k string, series array<double>")
    scores = spark.createDataFrame([("a", [0.1 * i for i in range(8)]), ("b", [0.3] * 7), ("c", [0.9])], "k string, series array<double>")
    got = {(r.k, r.signal) for r in monitoring.weak_signals(counts, scores, "k").collect()}
    assert got == {("a", "changepoint"), ("a", "trend")}
    assert {r.k for r in monitoring.monitor_ports(counts, "k").collect()} == {"a"}
    padded = {r.k: r.series for r in monitoring.left_padded(counts, 9).collect()}
    assert padded["a"] == [1, 1, 1, 1, 1, 1, 8, 10, 12] and padded["c"] == [0.3] * 9
    assert {r.k: r.series for r in monitoring.left_padded(counts, 3).collect()}["a"] == [8, 10, 12]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,country_iso,city,latitude,longitude,port_code,annual_volume_usd,risk_score,critical\nAcme & Co,tw,X,1,2,twkhh,5,,true\n,us,,,,,,,\n")
    rows = feeds.seed_suppliers(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.supplier_id, r.country, r.port_code, r.risk_score, r.critical) for r in rows] == [("acme-co", "TW", "TWKHH", 0.5, True)]
    (tmp_path / "wgi.json").write_text(json.dumps({"TW": 0.62, "XX": 0.1}))
    static = spark.createDataFrame([("TW", 0.5), ("US", 0.8)], "country string, stability double")
    got = {r.country: (r.stability, r.stability_source) for r in feeds.stability_table(spark, str(tmp_path / "wgi.json"), static).collect()}
    assert got == {"TW": (0.62, "cached"), "US": (0.8, "static_fallback"), "XX": (0.1, "cached")}
    assert feeds.backtest_report(spark, str(tmp_path / "none.json")).first()[0] == "not_run"
    (tmp_path / "b.json").write_text(json.dumps({"precision": 0.5}, indent=1))
    assert feeds.backtest_report(spark, str(tmp_path / "b.json")).first()["precision"] == 0.5
    v = spark.createDataFrame([("1", " ", None, 1.0, 2.0, None), (None, "x", "t", 1.0, 2.0, 3.0)], "mmsi string, name string, ship_type string, lat double, lon double, speed double")
    assert [(r.vessel_id, r.name, r.ship_type, r.speed) for r in feeds.vessel_properties(v).collect()] == [("vessel-1", "Unknown Vessel", "unknown", 0.0)]
    header, example = feeds.csv_template()
    (tmp_path / "t.csv").write_text(f"{header}\n{example}\n")
    good, bad = feeds.supplier_upload(spark, str(tmp_path / "t.csv"))
    assert good.count() == 1 and bad.count() == 0
    day = "\t".join({"GLOBALEVENTID": "1", "SQLDATE": "20240105", "EventCode": c, "ActionGeo_Lat": "1", "ActionGeo_Long": "2"}.get(n, "") for c in ("190",) for n in feeds.EXPORT_COLUMNS)
    (tmp_path / "20240105.export").write_text(day + "\n" + day.replace("\t190\t", "\t06\t") + "\n")
    assert [r.event_type for r in feeds.export_of_day(spark, str(tmp_path), "2024-01-05").collect()] == ["protest"]


def test_seeding_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "node string, teu int")
    seeds = spark.createDataFrame([("b", 5), ("c", 6)], "node string, teu int")
    once = sinks.seeded(old, seeds, "node")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 5), ("c", 6)] == sorted(map(tuple, sinks.seeded(once, seeds, "node").collect()))


def test_an_upsert_rewrites_only_what_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    merge = pipelines.upsert_into(path, "k", "o", buckets=8)
    batch = lambda rows: spark.createDataFrame(rows, "k long, o int, v string")
    assert pipelines.current(spark, path) is None
    merge(batch([(i, 1, "a") for i in range(100)]), 0)
    merge(batch([(5, 2, "b"), (200, 1, "n")]), 1)
    merge(batch([(5, 2, "b"), (200, 1, "n")]), 1)  # a repeated batch
    merge(batch([(5, 1, "late")]), 2)
    got = {r.k: r.v for r in pipelines.current(spark, path).collect()}
    assert len(got) == 101 and got[5] == "b" and got[200] == "n" and got[7] == "a"
    assert len({p for p in pipelines._newest(spark, path).values() if "version=000000000000" in p}) >= 6


def test_history_raises_the_score(spark):
    f = spark.createDataFrame([(1, 0.0, False, 0, 0.0, 0.0, 10), (2, 0.0, False, 0, 0.0, 0.0, 0), (3, 1.0, True, 5, 1.0, 1.0, 5)], "supplier_id long, proximity double, single_source boolean, critical_events long, congestion double, weather double, disruptions long")
    got = {r.supplier_id: r.score for r in features.rule_score(f).collect()}
    assert got == {1: pytest.approx(0.15), 2: 0.0, 3: pytest.approx(1.0)}
    top = features.contributions(f, 2).where("supplier_id = 3").orderBy("rank").collect()
    assert [(r.feature, r.contribution) for r in top] == [("proximity", 0.25), ("critical_events", 0.2)]


def test_messages_name_their_topic(spark):
    rows = sinks.as_messages(spark.createDataFrame([(1, "protest")], "event_id long, kind string"), "gdelt", F.col("kind"), F.col("event_id")).collect()
    assert (rows[0].topic, rows[0].key, json.loads(rows[0].value)["_metadata"]) == ("events.gdelt.protest", "1", {"source": "gdelt", "type": "protest"})


def test_severest_events_rank_by_the_sum(spark):
    rows = [(1, 5, 0.5), (1, 200_000, 0.4999), (1, 7, 0.1), (2, 1, None), (2, 2, 0.2), (3, 4, None), (4, 8, 1.0), (4, 9, 1.0)]
    events = spark.createDataFrame(rows, "supplier_id long, event_id long, severity double")
    got = {tuple(r) for r in landed.severest_events(SimpleNamespace(events=events)).collect()}
    assert got == {(1, 200_000, 0.5), (2, 2, 0.2), (3, None, None), (4, 9, 1.0)}


def test_names_with_a_letter_missing_meet_by_rare_stretches(spark, monkeypatch):
    asked = []
    real = names.by_letters
    monkeypatch.setattr(names, "by_letters", lambda m, *more: asked.append(m.count()) or real(m, *more))
    rng = random.Random(5)
    told = [(i, f"Supplier#{i:09d}") for i in range(0, 900, 3)] + [(i, " ".join(rng.choice(["harbor", "harbour", "steel", "works", "of", "oslo", "kiel", "kielce", "trading"]) for _ in range(rng.randint(1, 4)))) for i in range(2000, 2060)]
    said = [f"suplier {i:09d}" for i in range(0, 300, 3)] + ["harbr steel works", "wroks of steel oslo", "kiel trading harbor of", "kielc trading", "oslo trdaing works", "supplier 00000012"]
    got = {(r.mention, r.id, round(r.score, 6)) for r in names.fuzzy_match(spark.createDataFrame([(m,) for m in said], "mention string"), spark.createDataFrame(told, "id long, name string")).collect()}
    want = set()
    for m in said:
        score, i = max((names.token_set_ratio(m, n), -i) for i, n in told)
        want |= {(m, -i, round(score, 6))} if score >= 70 else set()
    assert got == want
    assert asked == [asked[0]] and asked[0] < 10
