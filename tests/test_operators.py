"""Operators on small inputs against plain Python, with nulls, empty tables and ties."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harborline.functions import expressions as ex
from harborline.operators import alerts, analytics, features, graph, links, signals, simulation, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_bands_disagree_where_they_should(spark):
    r = one(spark, *[b(F.lit(0.3)) for b in (ex.band_api, ex.band_map, ex.band_methodology, ex.band_view)], ex.band_api(F.lit(None).cast("double")))
    assert list(r) == ["LOW", "LOW", "MEDIUM", "LOW", "UNKNOWN"]


def test_distance_in_nautical_miles(spark):
    d = one(spark, ex.haversine(F.lit(51.5), F.lit(-0.1), F.lit(48.9), F.lit(2.3), ex.EARTH_NM))[0]
    assert 170 < d < 190


def test_severity_and_titles(spark):
    none = F.lit(None).cast("double")
    r = one(spark, ex.severity(F.lit(-8.5), F.lit("x")), ex.severity(F.lit(0.0), F.lit("assault")), ex.severity(none, F.lit("other")), ex.root_type(F.lit("190")), ex.root_type(F.lit("")), ex.root_type(F.lit("99")))
    assert list(r) == [0.85, 0.8, 0.5, "force_conflict", "unknown", "other"]
    t = one(spark, ex.title(F.lit("mass_violence"), F.array(F.lit("X")), F.lit("Y")), ex.title(F.lit("protest"), F.array().cast("array<string>"), F.lit("Y")))
    assert list(t) == ["Mass Violence — X (Y)", "Protest in Y"]


def test_ring_closes(spark):
    ring = one(spark, ex.ring(F.lit(10.0), F.lit(50.0), F.lit(100.0)))[0]
    assert len(ring) == 33 and ring[0] == pytest.approx(ring[-1])


def test_geo_links_match_all_pairs(spark):
    rng = np.random.default_rng(1)
    e = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)))] + [(900, None, 1.0), (901, 89.9, 179.9), (902, 0.0, -179.9)]
    s = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)))] + [(901, 89.9, -90.0), (902, 0.0, 179.9)]
    got = {(r[0], r[1]) for r in links.geo_links(spark.createDataFrame(e, "event_id long, lat double, lon double"), spark.createDataFrame(s, "supplier_id long, lat double, lon double"), 900.0).collect()}

    def near(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) <= 900

    assert got == {(i, j) for i, a, b in e for j, c, d in s if a is not None and near(a, b, c, d)}


def test_links_merge_keeps_first_method_and_best_confidence(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, 1, "a", 0.4, t, 2), (1, 1, "b", 1.7, t + dt.timedelta(1), 1), (1, 2, "c", -1.0, t, 1)]
    got = {(r.event_id, r.supplier_id): (r.method, r.confidence, r.linked_at) for r in links.merge_links(spark.createDataFrame(rows, "event_id long, supplier_id long, method string, confidence double, linked_at timestamp, seq int")).collect()}
    assert got == {(1, 1): ("a", 1.0, t), (1, 2): ("c", 0.0, t)}


def test_as_of_takes_the_latest_before_else_the_earliest(spark):
    left = spark.createDataFrame([(1, 5, "x"), (1, 0, "y"), (2, 5, "z")], "k int, t int, name string")
    right = spark.createDataFrame([(1, 3, 0.3), (1, 5, 0.5), (1, 9, 0.9)], "k int, u int, v double")
    got = {r["name"]: r["v"] for r in links.as_of_join(left, right, "k", "t", "u", "v").collect()}
    assert got == {"x": 0.5, "y": 0.3, "z": None}


def edges(spark, rows):
    return spark.createDataFrame(rows, "src string, src_type string, rel string, dst string, dst_type string")


def plain_bfs(rows, start, kind, impact, most=5):
    near = {}
    for a, at, rel, b, bt in rows:
        near.setdefault(a, set()).add((rel, b, bt))
        near.setdefault(b, set()).add((rel, a, at))
    seen, out, queue = set(), [], [(start, kind, 0, impact, 0.0)]
    while queue:
        node, t, depth, i, delay = queue.pop(0)
        if node in seen or depth >= most or i < 0.1:
            continue
        seen.add(node)
        out.append((node, depth, round(i, 9), delay))
        if t in graph.EXPANDS:
            for rel, b, bt in sorted(near.get(node, ())):
                share, hours = graph.DECAY.get(rel, graph.OTHER)
                if b not in seen:
                    queue.append((b, bt, depth + 1, i * share, delay + hours))
    return out


def test_spread_is_the_queue_in_levels(spark):
    rng = np.random.default_rng(3)
    kinds = ["supplier", "port", "chokepoint", "region"]
    node = lambda i: (f"n{i}", kinds[i % 4])
    rows = [(*node(int(a)), str(r), *node(int(b))) for a, b, r in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.choice(["SUPPLIES", "SHIPS_VIA", "PASSES_THROUGH", "OTHER"], 60)) if a != b]
    starts = spark.createDataFrame([("a", "n0", "supplier", 0.9), ("b", "n1", "port", 0.3), ("c", "n2", "chokepoint", 0.05)], "run_id string, node string, node_type string, impact double")
    got = graph.propagate(edges(spark, rows), starts).orderBy("run_id", "step").collect()
    for run, start, kind, impact in (("a", "n0", "supplier", 0.9), ("b", "n1", "port", 0.3), ("c", "n2", "chokepoint", 0.05)):
        assert [(r.node, r.depth, round(r.impact, 9), r.delay_hours) for r in got if r.run_id == run] == plain_bfs(rows, start, kind, impact)


def test_revenue_and_recovery(spark):
    for n in (0, 1, 5, 16, 17, 40):
        assert one(spark, graph.revenue(F.lit(n)))[0] == pytest.approx(sum(max(50000, 250000 * (1 - 0.05 * i)) for i in range(n)))
    assert one(spark, graph.recovery_days(F.lit(100.0), F.lit(3), F.lit(300)))[0] == int(100 / 24 + 7 + 21)


def test_communities_of_two_triangles(spark):
    rows = [(a, "supplier", "SUPPLIES", b, "supplier") for a, b in ("ab", "bc", "ca", "xy", "yz", "zx")]
    got = {r[0]: r[1] for r in graph.communities(edges(spark, rows), spark.createDataFrame([(x,) for x in "abcxyz"], "node string"), 4).collect()}
    assert not set(map(got.get, "abc")) & set(map(got.get, "xyz"))


def test_changepoint(spark):
    s = spark.createDataFrame([("up", [1.0, 1.0, 1.0, 1.0, 8.0, 10.0, 12.0]), ("short", [1.0, 2.0]), ("none", [])], "k string, series array<double>")
    got = {r.k: r for r in signals.changepoint(s, "k", threshold=3.0).collect()}
    assert got["up"].detected and got["up"].current_rate == 10
    assert not got["short"].detected and got["short"].statistic == 0 and not got["none"].detected


def test_trend_of_short_series_is_flat(spark):
    s = spark.createDataFrame([("up", [0.1, 0.2, 0.3]), ("one", [0.4]), ("none", [])], "k string, series array<double>")
    got = {r.k: r for r in signals.trend(s, "k").collect()}
    assert got["up"].direction == "increasing" and got["up"].forecast[0] == pytest.approx(0.4)
    assert got["one"].forecast == [0.4] * 7 and got["one"].band == 0.1 and got["none"].forecast == [0.0] * 7


def test_regimes(spark):
    s = spark.createDataFrame([("hot", [0.9] * 8), ("mid", [0.5] * 3), ("none", [])], "k string, series array<double>")
    got = {r.k: (r.regime, r.confidence) for r in signals.threshold_regime(s, "k").collect()}
    assert got["hot"][0] == "crisis" and got["mid"][0] == "escalation" and got["none"] == ("stable", 0.0)
    h = spark.createDataFrame([("k", [0.1] * 8 + [0.9] * 6)], "k string, series array<double>")
    assert signals.hidden_regime(h, "k").first().regime == "crisis"


def test_isolation_forest_finds_the_odd_day(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = spark.createDataFrame([("k", d, 50.0 if i == 20 else float(i % 3)) for i, d in enumerate(days)], "k string, day date, x double")
    got = signals.anomalies(rows, "k", ["x"]).toPandas()
    assert got.sort_values("score").iloc[-1].day == days[20]


def test_quantile_takes_the_higher_value(spark):
    v = [3.0, 1.0, 2.0, 2.0, 9.0]
    got = analytics.quantile_higher(spark.createDataFrame([(x,) for x in v] + [(None,)], "v double"), "v", 0.9).first()[0]
    assert got == np.quantile(v, 0.9, method="higher")


def test_conformal_needs_ten_labels(spark):
    rows = spark.createDataFrame([(i, 0.5, 0.4) for i in range(9)], "i int, s double, y double")
    assert analytics.conformal(rows, "s", "y", "i").first().low is None
    rows = spark.createDataFrame([(i, 0.5, 0.4) for i in range(12)], "i int, s double, y double")
    assert analytics.conformal(rows, "s", "y", "i").first().low == pytest.approx(0.4)


def test_bootstrap_brackets_the_correlation(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=300)
    rows = spark.createDataFrame(pd.DataFrame({"a": x, "b": x + rng.normal(size=300)}))
    r = rows.stat.corr("a", "b")
    low, high = analytics.bootstrap_correlation(rows, "a", "b").first()
    assert low < r < high < low + 0.4


def test_gate_counts_from_what_was_sent(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda m: t + dt.timedelta(minutes=m)
    rows = [(1, at(0), "critical", "e", "A"), (2, at(1), "critical", "e", "B"), (3, at(6), "critical", "e", "A"), (4, at(6), "critical", "e", "B"), (5, at(59), "critical", "e", "A"), (6, at(60), "critical", "e", "A"), (7, at(0), "info", None, None)]
    got = {r.alert_id: r.outcome for r in alerts.gate(spark.createDataFrame(rows, "alert_id long, ts timestamp, tier string, entity_id string, title string")).collect()}
    assert got == {1: "sent", 2: "rate_limited", 3: "duplicate", 4: "sent", 5: "duplicate", 6: "sent", 7: "sent"}


def test_text_rules(spark):
    r = one(spark, *text.event_class(F.lit("Missile STRIKE near port")), text.event_class(F.lit("hm"))[0], text.event_class(F.lit(None).cast("string"))[1], *text.risk_level(F.lit("war and protest")))
    assert list(r) == ["armed_conflict", 0.9, "unknown", 0.3, "HIGH", 0.5]
    assert one(spark, text.route(F.lit("how calculated")))[0][0].collection == "methodology"
    assert len(one(spark, text.route(F.lit("x")))[0]) == 6


def test_chunks_pack_paragraphs(spark):
    docs = spark.createDataFrame([(1, "a" * 300 + "\n\n" + "b" * 200 + "\n\n" + "c" * 700 + "\n\n\n\nd"), (2, ""), (3, None)], "id int, text string")
    got = [(r.id, r.chunk_no, len(r.chunk)) for r in text.chunks(docs).orderBy("id", "chunk_no").collect()]
    assert got == [(1, 0, 502), (1, 1, 700), (1, 2, 1)]


def test_chunks_keep_digits_and_lose_spaces(spark):
    docs = spark.createDataFrame([(1, "010 first 0\n\n  1 second 1\u00a0\n\n \u2003 \n\n2 third 2 ")], "id int, text string")
    assert [r.chunk for r in text.chunks(docs).collect()] == ["010 first 0\n\n1 second 1\n\n2 third 2"]


def test_names_match_by_words(spark):
    assert text.token_set_ratio("Taiwan Semiconductor Corp", "corp taiwan semiconductor") == 100
    assert text.token_set_ratio("", "x") == 0
    names = spark.createDataFrame([(1, "Seoul Precision Parts"), (2, "Rotterdam Components")], "id int, name string")
    got = text.fuzzy_match(spark.createDataFrame([("seoul precison parts",), ("nothing alike",), (None,)], "mention string"), names).collect()
    assert [(r.mention, r.id) for r in got] == [("seoul precison parts", 1)]


def test_entities_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "Ships of Acme Trading Co left the Port of Suez for the Suez Canal"), (2, None)], "id int, text string")
    got = [(r.kind, r.entity) for r in text.entities(docs).collect()]
    assert ("chokepoint", "Suez Canal") in got and ("port", "Port of Suez") in got and ("supplier", "Acme Trading Co") in got


def test_embedding_is_fixed_by_the_text(spark):
    v = [r.vector for r in text.hash_embedding(spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "text string")).collect()]
    assert v[0] == v[1] != v[2] and np.linalg.norm(v[3]) == pytest.approx(1, abs=1e-5)


def test_budget_cuts_the_row_that_crosses_it(spark):
    rows = spark.createDataFrame([(1, i, "x" * 30) for i in range(5)], "q int, i int, text string")
    assert [len(r.text) for r in text.within_budget(rows, "q", "i", "text", 70).orderBy("i").collect()] == [30, 30, 10]


def test_simulation_is_repeatable_and_ordered(spark):
    e = edges(spark, [("supplier-1", "supplier", "SHIPS_VIA", "port-1", "port"), ("port-1", "port", "PASSES_THROUGH", "chokepoint-1", "chokepoint")])
    s = spark.createDataFrame([("x", "chokepoint-1", "chokepoint", 0.8, 0.6, 10)], "scenario_id string, node string, node_type string, severity double, probability double, duration_days int")
    skus = spark.createDataFrame([("supplier-1", 4)], "node string, n long")
    a, b = (simulation.summary(simulation.simulate(e, s, skus, 10)).first() for _ in range(2))
    assert a == b and a.iterations == 1000 and 0.5 < a.probability < 0.7 and a.days_p10 <= a.days_p50 <= a.days_p90


def test_empty_tables(spark):
    ev = spark.createDataFrame([], "event_id long, ts timestamp, kind string, severity double, country string, supplier_id long, lat double, lon double, text string")
    sup = spark.createDataFrame([], "supplier_id long, name string, country string, risk_score double, industry string, critical boolean, single_source boolean, lat double, lon double")
    now = dt.datetime(2024, 1, 1)
    assert signals.daily_counts(ev, "kind", now).count() == 0
    assert links.geo_links(ev, sup).count() == 0
    assert analytics.sector_rollup(sup).count() == 4
    assert features.event_signals(ev, now).count() == 0
    health = analytics.graph_health(sup, ev, spark.createDataFrame([], "supplier_id long, confidence double"), spark.createDataFrame([], "supplier_id long"), spark.createDataFrame([], "tier int")).first()
    assert health.completeness == 0 and health.status == "empty"
