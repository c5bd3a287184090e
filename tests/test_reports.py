"""Composed reports on small inputs."""

import datetime as dt

import numpy as np
import pytest

from harborline.operators import reports


def test_explanations_fall_to_the_baseline(spark):
    sup = spark.createDataFrame([(1, "A", 0.9, True, True), (2, "B", None, False, False)], "supplier_id long, country string, risk_score double, critical boolean, single_source boolean")
    sig = spark.createDataFrame([(1, 5)], "supplier_id long, recent_events long")
    got = {r.supplier_id: (r.band, [(f.feature, f.contribution) for f in r.factors]) for r in reports.explanations(sup, sig, ["A"]).collect()}
    assert got[1] == ("CRITICAL", [("critical_supplier", 0.22), ("single_source", 0.2), ("active_disruptions", 0.35), ("geopolitical_exposure", 0.18)])
    assert got[2] == ("UNKNOWN", [("baseline", 0.05)])


def test_embeddings_are_fixed_units_that_lean_to_neighbours(spark):
    sup = spark.createDataFrame([(1, 0.5), (2, None)], "supplier_id long, risk_score double")
    near = spark.createDataFrame([(1, i) for i in range(20)], "supplier_id long, neighbour long")
    a, b = (sorted((r.supplier_id, r.vector) for r in reports.embeddings(sup, near).collect()) for _ in range(2))
    assert a == b and all(np.linalg.norm(v) == pytest.approx(1) and len(v) == 32 for _, v in a)


def test_gaps_and_first_hit(spark):
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 1, 4),)], "ts timestamp")
    rows = reports.gap_filled(ev, ["quiet", "calm"]).orderBy("day").collect()
    assert [r.n for r in rows] == [1, 0, 0, 1] and rows[1].note != rows[2].note and rows[0].note is None
    assert reports.gap_filled(ev.limit(0), ["quiet"]).count() == 0
    f = spark.createDataFrame([("a", [0.1, 0.8, 0.9]), ("b", [0.1])], "k string, forecast array<double>")
    assert {r.k: r.days for r in reports.first_critical(f, "k").collect()} == {"a": 2, "b": None}


def test_causal_ladder(spark):
    make = lambda n: spark.createDataFrame([(i, float(i % 11), 2.0 * (i % 11)) for i in range(n)], "i int, x double, y double")
    got = [reports.causal_assessment(make(n), "x", "y", "i").first() for n in (1, 10, 200)]
    assert [g.method for g in got] == ["insufficient_data", "association_only", "adjusted_regression"]
    assert [g.causal_claim_allowed for g in got] == [False, False, True] and got[2].effect == pytest.approx(2)


def test_facts_meet_by_words(spark):
    q = spark.createDataFrame([(1, "Which OIL suppliers are in Norway?"), (2, "the and"), (3, None)], "question_id int, question string")
    s = spark.createDataFrame([(1, "Acme", "Norway", 0.9, "oil"), (2, "Beta", "Chile", 0.3, "parts"), (3, None, None, None, None)], "supplier_id long, name string, country string, risk_score double, industry string")
    assert [(r.question_id, r.rank, r.fact) for r in reports.facts(q, s).collect()] == [(1, 1, "Acme in Norway is rated CRITICAL")]


def test_resolution_of_mentions(spark):
    ev = spark.createDataFrame([(1, "Fire at Acme Trading Co beside the Suez Canal"), (2, None)], "event_id long, text string")
    sup = spark.createDataFrame([(7, "Acme Trading Company")], "supplier_id long, name string")
    k = spark.createDataFrame([(1, "Suez Canal"), (2, "Panama Canal")], "chokepoint_id int, chokepoint_name string")
    assert sorted((r.target, r.id) for r in reports.resolved_links(ev, sup, k).collect()) == [("chokepoint", "1"), ("supplier", "7")]
