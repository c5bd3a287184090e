"""Entity rules, message fields, exports, alert store and SQL functions."""

import collections
import datetime as dt
import json

from pyspark.sql import functions as F

from harborline.operators import analytics, monitoring, text
from harborline.sources import sinks


def test_entity_rules(spark):
    said = ["The factory of Acme Steel near Port of Rotterdam, by the Suez Canal. A quay in Aden.", "quiet quay", None, "", "x" * 300 + " plant of Beta Works " + "y" * 300 + " Gamma"]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, text string")
    got = {}
    for r in text.rule_entities(rows).collect():
        assert said[r.id][r.start : r.end] == r.entity
        got.setdefault(r.id, []).append((r.kind, r.entity, r.confidence))
    kinds = {e: (k, c) for k, e, c in got[0]}
    assert kinds["Suez Canal"] == ("chokepoint", 0.95) and kinds["quay"] == ("port", 0.6)
    assert any(k == "port" and c == 0.7 for k, _, c in got[0])
    assert got[4] == [("supplier", "Beta Works", 0.5)]  # Gamma is too far from the word
    assert set(got) == {0, 4}
    for i in got:
        spans = sorted((r.start, r.end) for r in text.rule_entities(rows.where(f"id = {i}")).collect())
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_message_fields_in_order(spark):
    rows = spark.createDataFrame([("", None, "t"), ("d", "n", "t"), (None, "n", ""), (None, None, None)], "description string, notes string, title string")
    assert [r[0] for r in rows.select(text.message_text({c: F.col(c) for c in rows.columns})).collect()] == ["t", "d", "n", ""]


def test_names_and_places(spark):
    row = spark.createDataFrame([("The Acme Steel Works met Bob in Port Said, near Red Sea region.",)], "t string").select(text.named(F.col("t")), text.locations(F.col("t"))).first()
    assert row[0] == ["The Acme Steel Works", "Bob", "Port Said", "Red Sea"] and row[1] == ["Port Said", "Red Sea region"]  # as long as the pattern goes


def test_vectors_are_made_for_changed_documents_only(spark):
    made = spark.sparkContext.accumulator(0)

    def embed(rows):
        def run(batches):
            for b in batches:
                made.add(len(b))
                yield b.assign(vector=[[float(len(x))] for x in b["text"]])

        return rows.mapInPandas(run, "id long, text string, source string, version long, vector array<double>")

    old = spark.createDataFrame([(1, "a", "s", 1, [1.0]), (2, "bb", "s", 1, [2.0])], "id long, text string, source string, version long, vector array<double>")
    new = spark.createDataFrame([(2, "bb", "s", 2), (1, "aaa", "s", 2), (3, "", "s", 2)], "id long, text string, source string, version long")
    got = sorted((r.id, r.text, r.vector) for r in sinks.vectors_upserted(old, new, embed).collect())
    assert got == [(1, "aaa", [3.0]), (2, "bb", [2.0]), (3, "", [0.0])] and made.value == 2


def test_alert_store_keeps_the_newest(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    alerts = lambda ids: spark.createDataFrame([(i, at(i), f"t{i}") for i in ids], "alert_id long, ts timestamp, title string")
    path = str(tmp_path / "alerts")
    sinks.keep_alerts(alerts(range(4)), path, 5)
    sinks.keep_alerts(alerts([3, 4, 5, 6]), path, 5)
    sinks.keep_alerts(alerts([]), path, 5)
    assert sorted(r.alert_id for r in spark.read.parquet(path).collect()) == [2, 3, 4, 5, 6]


def test_repeated_texts_are_searched_once(spark):
    texts = ["Ships leave the Suez Canal", "Acme Steel factory on fire", "Port of Rotterdam and the Suez Canal", None, ""]
    rows = spark.createDataFrame([(texts[i % 5],) for i in range(100)], "text string").repartition(7)
    plain = collections.Counter((r.kind, r.entity) for r in text.rule_entities(rows).collect())
    counts = text.entity_counts(rows)
    assert plain and {(r.kind, r.entity): r.n for r in counts.collect()} == plain
    searched = spark.sparkContext.accumulator(0)

    def watched(rows):
        def run(batches):
            for b in batches:
                searched.add(len(b))
                yield b

        return rows.mapInPandas(run, rows.schema)

    real = text.rule_entities
    try:
        text.rule_entities = lambda rows, *more: real(watched(rows), *more)
        text.entity_counts(rows).collect()
    finally:
        text.rule_entities = real
    assert searched.value == 5


def test_pairs_and_their_summary(spark, tmp_path):
    pairs = spark.createDataFrame([(1, 0.5, 0.1), (2, None, 0.2)], "event_id long, severity double, risk_score double")
    sinks.export_pairs(pairs, str(tmp_path / "pairs"), F.lit("2024-01-01"))
    assert spark.read.option("header", True).csv(str(tmp_path / "pairs")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "pairs.summary")).first()[0]) == {"exported_at": "2024-01-01", "pair_count": 2, "correlation_pairs": 1}


def test_sql_functions(spark):
    text.register_functions(spark)
    row = spark.sql("select name_similarity('Acme Steel', 'steel ACME') as a, risk_word_level('war and protest') as b, risk_word_level(null) as c, rule_entities('Suez Canal') as d").first()
    assert tuple(row) == (100.0, "HIGH", "NONE", ["chokepoint:Suez Canal"])


def test_status_and_constant_correlation(spark):
    rows = spark.createDataFrame([(i % 2, i > 3) for i in range(12)], "label int, held_out boolean")
    ok, few = monitoring.model_status(rows, True).first(), monitoring.model_status(rows.where("label = 1"), True).first()
    assert (ok.training_status, ok.calibration_status, few.training_status) == ("validated", "validated", "demo")
    same = spark.createDataFrame([(1.0, float(i)) for i in range(6)], "a double, b double")
    assert analytics.correlation(same, "a", "b").first().r is None
