"""The recurrent forecast and adjusted effects on small fixtures."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from harborline.operators import causal, learning, recurrent

DAY = dt.date(2024, 1, 1)


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(5, 4)), rng.normal(size=5), recurrent.first_weights(3) * 2
    g = recurrent.gradient(w, x, y)
    loss = lambda v: ((recurrent.predicted(v, x) - y) ** 2).mean()
    for i in range(0, len(w), 7):
        e = np.zeros_like(w)
        e[i] = 1e-6
        assert g[i] == pytest.approx((loss(w + e) - loss(w - e)) / 2e-6, abs=1e-6)


@pytest.fixture(scope="module")
def chaotic(spark):
    """Series whose next value is a curve of the last one, which no line foretells."""
    rng, rows = np.random.default_rng(2), []
    for k in range(20):
        v = rng.uniform(0.2, 0.8)
        for d in range(60):
            rows.append((f"k{k}", DAY + dt.timedelta(days=d), float(v)))
            v = 3.8 * v * (1 - v)
    return spark.createDataFrame(rows, "key string, day date, value double")


def test_beats_ridge_on_windows_it_did_not_see_and_repeats(spark, chaotic, monkeypatch):
    windows = recurrent.window_pairs(chaotic, "key", "value", 7, 1)
    seen, unseen = windows.where("key < 'k5'"), windows.where("key >= 'k5'").toPandas()
    monkeypatch.setattr(recurrent, "SHARD_WINDOWS", 400)  # several shards
    model, again = recurrent.fitted(seen, "key"), recurrent.fitted(seen.repartition(5), "key")
    assert np.array_equal(model.weights, again.weights)
    x, y = np.stack(unseen["inputs"].to_numpy()), np.stack(unseen["targets"].to_numpy())[:, -1]
    s = seen.toPandas()
    a, b = np.stack(s["inputs"].to_numpy()), np.stack(s["targets"].to_numpy())[:, -1]
    one = lambda m: np.column_stack([m, np.ones(len(m))])
    line = one(x) @ np.linalg.solve(one(a).T @ one(a) + np.eye(8), one(a).T @ b)
    assert ((model(x) - y) ** 2).mean() < 0.6 * ((line - y) ** 2).mean()


def test_short_histories_take_the_trend(spark, chaotic):
    series = spark.createDataFrame([("long", [0.5] * 21), ("short", [0.1 * i for i in range(5)]), ("one", [0.4]), ("none", [])], "key string, series array<double>")
    model = recurrent.Model(recurrent.first_weights(), 0.5, 0.1)
    got = {r.key: r for r in recurrent.forecasts(series, "key", model).collect()}
    assert {k: r.method for k, r in got.items()} == {"long": "recurrent", "short": "trend", "one": "trend", "none": "insufficient_data"}
    assert got["long"].high - got["long"].low == pytest.approx(0.16) and (got["none"].forecast, got["none"].low, got["none"].high) == (0.5, 0.3, 0.7)
    assert got["short"].forecast == 1.0
    assert {r.method for r in recurrent.forecasts(series, "key", None).collect()} == {"trend", "insufficient_data"}
    assert recurrent.fitted(recurrent.window_pairs(chaotic.limit(0), "key", "value"), "key") is None


def pairs(spark, n, effect, confounding, seed=5):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=n)
    x = confounding * c + rng.normal(size=n)
    y = effect * x + confounding * 2 * c + 0.3 * rng.normal(size=n)
    return spark.createDataFrame([(i, float(a), float(b), float(d), 1.0) for i, (a, b, d) in enumerate(zip(x, y, c))] + [(n, None, 1.0, 1.0, 1.0)], "id long, x double, y double, c double, same double")


def test_a_true_effect_stays_and_a_confounded_one_is_refused(spark):
    true = causal.assessed(pairs(spark, 400, 0.5, 1.0), "id", "x", "y", ["c", "same"]).first()
    assert true.n == 400 and true.effect == pytest.approx(0.5, abs=0.05) and true.refutation_passed and true.causal_claim_allowed and true.placebo_share == 0
    mixed = pairs(spark, 400, 0.0, 1.0)
    assert abs(mixed.agg(F.corr("x", "y")).first()[0]) > 0.5  # together they go, by the common cause
    none = causal.assessed(mixed, "id", "x", "y", ["c"]).first()
    assert abs(none.effect) < 0.05 and not none.causal_claim_allowed


def test_few_pairs_and_treatments_that_do_not_vary(spark):
    few = pairs(spark, 10, 0.5, 0.0)
    assert causal.assessed(few.limit(3), "id", "x", "y", ["c"]).first().method == "insufficient_data"
    assert causal.assessed(few, "id", "x", "y", ["c"]).first().method == "association_only"
    still = causal.assessed(pairs(spark, 60, 0.5, 0.0).withColumn("x", F.lit(2.0)), "id", "x", "y", ["c"]).first()
    assert still.effect == 0 and not still.causal_claim_allowed


def test_splits_are_kept_by_a_saved_model(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), float(i % 3)], i % 2) for i in range(40)], "id long, vector array<double>, label int")
    split = learning.holdout(rows, "id", "label")
    path = learning.fitted(split, trees=2, depth=2)
    p = learning.scored(split, path)
    assert p.where("held_out and (probability >= 0.5) <> (label = 1)").count() == 0
