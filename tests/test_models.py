"""Held-out evaluation, Shapley values and communities against plain brute force."""

import itertools
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array

from harborline.operators import graph, learning, modularity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(160, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] + 0.3 * rng.normal(size=160) > 0.2)).astype(int)
    rows = spark.createDataFrame([(i, [float(v) for v in a], int(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, vector array<double>, label int")
    return learning.holdout(rows, "id", "label")


@pytest.fixture(scope="module")
def saved(labelled):
    return learning.fitted(labelled, trees=4, depth=3, step=0.3)


def test_each_class_gives_a_quarter(labelled):
    p = labelled.toPandas()
    for _, c in p.groupby("label"):
        assert c["held_out"].sum() == math.floor(0.25 * len(c) + 0.5)


def test_measures_from_the_probabilities_in_sql(labelled, saved):
    scored = learning.scored(labelled, saved)
    p, got = scored.select("label", "held_out", "probability").toPandas(), learning.evaluation(scored).first()
    f1, auc = duckdb.sql("""with t as (select * from p where held_out), a as (select count(*) filter (x.probability > y.probability) + 0.5 * count(*) filter (x.probability = y.probability) as s, count(*) as n from t x, t y where x.label = 1 and y.label = 0)
      select (select 2.0 * count(*) filter (probability >= 0.5 and label = 1) / (count(*) filter (probability >= 0.5) + count(*) filter (label = 1)) from t), s / n from a""").fetchall()[0]
    assert (got["f1"], got["roc_auc"]) == (pytest.approx(float(f1)), pytest.approx(float(auc)))
    assert got["train_rows"] + got["test_rows"] == 160 and got["roc_auc"] > 0.7
    one = learning.evaluation(scored.where("label = 1")).first()
    assert one["roc_auc"] is None


def brute(nodes, weights, x):
    """Shapley values by all subsets; a feature that is not known takes both ways by their share of rows."""

    def value(tree, at, known):
        v, n, f, t, left, right = tree[at]
        if left < 0:
            return v
        if f in known:
            return value(tree, left if x[f] <= t else right, known)
        return sum(tree[c][1] / n * value(tree, c, known) for c in (left, right))

    k = len(x)
    game = {s: sum(w * value(t, 0, s) for t, w in zip(nodes, weights)) for r in range(k + 1) for s in map(frozenset, itertools.combinations(range(k), r))}
    weight = lambda s: math.factorial(len(s)) * math.factorial(k - 1 - len(s)) / math.factorial(k)
    return game[frozenset()], [sum(weight(s) * (game[s | {i}] - game[s]) for s in game if i not in s) for i in range(k)]


def test_shapley_values_equal_those_of_all_subsets(spark, labelled, saved, monkeypatch):
    seen = {}
    real = learning.Leaves.__init__
    monkeypatch.setattr(learning.Leaves, "__init__", lambda self, nodes, weights, n: (seen.update(nodes=[nodes[i] for i in sorted(nodes)], weights=weights), real(self, nodes, weights, n))[1])
    forest = learning.leaves(spark, saved)
    rows = learning.scored(labelled, saved).toPandas()
    x = np.stack(rows["vector"].to_numpy())
    got = forest.values(x)
    for i in range(0, len(x), 9):
        expected, want = brute(seen["nodes"], seen["weights"], x[i])
        assert forest.expected == pytest.approx(expected, abs=1e-12) and got[i] == pytest.approx(want, abs=1e-12)
    assert np.abs(got.sum(1) + forest.expected - rows["margin"]).max() < 1e-9


def test_top_terms_are_the_largest(spark, labelled, saved):
    forest, names = learning.leaves(spark, saved), ["a", "b", "c", "d"]
    got = learning.shapley(labelled, "id", forest, names, 3).toPandas()
    every = {i: v for i, v in zip(labelled.toPandas()["id"], forest.values(np.stack(labelled.toPandas()["vector"].to_numpy())))}
    assert len(got) == 3 * 160
    for i, g in got.groupby("id"):
        g = g.sort_values("rank")
        order = np.argsort(-np.abs(every[i]), kind="stable")[:3]
        assert g["feature"].tolist() == [names[k] for k in order] and g["contribution"].to_numpy() == pytest.approx(every[i][order])
        assert all((d == "increases") == (c > 0) for d, c in zip(g["direction"], g["contribution"]))


def test_rows_of_one_file_are_dealt_and_equal_vectors_worked_out_once(spark, labelled, saved, tmp_path, monkeypatch):
    rows = labelled.unionByName(labelled.withColumn("id", labelled["id"] + 1000)).coalesce(1)
    monkeypatch.setattr(learning, "TELL_ROWS", 64)
    forest, names = learning.leaves(spark, saved), ["a", "b", "c", "d"]
    told = learning.shapley(rows, "id", forest, names, 4)
    assert told.rdd.getNumPartitions() == 5 and learning.dealt(rows, 320).rdd.getNumPartitions() == 1
    p = told.toPandas()
    every = {r.id: forest.values(np.array([r.vector]))[0] for r in labelled.collect()}
    assert len(p) == 4 * 320
    for i, g in p.groupby("id"):
        order = np.argsort(-np.abs(every[i % 1000]), kind="stable")
        g = g.sort_values("rank")
        assert g["feature"].tolist() == [names[k] for k in order] and g["contribution"].to_numpy() == pytest.approx(every[i % 1000][order])


def test_equal_rows_are_fitted_once_with_the_same_trees(spark, labelled, monkeypatch):
    train = labelled.where("not held_out").selectExpr("vector", "label", "held_out", "explode(sequence(1, id % 4 + 1)) as copy", "id").drop("copy")
    train = train.unionByName(train.where("id % 5 = 0").selectExpr("vector", "1 - label as label", "held_out", "id")).drop("id")
    every, distinct = train.count(), train.distinct().count()
    assert distinct < every
    path, seen = learning.fitted(train, trees=4, depth=3, step=0.3), []
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").where("id = 0").collect()
    assert [n["rawCount"] for n in nodes] == [distinct] * 4  # a pass reads the distinct rows
    monkeypatch.setattr(learning, "Leaves", lambda nodes, *a: seen.extend(t[0][1] for t in nodes.values()))
    learning.leaves(spark, path)
    assert seen == [every] * 4  # shares are those of all rows
    plain = GBTClassifier(maxIter=4, maxDepth=3, stepSize=0.3, seed=42).fit(train.select(array_to_vector("vector").alias("features"), train["label"].cast("double").alias("label")))
    p = learning.scored(labelled, path).withColumn("features", array_to_vector("vector")).drop("probability")
    both = plain.transform(p).select("margin", vector_to_array("rawPrediction")[1].alias("plain")).toPandas()
    assert both["margin"].to_numpy() == pytest.approx(both["plain"].to_numpy(), abs=1e-9)
    monkeypatch.setattr(learning, "FIT_ROWS", 50)
    got = learning.folded(train)
    assert got.rdd.getNumPartitions() == -(-distinct // 50) and got.agg({"weight": "sum"}).first()[0] == every


# ---- modularity


def partitions(items):
    if not items:
        yield []
        return
    for rest in partitions(items[1:]):
        yield [[items[0]], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], [items[0], *rest[i]], *rest[i + 1 :]]


def quality(edges, parts):
    m = sum(w for _, _, w in edges)
    of = {n: i for i, p in enumerate(parts) for n in p}
    d = [0.0] * len(parts)
    inside = 0
    for a, b, w in edges:
        d[of[a]] += w
        d[of[b]] += w
        inside += w * (of[a] == of[b])
    return inside / m - sum(x * x for x in d) / (4 * m * m)


def found(spark, edges, nodes, **kw):
    e = spark.createDataFrame(edges, "a string, b string, w long")
    members = modularity.communities(e, spark.createDataFrame([(n,) for n in nodes], "node string"), **kw)
    parts: dict[str, list] = {}
    for r in members.collect():
        parts.setdefault(r.community, []).append(r.node)
    return e, members, list(parts.values())


CLIQUES = [(a, b, 1) for k in ("abcd", "efgh") for a, b in itertools.combinations(k, 2)] + [("d", "e", 1)]
PAIRS = [("a", "b", 5), ("c", "d", 5), ("e", "f", 5), ("g", "h", 5), ("b", "c", 1), ("d", "e", 1), ("f", "g", 1), ("h", "a", 1)]
STAR = [("a", x, 1) for x in "bcdefg"] + [("g", "h", 3)]


@pytest.mark.parametrize("edges", [CLIQUES, PAIRS, STAR], ids=["cliques", "pairs", "star"])
def test_the_best_of_all_partitions_of_eight_nodes(spark, edges):
    e, members, parts = found(spark, edges, "abcdefgh")
    best = max(quality(edges, p) for p in partitions(list("abcdefgh")))
    assert quality(edges, parts) == pytest.approx(best)
    q = modularity.modularity(e, members).first()
    assert q.modularity == pytest.approx(quality(edges, parts)) and q.communities == len(parts)


def test_not_below_label_propagation_and_odd_graphs(spark):
    rng = random.Random(3)
    edges = [(f"n{a}", f"n{b}", 1) for a, b in itertools.combinations(range(30), 2) if rng.random() < (0.5 if a // 10 == b // 10 else 0.04)]
    e, members, parts = found(spark, edges, [f"n{i}" for i in range(30)])
    labels: dict[str, list] = {}
    for r in graph.communities(e.selectExpr("a as src", "'n' as src_type", "'x' as rel", "b as dst", "'n' as dst_type"), members.select("node"), 5).collect():
        labels.setdefault(r.community, []).append(r.node)
    assert quality(edges, parts) >= quality(edges, list(labels.values())) > 0
    # loops, repeated and reversed links, unknown nodes, nulls, a node alone; no links; no nodes
    odd = [("a", "b", 1), ("b", "a", 2), ("c", "c", 1), ("a", "zz", 9), (None, "a", 1), ("c", "d", 2)]
    _, _, parts = found(spark, odd, ["a", "b", "c", "d", "e"])
    assert sorted(map(sorted, parts)) == [["a", "b"], ["c", "d"], ["e"]]
    e, members, parts = found(spark, [], ["a", "b"])
    assert sorted(parts) == [["a"], ["b"]] and modularity.modularity(e, members).first().modularity == 0
    assert found(spark, [("a", "b", 1)], [])[2] == []
    assert pd.DataFrame(members.collect()).shape[0] == 2


def test_vectors_are_written_once_for_a_query(spark, sf_dir):
    from harborline.plans import models
    from harborline.sources.tables import Tables

    t = Tables(spark, sf_dir)
    first = models._labelled(t)
    assert models._labelled(t) is first and all("/labelled-" in f for f in first.inputFiles())
    assert all("/vectors-" in f for f in models._vectors(t).inputFiles()) and models._vectors(t).count() == first.count() == t.n_suppliers
