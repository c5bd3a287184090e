"""Learned scores: boosted trees on a held-out split, exact Shapley values of their terms, and a ridge forecast over windows."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..materialize import materialized, shared_dir

#: The model inputs in the order of ``features.vector``, and what each says.
INPUTS = {
    "proximity": "distance to conflict",
    "stability": "political stability of the country",
    "congestion": "congestion of the ports",
    "weather": "chance of extreme weather",
    "recent_events": "number of recent events",
    "critical_events": "number of critical events",
    "depth": "depth in the supply chain",
    "single_source": "only source of a product",
    "alternatives": "number of other suppliers",
    "financial_health": "financial health",
    "volatility": "market volatility",
    "disruptions": "disruptions so far",
    "resolution": "days until a disruption ends",
}
TREES, DEPTH, STEP, TEST_SHARE = 120, 5, 0.08, 0.25
#: Rows that one pass over all leaves takes at once, in (row, leaf, split) cells.
CELLS = 1 << 22
#: Rows (of the fit: distinct ones) that a task of the fit and of the explanations takes: few bytes a row, so files alone would make a single task.
FIT_ROWS, TELL_ROWS = 16384, 4096


def folded(rows: DataFrame) -> DataFrame:
    """(vector, label, weight): rows(vector, label) with equal ones once and their number, over tasks of about ``FIT_ROWS``.

    They are in order within a task, so the order of the files does not matter where there is one.
    """
    one = materialized(rows.groupBy("vector", F.col("label").cast("double").alias("label")).agg(F.count("*").cast("double").alias("weight")), "folded")
    return one.repartition(max(1, -(-one.count() // FIT_ROWS))).sortWithinPartitions("vector", "label")


def grown(rows: DataFrame, trees: int, depth: int, step: float, seed: int) -> GBTClassificationModel:
    """The trees fitted on rows(vector, label).

    Every level of every tree is a pass over what they are fitted on. Equal rows add the same terms to every sum behind a split
    or a leaf, so one of them with their number as its weight gives the same trees, and a pass grows with the distinct rows. Up
    to 10,000 of these Spark takes split points from all of them, beyond that from a sample.
    """
    train = folded(rows).select(array_to_vector("vector").alias("features"), "label", "weight")
    return GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, weightCol="weight").fit(train)


def boosted_model(vectors: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 4, step: float = 0.1, seed: int = 42):
    """A fitted model and the labelled rows; vectors(supplier_id, vector), labels(supplier_id, label)."""
    rows = vectors.join(labels, "supplier_id").select("supplier_id", "vector", "label")
    return grown(rows, trees, depth, step, seed), rows.select("supplier_id", array_to_vector("vector").alias("features"), "label")


def boosted_scores(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """supplier_id, probability, and confidence: twice the distance of the probability from one half."""
    model, rows = boosted_model(vectors, labels)
    p = vector_to_array("probability")[1]
    return model.transform(rows).select("supplier_id", F.round(p, 4).alias("probability"), F.round(F.abs(p - 0.5) * 2, 4).alias("confidence"))


def importances(vectors: DataFrame, labels: DataFrame, names: list[str]) -> list[tuple[str, float]]:
    """Inputs by their share in the trees' gain, largest first."""
    model, _ = boosted_model(vectors, labels)
    return sorted(zip(names, model.featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))


def dealt(rows: DataFrame, each: int) -> DataFrame:
    """rows over tasks of about ``each`` rows; those of a single task as they are. The number depends on the rows alone."""
    tasks = -(-rows.count() // each)
    return rows.repartition(tasks) if tasks > 1 else rows


# ---- held-out evaluation


def holdout(rows: DataFrame, key: str, label: str, share: float = TEST_SHARE) -> DataFrame:
    """rows plus held_out: of each class the first share by md5 of the key, halves rounded up.

    A row's place in its class is its place in one of 4096 ranges of the digest and the counts of those below, so no class
    is ranked in one task.
    """
    r = rows.withColumn("_d", F.md5(F.col(key).cast("string").cast("binary"))).withColumn("_bin", F.conv(F.substring("_d", 1, 3), 16, 10).cast("int"))
    counts = r.groupBy(label, "_bin").agg(F.count("*").alias("_n"))
    below = F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(label, "_bin", below.alias("_below"), F.floor(share * F.sum("_n").over(Window.partitionBy(label)) + 0.5).alias("_take"))
    place = F.row_number().over(Window.partitionBy(label, "_bin").orderBy("_d", key))
    return r.join(counts, [label, "_bin"]).withColumn("held_out", F.col("_below") + place <= F.col("_take")).select(*rows.columns, "held_out")


def fitted(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, step: float = STEP, seed: int = 42) -> str:
    """Fit on the rows(vector, label, held_out) that are not held out and save the model in the shared folder; returns its path."""
    path = f"{shared_dir(rows.sparkSession)}/boosted-{uuid.uuid4().hex}"
    grown(rows.where("not held_out"), trees, depth, step, seed).save(path)
    return path


def scored(rows: DataFrame, path: str) -> DataFrame:
    """rows(vector) plus probability and margin by the model saved at path."""
    model = GBTClassificationModel.load(path)
    out = model.transform(rows.withColumn("features", array_to_vector("vector")))
    return out.select(*rows.columns, vector_to_array("probability")[1].alias("probability"), vector_to_array("rawPrediction")[1].alias("margin"))


def evaluation(rows: DataFrame) -> DataFrame:
    """One row: train and test rows, F1 at one half and the area under the curve over the held-out ones.

    rows: label (0 or 1), held_out, probability. Without both classes in the test rows the area is null.
    """
    hit = lambda said, is_: F.count_if(F.col("held_out") & (F.col("probability") >= 0.5).eqNullSafe(F.lit(said)) & (F.col("label") == is_))
    tp, fp, fn = hit(True, 1), hit(True, 0), hit(False, 1)
    classes = F.count_if(F.col("held_out") & (F.col("label") == 1)) * F.count_if(F.col("held_out") & (F.col("label") == 0))
    counts = rows.agg(F.count_if(~F.col("held_out")).alias("train_rows"), F.count_if("held_out").alias("test_rows"), F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1"), (classes > 0).alias("_both"))
    test = rows.where("held_out").select(F.col("label").cast("double").alias("label"), F.col("probability").alias("rawPrediction"))
    area = BinaryClassificationEvaluator(numBins=0).evaluate(test) if counts.first()["_both"] else None
    return counts.drop("_both").withColumn("roc_auc", F.lit(area).cast("double"))


# ---- Shapley values


class Leaves:
    """All leaves of a saved forest as arrays: what a row must fulfil on its way to each, and each one's share of the rows.

    A leaf with splits on features 1..m is a game of m players: a feature that is known counts 1 or 0, as the row fulfils its
    splits or not; one that is not known counts the share of training rows that go the leaf's way there. The Shapley values of
    that game depend on the row only through which features fulfil their splits, so they are worked out once for each leaf
    and each such pattern, by extending the polynomial of subset sizes one feature at a time; a row looks its pattern up. Sums
    over leaves are exact for the model. Trees have ``MOST_DEPTH`` levels at most, which bounds the patterns.
    """

    MOST_DEPTH = 7

    def __init__(self, nodes: dict[int, list], weights: list[float], n_features: int):
        paths = [(v * w, p) for tree, w in zip((nodes[i] for i in sorted(nodes)), weights) for v, p in self._paths(tree)]
        m = max([1, *(len(p) for _, p in paths)])
        if m > self.MOST_DEPTH:
            raise ValueError(f"trees split on more than {self.MOST_DEPTH} features on one path")
        n = len(paths)
        self.feature, self.low, self.high, self.share = np.zeros((n, m), np.int64), np.full((n, m), -np.inf), np.full((n, m), np.inf), np.ones((n, m))
        self.value = np.array([v for v, _ in paths])
        for i, (_, path) in enumerate(paths):
            for j, (f, (lo, hi, z)) in enumerate(sorted(path.items())):
                self.feature[i, j], self.low[i, j], self.high[i, j], self.share[i, j] = f, lo, hi, z
        self.expected = float((self.value * self.share.prod(1)).sum())
        self.n_features, self.terms = n_features, self._terms(m)

    @staticmethod
    def _paths(tree: list):
        """(value, {feature: (above, up to, share)}) of each leaf of nodes (value, rows, feature, threshold, left, right)."""
        todo = [(0, {})]
        while todo:
            at, path = todo.pop()
            value, rows, feature, threshold, left, right = tree[at]
            if left < 0:
                yield value, path
                continue
            lo, hi, z = path.get(feature, (-math.inf, math.inf, 1.0))
            todo.append((left, path | {feature: (lo, min(hi, threshold), z * tree[left][1] / rows)}))
            todo.append((right, path | {feature: (max(lo, threshold), hi, z * tree[right][1] / rows)}))

    def _terms(self, m: int) -> np.ndarray:
        """Shapley value of each leaf's features for each pattern of fulfilled ones: (leaf, pattern, feature)."""
        known = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
        weight = np.array([math.factorial(s) * math.factorial(m - 1 - s) / math.factorial(m) for s in range(m)])
        out = np.zeros((len(self.value), 1 << m, m))
        for j in range(m):
            poly = np.zeros((len(self.value), 1 << m, m))
            poly[:, :, 0] = 1
            for i in (i for i in range(m) if i != j):
                up = np.zeros_like(poly)
                up[:, :, 1:] = poly[:, :, :-1] * known[None, :, i, None]
                poly = poly * self.share[:, None, i, None] + up
            out[:, :, j] = (poly @ weight) * (known[None, :, j] - self.share[:, None, j]) * self.value[:, None]
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        """(rows, features): each row's Shapley values; with ``expected`` they add up to its margin."""
        n, m = self.feature.shape
        out = np.zeros((len(x), self.n_features))
        bit = 1 << np.arange(m)
        step = max(1, CELLS // (n * m))
        for at in range(0, len(x), step):
            v = x[at : at + step][:, self.feature]
            pattern = ((v > self.low) & (v <= self.high)) @ bit
            terms = self.terms[np.arange(n), pattern]
            for j in range(m):
                by_feature = np.zeros((n, self.n_features))
                by_feature[np.arange(n), self.feature[:, j]] = 1
                out[at : at + step] += terms[:, :, j] @ by_feature
        return out


def leaves(spark: SparkSession, path: str) -> Leaves:
    """The leaves of the model saved at path; a forest of bounded depth and number of trees has a bounded number of nodes.

    A node's rows are the sum of their weights: equal rows are fitted as one.
    """
    model = GBTClassificationModel.load(path)
    rows = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").select("treeID", "id", "prediction", F.get("impurityStats", F.lit(0)).alias("rows"), F.col("split.featureIndex").alias("feature"), F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), "leftChild", "rightChild")
    trees: dict[int, list] = {}
    for r in rows.orderBy("treeID", "id").collect():
        trees.setdefault(r["treeID"], []).append((r["prediction"], r["rows"], r["feature"], r["threshold"], r["leftChild"], r["rightChild"]))
    return Leaves(trees, list(model.treeWeights), model.numFeatures)


def shapley(rows: DataFrame, key: str, forest: Leaves, names: list[str], top: int = 5) -> DataFrame:
    """(key, rank, feature, contribution, direction, expected, total): each row's largest terms by absolute value, ties by input.

    total is the sum of all terms and the expected value, which is the model's margin. rows(key, vector) are passed over twice.
    Rows of a batch with the same vector are worked out once.
    """
    shared = rows.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            x, row = np.unique(np.stack(batch["vector"].to_numpy()).astype(float), axis=0, return_inverse=True)
            phi = shared.value.values(x)[row.ravel()]
            order = np.argsort(-np.abs(phi), axis=1, kind="stable")[:, :top]
            n = order.shape[1]
            yield pd.DataFrame(
                {
                    key: np.repeat(batch[key].to_numpy(), n),
                    "rank": np.tile(np.arange(1, n + 1), len(batch)).astype("int32"),
                    "feature": pd.Series([names[i] for i in order.ravel()], dtype=object),
                    "contribution": np.take_along_axis(phi, order, 1).ravel(),
                    "expected": shared.value.expected,
                    "total": np.repeat(phi.sum(1) + shared.value.expected, n),
                }
            )

    kind = rows.schema[key].dataType.simpleString()
    out = dealt(rows.select(key, "vector"), TELL_ROWS).mapInPandas(run, f"{key} {kind}, rank int, feature string, contribution double, expected double, total double")
    return out.withColumn("direction", F.when(F.col("contribution") > 0, "increases").otherwise("decreases"))


# ---- ridge


def ridge_forecast(sequences: DataFrame, key: str, penalty: float = 1.0) -> DataFrame:
    """The value after each key's last window by ridge regression over all windows; sequences(key, day, inputs, label)."""
    n = 7
    wide = sequences.select(key, "day", "label", *[F.col("inputs")[i].alias(f"x{i}") for i in range(n)])
    assembled = VectorAssembler(inputCols=[f"x{i}" for i in range(n)], outputCol="features").transform(wide)
    model = LinearRegression(regParam=penalty, elasticNetParam=0.0).fit(assembled)
    last = sequences.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("day")))).where("_n = 1")
    ahead = last.select(key, array_to_vector(F.concat(F.slice("inputs", 2, n - 1), F.array("label"))).alias("features"))
    return model.transform(ahead).select(key, F.round("prediction", 4).alias("next"))
