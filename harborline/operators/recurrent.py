"""A small gated recurrent forecast: trained in rounds of local steps on shards of the windows, whose weights are averaged.

A round is one job: each shard takes the shared weights, makes a few steps on its own windows and returns its weights with its
number of windows; averages by that number are the next round's weights. Shards have a bounded number of windows and are dealt
by hash, so more data means more shards, and a repeated run gives the same forecasts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialized
from . import signals

HIDDEN, ROUNDS, STEPS, RATE, SHARD_WINDOWS = 8, 10, 20, 0.03, 20_000
#: Windows of this many values forecast this many days ahead; shorter histories take the trend.
LENGTH, AHEAD = 14, 7
SPREAD, LEAST, MOST = 0.08, 0.05, 0.95
_SHAPES = [(3, HIDDEN), (3, HIDDEN, HIDDEN), (3, HIDDEN), (HIDDEN,), (1,)]


def first_weights(seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 0.5 / np.sqrt(HIDDEN), s).ravel() for s in _SHAPES])


def _split(w: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in _SHAPES:
        n = int(np.prod(s))
        out.append(w[at : at + n].reshape(s))
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def predicted(w: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """The cell's output after reading each row of x; keep gets what the way back needs."""
    a, u, b, v, c = _split(w)
    h = np.zeros((len(x), HIDDEN))
    for t in range(x.shape[1]):
        i = x[:, t, None]
        z, r = _sigmoid(i * a[0] + h @ u[0] + b[0]), _sigmoid(i * a[1] + h @ u[1] + b[1])
        n = np.tanh(i * a[2] + (r * h) @ u[2] + b[2])
        if keep is not None:
            keep.append((i, h, z, r, n))
        h = (1 - z) * n + z * h
    if keep is not None:
        keep.append(h)
    return h @ v + c[0]


def gradient(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of the mean squared error, back through all steps."""
    a, u, b, v, c = _split(w)
    keep: list = []
    error = 2 * (predicted(w, x, keep) - y) / len(y)
    last = keep.pop()
    da, du, db = np.zeros_like(a), np.zeros_like(u), np.zeros_like(b)
    dv, dc, dh = last.T @ error, np.array([error.sum()]), error[:, None] * v
    for i, h, z, r, n in reversed(keep):
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        back = dn @ u[2].T
        dr = back * h * r * (1 - r)
        for k, (d, into) in enumerate(((dz, h), (dr, h), (dn, r * h))):
            da[k] += (i * d).sum(0)
            du[k] += into.T @ d
            db[k] += d.sum(0)
        dh = dh * z + back * r + dz @ u[0].T + dr @ u[1].T
    return np.concatenate([da.ravel(), du.ravel(), db.ravel(), dv, dc])


def _stepped(w: np.ndarray, x: np.ndarray, y: np.ndarray, steps: int, rate: float) -> np.ndarray:
    m, s = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = gradient(w, x, y)
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)
    return w


def window_pairs(series: DataFrame, key: str, value: str, length: int = LENGTH, ahead: int = AHEAD) -> DataFrame:
    """(key, day, inputs, targets): ``length`` values and the ``ahead`` values after them; day is the last input's."""
    w = Window.partitionBy(key).orderBy("day")
    v = F.col(value).cast("double")
    rows = series.withColumn("inputs", F.collect_list(v).over(w.rowsBetween(1 - length, 0))).withColumn("targets", F.collect_list(v).over(w.rowsBetween(1, ahead)))
    return rows.where((F.size("inputs") == length) & (F.size("targets") == ahead)).select(key, "day", "inputs", "targets")


class Model:
    """Weights, and the mean and deviation that inputs are scaled by."""

    def __init__(self, weights: np.ndarray, mean: float, std: float):
        self.weights, self.mean, self.std = weights, mean, std

    def __call__(self, inputs: np.ndarray) -> np.ndarray:
        return predicted(self.weights, (inputs - self.mean) / self.std) * self.std + self.mean


def fitted(windows: DataFrame, key: str, rounds: int = ROUNDS, steps: int = STEPS, rate: float = RATE, seed: int = 42) -> Model | None:
    """A model of the last target; windows(key, day, inputs, targets). None without windows."""
    spark = windows.sparkSession
    n, mean, std = windows.select(F.explode("inputs").alias("v"), F.lit(1).alias("one")).agg(F.count("*"), F.avg("v"), F.stddev_pop("v")).first()
    if not n:
        return None
    std = std if std and std > 1e-9 else 1.0
    count = windows.count()
    shards = max(1, -(-count // SHARD_WINDOWS))
    dealt = windows.select(F.pmod(F.xxhash64(key, "day"), F.lit(shards)).cast("int").alias("shard"), F.concat_ws("|", F.col(key).cast("string"), F.col("day").cast("string")).alias("at"), "inputs", F.element_at("targets", -1).alias("label"))
    rows, w = materialized(dealt, "windows"), first_weights(seed)
    for number in range(rounds):
        shared, now = spark.sparkContext.broadcast(w), rate * 0.8**number

        def local(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("at")  # sums in one order, whatever order the rows came in
            x, y = (np.stack(frame["inputs"].to_numpy()) - mean) / std, (frame["label"].to_numpy() - mean) / std
            return pd.DataFrame({"n": [len(y)], "w": [_stepped(shared.value, x, y, steps, now).tolist()]})  # noqa: B023

        each = rows.groupBy("shard").applyInPandas(local, "n long, w array<double>")
        place = each.select("n", F.posexplode("w").alias("place", "v")).groupBy("place").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v"))
        w = np.round(np.array([r["v"] for r in place.orderBy("place").collect()]), 9)  # a row for each weight
    return Model(w, mean, std)


def forecasts(series: DataFrame, key: str, model: Model | None, length: int = LENGTH, ahead: int = AHEAD) -> DataFrame:
    """(key, forecast, low, high, method): the value ``ahead`` days on; series(key, series) in order of days.

    From ``length + ahead`` values on by the model, within .05 to .95 and .08 to either side; below that by the trend with its band;
    without values .5 between .3 and .7.
    """
    spark = series.sparkSession
    enough = (F.size("series") >= length + ahead) if model is not None else F.lit(False)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    shown = lambda df, how: df.select(key, F.round("forecast", 4).alias("forecast"), F.round(clip(F.col("forecast") - F.col("band")), 4).alias("low"), F.round(clip(F.col("forecast") + F.col("band")), 4).alias("high"), how.alias("method"))
    trend = signals.trend(series.where(~enough | F.col("series").isNull()), key, ahead).withColumn("forecast", F.element_at("forecast", -1))
    known = series.select(key, (F.size("series") > 0).alias("_any"))
    trend = trend.join(known, key).withColumn("forecast", F.when(F.col("_any"), F.col("forecast")).otherwise(0.5)).withColumn("band", F.when(F.col("_any"), F.col("band")).otherwise(0.2))
    out = shown(trend, F.when(F.col("_any"), "trend").otherwise("insufficient_data"))
    if model is None:
        return out
    shared, kind = spark.sparkContext.broadcast(model), series.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "forecast": np.clip(shared.value(np.stack(b["inputs"].to_numpy()).astype(float)), LEAST, MOST)})

    cell = series.where(enough).select(key, F.slice("series", -length, length).alias("inputs")).mapInPandas(run, f"{key} {kind}, forecast double").withColumn("band", F.lit(SPREAD))
    return shown(cell, F.lit("recurrent")).unionByName(out)


def history(suppliers: DataFrame, recent: DataFrame, days: int = 14) -> DataFrame:
    """(supplier_id, series, origin): the scores that a forecast starts from, where none were kept.

    suppliers(supplier_id, risk_score, ...), recent(supplier_id, recent_events, max_severity) of the last 30 days. With events: .3, the
    last three days at least .8 of the severest. Without: .85 of the risk (within .1 and 1), the last three at least .8 of
    the risk and .95 of it again, at most .95.
    """
    s = suppliers.join(recent.select("supplier_id", "max_severity"), "supplier_id", "left")
    risk = F.coalesce("risk_score", F.lit(0.5))
    base = F.when(F.col("max_severity").isNotNull(), 0.3).otherwise(F.greatest(F.lit(0.1), F.least(F.lit(1.0), risk * 0.85)))
    last = F.when(F.col("max_severity").isNotNull(), F.greatest(base, F.col("max_severity") * 0.8)).otherwise(F.greatest(base, risk * 0.8, F.least(F.lit(0.95), risk) * 0.95))
    origin = F.when(F.col("max_severity").isNotNull(), "events").otherwise("snapshot")
    return s.select("supplier_id", F.concat(F.array_repeat(base, days - 3), F.array_repeat(last, 3)).alias("series"), origin.alias("origin"))
