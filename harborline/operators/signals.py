"""Series per entity: calendars, windows, changepoints, trends, regimes, anomalies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, key: str, as_of, days: int = 30) -> DataFrame:
    """(key, day, n) for each of the last ``days`` days of every key seen in them, days without events as 0."""
    last = F.to_date(F.lit(as_of))
    seen = events.where(F.to_date("ts") > F.date_sub(last, days)).groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    spine = seen.select(key).distinct().withColumn("day", F.explode(F.sequence(F.date_sub(last, days - 1), last)))
    return spine.join(seen, [key, "day"], "left").select(key, "day", F.coalesce("n", F.lit(0)).alias("n"))


def window_features(series: DataFrame, key: str, value: str, size: int = 7) -> DataFrame:
    """Mean, population deviation, largest value and slope of each full window of ``size`` rows ending at a day."""
    rows = Window.partitionBy(key).orderBy("day").rowsBetween(1 - size, 0)
    x = F.row_number().over(Window.partitionBy(key).orderBy("day")).cast("double")
    s = series.withColumn("_x", x)
    v = F.col(value).cast("double")
    return (
        s.withColumn("_n", F.count("*").over(rows))
        .withColumn("mean", F.avg(v).over(rows))
        .withColumn("std", F.stddev_pop(v).over(rows))
        .withColumn("top", F.max(v).over(rows))
        .withColumn("slope", F.covar_pop(v, F.col("_x")).over(rows) / F.var_pop("_x").over(rows))
        .where(F.col("_n") == size)
        .select(key, "day", "mean", "std", "top", "slope")
    )


def as_series(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, series): each key's values in day order. A key's days are few; they are sorted in one aggregate."""
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("day", F.col(value).cast("double").alias("v")))), lambda x: x["v"]).alias("series"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def changepoint(series: DataFrame, key: str, lookback: int = 14, threshold: float = 5.0, drift: float = 0.5) -> DataFrame:
    """One-sided CUSUM over the last ``lookback`` values, with rates before and in the last three; fewer than three: no signal."""
    s = series.withColumn("w", F.when(F.size("series") > lookback, F.slice("series", -lookback, lookback)).otherwise(F.col("series")))
    n = F.size("w")
    enough = n >= 3
    mean = _sum(F.slice("w", 1, F.greatest(n - 1, F.lit(0)))) / F.greatest(n - 1, F.lit(1))
    s = s.withColumn("_mean", mean)
    stat = F.aggregate("w", F.lit(0.0), lambda a, x: F.greatest(F.lit(0.0), a + x - F.col("_mean") - drift))
    before = F.when(n > 3, _sum(F.slice("w", 1, F.greatest(n - 3, F.lit(0)))) / F.greatest(n - 3, F.lit(1))).otherwise(F.try_element_at("w", F.lit(1)))
    out = s.select(key, F.when(enough, stat).otherwise(0.0).alias("statistic"), F.when(enough, before).otherwise(0.0).alias("baseline_rate"), F.when(enough, _sum(F.slice("w", -3, 3)) / 3).otherwise(0.0).alias("current_rate"))
    return out.withColumn("detected", F.col("statistic") >= threshold)


def trend(series: DataFrame, key: str, ahead: int = 7) -> DataFrame:
    """Least-squares line through each series, its direction and strength, and ``ahead`` forecasts within 0 to 1 (band .15).

    Below two points: flat at the last value (0 without one), band .1.
    """
    points = series.select(key, F.posexplode_outer("series").alias("i", "v"))
    fit = points.groupBy(key).agg(F.regr_slope("v", F.col("i").cast("double")).alias("slope"), F.regr_intercept("v", F.col("i").cast("double")).alias("intercept"), F.count("v").alias("n"), F.max_by("v", "i").alias("last"))
    steep = F.coalesce("slope", F.lit(0.0))
    at = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("n") >= 2, F.col("intercept") + F.col("slope") * (F.col("n") + i - 1)).otherwise(F.coalesce("last", F.lit(0.0)))))
    values = F.transform(F.sequence(F.lit(1), F.lit(ahead)), at)
    return fit.select(key, steep.alias("slope"), F.when(steep > 0.01, "increasing").when(steep < -0.01, "decreasing").otherwise("stable").alias("direction"), F.least(F.lit(1.0), F.abs(steep) * 10).alias("strength"), values.alias("forecast"), F.when(F.col("n") >= 2, 0.15).otherwise(0.1).alias("band"))


def regional_rate(events: DataFrame, region: str, as_of, days: int = 30) -> DataFrame:
    """(region, day, rate): half the day's share of its region's busiest day, half its mean severity. Days without events are not made up."""
    daily = events.where(F.to_date("ts") > F.date_sub(F.to_date(F.lit(as_of)), days)).groupBy(region, F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg("severity").alias("severity"))
    return daily.select(region, "day", (0.5 * F.col("n") / F.max("n").over(Window.partitionBy(region)) + 0.5 * F.col("severity")).alias("rate"))


def threshold_regime(series: DataFrame, key: str) -> DataFrame:
    """crisis at a mean of .75 or more over the last seven values, escalation at .45, else stable; with its confidence."""
    tail = F.when(F.size("series") > 7, F.slice("series", -7, 7)).otherwise(F.col("series"))
    rate = F.when(F.size("series") > 0, _sum(tail) / F.size(tail)).otherwise(0.0)
    r = series.select(key, rate.alias("rate"), (F.size("series") > 0).alias("_any"))
    x = F.col("rate")
    regime = F.when(x >= 0.75, "crisis").when(x >= 0.45, "escalation").otherwise("stable")
    sure = F.when(x >= 0.75, F.least(F.lit(0.95), 0.6 + x * 0.3)).when(x >= 0.45, F.least(F.lit(0.9), 0.5 + x * 0.35)).otherwise(F.least(F.lit(0.9), 0.55 + (1 - x) * 0.3))
    return r.select(key, "rate", regime.alias("regime"), F.when(F.col("_any"), sure).otherwise(0.0).alias("confidence"))


def hidden_regime(series: DataFrame, key: str, seed: int = 42, rounds: int = 50) -> DataFrame:
    """Three-state Gaussian hidden Markov model per key (Baum-Welch), states named by their means; below five values none.

    One key's series is one small array; keys are independent.
    """

    def fit(batches):
        for batch in batches:
            rows = [_hmm(np.asarray(x, float), seed, rounds) for x in batch["series"]]
            yield pd.DataFrame({key: batch[key], "regime": [r[0] for r in rows], "confidence": [r[1] for r in rows]})

    kind = series.schema[key].dataType.simpleString()
    return series.where(F.size("series") >= 5).select(key, "series").mapInPandas(fit, f"{key} {kind}, regime string, confidence double")


def _hmm(x: np.ndarray, seed: int, rounds: int) -> tuple[str, float]:
    mean = np.quantile(x, [0.15, 0.5, 0.85]) + np.random.default_rng(seed).normal(0, 1e-3, 3)
    var, start, move = np.full(3, x.var() + 1e-3), np.full(3, 1 / 3), np.full((3, 3), 0.1) + 0.7 * np.eye(3)
    for _ in range(rounds):
        like = np.exp(-0.5 * (x[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        fore, back, scale = np.empty_like(like), np.ones_like(like), np.empty(len(x))
        for t in range(len(x)):
            fore[t] = like[t] * (start if t == 0 else fore[t - 1] @ move)
            scale[t] = fore[t].sum()
            fore[t] /= scale[t]
        for t in range(len(x) - 2, -1, -1):
            back[t] = move @ (like[t + 1] * back[t + 1]) / scale[t + 1]
        state = fore * back
        state /= state.sum(1, keepdims=True)
        pair = sum(np.outer(fore[t], like[t + 1] * back[t + 1]) * move / scale[t + 1] for t in range(len(x) - 1))
        start, move = state[0], pair / pair.sum(1, keepdims=True)
        mean = (state * x[:, None]).sum(0) / state.sum(0)
        var = np.maximum((state * (x[:, None] - mean) ** 2).sum(0) / state.sum(0), 1e-4)
    names = {int(k): n for k, n in zip(np.argsort(mean), ("stable", "escalation", "crisis"))}
    now = int(state[-1].argmax())
    return names[now], float(state[-1, now])


def training_sequences(series: DataFrame, key: str, value: str, length: int = 7) -> DataFrame:
    """(key, day, inputs, label): each value with the ``length`` values before it; keys need more than ``length`` values."""
    back = Window.partitionBy(key).orderBy("day").rowsBetween(-length, -1)
    return series.withColumn("inputs", F.collect_list(F.col(value).cast("double")).over(back)).where(F.size("inputs") == length).select(key, "day", "inputs", F.col(value).cast("double").alias("label"))


def anomalies(rows: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """rows' key, day and an isolation-forest score per key: how soon random cuts part a day from the key's other days.

    Fitted per key on its standardised window features; a tree looks at ``sample`` of them at most, as the method has it.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day")
        x = frame[columns].to_numpy(float)
        x = (x - x.mean(0)) / np.where(x.std(0) > 0, x.std(0), 1)
        rng = np.random.default_rng(seed)
        m = min(sample, len(x))
        depth = np.zeros(len(x))
        for _ in range(trees):
            depth += _isolate(x, x[rng.choice(len(x), m, replace=False)], rng, int(np.ceil(np.log2(max(m, 2)))))
        return pd.DataFrame({key: frame[key], "day": frame["day"], "score": 2.0 ** (-depth / trees / max(_path(m), 1e-9))})

    kind = rows.schema[key].dataType.simpleString()
    return rows.groupBy(key).applyInPandas(fit, f"{key} {kind}, day date, score double")


def _path(n: int) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _isolate(x: np.ndarray, base: np.ndarray, rng: np.random.Generator, most: int) -> np.ndarray:
    out = np.zeros(len(x))
    todo = [(np.arange(len(x)), base, 0)]
    while todo:
        at, b, d = todo.pop()
        spread = np.flatnonzero(np.ptp(b, axis=0) > 0) if len(b) > 1 else []
        if d >= most or len(b) <= 1 or not len(spread):
            out[at] = d + _path(len(b))
            continue
        c = rng.choice(spread)
        cut = rng.uniform(b[:, c].min(), b[:, c].max())
        todo += [(at[x[at, c] < cut], b[b[:, c] < cut], d + 1), (at[x[at, c] >= cut], b[b[:, c] >= cut], d + 1)]
    return out
