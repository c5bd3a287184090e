"""Effect of a treatment, adjusted for common causes, and attempts to refute it.

An estimate is the treatment's coefficient in a linear regression of the outcome on it and the common causes. All that it needs of
the data is one row of sums of products, so estimates of many variants of the data are one aggregate, grouped by variant; what
reaches the driver is a row of sums for each, and the systems that are solved there have a row for each common cause.

Variants are drawn by hashes of the key, so they are the same wherever and whenever they are made: placebos (the treatment
permuted among rows), a random common cause beside the given ones, and subsets of the rows.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialized
from .analytics import pearson

PLACEBOS, SUBSETS, SUBSET_SHARE = 20, 5, 0.8
#: Rows among which a placebo permutes, about.
PERMUTED_ROWS = 1 << 16
#: An effect counts from here on; a random cause may change it, and subsets may spread, by these shares of it at most.
LEAST_EFFECT, MOST_CHANGE, MOST_SPREAD, PLACEBO_LEVEL = 0.05, 0.1, 0.5, 0.05


def draw(key: Column, tag: Column) -> Column:
    """A number of 0 to 1 from the hash of key and tag."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), tag).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967296.0


def variants(pairs: DataFrame, key: str, x: str, y: str, causes: list[str]) -> DataFrame:
    """(kind, draw, x, y, c0, c1, ...): the rows of each variant; the last c is the random cause, 0 in other variants.

    Rows with a null in any of the columns take no part. Placebos permute within parts of the table of about ``PERMUTED_ROWS``.
    """
    whole = pairs.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(causes)]).na.drop()
    rows = materialized(whole, "pairs")
    parts = max(1, rows.count() // PERMUTED_ROWS)
    noise = f"c{len(causes)}"
    plain = rows.withColumn(noise, F.lit(0.0))
    number = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw")
    c = [f"c{i}" for i in range(len(causes) + 1)]
    # in the order of a hash, each row takes the treatment of the next one, the last that of the first
    order = Window.partitionBy("draw", "part").orderBy("o", "k")
    dealt = plain.select("*", number(PLACEBOS)).withColumn("part", F.floor(draw(F.col("k"), F.lit("part")) * parts)).withColumn("o", draw(F.col("k"), F.concat(F.lit("placebo"), F.col("draw").cast("string"))))
    placebo = dealt.withColumn("x", F.coalesce(F.lead("x").over(order), F.first("x").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    subset = plain.select("*", number(SUBSETS)).where(draw(F.col("k"), F.concat(F.lit("subset"), F.col("draw").cast("string"))) < SUBSET_SHARE)
    told = lambda df, kind: df.select(F.lit(kind).alias("kind"), "draw", "x", "y", *c)
    zero = F.lit(0).alias("draw")
    return (
        told(plain.select("*", zero), "estimate")
        .unionByName(told(rows.withColumn(noise, draw(F.col("k"), F.lit("cause"))).select("*", zero), "random_cause"))
        .unionByName(told(subset, "subset"))
        .unionByName(told(placebo, "placebo"))
    )


def effects(variant_rows: DataFrame, causes: int) -> list[tuple[str, int, int, float]]:
    """(kind, draw, rows, effect) of each variant; an effect is 0 where the treatment does not vary beside the causes."""
    columns = [F.lit(1.0), F.col("x"), *[F.col(f"c{i}") for i in range(causes)], F.col("y")]
    p = len(columns)
    cells = list(combinations_with_replacement(range(p), 2))
    sums = variant_rows.groupBy("kind", "draw").agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in cells])
    out = []
    for r in sums.orderBy("kind", "draw").collect():  # a row for each variant
        m = np.zeros((p, p))
        for i, j in cells:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        n = m[0, 0]
        centred = m[1:, 1:] - np.outer(m[0, 1:], m[0, 1:]) / n
        scale = np.sqrt(np.maximum(np.diag(centred), 0))
        scale[scale < 1e-9 * np.sqrt(n)] = np.inf  # a column that does not vary has no part
        unit = centred / np.outer(scale, scale)
        b = np.linalg.lstsq(unit[:-1, :-1] + np.diag((np.diag(unit)[:-1] == 0).astype(float)), unit[:-1, -1], rcond=1e-10)[0]
        out.append((r["kind"], r["draw"], int(n), float(b[0] * scale[-1] / scale[0]) if np.isfinite(scale[[0, -1]]).all() else 0.0))
    return out


def assessed(pairs: DataFrame, key: str, x: str, y: str, causes: list[str], least: int = 30) -> DataFrame:
    """One row: n, method, effect, what each refuter found, refutation_passed and causal_claim_allowed.

    Below 5 pairs insufficient_data, below ``least`` association_only (the correlation). Else adjusted_regression: refuted where
    a twentieth of the placebos, or more, have as large an effect, a random common cause changes it by a tenth, or subsets
    spread by half of it. A claim also needs an effect above .05.
    """
    spark, rows = pairs.sparkSession, variants(pairs, key, x, y, causes)
    kind = "n long, method string, effect double, placebo_share double, cause_change double, subset_spread double, refutation_passed boolean, causal_claim_allowed boolean"
    n, r = rows.where("kind = 'estimate'").agg(F.count("*"), pearson("x", "y")).first()
    if n < least:
        return spark.createDataFrame([(n, "insufficient_data" if n < 5 else "association_only", None if n < 5 else r, None, None, None, False, False)], kind)
    found = effects(rows, len(causes) + 1)
    of = lambda k: np.array([e for name, _, _, e in found if name == k])
    effect = float(of("estimate")[0])
    placebo = float((np.abs(of("placebo")) >= abs(effect)).mean())
    change, spread = float(abs(of("random_cause")[0] - effect)), float(np.abs(of("subset") - effect).max())
    passed = placebo < PLACEBO_LEVEL and change <= MOST_CHANGE * abs(effect) and spread <= MOST_SPREAD * abs(effect)
    return spark.createDataFrame([(n, "adjusted_regression", effect, placebo, change, spread, passed, passed and abs(effect) > LEAST_EFFECT)], kind)


#: What an alert says about each method's result.
DISCLAIMERS = {
    "insufficient_data": "Not enough pairs to say anything about causes.",
    "association_only": "Seen together; not a verified causal claim.",
    "adjusted_regression": "Adjusted regression with placebo, random cause and subset refuters.",
}


def with_causal_fields(alerts: DataFrame, assessment: DataFrame) -> DataFrame:
    """alerts plus what an ``assessed`` row says: whether a claim is allowed, its method, effect, pairs and disclaimer."""
    told = F.element_at(F.create_map(*[F.lit(x) for pair in DISCLAIMERS.items() for x in pair]), F.col("method"))
    row = assessment.select(F.col("causal_claim_allowed"), F.col("method").alias("causal_method"), F.round("effect", 4).alias("causal_effect_size"), F.col("n").alias("causal_sample_count"), told.alias("causal_disclaimer"))
    return alerts.crossJoin(F.broadcast(row))  # one row
