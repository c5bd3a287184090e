"""Composed reports: map layers, supplier explanations, documents for retrieval, facts for questions, event analysis, summaries."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import band_api, point
from . import graph, text
from .analytics import pearson


def map_events(events: DataFrame, affects: DataFrame, suppliers: DataFrame, kinds: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The severest events as map points; one without a place takes that of its linked supplier of the lowest id that has one.

    The kinds filter the limited list, as the layer is cut first.
    """
    best = events.orderBy(F.desc("severity"), "event_id").limit(limit)
    places = affects.select("event_id", "supplier_id").distinct().join(F.broadcast(best.select("event_id")), "event_id").join(suppliers.where("lat is not null").select("supplier_id", F.col("lat").alias("slat"), F.col("lon").alias("slon")), "supplier_id")
    first = places.groupBy("event_id").agg(F.min_by(F.struct("slat", "slon"), "supplier_id").alias("s"))
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = best.join(first, "event_id", "left").withColumn("at", F.when(own, F.struct("lat", "lon")).otherwise(F.struct(F.col("s.slat").alias("lat"), F.col("s.slon").alias("lon"))))
    rows = rows.where("at.lat is not null").select("event_id", "kind", "severity", F.col("at.lat").alias("lat"), F.col("at.lon").alias("lon"), own.alias("own_place"))
    rows = rows.withColumn("feature", point(F.col("lon"), F.col("lat"), kind=F.col("kind"), severity=F.col("severity")))
    return rows if kinds is None else rows.where(F.col("kind").isin(kinds))


def first_sector(name: Column, industry: Column) -> Column:
    """The first sector whose words a supplier has; automotive without any."""
    t = F.lower(F.concat_ws(" ", name, industry))
    return F.when(t.rlike("semiconductor|chip|electronics|taiwan"), "semiconductors").when(t.rlike("energy|oil|lng|chemical"), "energy").when(t.rlike("auto|motor|vehicle|parts"), "automotive").when(t.rlike("port|shipping|maritime|logistics"), "shipping").otherwise("automotive")


def explanations(suppliers: DataFrame, signals: DataFrame, tense: list[str]) -> DataFrame:
    """supplier_id, band, factors: what raises each supplier's risk and by how much; the baseline where nothing does."""
    s = suppliers.join(signals, "supplier_id", "left")
    n = F.coalesce("recent_events", F.lit(0))
    factor = lambda on, name, share: F.when(on, F.struct(F.lit(name).alias("feature"), share.cast("double").alias("contribution")))
    found = F.filter(
        F.array(factor(F.col("critical"), "critical_supplier", F.lit(0.22)), factor(F.col("single_source"), "single_source", F.lit(0.2)), factor(n > 0, "active_disruptions", F.least(F.lit(0.35), 0.12 * n)), factor(F.col("country").isin(tense), "geopolitical_exposure", F.lit(0.18))),
        lambda x: x.isNotNull(),
    )
    base = F.array(F.struct(F.lit("baseline").alias("feature"), F.lit(0.05).alias("contribution")))
    return s.select("supplier_id", band_api(F.col("risk_score")).alias("band"), F.when(F.size(found) > 0, found).otherwise(base).alias("factors"))


def supplier_documents(suppliers: DataFrame) -> DataFrame:
    """(id, source, text) of each supplier for retrieval; the id is a number made from the text's collection and key."""
    key = F.col("supplier_id").cast("string")
    body = F.concat(F.col("name"), F.lit(". Country: "), F.coalesce("country", F.lit("unknown")), F.lit(". Industry: "), F.coalesce("industry", F.lit("unknown")), F.lit(". Tier "), F.col("tier").cast("string"), F.when(F.col("critical"), F.lit(". Critical supplier.")).otherwise(F.lit(".")))
    return suppliers.select(text.document_id(F.lit("suppliers"), key).alias("id"), F.concat(F.lit("supplier/"), key).alias("source"), body.alias("text"))


def event_documents(events: DataFrame, most: int = 800) -> DataFrame:
    """(id, source, text) of each event, at most ``most`` characters."""
    key = F.col("event_id").cast("string")
    body = F.substring(F.concat(F.initcap(F.replace(F.col("kind"), F.lit("_"), F.lit(" "))), F.lit(" in "), F.coalesce("country", F.lit("Unknown")), F.lit(". "), F.coalesce("text", F.lit(""))), 1, most)
    return events.select(text.document_id(F.lit("events"), key).alias("id"), F.concat(F.lit("event/"), key).alias("source"), body.alias("text"))


def analyze(events: DataFrame) -> DataFrame:
    """Events with rule type, risk level and confidence, and the features that these imply."""
    kind, severity = text.event_class(F.col("text"))
    e = text.risk_levels(events.select("event_id", "text", kind.alias("event_type"), severity.alias("rule_severity"))).drop("text")
    high = F.col("level").isin("HIGH", "CRITICAL")
    return e.withColumn("proximity", F.when(high, 0.7).otherwise(0.1)).withColumn("critical_events", F.when(high, 1).otherwise(0)).withColumn("stability", 1 - text.level_score(F.col("level")))


def resolved_links(events: DataFrame, suppliers: DataFrame, chokepoints: DataFrame) -> DataFrame:
    """(event_id, target, id, score): entities of the texts resolved to suppliers (by name similarity) and chokepoints (by containment)."""
    found = text.entities(events.select("event_id", "text"))
    names = suppliers.select(F.col("supplier_id").cast("string").alias("id"), "name")
    mentions = found.where("kind = 'supplier'").select("event_id", F.col("entity").alias("mention")).distinct()
    s = text.fuzzy_match(mentions.select("mention").distinct(), names).join(mentions, "mention").select("event_id", F.lit("supplier").alias("target"), "id", "score")
    c = found.where("kind = 'chokepoint'").select("event_id", "entity").distinct().join(F.broadcast(chokepoints.select("chokepoint_id", "chokepoint_name")), F.lower("chokepoint_name").contains(F.lower("entity")))
    return s.unionByName(c.select("event_id", F.lit("chokepoint").alias("target"), F.col("chokepoint_id").cast("string").alias("id"), F.lit(100.0).alias("score")))


def gap_filled(timeline: DataFrame, notes: list[str]) -> DataFrame:
    """(day, n, note): every day between the first and last, days without entries with a note in turn."""
    days = timeline.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    turn = (F.datediff(F.col("day"), F.lit("1970-01-01").cast("date")) % len(notes) + 1).cast("int")
    return spine.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), F.element_at(F.array(*map(F.lit, notes)), turn)).alias("note"))


def first_critical(forecasts: DataFrame, key: str, threshold: float = 0.7) -> DataFrame:
    """(key, days): days until the first forecast at the threshold or above; null if none is."""
    hit = F.array_position(F.transform("forecast", lambda v: v >= threshold), True)
    return forecasts.select(key, F.when(hit > 0, hit.cast("int")).alias("days"))


def regime_summary(regimes: DataFrame) -> DataFrame:
    return regimes.agg(F.count("*").alias("regions"), *[F.count_if(F.col("regime") == r).alias(r) for r in ("stable", "escalation", "crisis")])


def snapshot_manifest(snapshots: DataFrame, least: int = 7) -> DataFrame:
    """One row: days, first and last, rows, and whether there are enough days to train on."""
    return snapshots.agg(F.countDistinct("snapshot_date").alias("days"), F.min("snapshot_date").alias("first"), F.max("snapshot_date").alias("last"), F.count("*").alias("rows")).withColumn("ready", F.col("days") >= least)


def embeddings(suppliers: DataFrame, neighbours: DataFrame, size: int = 32) -> DataFrame:
    """(supplier_id, vector): unit vectors from the hash of a supplier's id, its first eight neighbours', and its risk.

    neighbours(supplier_id, neighbour); their order is the id's.
    """
    rank = Window.partitionBy("supplier_id").orderBy("neighbour")
    first = neighbours.withColumn("r", F.row_number().over(rank)).where("r <= 8").groupBy("supplier_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "neighbour"))), lambda x: x["neighbour"].cast("string")).alias("near"))
    rows = suppliers.join(first, "supplier_id", "left").select("supplier_id", F.coalesce("near", F.array().cast("array<string>")).alias("near"), F.coalesce("risk_score", F.lit(0.0)).alias("risk"))

    def draw(key: str, spread: float) -> np.ndarray:
        return np.random.default_rng(int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)).normal(0, spread, size)

    def run(batches):
        for batch in batches:
            out = []
            for i, near, risk in zip(batch["supplier_id"], batch["near"], batch["risk"]):
                v = draw(str(i), 1.0) + sum((draw(n, 0.3) / (k + 2) for k, n in enumerate(near)), np.zeros(size)) + 0.15 * risk
                out.append((v / np.linalg.norm(v)).tolist())
            yield pd.DataFrame({"supplier_id": batch["supplier_id"], "vector": out})

    cores = rows.sparkSession.sparkContext.defaultParallelism  # rows are few bytes and much work, so they are dealt by number
    return rows.repartition(cores).mapInPandas(run, "supplier_id long, vector array<double>")


def influential(edges: DataFrame, suppliers: DataFrame, top: int = 5) -> DataFrame:
    """(node, rank, neighbour, weight): each supplier's riskiest neighbours, weighing .8 of their risk."""
    risk = suppliers.select(F.concat(F.lit("supplier-"), F.col("supplier_id").cast("string")).alias("next"), "risk_score")
    near = graph.undirected(edges).where("node_type = 'supplier' and next_type = 'supplier'").select("node", "next").distinct().join(risk, "next")
    order = Window.partitionBy("node").orderBy(F.desc("risk_score"), "next")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("node", "rank", F.col("next").alias("neighbour"), (0.8 * F.col("risk_score")).alias("weight"))


def keywords(question: Column, most: int = 8) -> Column:
    """Up to eight distinct words of three letters or more, but common ones."""
    common = ["the", "and", "for", "are", "what", "which", "how", "why", "who", "our", "with", "from", "that", "this", "does", "have", "has", "was", "were", "any", "about"]
    return F.slice(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(question), F.lit("[a-z]{3,}"), 0), lambda w: ~w.isin(common))), 1, most)


def facts(questions: DataFrame, suppliers: DataFrame, per_question: int = 5) -> DataFrame:
    """(question_id, rank, fact): suppliers whose name, country or industry holds a word of the question, riskiest first.

    Words are the join key, so no question meets every supplier. Questions that ask for a number get facts only.
    """
    asked = questions.select("question_id", F.explode(keywords(F.col("question"))).alias("word"))
    said = suppliers.select("supplier_id", "name", "country", "risk_score", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "country", "industry")), F.lit("[a-z]{3,}"), 0))).alias("word"))
    hits = asked.join(said, "word").select("question_id", "supplier_id", "name", "country", "risk_score").distinct()
    rank = Window.partitionBy("question_id").orderBy(F.desc("risk_score"), "supplier_id")
    fact = F.concat("name", F.lit(" in "), "country", F.lit(" is rated "), band_api(F.col("risk_score")))
    return hits.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_question).select("question_id", "rank", fact.alias("fact"))


def causal_assessment(pairs: DataFrame, x: str, y: str, order: str, least: int = 30) -> DataFrame:
    """One row: pairs, method, effect and whether a causal claim is allowed.

    Below 5 pairs insufficient_data, below ``least`` association_only (the correlation). Else the slope of y on x after
    weekly means are taken off both; it must exceed .05, and the effect of a random placebo, both by a standard deviation, must stay below half of it.
    """
    season = F.pmod(F.col(order), F.lit(7))
    w = Window.partitionBy("_s")
    r = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_s", season)
    r = r.withColumn("_x", F.col(x) - F.avg(x).over(w)).withColumn("_y", F.col(y) - F.avg(y).over(w))
    r = r.withColumn("_p", F.conv(F.substring(F.md5(F.concat(F.col(order).cast("string"), F.lit("|11")).cast("binary")), 1, 8), 16, 10).cast("long") % 1000 / 1000.0)
    a = r.agg(F.count("*").alias("n"), pearson(x, y).alias("r"), F.regr_slope("_y", "_x").alias("slope"), (F.regr_slope("_y", "_p") * F.stddev_pop("_p")).alias("placebo"), F.stddev_pop("_x").alias("spread"))
    enough = F.col("n") >= least
    method = F.when(F.col("n") < 5, "insufficient_data").when(~enough, "association_only").otherwise("adjusted_regression")
    effect = F.when(F.col("n") < 5, None).when(~enough, F.col("r")).otherwise(F.col("slope"))
    allowed = enough & (F.abs("slope") > 0.05) & (F.abs("placebo") < 0.5 * F.abs("slope") * F.col("spread"))
    return a.select("n", method.alias("method"), F.round(effect, 6).alias("effect"), F.coalesce(allowed, F.lit(False)).alias("causal_claim_allowed"))


#: Words of a question that lead to a scenario; the first scenario with one wins.
SCENARIO_WORDS = {
    "red-sea-bab-el-mandeb": ["red sea", "houthi", "bab"],
    "taiwan-strait-tension": ["taiwan", "semiconductor", "chip"],
    "suez-canal-blockage": ["suez", "canal"],
    "russia-ukraine-supply": ["ukraine", "russia"],
    "us-iran-hormuz": ["hormuz", "iran"],
    "china-us-trade": ["china", "tariff", "export control"],
}
#: Fixed value: questions that ask for a number.
ASKS_NUMBER = r"(?i)\b(\d{1,3})\s*%\s*(risk|scri|score)|risk\s*(score|level)\s*(is|of|at)\s*(\d+\.?\d*)|what\s+is\s+the\s+risk\s+score"


def scenario_of(question: Column) -> Column:
    """The first scenario that one of its words in the question leads to, or null."""
    q = F.lower(question)
    hit = F.lit(None).cast("string")
    for scenario, words in reversed(SCENARIO_WORDS.items()):
        hit = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w)), scenario).otherwise(hit)
    return hit


def answers(questions: DataFrame, suppliers: DataFrame, per_question: int = 5) -> DataFrame:
    """(question_id, scenario_id, grounded, answer): what the tables can say to each question, and nothing else.

    A question for a number is told the scores of the suppliers that it names, or refused where there are none; others are
    told the facts that hold their words, with the scenario to look at. Without either nothing is claimed.
    """
    found = facts(questions, suppliers, per_question).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fact"))), lambda x: x["fact"]), "; ").alias("facts"))
    asked = questions.select("question_id", F.explode(keywords(F.col("question"))).alias("word"))
    named = suppliers.where("risk_score is not null").select("supplier_id", "name", "risk_score", F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", "country", "industry")), F.lit("[a-z]{3,}"), 0))).alias("word"))
    rank = Window.partitionBy("question_id").orderBy(F.desc("risk_score"), "supplier_id")
    known = asked.join(named, "word").select("question_id", "supplier_id", "name", "risk_score").distinct().withColumn("n", F.row_number().over(rank)).where(F.col("n") <= per_question)
    scores = known.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "name", "risk_score"))), lambda x: F.concat(x["name"], F.lit(" "), F.floor(x["risk_score"] * 100).cast("string"), F.lit(" %"))), "; ").alias("scores"))
    q = questions.join(found, "question_id", "left").join(scores, "question_id", "left").withColumn("scenario_id", scenario_of(F.col("question")))
    number = F.col("question").rlike(ASKS_NUMBER)
    text_ = (
        F.when(number & F.col("scores").isNull(), "No scores are known for this question, so no number is given.")
        .when(number, F.concat(F.lit("Known scores: "), F.col("scores"), F.lit(".")))
        .when(F.col("scenario_id").isNotNull(), F.concat(F.lit("See scenario "), F.col("scenario_id"), F.lit(". Facts: "), F.coalesce("facts", F.lit("none")), F.lit(".")))
        .when(F.col("facts").isNotNull(), F.concat(F.lit("No scenario fits. Facts: "), F.col("facts"), F.lit(".")))
        .otherwise("The tables do not say.")
    )
    grounded = number | F.col("scenario_id").isNotNull() | F.col("facts").isNotNull()
    return q.select("question_id", "scenario_id", grounded.alias("grounded"), text_.alias("answer"))


def scenario_documents(scenarios: DataFrame) -> DataFrame:
    """(id, source, text) of scenarios(id, name, description, region, sectors, severity, mitigations): three mitigations at most."""
    key = F.col("id")
    body = F.concat(F.coalesce("name", key), F.lit(". "), F.coalesce("description", F.lit("")), F.lit(" Region: "), F.coalesce("region", F.lit("")), F.lit(". Sectors: "), F.array_join(F.coalesce("sectors", F.array().cast("array<string>")), ", "), F.lit(". Severity: "), F.coalesce(F.col("severity").cast("string"), F.lit("")), F.lit(". Mitigations: "), F.array_join(F.slice(F.coalesce("mitigations", F.array().cast("array<string>")), 1, 3), "; "))
    return scenarios.select(text.document_id(F.lit("scenarios"), key).alias("id"), F.concat(F.lit("simulation/"), key).alias("source"), F.trim(body).alias("text"))


def backtest_documents(cases: DataFrame) -> DataFrame:
    """(id, source, text) of past cases(id, title, description, region, lessons)."""
    key = F.col("id")
    body = F.concat(F.coalesce("title", key), F.lit(". "), F.coalesce("description", F.lit("")), F.lit(" Region: "), F.coalesce("region", F.lit("")), F.lit(". Lessons: "), F.array_join(F.coalesce("lessons", F.array().cast("array<string>")), "; "))
    return cases.select(text.document_id(F.lit("backtests"), key).alias("id"), F.concat(F.lit("backtest/"), key).alias("source"), F.trim(body).alias("text"))


def message_documents(events: DataFrame, most: int = 800) -> DataFrame:
    """(id, text) of event messages(event_id, event_type, region, country, description, actors); those without an id are dropped."""
    place = F.coalesce("region", "country", F.lit("Unknown"))
    kind = F.initcap(F.replace(F.coalesce("event_type", F.lit("event")), F.lit("_"), F.lit(" ")))
    actor = F.try_element_at("actors", F.lit(1))
    head = F.when(actor.isNotNull(), F.concat(kind, F.lit(" — "), actor, F.lit(" ("), place, F.lit(")"))).otherwise(F.concat(kind, F.lit(" in "), place))
    body = F.concat(head, F.lit(". "), F.coalesce("description", F.lit("Geopolitical signal")), F.lit(" Region: "), place)
    return events.where("event_id is not null").select(F.col("event_id").alias("id"), F.substring(F.trim(body), 1, most).alias("text"))


def recommendations(suppliers: DataFrame, top: int = 3) -> DataFrame:
    """(rank, recommendation) for the riskiest suppliers: a review of them, contingency plans where one is critical, and standing advice."""
    best = suppliers.orderBy(F.desc("risk_score"), "supplier_id").limit(top)
    row = best.agg(F.count("*").alias("n"), F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("worst"))
    told = F.filter(
        F.array(
            F.when(F.col("n") > 0, F.concat(F.lit("Review the "), F.col("n").cast("string"), F.lit(" riskiest suppliers now"))),
            F.when(F.col("worst") > 0.8, F.lit("Start contingency plans for critical suppliers")),
            F.lit("Check stock of the products they make"),
            F.lit("Look for other suppliers"),
            F.lit("Tell stakeholders what changed"),
        ),
        lambda x: x.isNotNull(),
    )
    return row.select(F.posexplode(told).alias("at", "recommendation")).select((F.col("at") + 1).alias("rank"), "recommendation")
