"""Text operators: rule classifiers, entity spans, chunks, embeddings, retrieval, name matching."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialized
from .names import common_length, fuzzy_match, indel_ratio, token_set_ratio  # noqa: F401
from .vectors import Cells

#: Patterns in order, the event type and severity each stands for.
EVENT_RULES = [
    (r"\b(war|invasion|airstrike|missile|bombing|armed conflict)\b", "armed_conflict", 0.9),
    (r"\b(blockade|port closed|canal blocked|shipping halted)\b", "port_disruption", 0.85),
    (r"\b(sanction|embargo|export ban|trade restriction)\b", "sanctions", 0.75),
    (r"\b(protest|strike|riot|demonstration|unrest)\b", "civil_unrest", 0.6),
    (r"\b(hurricane|earthquake|flood|wildfire|typhoon|cyclone)\b", "natural_disaster", 0.8),
    (r"\b(cyber|ransomware|hack|data breach)\b", "cyber_incident", 0.7),
    (r"\b(tariff|trade war|export control|diplomatic)\b", "trade_tension", 0.55),
    (r"\b(congestion|delay|backlog|shortage)\b", "logistics_delay", 0.5),
]
#: Risk words by level.
RISK_WORDS = {
    "CRITICAL": ["war", "invasion", "missile", "bombing", "airstrike", "cyberattack", "ransomware", "port closed", "port blockade", "hurricane", "earthquake", "tsunami", "flood"],
    "HIGH": ["protest", "strike", "demonstration", "riot", "port congestion", "shipping delay", "supply shortage", "trade war", "sanctions", "embargo"],
    "MEDIUM": ["tension", "dispute", "investigation", "regulatory", "policy change", "customs delay"],
    "LOW": ["minor", "small", "localized", "temporary"],
}
#: Query words that lead to a collection, and how many documents each collection then gives.
ROUTES = [
    (r"(?i)\b(how\s+calculated|methodology|scri|conformal|shap|xgboost|metrics)\b", [("methodology", 4), ("events", 1), ("suppliers", 1)]),
    (r"(?i)\b(suez|ukraine|ever\s+given|backtest|2021|2022|historical)\b", [("backtests", 4), ("scenarios", 2), ("events", 1)]),
    (r"(?i)\b(region|sector|cluster|community|chokepoint|corridor|geography)\b", [("graph_communities", 3), ("suppliers", 2), ("events", 1)]),
]
DEFAULT_ROUTE = [("events", 2), ("suppliers", 2), ("methodology", 1), ("scenarios", 1), ("backtests", 1), ("graph_communities", 1)]


#: Fixed value: where a place name stands.
PLACE = r"(?i)\b(?:in|at|near|around)\s+([A-Z][a-zA-Z\s\-]{2,40})(?:[,\.]|\s+(?:port|canal|strait|region))"


#: Fixed value: a run of capitalised words; fixed values: words that are none by themselves.
NAMES = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,3})\b"
NO_NAMES = ["The", "A", "An", "In", "At", "On", "For", "And", "Or", "Red", "Sea"]


def named(text: Column) -> Column:
    """Up to eight runs of capitalised words, of three letters or more, in order."""
    found = F.regexp_extract_all(text, F.lit(NAMES), 1)
    return F.slice(F.filter(found, lambda x: ~x.isin(NO_NAMES) & (F.length(x) > 2)), 1, 8)


def event_class(text: Column) -> tuple[Column, Column]:
    """(type, severity) by the first rule that matches; under five characters unknown .3, no rule general_signal .4."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    kind, level = F.lit("general_signal"), F.lit(0.4)
    for pattern, name, value in reversed(EVENT_RULES):
        kind, level = F.when(t.rlike(pattern), name).otherwise(kind), F.when(t.rlike(pattern), value).otherwise(level)
    return F.when(F.length(t) < 5, "unknown").otherwise(kind), F.when(F.length(t) < 5, 0.3).otherwise(level)


def locations(text: Column) -> Column:
    """Up to five places named after in, at, near or around."""
    found = F.regexp_extract_all(text, F.lit(PLACE), 1)
    return F.slice(F.array_distinct(F.transform(found, lambda x: F.trim(x))), 1, 5)  # a bare F.trim would take the place for what to trim


def _level_counts(lowered: Column) -> list[Column]:
    return [reduce(lambda a, b: a + b, [lowered.contains(w).cast("int") for w in words]) for words in RISK_WORDS.values()]


def _level_of(n: list[Column]) -> tuple[Column, Column]:
    best, total = F.greatest(*n), reduce(lambda a, b: a + b, n)
    level = F.lit("NONE")
    for c, name in zip(n, RISK_WORDS):  # the last that reaches the greatest count wins
        level = F.when((total > 0) & (c == best), name).otherwise(level)
    return level, F.when(total == 0, 1.0).otherwise(best / total)


def risk_level(text: Column) -> tuple[Column, Column]:
    """(level, confidence): share of the levels' words found in the text; NONE without any; ties go to the lower level."""
    return _level_of(_level_counts(F.lower(F.coalesce(text, F.lit("")))))


def risk_levels(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows plus level and confidence as ``risk_level`` tells them; the counts are made once, in a projection of their own."""
    lowered = rows.withColumn("_t", F.lower(F.coalesce(F.col(text), F.lit(""))))
    counted = lowered.withColumns({f"_n{i}": c for i, c in enumerate(_level_counts(F.col("_t")))}).drop("_t")
    level, sure = _level_of([F.col(f"_n{i}") for i in range(len(RISK_WORDS))])
    return counted.select(*rows.columns, level.alias("level"), sure.alias("confidence"))


def level_score(level: Column) -> Column:
    return F.when(level == "CRITICAL", 1.0).when(level == "HIGH", 0.75).when(level == "MEDIUM", 0.5).when(level == "LOW", 0.25).when(level == "NONE", 0.0).otherwise(0.5)


#: The space characters of Unicode, which paragraphs are trimmed of.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def chunks(docs: DataFrame, text: str = "text", size: int = 600) -> DataFrame:
    """docs' rows exploded into (chunk_no, chunk): paragraphs, without ``SPACES`` around, packed greedily up to ``size`` characters;
    a longer one stays whole."""
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n\n"), lambda p: F.trim(p, F.lit(SPACES))), lambda p: p != "")
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def pack(s, p):
        fits = (s["open"] != "") & (F.length(s["open"]) + F.length(p) + 2 <= size)
        return (
            F.when(s["open"] == "", F.struct(s["done"].alias("done"), p.alias("open")))
            .when(fits, F.struct(s["done"].alias("done"), F.concat(s["open"], F.lit("\n\n"), p).alias("open")))
            .otherwise(F.struct(F.array_append(s["done"], s["open"]).alias("done"), p.alias("open")))
        )

    packed = F.aggregate(parts, empty, pack, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.array_append(s["done"], s["open"])))
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(packed).alias("chunk_no", "chunk"))


def document_id(collection: Column, key: Column) -> Column:
    """A number from the first fifteen hex digits of sha-256."""
    return F.conv(F.substring(F.sha2(F.concat(collection, F.lit(":"), key), 256), 1, 15), 16, 10).cast("long")


def route(query: Column) -> Column:
    """The collections a query asks, with a limit each."""
    as_array = lambda r: F.array(*[F.struct(F.lit(c).alias("collection"), F.lit(n).alias("most")) for c, n in r])
    out = as_array(DEFAULT_ROUTE)
    for pattern, r in reversed(ROUTES):
        out = F.when(query.rlike(pattern), as_array(r)).otherwise(out)
    return out


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def in_rounds(queries: DataFrame, key: str, block: int, answer) -> DataFrame | None:
    """The union of answer(rows) over blocks of about ``block`` rows of a stated query set, dealt by a hash of their key.

    One block at a time is on the driver. Where there are several, each one's answers are written before the next is fetched.
    """
    rounds = max(1, -(-queries.count() // block))
    parts = []
    for number in range(rounds):
        asked = queries.where(F.pmod(F.xxhash64(key), F.lit(rounds)) == number).orderBy(key).collect()
        if asked:
            parts.append(answer(asked) if rounds == 1 else materialized(answer(asked), "answers"))
    return reduce(DataFrame.unionByName, parts) if parts else None


def vector_top_k(queries: DataFrame, rows: DataFrame, k: int, query_block: int = 256) -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows by cosine for each query; queries(query_id, vector), rows(id, vector).

    A stated query set against all rows: queries are broadcast in blocks of bounded size, each task keeps its best k per
    query, and those are merged. A row of the query's own id is left out; ties go to the smaller id.
    """

    def answer(asked: list) -> DataFrame:
        ids, q = np.array([r["query_id"] for r in asked]), np.array([r["vector"] for r in asked], float)
        shared = queries.sparkSession.sparkContext.broadcast((ids, q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)))

        def run(batches):
            ids, q = shared.value
            best_s, best_i = np.full((len(ids), k), -2.0), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                v = np.stack(batch["vector"].to_numpy()).astype(float)
                s = np.round(q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).T, 6)
                i = batch["id"].to_numpy()
                s[ids[:, None] == i[None, :]] = -2.0
                s, i = np.concatenate([best_s, s], 1), np.concatenate([best_i, np.broadcast_to(i, (len(ids), len(i)))], 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            a, b = np.nonzero(best_s > -2.0)
            yield pd.DataFrame({"query_id": ids[a], "id": best_i[a, b], "score": best_s[a, b]})

        return rows.select("id", "vector").mapInPandas(run, "query_id long, id long, score double")

    out = in_rounds(queries, "query_id", query_block, answer)
    if out is None:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def routed_search(queries: DataFrame, hits: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, rank, collection, id, score): hits of the collections that each query is routed to, merged by score.

    queries(query_id, query); hits(query_id, collection, id, score). Each collection gives as many as the route says.
    """
    routes = queries.select("query_id", F.explode(route(F.col("query"))).alias("r")).select("query_id", "r.collection", F.col("r.most").alias("most"))
    inside = Window.partitionBy("query_id", "collection").orderBy(F.desc("score"), "id")
    kept = hits.join(F.broadcast(routes), ["query_id", "collection"]).withColumn("n", F.row_number().over(inside)).where(F.col("n") <= F.col("most"))
    merged = Window.partitionBy("query_id").orderBy(F.desc("score"), "collection", "id")
    return kept.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= most).select("query_id", "rank", "collection", "id", "score")


def collection_hits(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, collection, id, score): the nearest rows of each collection that a query is routed to, as many as any route wants.

    queries(query_id, query, vector); rows(id, vector, kind), the kind being the collection. Exact, by ``vectors.Cells``.
    """
    most = max(n for r in [DEFAULT_ROUTE, *(r for _, r in ROUTES)] for _, n in r)
    asked = queries.select("query_id", "vector", F.explode(route(F.col("query"))).alias("r")).select("query_id", "vector", F.col("r.collection").alias("kind"))
    return Cells(rows).search(asked, most, skip_own=False).select("query_id", F.col("kind").alias("collection"), "id", "score")


def hash_embedding(texts: DataFrame, text: str = "text", size: int = 384) -> DataFrame:
    """texts plus vector: unit normals drawn from the first eight bytes of the text's sha-256. Equal texts have equal vectors."""

    def run(batches):
        for batch in batches:
            rows = []
            for t in batch[text]:
                v = np.random.default_rng(int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "big")).standard_normal(size).astype(np.float32)
                rows.append((v / np.linalg.norm(v)).tolist())
            yield batch.assign(vector=rows)

    return texts.mapInPandas(run, texts.withColumn("vector", F.array(F.lit(0.0).cast("float"))).schema)


def dedupe_by(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each non-empty key in the given order."""
    return rows.where((F.col(key) != "") & F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def within_budget(rows: DataFrame, query: str, order: str, text: str, budget: int = 4000) -> DataFrame:
    """Rows of each query in order while their texts' running length stays within the budget; the one that crosses it is cut."""
    before = F.coalesce(F.sum(F.length(text)).over(Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).where(F.col("_before") < budget).withColumn(text, F.substring(F.col(text), F.lit(1), (F.lit(budget) - F.col("_before")).cast("int"))).drop("_before")


#: Chokepoint names that texts mention.
CHOKEPOINTS = ["suez canal", "panama canal", "strait of hormuz", "bab el mandeb", "strait of malacca", "bosphorus", "strait of gibraltar", "red sea", "black sea", "taiwan strait", "south china sea", "cape of good hope"]


def entities(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts exploded into (kind, entity, start, end, confidence): chokepoints .95, ports .7, suppliers .6; overlaps go to the surer, then the earlier."""
    choke = re.compile(r"\b(" + "|".join(map(re.escape, CHOKEPOINTS)) + r")\b", re.I)
    port = re.compile(r"\b(?:[Pp]ort of [A-Z][a-z]+(?: [A-Z][a-z]+)?|[A-Z][a-z]+ [Pp]ort)\b")
    firm = re.compile(r"\b[A-Z][\w&]*(?: [A-Z][\w&]*)* (?:Corp|Corporation|Inc|Ltd|GmbH|AG|Co|Company|Group|Holdings)\b|\bSupplier#\d+\b")

    def spans(t: str) -> list[dict]:
        found = [(0.95, m, "chokepoint") for m in choke.finditer(t)] + [(0.7, m, "port") for m in port.finditer(t)] + [(0.6, m, "supplier") for m in firm.finditer(t)]
        out: list[dict] = []
        for sure, m, kind in sorted(found, key=lambda f: (-f[0], f[1].start())):
            if all(m.end() <= o["start"] or m.start() >= o["end"] for o in out):
                out.append({"kind": kind, "entity": m[0], "start": m.start(), "end": m.end(), "confidence": sure})
        return sorted(out, key=lambda o: o["start"])

    kind = "array<struct<kind:string,entity:string,start:int,end:int,confidence:double>>"

    @F.pandas_udf(kind)
    def find(t: pd.Series) -> pd.Series:
        return t.map(lambda x: spans(x or ""))

    return texts.withColumn("_e", F.explode(find(F.col(text)))).select(*[F.col(c) for c in texts.columns], "_e.*")


#: Words near which a capitalised name is a supplier, and words that are a port where a name is near.
SUPPLIER_WORDS = ["supplier", "manufacturer", "factory", "plant", "facility", "vendor", "contractor", "subcontractor", "producer", "foundry", "mill", "refinery", "assembler"]
PORT_WORDS = ["port", "harbor", "terminal", "dock", "marina", "anchorage", "quay", "pier", "jetty", "wharf", "seaport"]
#: Patterns of ports, letter case aside, and of names.
PORT_PATTERNS = [r"Port of ([A-Z][a-zA-Z\s]+?)(?:\s|,|\.|;|$)", r"([A-Z][a-zA-Z\s]+?)(?:\s)(?:Port|Harbor|Terminal|Marina)", r"([A-Z][a-zA-Z\s]+?)(?:\s)(?:seaport|shipping terminal)"]
CAPITALISED = r"[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*"


def rule_spans(t: str, chokepoints: list[str]) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, confidence) of a text: chokepoints .95, port patterns .7, port words near a name .6, names near a
    supplier word .5; of overlapping ones the surer stays, then the one of the earlier rule."""
    found = [("chokepoint", *m.span(), 0.95) for c in chokepoints for m in re.finditer(rf"\b{re.escape(c)}\b", t, re.I)]
    found += [("port", *m.span(), 0.7) for p in PORT_PATTERNS for m in re.finditer(p, t, re.I)]
    found += [("port", *m.span(), 0.6) for w in PORT_WORDS for m in re.finditer(rf"\b{w}\b", t, re.I) if re.search("[A-Z][a-z]+", t[max(0, m.start() - 30) : m.end() + 30])]
    low = t.lower()
    for w in SUPPLIER_WORDS:
        if (at := low.find(w)) >= 0:
            start = max(0, at - 100)
            found += [("supplier", start + m.start(), start + m.end(), 0.5) for m in re.finditer(CAPITALISED, t[start : at + 100])]
    kept: list[tuple[str, int, int, float]] = []
    for s in sorted(found, key=lambda s: -s[3]):
        if all(s[2] <= k[1] or s[1] >= k[2] for k in kept):
            kept.append(s)
    return sorted(kept, key=lambda s: s[1])


#: Characters of texts whose entities a task keeps, beside those of its batch.
KEPT_CHARACTERS = 1 << 20


def rule_entities(texts: DataFrame, text: str = "text", chokepoints: list[str] | None = None) -> DataFrame:
    """texts exploded into (kind, entity, start, end, confidence) by ``rule_spans``; a null text has none."""
    names = chokepoints or CHOKEPOINTS
    kind = "array<struct<kind:string,entity:string,start:int,end:int,confidence:double>>"

    @F.pandas_udf(kind)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        spans: dict[str, list[dict]] = {}  # of the task's texts so far, up to ``KEPT_CHARACTERS``
        held = 0
        for t in batches:
            for x in t.unique():
                if x and x not in spans:
                    if held + len(x) > KEPT_CHARACTERS:
                        spans, held = {y: spans[y] for y in t.unique() if y in spans}, 0
                    held += len(x)
                    spans[x] = [{"kind": k, "entity": x[a:b], "start": a, "end": b, "confidence": c} for k, a, b, c in rule_spans(x, names)]
            yield t.map(lambda x: spans.get(x, []))  # noqa: B023

    return texts.withColumn("_e", F.explode(find(F.col(text)))).select(*[F.col(c) for c in texts.columns], "_e.*")


def entity_counts(texts: DataFrame, text: str = "text", chokepoints: list[str] | None = None) -> DataFrame:
    """(kind, entity, n): how often each entity of ``rule_entities`` occurs; a text that comes again is searched once."""
    found = rule_entities(texts.groupBy(text).agg(F.count("*").alias("n")), text, chokepoints)
    return found.groupBy("kind", "entity").agg(F.sum("n").alias("n"))


def message_text(fields: dict[str, Column]) -> Column:
    """The text of a message: the first of its fields that is not empty, by ``MESSAGE_FIELDS``; fields that a table lacks are passed over."""
    return F.coalesce(*[F.when(fields[f] != "", fields[f]) for f in MESSAGE_FIELDS if f in fields], F.lit(""))


#: The fields of a message that may hold its text, in order; those of its raw data come after its own.
MESSAGE_FIELDS = ["description", "notes", "headline", "news_title", "title", "raw_data.description", "raw_data.notes", "raw_data.title", "raw_data.source_url"]


def register_functions(spark) -> None:
    """Make name_similarity(a, b), risk_word_level(text) and rule_entities(text) callable from SQL, the first and last on Arrow batches."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)], dtype=float)

    @F.pandas_udf("array<string>")
    def found(t: pd.Series) -> pd.Series:
        return t.map(lambda x: [f"{k}:{x[a:b]}" for k, a, b, _ in rule_spans(x, CHOKEPOINTS)] if x else [])

    spark.udf.register("name_similarity", similarity)
    spark.udf.register("rule_entities", found)
    counts = {level: " + ".join(f"cast(contains(lower(coalesce(t, '')), '{w}') as int)" for w in words) for level, words in RISK_WORDS.items()}
    best = f"greatest({', '.join(counts.values())})"
    ladder = " ".join(f"when {n} = {best} then '{level}'" for level, n in reversed(counts.items()))
    spark.sql(f"create or replace temporary function risk_word_level(t string) returns string return case when {best} = 0 then 'NONE' {ladder} end")
