"""Registered queries of explanations, intervals, extraction, monitoring and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import analytics, features, monitoring, signals, text
from ..sources import sinks
from .catalog import COUNTRY_SQL, SCORE_SQL, _daily, _features, query, r6

# ---- intervals and explanations

INTERVAL_SQL = COUNTRY_SQL + f""", sc as (select supplier_id, {SCORE_SQL} as score from feat), lb as (select supplier_id, max(disrupted)::double as label from lab group by 1), j as (select sc.*, lb.label from sc left join lb using (supplier_id)),
k as (select count(*) as n, list_sort(list(supplier_id)) as ids from j where label is not null), cal as (select abs(score - label) as r from j, k where label is not null and n >= 10 and supplier_id >= ids[(n - greatest(floor(n * 0.3), 5) + 1)::int]),
q as (select list_sort(list(r))[(ceil(0.9 * (count(*) - 1)) + 1)::int] as q from cal), iv as (select supplier_id, score, case when q is not null then greatest(0.0, score - q) end as low, case when q is not null then least(1.0, score + q) end as high from j, q)
"""


def _intervals(t):
    """Rule scores with the band that the last labelled suppliers' errors give."""
    s = features.rule_score(_features(t)).select("supplier_id", "score", "category")
    labels = t.disruption_labels.groupBy("supplier_id").agg(F.max("disrupted").cast("double").alias("label"))
    return analytics.conformal(s.join(labels, "supplier_id", "left"), "score", "label", "supplier_id")


@query(INTERVAL_SQL + "select supplier_id, round(score, 6) as score, round(low, 6) as low, round(high, 6) as high from iv")
def score_intervals(t):
    return _intervals(t).select("supplier_id", r6("score").alias("score"), r6("low").alias("low"), r6("high").alias("high"))


_TERMS_SQL = """, term as (select supplier_id, unnest([{'feature': 'proximity', 'c': 0.25::double * proximity}, {'feature': 'single_source', 'c': 0.2::double * single_source::int}, {'feature': 'critical_events', 'c': 0.2::double * least(critical_events / 5.0::double, 1.0)}, {'feature': 'history', 'c': 0.15::double * least(disruptions / 5.0::double, 1.0)}, {'feature': 'congestion', 'c': 0.1::double * congestion}, {'feature': 'weather', 'c': 0.1::double * weather}]) as t from feat),
top as (select supplier_id, string_agg(t.feature, ',' order by n) as terms from (select *, row_number() over (partition by supplier_id order by abs(t.c) desc, t.feature) as n from term) where n <= 3 group by 1)
"""


@query(INTERVAL_SQL + _TERMS_SQL + "select supplier_id, round(score, 6) as score, case when score >= 0.8 then 'CRITICAL' when score >= 0.6 then 'HIGH' when score >= 0.4 then 'MEDIUM' when score >= 0.2 then 'LOW' else 'NONE' end as category, round(low, 6) as low, round(high, 6) as high, terms from iv join top using (supplier_id)")
def supplier_explained(t):
    """Score, band, interval and the three largest terms of every supplier."""
    terms = features.contributions(_features(t), 3).groupBy("supplier_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), ",").alias("terms"))
    return _intervals(t).join(terms, "supplier_id").select("supplier_id", r6("score").alias("score"), "category", r6("low").alias("low"), r6("high").alias("high"), "terms")


@query(", l as (select supplier_id, (risk_score >= 0.65 or critical)::int as label from sup), r as (select *, row_number() over (partition by label order by md5(supplier_id::varchar), supplier_id) > floor(0.25 * count(*) over (partition by label) + 0.5) as train from l) select count(*) as labels, true as model_loaded, case when count(distinct label) filter (train) > 1 then 'validated' else 'demo' end as training_status, case when count(distinct label) filter (train) > 1 and count(*) >= 10 then 'validated' else 'demo' end as calibration_status from r")
def model_status(t):
    from .models import _labelled

    return monitoring.model_status(_labelled(t), True)


# ---- extraction

_NAMES_SQL = "[x for x in regexp_extract_all(text, '{}', 1) if x not in ({}) and length(x) > 2][:8]".format(text.NAMES, ", ".join(f"'{w}'" for w in text.NO_NAMES))
_PLACES_SQL = f"[trim(x) for x in regexp_extract_all(text, '{text.PLACE}', 1)]"


@query(f"select event_id, array_to_string({_NAMES_SQL}, '|') as entities, array_to_string((select list(x order by i) from (select x, min(i) as i from (select unnest({_PLACES_SQL}) as x, generate_subscripts({_PLACES_SQL}, 1) as i) group by x order by 2 limit 5)), '|') as places from ev")
def event_extraction(t):
    """Names and places of every event's text."""
    c = F.col("text")
    return t.events.select("event_id", F.array_join(text.named(c), "|").alias("entities"), F.nullif(F.array_join(text.locations(c), "|"), F.lit("")).alias("places"))


@query(r""", c as (select event_id, 'chokepoint' as kind, unnest(regexp_extract_all(text, '(?i)\b(suez canal|panama canal|red sea)\b')) as entity, text from ev),
p as (select event_id, 'port' as kind, unnest(regexp_extract_all(text, '(?i)[A-Z][a-zA-Z\s]+?\s(?:Port|Harbor|Terminal|Marina)')) as entity, text from ev),
near as (select event_id, text, min(instr(lower(text), w)) over (partition by event_id) as at from ev, (select unnest(['supplier', 'manufacturer', 'factory', 'plant', 'facility', 'vendor', 'contractor', 'subcontractor', 'producer', 'foundry', 'mill', 'refinery', 'assembler']) as w) where instr(lower(text), w) > 0),
s as (select distinct event_id, 'supplier' as kind, unnest(regexp_extract_all(text, '[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*')) as entity, text from near)
select kind, entity, count(*) as n from (select event_id, kind, entity from c union all select event_id, kind, entity from p union all select s.event_id, s.kind, s.entity from s where not exists (select 1 from c where c.event_id = s.event_id and contains(c.entity, s.entity))) group by all""")
def rule_entities(t):
    """Entities of all event texts by the full rules; the texts are shorter than a supplier word's window, and hold no port word alone."""
    return text.entity_counts(t.events.select("text"))


@query("select event_id, case when event_id % 3 = 0 then text when event_id % 3 = 1 then 'note ' || event_id else kind end as text from ev")
def message_texts(t):
    """The text of messages whose fields are filled in turn."""
    e = F.col("event_id")
    fields = {"description": F.when(e % 3 == 0, F.col("text")).otherwise(""), "notes": F.when(e % 3 == 1, F.concat(F.lit("note "), e.cast("string"))), "title": F.col("kind")}
    return t.events.select("event_id", text.message_text(fields).alias("text"))


# ---- monitoring


@query()
def monitored_kinds(t):
    """Anomalies, changepoints and rises of every kind of event."""
    from pyspark.sql import Window

    daily = _daily(t)
    scores = signals.as_series(daily.withColumn("v", F.col("n") / F.max("n").over(Window.partitionBy("kind"))), "kind", "v")
    return monitoring.monitored(daily, scores, "kind").withColumn("strength", r6("strength"))


@query(COUNTRY_SQL + f""", sc as (select supplier_id, name, country, {SCORE_SQL} as score, recent_events from feat), w as (select *, list_concat([0.0::double for i in range(0, 7)], [greatest(1, recent_events // 7)::double for i in range(0, 7)]) as w from sc),
x as (select *, list_reduce(list_prepend(0.0::double, w), lambda s, x: greatest(0.0, s + x - list_sum(w[:-2]) / 13 - 0.5)) as statistic from w)
select supplier_id, name, country, round(score, 6) as score, case when score >= 0.8 then 'CRITICAL' when score >= 0.6 then 'HIGH' when score >= 0.4 then 'MEDIUM' when score >= 0.2 then 'LOW' else 'NONE' end as category, recent_events, round(statistic, 6) as statistic, statistic >= 5 as jump, 'stable' as direction, 0.3::double as forecast from x""")
def supplier_risk_summary(t):
    s = monitoring.risk_summary(features.rule_score(_features(t)), features.event_signals(t.events, t.as_of))
    return s.withColumns({c: r6(c) for c in ("score", "statistic", "forecast")})


# ---- exports and SQL functions


@query(", n as (select e.event_id, e.severity, s.risk_score from ev e join sup s using (supplier_id) order by e.ts desc, event_id limit 500) select '{\"exported_at\":\"' || strftime((select as_of from now), '%Y-%m-%d') || '\",\"pair_count\":' || count(*) || ',\"correlation_pairs\":' || count(*) || '}' as summary from n")
def pairs_summary(t):
    pairs = t.events.select("event_id", "severity", F.col("ts").alias("ingested_at"), "supplier_id").join(t.suppliers.select("supplier_id", "risk_score"), "supplier_id")
    return sinks.pairs_summary(sinks.newest_pairs(pairs, 500), F.date_format(F.lit(t.as_of), "yyyy-MM-dd"))


@query("select supplier_id, 100.0::double as similarity, case when contains(lower(name), 'war') then 'CRITICAL' else 'NONE' end as level from sup")
def sql_functions(t):
    """Registered functions, one of them on Arrow batches, asked in SQL."""
    text.register_functions(t.spark)
    return t.as_views().sql("select supplier_id, name_similarity(name, concat('THE ', upper(name))) as similarity, risk_word_level(name) as level from suppliers")
