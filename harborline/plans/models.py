"""Registered queries of the learned score, communities by modularity, and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..materialize import materialized
from ..operators import alerts, causal, features, graph, learning, modularity, recurrent, reports, signals, text, vectors
from .catalog import EDGES_SQL, RATE_SQL, _features, query, r6

# ---- the learned score

#: Model folders of this session: the queries of one data folder share a fit.
_SAVED: dict[tuple[str, str], str] = {}


def _vectors(t):
    """The suppliers' vectors, written once for a query: the fit and what asks it pass over them many times."""
    if not hasattr(t, "_written_vectors"):
        t._written_vectors = materialized(features.vector(_features(t)), "vectors")
    return t._written_vectors


def _labelled(t):
    """(supplier_id, vector, label, held_out): labels by risk, a quarter of each class held out; written once like the vectors."""
    if not hasattr(t, "_written_labelled"):
        label = F.when((F.col("risk_score") >= 0.65) | F.col("critical"), 1).otherwise(0).alias("label")
        rows = _vectors(t).join(t.suppliers.select("supplier_id", label), "supplier_id")
        t._written_labelled = materialized(learning.holdout(rows, "supplier_id", "label"), "labelled")
    return t._written_labelled


def _model(t) -> str:
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _SAVED:
        _SAVED[key] = learning.fitted(_labelled(t))
    return _SAVED[key]


@query(""", l as (select supplier_id, (risk_score >= 0.65 or critical)::int as label from sup), r as (select *, row_number() over (partition by label order by md5(supplier_id::varchar), supplier_id) as place, count(*) over (partition by label) as n from l)
select supplier_id, label, place <= floor(0.25 * n + 0.5) as held_out from r""")
def holdout_split(t):
    return _labelled(t).select("supplier_id", "label", "held_out")


@query()
def heldout_scores(t):
    """Suppliers that the model did not see, with their probability."""
    return learning.scored(_labelled(t).where("held_out"), _model(t)).select("supplier_id", "label", "probability")


@query()
def model_evaluation(t):
    return learning.evaluation(materialized(learning.scored(_labelled(t), _model(t)).select("label", "held_out", "probability"), "scored")).select("train_rows", "test_rows", r6("f1").alias("f1"), r6("roc_auc").alias("roc_auc"))


@query()
def score_explanations(t):
    """The five largest terms of every supplier's learned score."""
    names = list(learning.INPUTS)
    told = learning.shapley(_vectors(t), "supplier_id", learning.leaves(t.spark, _model(t)), names)
    about = F.element_at(F.create_map(*[F.lit(x) for pair in learning.INPUTS.items() for x in pair]), F.col("feature"))
    return told.select("supplier_id", "rank", "feature", F.round("contribution", 4).alias("contribution"), "direction", about.alias("description"))


# ---- communities


def _links(t):
    """Suppliers with those they supply and the ports they ship through, each pair once; and all these nodes."""
    near = graph.undirected(graph.supply_edges(t).where("rel in ('SUPPLIES', 'SHIPS_VIA')")).where("node < next")
    node = lambda df, kind: df.select(F.concat(F.lit(f"{kind}-"), F.col(f"{kind}_id").cast("string")).alias("node"))
    return near.select(F.col("node").alias("a"), F.col("next").alias("b"), F.lit(1).cast("long").alias("w")).distinct(), node(t.suppliers, "supplier").union(node(t.ports, "port"))


LINK_SQL = EDGES_SQL + ", lnk as (select distinct node as a, next as b, 1::bigint as w from near where rel in ('SUPPLIES', 'SHIPS_VIA') and node < next), nod as (select 'supplier-' || supplier_id as node from sup union all select 'port-' || port_id from port)"


def _communities_sql(levels: int, rounds: int) -> str:
    """members(node, community) by the same rounds, one table expression each."""
    out = LINK_SQL + ", both0 as materialized (select a, b, w from lnk union all select b, a, w from lnk), loop0 as (select node, 0::hugeint as loop from nod), mem0 as (select node, node as community from nod)"
    for i in range(levels):
        out += f""",
lab{i}_0 as materialized (select n.node, n.node as community, (coalesce(d.d, 0) + coalesce(l.loop, 0))::hugeint as degree, coalesce(l.loop, 0)::hugeint as loop from (select distinct community as node from mem{i}) n left join loop{i} l using (node) left join (select a as node, sum(w)::hugeint as d from both{i} group by a) d using (node)),
m{i} as materialized (select sum(degree)::hugeint as m from lab{i}_0)"""
        value = lambda lab: f"((select m from m{i}) * (coalesce((select sum(w) from both{i} l join {lab} x on x.node = l.a join {lab} y on y.node = l.b where x.community = y.community), 0)::hugeint + (select sum(loop) from {lab})::hugeint) - (select sum(t * t) from (select sum(degree)::hugeint as t from {lab} group by community)))"  # noqa: B023, E731
        for r in range(rounds):
            k, side = f"{i}_{r}", "<" if r % 2 == 0 else ">"
            out += f""",
s{k} as (select o.node, o.community as here, x.c, (select m from m{i}) * x.w - o.degree * (t.t - case when x.c = o.community then o.degree else 0 end) as s from (
  select a, c, sum(w)::hugeint as w from (select l.a, y.community as c, l.w from both{i} l join lab{k} y on y.node = l.b union all select node, community, 0 from lab{k}) group by all) x
  join lab{k} o on o.node = x.a join (select community as c, sum(degree)::hugeint as t from lab{k} group by 1) t on t.c = x.c),
mv{k} as materialized (select g.node, g.here, g.c as there, g.s - y.s as gain from (select *, row_number() over (partition by node order by s desc, c) as n from s{k} where c {side} here) g join s{k} y on y.node = g.node and y.c = y.here where n = 1 and g.s > y.s),
bst{k} as (select c, node from (select c, node, row_number() over (partition by c order by gain desc, node) as n from (select here as c, node, gain from mv{k} union all select there, node, gain from mv{k})) where n = 1),
apt{k} as (select v.* from mv{k} v join bst{k} x on x.c = v.here and x.node = v.node join bst{k} y on y.c = v.there and y.node = v.node),
all{k} as materialized (select l.node, coalesce(v.there, l.community) as community, degree, loop from lab{k} l left join mv{k} v using (node)),
few{k} as materialized (select l.node, coalesce(v.there, l.community) as community, degree, loop from lab{k} l left join apt{k} v using (node)),
win{k} as materialized (select {value(f'all{k}')} > {value(f'lab{k}')} as better),
lab{i}_{r + 1} as materialized (select * from all{k} where (select better from win{k}) union all select * from few{k} where not (select better from win{k}))"""
        last = f"lab{i}_{rounds}"
        out += f""",
mem{i + 1} as materialized (select x.node, l.community from mem{i} x join {last} l on l.node = x.community),
mrg{i} as materialized (select x.community as a, y.community as b, sum(w)::hugeint as w from both{i} l join {last} x on x.node = l.a join {last} y on y.node = l.b group by all),
loop{i + 1} as materialized (select k.node, k.loop + coalesce(g.w, 0) as loop from (select community as node, sum(loop)::hugeint as loop from {last} group by 1) k left join mrg{i} g on g.a = k.node and g.b = k.node),
both{i + 1} as materialized (select * from mrg{i} where a <> b)"""
    return out + f", members as (select * from mem{levels})"


_COMMUNITIES = (3, 4)


@query(_communities_sql(*_COMMUNITIES) + " select node, community from members")
def modularity_communities(t):
    return modularity.communities(*_links(t), *_COMMUNITIES)


@query(_communities_sql(*_COMMUNITIES) + """, m as (select sum(w)::double as m from lnk), c as (select c, sum(inside) as inside, sum(d) as d from (select x.community as c, case when x.community = y.community then 2 else 0 end as inside, 1 as d from lnk join members x on x.node = a join members y on y.node = b union all select y.community, 0, 1 from lnk join members y on y.node = b) group by c)
select (select count(distinct community) from members) as communities, round(sum(inside / (2 * m) - (d / (2 * m)) ** 2), 6) as modularity from c, m""")
def community_modularity(t):
    edges, nodes = _links(t)
    return modularity.modularity(edges, modularity.communities(edges, nodes, *_COMMUNITIES)).withColumn("modularity", r6("modularity"))


# ---- vectors


@query()
def alternatives_by_embedding(t):
    """The five best alternatives of every supplier: .6 of the embeddings' cosine and .4 of what is missing to full risk."""
    near = graph.undirected(graph.supply_edges(t)).where("node_type = 'supplier' and next_type in ('supplier', 'port')")
    neighbours = near.select(F.substring("node", 10, 20).cast("long").alias("supplier_id"), F.col("next").alias("neighbour")).distinct()
    s = reports.embeddings(t.suppliers, neighbours).join(t.suppliers.select("supplier_id", "name", "risk_score"), "supplier_id")
    rows = materialized(s.select(F.col("supplier_id").alias("id"), "vector", (0.4 * (1 - F.coalesce("risk_score", F.lit(0.5)))).alias("bonus")), "embedded")
    best = vectors.Cells(rows).search(rows.select(F.col("id").alias("query_id"), "vector"), 5, 0.6)
    risk = t.suppliers.select(F.col("supplier_id").alias("id"), F.col("name").alias("alternative"), "risk_score")
    told = best.join(risk, "id").select(F.col("query_id").alias("supplier_id"), "rank", "id", "alternative", F.round("risk_score", 4).alias("risk_score"), F.col("score"))
    similarity = F.round((F.col("score") - 0.4 * (1 - F.coalesce("risk_score", F.lit(0.5)))) / 0.6, 4)
    return told.withColumn("similarity", similarity).withColumn("score", F.round("score", 4))


QUESTIONS = [(1, "How is the methodology of SCRI calculated?"), (2, "What happened at Suez in 2021?"), (3, "Which sector cluster is at risk?"), (4, "Any news on suppliers?")]
COLLECTIONS = ["events", "suppliers", "methodology", "scenarios", "backtests", "graph_communities"]
_ROUTED_SQL = """with q as (select * from (values %s) v(query_id, question)),
route as (select query_id, unnest(case %s else %s end) as x from q),
qv as (select query_id, [('0x' || substr(md5(question || '|' || j), 1, 8))::bigint / 4294967295.0::double - 0.5 for j in range(1, 65)] as v from q),
hit as (select r.query_id, r.x.collection as collection, r.x.most as most, e.vec_id as id, round(list_cosine_similarity(qv.v, e.embedding::double[]), 6) as score from route r join qv using (query_id)
  join embeddings e on ['events', 'suppliers', 'methodology', 'scenarios', 'backtests', 'graph_communities'][e.vec_id %% 6 + 1] = r.x.collection),
k as (select *, row_number() over (partition by query_id, collection order by score desc, id) as n from hit),
m as (select *, row_number() over (partition by query_id order by score desc, collection, id) as rank from k where n <= most)
select query_id, rank::int as rank, collection, id, score from m where rank <= 8"""


def _route_sql() -> str:
    as_list = lambda r: "[" + ", ".join(f"{{'collection': '{c}', 'most': {n}}}" for c, n in r) + "]"
    whens = " ".join(f"when regexp_matches(question, '{pattern}') then {as_list(r)}" for pattern, r in text.ROUTES)
    return _ROUTED_SQL % (", ".join(f"({i}, '{x}')" for i, x in QUESTIONS), whens, as_list(text.DEFAULT_ROUTE))


@query(_route_sql(), domain=False)
def routed_search(t):
    """Questions against the vectors of the collections that each is routed to."""
    asked = t.spark.createDataFrame(QUESTIONS, "query_id long, query string")
    number = lambda j: F.conv(F.substring(F.md5(F.concat(F.col("query"), F.lit("|"), j.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") / 4294967295.0 - 0.5
    asked = asked.withColumn("vector", F.transform(F.sequence(F.lit(1), F.lit(64)), number))
    rows = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.element_at(F.array(*map(F.lit, COLLECTIONS)), (F.col("vec_id") % 6 + 1).cast("int")).alias("kind"))
    return text.routed_search(asked, text.collection_hits(asked, rows))


# ---- causes


def _cause_pairs(t):
    """Suppliers' risk and number of events, with two common causes."""
    e = t.events.groupBy("supplier_id").agg((F.count("*") / 100.0).alias("y"))
    s = t.suppliers.select("supplier_id", F.col("risk_score").alias("x"), (F.col("supplier_id") % 7).alias("season"), F.col("single_source").cast("int").alias("single"))
    return s.join(e, "supplier_id", "left").withColumn("y", F.coalesce("y", F.lit(0.0)))


_U = "('0x' || substr(md5(k || '|{}'), 1, 8))::bigint / 4294967296.0::double"
def _cause_sql(pairs: str) -> str:
    """The effect in every variant of p(k, x, y, c0, c1), by taking the causes off one after another."""
    return f""", p as ({pairs}),
d as (select p.*, i as draw from p, range(0, 20) r(i)),
v as (select 'estimate' as kind, 0 as draw, x, y, c0, c1, 0.0::double as c2 from p union all select 'random_cause', 0, x, y, c0, c1, {_U.format('cause')} from p
  union all select 'subset', draw, x, y, c0, c1, 0.0 from d where draw < 5 and {_U.format("subset' || draw || '")} < 0.8
  union all select 'placebo', draw, coalesce(lead(x) over w, first_value(x) over w), y, c0, c1, 0.0 from d window w as (partition by draw order by {_U.format("placebo' || draw || '")}, k)),
s0 as (select kind, draw, x - avg(x) over w as x, y - avg(y) over w as y, c0 - avg(c0) over w as c0, c1 - avg(c1) over w as c1, c2 - avg(c2) over w as c2 from v window w as (partition by kind, draw)),
s1 as (select kind, draw, x - c0 * coalesce(regr_slope(x, c0) over w, 0) as x, y - c0 * coalesce(regr_slope(y, c0) over w, 0) as y, c1 - c0 * coalesce(regr_slope(c1, c0) over w, 0) as c1, c2 - c0 * coalesce(regr_slope(c2, c0) over w, 0) as c2 from s0 window w as (partition by kind, draw)),
s2 as (select kind, draw, x - c1 * coalesce(regr_slope(x, c1) over w, 0) as x, y - c1 * coalesce(regr_slope(y, c1) over w, 0) as y, c2 - c1 * coalesce(regr_slope(c2, c1) over w, 0) as c2 from s1 window w as (partition by kind, draw)),
s3 as (select kind, draw, case when kind = 'random_cause' then x - c2 * regr_slope(x, c2) over w else x end as x, case when kind = 'random_cause' then y - c2 * regr_slope(y, c2) over w else y end as y from s2 window w as (partition by kind, draw)),
fx as (select kind, draw, count(*) as n, regr_slope(y, x) as effect from s3 group by all)
"""


_CAUSE_SQL = _cause_sql("select s.supplier_id as k, s.risk_score::double as x, count(e.event_id) / 100.0::double as y, (s.supplier_id % 7)::double as c0, s.single_source::int::double as c1 from sup s left join ev e using (supplier_id) group by all")


@query(_CAUSE_SQL + "select kind, draw::int as draw, n, round(effect, 6) as effect from fx")
def causal_refuters(t):
    """The adjusted effect in every variant of the data."""
    found = causal.effects(causal.variants(_cause_pairs(t), "supplier_id", "x", "y", ["season", "single"]), 3)
    return t.spark.createDataFrame(found, "kind string, draw int, n long, effect double").withColumn("effect", r6("effect"))


_VERDICT_SQL = """, a as (select (select effect from fx where kind = 'estimate') as effect, (select n from fx where kind = 'estimate') as n, (select avg((abs(effect) >= abs((select effect from fx where kind = 'estimate')))::int) from fx where kind = 'placebo') as placebo_share,
  (select abs(effect - (select effect from fx where kind = 'estimate')) from fx where kind = 'random_cause') as cause_change, (select max(abs(effect - (select effect from fx where kind = 'estimate'))) from fx where kind = 'subset') as subset_spread),
said as (select n, case when n < 5 then 'insufficient_data' when n < 30 then 'association_only' else 'adjusted_regression' end as method, round(case when n >= 30 then effect when n >= 5 then (select corr(x, y) from p) end, 6) as effect, case when n >= 30 then placebo_share end as placebo_share,
  case when n >= 30 then round(cause_change, 6) end as cause_change, case when n >= 30 then round(subset_spread, 6) end as subset_spread, n >= 30 and placebo_share < 0.05 and cause_change <= 0.1 * abs(effect) and subset_spread <= 0.5 * abs(effect) as refutation_passed,
  n >= 30 and placebo_share < 0.05 and cause_change <= 0.1 * abs(effect) and subset_spread <= 0.5 * abs(effect) and abs(effect) > 0.05 as causal_claim_allowed from a)
"""


@query(_CAUSE_SQL + _VERDICT_SQL + "select * from said")
def causal_assessment(t):
    out = causal.assessed(_cause_pairs(t), "supplier_id", "x", "y", ["season", "single"])
    return out.withColumns({c: r6(c) for c in ("effect", "cause_change", "subset_spread")})


@query(_cause_sql("select e.event_id as k, e.severity::double as x, s.risk_score::double as y, (e.event_id % 7)::double as c0, s.single_source::int::double as c1 from (select * from ev order by ts desc, event_id limit 100) e join sup s using (supplier_id)") + _VERDICT_SQL + """
select event_id as alert_id, causal_claim_allowed, method as causal_method, round(effect, 4) as causal_effect_size, n as causal_sample_count, case method when 'insufficient_data' then 'Not enough pairs to say anything about causes.' when 'association_only' then 'Seen together; not a verified causal claim.' else 'Adjusted regression with placebo, random cause and subset refuters.' end as causal_disclaimer
from (select event_id from ev, now where severity >= 0.75 and ts > as_of - interval 24 hour order by severity desc, event_id limit 10), said""")
def causal_alerts(t):
    """The severest alerts of the last day with what the newest hundred pairs say about causes."""
    newest = t.events.orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "supplier_id", "severity")
    pairs = newest.join(t.suppliers.select("supplier_id", "risk_score", F.col("single_source").cast("int").alias("single")), "supplier_id").withColumn("season", F.col("event_id") % 7)
    said = causal.assessed(pairs, "event_id", "severity", "risk_score", ["season", "single"])
    return causal.with_causal_fields(alerts.emit_high(t.events, t.as_of, 24).select("alert_id"), said)


# ---- recurrent forecast


@query(RATE_SQL + """, w as (select country, day, list(rate) over (partition by country order by day rows between 13 preceding and current row) as a, list(rate) over (partition by country order by day rows between 1 following and 7 following) as b from rate)
select country, day::varchar as day, round(list_sum(a), 6) as inputs, round(list_sum(b), 6) as targets from w where len(a) = 14 and len(b) = 7""")
def training_windows(t):
    """Windows of 14 days and the 7 after them, told by their sums."""
    total = lambda c: r6(F.aggregate(c, F.lit(0.0), lambda s, v: s + v))
    w = recurrent.window_pairs(signals.regional_rate(t.events, "country", t.as_of), "country", "rate")
    return w.select("country", F.col("day").cast("string").alias("day"), total("inputs").alias("inputs"), total("targets").alias("targets"))


@query(""", x as (select s.supplier_id, coalesce(risk_score, 0.5)::double as risk, m from sup s left join (select supplier_id, max(severity) as m from ev, now where ts > as_of - interval 30 day group by 1) using (supplier_id)),
b as (select *, case when m is not null then 0.3::double else greatest(0.1, least(1.0, risk * 0.85)) end as base from x), l as (select *, case when m is not null then greatest(base, m * 0.8) else greatest(base, risk * 0.8, least(0.95, risk) * 0.95) end as last from b)
select supplier_id, case when m is not null then 'events' else 'snapshot' end as origin, round(11 * base + 3 * last, 6) as total, round(last, 6) as latest from l""")
def forecast_history(t):
    h = recurrent.history(t.suppliers, features.event_signals(t.events, t.as_of))
    return h.select("supplier_id", "origin", r6(F.aggregate("series", F.lit(0.0), lambda s, v: s + v)).alias("total"), r6(F.element_at("series", -1)).alias("latest"))


@query()
def recurrent_forecast(t):
    """The rate of every country a week ahead, by the cell where there are three weeks of it, else by its trend."""
    rate = signals.regional_rate(t.events, "country", t.as_of)
    model = recurrent.fitted(recurrent.window_pairs(rate, "country", "rate"), "country")
    return recurrent.forecasts(signals.as_series(rate, "country", "rate"), "country", model)
