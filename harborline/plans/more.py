"""Further registered queries: links of scenarios and regions, monitoring, map layers, routed search, simulation draws and spreads."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import features, graph, monitoring, reports, signals, simulation
from ..sources import feeds, sinks
from .catalog import COUNTRY_SQL, DAILY_SQL, RATE_SQL, SCORE_SQL, SKU_SQL, _daily, _features, _scenarios, _sku_nodes, _spread_sql, query, r6

# ---- scores and labels


@query(COUNTRY_SQL + """, term as (select supplier_id, unnest([{'feature': 'proximity', 'c': 0.25::double * proximity}, {'feature': 'single_source', 'c': 0.2::double * single_source::int}, {'feature': 'critical_events', 'c': 0.2::double * least(critical_events / 5.0::double, 1.0)}, {'feature': 'history', 'c': 0.15::double * least(disruptions / 5.0::double, 1.0)}, {'feature': 'congestion', 'c': 0.1::double * congestion}, {'feature': 'weather', 'c': 0.1::double * weather}]) as t from feat)
select * from (select supplier_id, row_number() over (partition by supplier_id order by abs(t.c) desc, t.feature)::int as rank, t.feature as feature, round(t.c, 6) as contribution from term) where rank <= 5""")
def score_contributions(t):
    return features.contributions(_features(t)).withColumn("contribution", r6("contribution"))


@query(COUNTRY_SQL + f"select supplier_id, round({SCORE_SQL}, 6) as score from feat where supplier_id in (select supplier_id from aff, now where linked_at > as_of - interval 6 hour)")
def rescored_suppliers(t):
    return features.rescored(features.rule_score(_features(t)), t.affects, t.as_of, 6).select("supplier_id", r6("score").alias("score"))


@query(COUNTRY_SQL + f", sc as (select supplier_id, round({SCORE_SQL}, 6) as score from feat)" + """ select supplier_id, score as risk_score, case when score >= 0.8 then 'CRITICAL' when score >= 0.6 then 'HIGH' when score >= 0.4 then 'MEDIUM' when score >= 0.2 then 'LOW' else 'NONE' end as risk_category, 'rule-based-1.0' as model_version, as_of as scored_at from sc, now""")
def score_history(t):
    s = features.rule_score(_features(t)).withColumn("score", r6("score"))
    return sinks.scored_history(s.select("supplier_id", "score", "category", "factors"), "rule-based-1.0", F.lit(t.as_of)).drop("feature_snapshot")


@query(COUNTRY_SQL + f"select sup.supplier_id, sup.name, round(coalesce({SCORE_SQL.replace('single_source', 'feat.single_source').replace('critical_events', 'feat.critical_events')}, sup.risk_score), 6) as risk_score from sup left join feat using (supplier_id)")
def score_write_back(t):
    return sinks.written_back(t.suppliers, features.rule_score(_features(t))).select("supplier_id", "name", r6("risk_score").alias("risk_score"))


@query(""", named as (select trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug, s.*, l.disrupted from sup s left join (select supplier_id, max(disrupted) as disrupted from lab group by 1) l using (supplier_id))
select supplier_id, slug, coalesce(disrupted, (risk_score >= 0.65 or critical)::int)::int as label from named""")
def label_features(t):
    """Suppliers with their label by slug of the name; those that the labels leave out take the fallback rule."""
    s = t.suppliers.select("supplier_id", "name", "risk_score", "critical", ex.slug(F.col("name")).alias("slug"))
    labels = t.disruption_labels.groupBy("supplier_id").agg(F.max("disrupted").alias("disrupted")).join(s.select("supplier_id", "slug"), "supplier_id").drop("supplier_id")
    return s.join(labels, "slug", "left").select("supplier_id", "slug", F.coalesce("disrupted", ((F.col("risk_score") >= 0.65) | F.col("critical")).cast("int")).cast("int").alias("label"))


@query("select n_name as country, round(greatest(0.0, least(1.0, (n_nationkey % 13 - 6.0::double + 2.5) / 5.0)), 4) as stability from nation", domain=False)
def stability_index(t):
    return t.raw("nation").select(F.col("n_name").alias("country"), ex.stability_index(F.col("n_nationkey") % 13 - 6.0).alias("stability"))


# ---- filters, links, seeds


@query("select supplier_id, name from sup where upper(country) = 'NATION_3' order by supplier_id limit 25")
def country_suppliers(t):
    return t.suppliers.where(F.upper("country") == "NATION_3").orderBy("supplier_id").limit(25).select("supplier_id", "name")


@query("select event_id, kind from ev where kind in ('protest', 'attack') and len([w for w in ['missile', 'strike', 'riot'] if contains(lower(text), w)]) > 0")
def allowed_events(t):
    return t.events.where(F.col("kind").isin("protest", "attack") & F.exists(F.array(*map(F.lit, ("missile", "strike", "riot"))), lambda w: F.contains(F.lower("text"), w))).select("event_id", "kind")


def _event_rules():
    return [("event_id", F.col("event_id").isNotNull()), ("place", F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)), ("severity", F.col("severity").between(0, 1)), ("small", F.col("severity") >= 0.01)]


@query("select count(*) filter (lat between -90 and 90 and lon between -180 and 180 and severity between 0.01 and 1) as accepted, (select string_agg(event_id || ':' || reason, ',' order by event_id) from (select event_id, case when not coalesce(lat between -90 and 90 and lon between -180 and 180, false) then 'place' when not severity between 0 and 1 then 'severity' else 'small' end as reason from ev where not coalesce(lat between -90 and 90 and lon between -180 and 180 and severity between 0.01 and 1, false) order by event_id limit 10)) as first_errors from ev")
def validated_events(t):
    good, bad = feeds.first_errors(t.events, _event_rules(), "event_id")
    told = bad.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "reason"))), lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["reason"])), ",").alias("first_errors"))  # ten rows
    return good.agg(F.count("*").alias("accepted")).crossJoin(told)


@query("select distinct 'supplier-' || supplier_id as src, 'LOCATED_IN' as kind, 'region-' || chokepoint_id as dst from sup union select distinct 'supplier-' || supplier_id, 'SHIPS_VIA', 'port-' || port_id from via")
def region_port_links(t):
    s = F.concat(F.lit("supplier-"), F.col("supplier_id").cast("string")).alias("src")
    region = t.suppliers.select(s, F.lit("LOCATED_IN").alias("kind"), F.concat(F.lit("region-"), F.col("chokepoint_id").cast("string")).alias("dst"))
    port = t.ships_via.select(s, F.lit("SHIPS_VIA").alias("kind"), F.concat(F.lit("port-"), F.col("port_id").cast("string")).alias("dst"))
    return sinks.links_once(region.union(port).union(region))


@query("select scenario_id, supplier_id from (select supplier_id, unnest([x for x in [case when country in ('NATION_1') then 'DIS-001' end, case when country in ('NATION_2') then 'DIS-002' end, case when country in ('NATION_2', 'NATION_3', 'NATION_4') then 'DIS-003' end] if x is not null]) as scenario_id from sup)")
def scenario_supplier_links(t):
    return sinks.scenario_links(t.suppliers, {"DIS-001": ["NATION_1"], "DIS-002": ["NATION_2"], "DIS-003": ["NATION_2", "NATION_3", "NATION_4"]})


@query("select 'port-' || port_id as node, coalesce(case when port_id % 2 = 0 then port_id * 1000 end, 7) as teu from port union all select 'port-new', 5000")
def seeded_ports(t):
    """Ports with the capacity that seeds set; a seed of an unknown port adds it, and seeding twice changes nothing."""
    node = F.concat(F.lit("port-"), F.col("port_id").cast("string")).alias("node")
    old = t.ports.select(node, F.lit(7).alias("teu"))
    seeds = t.ports.where("port_id % 2 = 0").select(node, (F.col("port_id") * 1000).alias("teu")).union(t.spark.createDataFrame([("port-new", 5000)], "node string, teu int"))
    return sinks.seeded(sinks.seeded(old, seeds, "node"), seeds, "node")


@query("select event_id, severity, ts as ingested_at from ev order by ts desc, event_id limit 40")
def newest_pairs(t):
    return sinks.newest_pairs(t.events.select("event_id", "severity", F.col("ts").alias("ingested_at")), 40)


@query("select 'events.reports.' || kind as topic, event_id::varchar as key, '{\"event_id\":' || event_id || ',\"kind\":\"' || kind || '\",\"_metadata\":{\"source\":\"reports\",\"type\":\"' || kind || '\"}}' as value from ev")
def event_messages(t):
    return sinks.as_messages(t.events.select("event_id", "kind"), "reports", F.col("kind"), F.col("event_id"))


@query(", w as (select * from ev, now where ts > as_of - interval 7 day) select '# Weekly digest' || chr(10) || chr(10) || '- Events: ' || count(*) || chr(10) || '- Critical: ' || count(*) filter (severity >= 0.75) || chr(10) || '- Suppliers hit: ' || (select count(distinct supplier_id) from aff where event_id in (select event_id from w)) || chr(10) || '- Leading type: ' || (select kind from w group by kind order by count(*) desc, kind limit 1) as markdown from w")
def digest_markdown(t):
    from ..operators import analytics

    return sinks.digest_markdown(analytics.digest(t.events, t.affects, t.suppliers, t.as_of))


@query("select country, place::int as place, severity, risk_score from (select country, severity, row_number() over (partition by country order by event_id) as place from ev) join (select country, risk_score, row_number() over (partition by country order by supplier_id) as place from sup) using (country, place)")
def zipped_lists(t):
    a = t.events.select("country", "severity", F.col("event_id").alias("o"))
    return monitoring.zipped(a, t.suppliers.select("country", "risk_score", F.col("supplier_id").alias("o")), "country", "o").select("country", "place", "severity", "risk_score")


@query("select supplier_id, band, band2 from (select supplier_id, case when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' else 'LOW' end as band, case when risk_score >= 0.75 then 'CRITICAL' when risk_score >= 0.5 then 'HIGH' when risk_score >= 0.25 then 'MEDIUM' else 'LOW' end as band2, critical from sup) where critical")
def sql_views(t):
    """The domain as temporary views and the bands as SQL functions, asked in SQL."""
    return t.as_views().sql("select supplier_id, band_map(risk_score) as band, band_methodology(risk_score) as band2 from suppliers where critical")


# ---- map layers


@query("""select kind, feature from (select 'SHIPS_VIA' as kind, s.supplier_id, p.port_id, '{"type":"Feature","geometry":{"type":"LineString","coordinates":[[' || s.lon || ',' || s.lat || '],[' || p.lon || ',' || p.lat || ']]},"properties":{"route_type":"SHIPS_VIA","source":"' || s.name || '","target":"' || p.port_name || '"}}' as feature
  from via v join sup s using (supplier_id) join port p on p.port_id = v.port_id where s.lat is not null order by s.supplier_id, p.port_id limit 200)""")
def route_lines(t):
    rows = t.ships_via.join(t.suppliers.drop("port_id"), "supplier_id").join(t.ports.select("port_id", "port_name", F.col("lat").alias("plat"), F.col("lon").alias("plon")), "port_id").where("lat is not null").orderBy("supplier_id", "port_id").limit(200)
    return rows.select(F.lit("SHIPS_VIA").alias("kind"), ex.line([(F.col("lon"), F.col("lat")), (F.col("plon"), F.col("plat"))], route_type=F.lit("SHIPS_VIA"), source=F.col("name"), target=F.col("port_name")).alias("feature"))


@query("""select zone, corner::int as corner, round(lon + 400.0 / (111.32 * greatest(cos(radians(lat)), 0.01)) * cos(corner * 2 * pi() / 32), 6) + 0.0 as lon, round(lat + 400.0 / 110.574 * sin(corner * 2 * pi() / 32), 6) + 0.0 as lat from (select chokepoint_id as zone, chokepoint_id * 20.0::double - 40 as lat, chokepoint_id * 30.0::double - 60 as lon from choke), range(0, 33) c(corner)""")
def zone_rings(t):
    """Rings of 400 km about stand-in zones, one for each chokepoint."""
    z = t.chokepoints.select(F.col("chokepoint_id").alias("zone"), (F.col("chokepoint_id") * 20.0 - 40).alias("lat"), (F.col("chokepoint_id") * 30.0 - 60).alias("lon"))
    rings = z.select("zone", F.posexplode(ex.ring(F.col("lon"), F.col("lat"), F.lit(400.0))).alias("corner", "at"))
    return rings.select("zone", "corner", (r6(F.col("at")[0]) + 0.0).alias("lon"), (r6(F.col("at")[1]) + 0.0).alias("lat"))


@query("""select 'supplier-' || supplier_id as id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"name":"' || name || '","kind":"' || industry || '"}}' as feature from sup where lat is not null""")
def supplier_features(t):
    s = t.suppliers.where("lat is not null")
    return s.select(F.concat(F.lit("supplier-"), F.col("supplier_id").cast("string")).alias("id"), ex.point(F.col("lon"), F.col("lat"), name=F.col("name"), kind=F.col("industry")).alias("feature"))


@query("select node, case when node like '%supplier%' then 'supplier' when node like '%port%' then 'port' else 'chokepoint' end as kind from (select 'supplier-' || supplier_id as node from sup union all select 'port-' || port_id from port union all select 'chokepoint-' || chokepoint_id from choke)")
def node_kinds(t):
    n = lambda df, k: df.select(F.concat(F.lit(f"{k}-"), F.col(f"{k}_id").cast("string")).alias("node"), F.lit({"supplier": "vendor", "port": None, "chokepoint": "STRAIT"}[k]).alias("given"))
    every = n(t.suppliers, "supplier").union(n(t.ports, "port")).union(n(t.chokepoints, "chokepoint"))
    return every.select("node", ex.node_kind(F.col("given"), F.col("node")).alias("kind"))


@query("""select country as community, count(*) as suppliers, round(avg(risk_score), 6) as avg_risk, string_agg(distinct country, ',') as countries, array_to_string(list_sort(list(distinct industry)), ',') as industries, array_to_string(list(name order by name, supplier_id)[:5], ',') as names from sup group by country""")
def community_summary(t):
    return monitoring.community_summary(t.suppliers.withColumn("community", F.col("country")))


# ---- monitoring


@query(DAILY_SQL + """, a as (select kind, list(n order by day)[-14:] as w from daily group by kind),
j as (select kind, list_reduce(list_prepend(0.0::double, w), lambda s, x: greatest(0.0, s + x - list_sum(w[:-2]) / (len(w) - 1) - 0.5)) as statistic from a),
x as (select kind, n / max(n) over (partition by kind) as v, row_number() over (partition by kind order by day) - 1 as i from daily), f as (select kind, regr_slope(v, i) as b, count(*) as c from x group by kind)
select kind, 'changepoint' as signal, round(statistic, 6) as strength from j where statistic >= 5 union all select kind, 'trend', round(least(1.0, b * 10), 6) from f where c >= 7 and b > 0.01 and least(1.0, b * 10) > 0.5""")
def weak_signals(t):
    from pyspark.sql import Window

    daily = _daily(t)
    scores = daily.withColumn("v", F.col("n") / F.max("n").over(Window.partitionBy("kind")))
    return monitoring.weak_signals(signals.as_series(daily, "kind", "n"), signals.as_series(scores, "kind", "v"), "kind").withColumn("strength", r6("strength"))


@query(""", z as (select country as zone, avg(severity) as severity from ev group by country), d as (select zone, severity * 0.85 as base, i as day_no, (('0x' || substr(md5('7|' || zone || '|' || i || '|1'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u, (('0x' || substr(md5('7|' || zone || '|' || i || '|2'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as v from z, range(0, 30) r(i))
select zone, day_no::int as day_no, round(greatest(0.05, least(1.0, base * (0.9 + 0.1 * day_no / 29) + 0.06 * sqrt(-2 * ln(u)) * cos(6.283185307179586 * v))), 6) as rate from d""")
def stand_in_rates(t):
    zones = t.events.groupBy(F.col("country").alias("zone")).agg(F.avg("severity").alias("severity"))
    return monitoring.stand_in_rates(zones).withColumn("rate", r6("rate"))


@query(RATE_SQL + """, s as (select country, list(rate order by day) as v from rate group by country)
select country, 35::int as days, round(list_sum(list_resize([]::double[], greatest(35 - len(v), 0), v[1]) || v[-35:]), 6) as total from s""")
def padded_rates(t):
    s = monitoring.left_padded(signals.as_series(signals.regional_rate(t.events, "country", t.as_of), "country", "rate"), 35)
    return s.select("country", F.size("series").alias("days"), r6(F.aggregate("series", F.lit(0.0), lambda a, x: a + x)).alias("total"))


# ---- answers and documents

WORDS_SQL = """, q as (select * from (values (1, 'What is the risk score of oil suppliers?'), (2, 'Is the Suez canal open for container lines?'), (3, 'Which semiconductor fabs are there?'), (4, 'Tell me a joke'), (5, 'What is the risk score of nobody?'), (6, 'Any auto parts in trouble?')) v(question_id, question)),
w as (select question_id, unnest(list_distinct([x for x in regexp_extract_all(lower(question), '[a-z]{3,}') if x not in ('the', 'and', 'for', 'are', 'what', 'which', 'how', 'why', 'who', 'our', 'with', 'from', 'that', 'this', 'does', 'have', 'has', 'was', 'were', 'any', 'about')])[:8]) as word from q),
said as (select supplier_id, name, country, risk_score, unnest(list_distinct(regexp_extract_all(lower(name || ' ' || country || ' ' || industry), '[a-z]{3,}'))) as word from sup),
h as (select *, row_number() over (partition by question_id order by risk_score desc, supplier_id) as n from (select distinct question_id, supplier_id, name, country, risk_score from w join said using (word))),
f as (select question_id, string_agg(name || ' in ' || country || ' is rated ' || case when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' when risk_score >= 0.2 then 'LOW' else 'NONE' end, '; ' order by n) as facts, string_agg(name || ' ' || floor(risk_score * 100)::bigint || ' %', '; ' order by n) as scores from h where n <= 5 group by 1)
"""


@query(WORDS_SQL + """select question_id, case question_id when 2 then 'suez-canal-blockage' when 3 then 'taiwan-strait-tension' end as scenario_id, question_id <> 4 as grounded, case when question_id in (1, 5) then coalesce('Known scores: ' || scores || '.', 'No scores are known for this question, so no number is given.')
  when question_id = 2 then 'See scenario suez-canal-blockage. Facts: ' || coalesce(facts, 'none') || '.' when question_id = 3 then 'See scenario taiwan-strait-tension. Facts: ' || coalesce(facts, 'none') || '.' when facts is not null then 'No scenario fits. Facts: ' || facts || '.' else 'The tables do not say.' end as answer from q left join f using (question_id)""")
def grounded_answers(t):
    q = [(1, "What is the risk score of oil suppliers?"), (2, "Is the Suez canal open for container lines?"), (3, "Which semiconductor fabs are there?"), (4, "Tell me a joke"), (5, "What is the risk score of nobody?"), (6, "Any auto parts in trouble?")]
    return reports.answers(t.spark.createDataFrame(q, "question_id int, question string"), t.suppliers)


@query("""select ('0x' || substr(sha256('scenarios:s' || chokepoint_id), 1, 15))::bigint as id, 'simulation/s' || chokepoint_id as source, 'Closure of ' || chokepoint_name || '. Ships wait. Region: ' || chokepoint_name || '. Sectors: shipping, energy. Severity: 0.8. Mitigations: reroute; buffer; air freight' as text from choke
union all select ('0x' || substr(sha256('backtests:b' || chokepoint_id), 1, 15))::bigint, 'backtest/b' || chokepoint_id, 'Case ' || chokepoint_name || '. What happened. Region: ' || chokepoint_name || '. Lessons: watch queues; keep stock' from choke""")
def scenario_documents(t):
    c = t.chokepoints
    s = c.select(F.concat(F.lit("s"), F.col("chokepoint_id").cast("string")).alias("id"), F.concat(F.lit("Closure of "), "chokepoint_name").alias("name"), F.lit("Ships wait.").alias("description"), F.col("chokepoint_name").alias("region"), F.array(F.lit("shipping"), F.lit("energy")).alias("sectors"), F.lit(0.8).alias("severity"), F.array(*map(F.lit, ("reroute", "buffer", "air freight", "insure"))).alias("mitigations"))
    b = c.select(F.concat(F.lit("b"), F.col("chokepoint_id").cast("string")).alias("id"), F.concat(F.lit("Case "), "chokepoint_name").alias("title"), F.lit("What happened.").alias("description"), F.col("chokepoint_name").alias("region"), F.array(F.lit("watch queues"), F.lit("keep stock")).alias("lessons"))
    return reports.scenario_documents(s).unionByName(reports.backtest_documents(b))


@query("""select event_id as id, substr(case kind when 'shipment_delay' then 'Shipment Delay' else upper(kind[1]) || kind[2:] end || case when event_id % 2 = 0 then ' — Union (' || country || ')' else ' in ' || country end || '. ' || text || ' Region: ' || country, 1, 800) as text from ev""")
def message_documents(t):
    e = t.events.select("event_id", F.col("kind").alias("event_type"), F.lit(None).cast("string").alias("region"), "country", F.col("text").alias("description"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("Union"))).otherwise(F.array().cast("array<string>")).alias("actors"))
    return reports.message_documents(e)


@query(", b as (select * from sup order by risk_score desc, supplier_id limit 3) select row_number() over (order by o)::int as rank, r as recommendation from (select 1 as o, 'Review the ' || count(*) || ' riskiest suppliers now' as r from b having count(*) > 0 union all select 2, 'Start contingency plans for critical suppliers' from b having max(risk_score) > 0.8 union all select * from (values (3, 'Check stock of the products they make'), (4, 'Look for other suppliers'), (5, 'Tell stakeholders what changed')) v(o, r))")
def digest_recommendations(t):
    return reports.recommendations(t.suppliers)


# ---- simulation


def _draws_sql(scenarios: str) -> str:
    u = lambda use: f"((('0x' || substr(md5('42|' || scenario_id || '|' || iteration || '|{use}'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)"
    z = lambda use: f"sqrt(-2 * ln({u(use)})) * cos(6.283185307179586 * {u(use + 100)})"
    return f"""draw as materialized (select s.*, i as iteration, {u(1)} <= probability as fires, greatest(0.0, least(1.0, severity + 0.1 * {z(2)})) as drawn, {z(3)} as noise, {u(4)} as revenue_u from (select scenario_id, node, node_type, severity, probability, duration_days, i, i as iteration from ({scenarios}), range(0, 1000) r(i)) s)"""


SCENARIO_SQL = "select * from (values ('suez', 'chokepoint-0', 'chokepoint', 0.8::double, 0.5::double, 14), ('strike', 'port-3', 'port', 0.5, 0.3, 7), ('fire', 'supplier-4', 'supplier', 0.6, 0.2, 30)) v(scenario_id, node, node_type, severity, probability, duration_days)"
SWEEP_SQL = "select * from (values ('suez@0.2', 'chokepoint-0', 'chokepoint', 0.2::double, 0.5::double, 14), ('suez@0.5', 'chokepoint-0', 'chokepoint', 0.5, 0.5, 14), ('suez@0.8', 'chokepoint-0', 'chokepoint', 0.8, 0.5, 14)) v(scenario_id, node, node_type, severity, probability, duration_days)"
_STEPS = simulation.severity_steps(["SUPPLIES", "SHIPS_VIA", "PASSES_THROUGH"])


def _simulated_sql(scenarios: str) -> str:
    """Spread of every step of every scenario, then one row per iteration as ``out``."""
    step = f"len([s for s in {_STEPS} if s <= drawn + 1e-12])"
    groups = f"with {_draws_sql(scenarios)} select scenario_id || '|' || {step} as run_id, node, node_type, max(drawn) as impact from draw where fires and drawn >= 0.3 group by all"
    reached = "reached as (select run_id, count(*) filter (node_type = 'supplier') as suppliers, coalesce(sum(n), 0)::bigint as skus from spread left join (select 'supplier-' || supplier_id as node, n from sku) using (node) group by run_id)"
    out = f"""out as (select scenario_id, iteration, case when not fires then 'none' when drawn < 0.3 then 'contained' else 'disrupted' end as outcome, case when fires and drawn >= 0.3 then coalesce(suppliers, 0) else 0 end as suppliers, case when fires and drawn >= 0.3 then coalesce(skus, 0) else 0 end as skus,
      (case when not fires then 0 when drawn < 0.3 then greatest(1, floor(0.5 * duration_days)) else greatest(1, floor(duration_days * (1 + 0.1 * coalesce(suppliers, 0)) * (1 + 0.2 * noise))) end)::bigint as days, (case when fires and drawn >= 0.3 then coalesce(skus, 0) else 0 end) * (100000.0 + 900000.0 * revenue_u) as revenue
      from draw left join reached on run_id = scenario_id || '|' || {step})"""
    return _spread_sql(groups, 5) + f", {_draws_sql(scenarios)}{SKU_SQL}, {reached}, {out}"


SUMMARY_SQL = """, hit as (select scenario_id, count(*) as iterations, avg((outcome = 'disrupted')::int) as probability, coalesce(avg(suppliers) filter (outcome = 'disrupted'), 0.0) as suppliers, coalesce(avg(skus) filter (outcome = 'disrupted'), 0.0) as skus, coalesce(avg(days) filter (outcome = 'disrupted'), 0.0) as days, coalesce(avg(revenue) filter (outcome = 'disrupted'), 0.0) as revenue,
  """ + ", ".join(f"coalesce(quantile_cont({c}::double, {p / 100}) filter (outcome = 'disrupted'), 0.0) as {c}_p{p}" for c in ("days", "revenue") for p in (10, 50, 90)) + " from out group by scenario_id)"
_ROUNDED = ["suppliers", "skus", "days", "revenue", "days_p10", "days_p50", "days_p90", "revenue_p10", "revenue_p50", "revenue_p90"]
_ROUND_SQL = ", ".join(f"round({c}, 2) as {c}" for c in _ROUNDED)


def rounded(df):
    """Means and percentiles to two places: sums of many draws."""
    return df.withColumns({c: F.round(c, 2) for c in _ROUNDED})


@query(", " + _draws_sql(SCENARIO_SQL) + " select scenario_id, iteration::int as iteration, fires, round(drawn, 6) as drawn from draw")
def monte_carlo_draws(t):
    return simulation.iterations(_scenarios(t), 1000).select("scenario_id", "iteration", "fires", r6("drawn").alias("drawn"))


@query(_simulated_sql(SCENARIO_SQL) + SUMMARY_SQL + f" select scenario_id, iterations, probability, {_ROUND_SQL}, round(0.4 * probability + 0.4 * least(1.0, 0.3 * suppliers + 0.1 * skus + 0.4 * revenue / 1e6) + 0.2 * least(days / 30.0, 1.0), 6) as risk from hit")
def monte_carlo(t):
    return rounded(simulation.ranked(simulation.summary(simulation.simulate(graph.supply_edges(t), _scenarios(t), _sku_nodes(t)))))


@query(_simulated_sql(SWEEP_SQL) + SUMMARY_SQL + f" select scenario_id, iterations, probability, {_ROUND_SQL} from hit")
def sensitivity(t):
    one = _scenarios(t).where("scenario_id = 'suez'")
    return rounded(simulation.compare(simulation.summary(simulation.simulate(graph.supply_edges(t), simulation.sensitivity(one, "severity", [0.2, 0.5, 0.8]), _sku_nodes(t)))))


@query(_simulated_sql(SCENARIO_SQL) + f""", seen as (select scenario_id, spread.node, count(*) as runs from draw join spread on run_id = scenario_id || '|' || len([s for s in {_STEPS} if s <= drawn + 1e-12]) where spread.node_type = 'supplier' and fires and drawn >= 0.3 group by all),
r as (select *, row_number() over (partition by scenario_id order by runs desc, node) as rank from seen join (select scenario_id, count(*) as n from draw where fires and drawn >= 0.3 group by 1) using (scenario_id) where runs > 0.1 * n)
select scenario_id, rank::int as rank, node, runs from r where rank <= 10""")
def entity_frequency(t):
    return simulation.frequent(graph.supply_edges(t), _scenarios(t))


@query(_spread_sql("select 'r1' as run_id, 'supplier-1' as node, 'supplier' as node_type, 0.9 as impact", 5) + """, hit as (select run_id, node, 'affected_supplier' as role, row_number() over (order by step) as n from spread where node_type = 'supplier' and depth > 0), shown as (select run_id, node, role from hit where n <= 25 union all select run_id, node, 'epicenter' from spread where depth = 0)
select run_id, role, node as id, '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || lon || ',' || lat || ']},"properties":{"name":"' || name || '","risk_score":' || risk_score || ',"role":"' || role || '"}}' as feature from shown join sup on node = 'supplier-' || supplier_id where lat is not null""")
def scenario_overlay(t):
    spread = graph.propagate(graph.supply_edges(t), t.spark.createDataFrame([("r1", "supplier-1", "supplier", 0.9)], "run_id string, node string, node_type string, impact double"))
    return simulation.overlay(spread, t.suppliers)
