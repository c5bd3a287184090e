"""The registered queries of the library over the test tables, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import alerts, analytics, features, graph, links, reports, signals, simulation, text
from ..session import ship
from ..sources import sinks
from ..sources.tables import DOMAIN_SQL, Tables

FLAGSHIP = "supplier_risk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, domain: bool = True):
    """Register a function of Tables; ``sql`` follows the domain's common table expressions, or stands alone."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(ship(spark), sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = DOMAIN_SQL + sql if domain else sql
        return f

    return add


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


#: Stand-ins for the country tables: stability, weather and sanctions by nation key.
COUNTRY_SQL = """, country as (
  select n_name as country, 0.3::double + n_nationkey % 7 / 10.0::double as stability, n_nationkey % 4 / 5.0::double as weather, n_nationkey % 3 / 4.0::double as sanctions from nation where n_nationkey % 6 <> 0),
sig as (select supplier_id, count(*) as recent_events, count(*) filter (severity >= 0.75) as critical_events, max(severity) as max_severity from ev, now where ts > as_of - interval 30 day group by supplier_id),
hist as (select supplier_id, count(*) as n from lab where disrupted = 1 group by supplier_id),
lane as (select supplier_id, max(vessel_count) as vessels from via join port using (port_id) join choke using (chokepoint_id) group by supplier_id),
feat as (
  select s.supplier_id, s.name, s.country, greatest(least(coalesce(max_severity, 0.1), 1.0), coalesce(sanctions, 0.0) * 0.6) as proximity, coalesce(stability, 0.5) as stability,
    least(coalesce(vessels, 0) / 20.0::double, 1.0) as congestion, coalesce(weather, 0.0) as weather, coalesce(recent_events, 0)::bigint as recent_events,
    case when critical and coalesce(critical_events, 0) = 0 then 1 else coalesce(critical_events, 0) end::bigint as critical_events, single_source,
    case when critical then 0.35 else 0.65 end::double as financial_health, coalesce(hist.n, 0)::bigint as disruptions
  from sup s left join sig using (supplier_id) left join lane using (supplier_id) left join country using (country) left join hist using (supplier_id))
"""
SCORE_SQL = "least(1.0, greatest(0.0, 0.25 * proximity + 0.20 * single_source::int + 0.20 * least(critical_events / 5.0::double, 1.0) + 0.15 * least(disruptions / 5.0::double, 1.0) + 0.10 * congestion + 0.10 * weather))"


def _countries(t: Tables) -> DataFrame:
    n = F.col("n_nationkey")
    return t.raw("nation").where(n % 6 != 0).select(F.col("n_name").alias("country"), (0.3 + n % 7 / 10.0).alias("stability"), (n % 4 / 5.0).alias("weather"), (n % 3 / 4.0).alias("sanctions"))


def _features(t: Tables) -> DataFrame:
    return features.features(t.suppliers, features.event_signals(t.events, t.as_of), features.congestion(t.ships_via, t.ports, t.chokepoints), _countries(t), features.disruptions(t.disruption_labels))


# ---- features and scores


@query(COUNTRY_SQL + f", scored as (select *, {SCORE_SQL} as score from feat)" + """
select supplier_id, name, round(score, 6) as score, case when score >= 0.8 then 'CRITICAL' when score >= 0.6 then 'HIGH' when score >= 0.4 then 'MEDIUM' when score >= 0.2 then 'LOW' else 'NONE' end as category
from scored order by score desc, supplier_id limit 10""")
def supplier_risk(t):
    s = features.rule_score(_features(t))
    return s.orderBy(F.desc("score"), "supplier_id").limit(10).select("supplier_id", "name", r6("score").alias("score"), "category")


@query(COUNTRY_SQL + f"select supplier_id, round({SCORE_SQL}, 6) as score," + """
  concat_ws(',', case when proximity > 0.5 then 'conflict_proximity' end, case when single_source then 'single_source' end) as factors from feat""")
def supplier_risk_rule_score(t):
    return features.rule_score(_features(t)).select("supplier_id", r6("score").alias("score"), "factors")


@query(COUNTRY_SQL + """select supplier_id, round(proximity, 6) as f0, round(stability, 6) as f1, round(congestion, 6) as f2, round(weather, 6) as f3, round(least(recent_events / 10.0, 1.0), 6)::double as f4, round(least(critical_events / 5.0, 1.0), 6)::double as f5,
  0.2::double as f6, single_source::int::double as f7, 0.0::double as f8, financial_health as f9, 0.3::double as f10, round(least(disruptions / 5.0, 1.0), 6)::double as f11, 0.0::double as f12 from feat""")
def feature_vector(t):
    v = features.vector(_features(t))
    return v.select("supplier_id", *[r6(F.col("vector")[i]).alias(f"f{i}") for i in range(13)])


@query(COUNTRY_SQL + """select supplier_id, round(least(1.0, (proximity + (1.0 - stability)) / 2.0), 3) as geographic, round(least(1.0, (congestion + weather) / 2.0), 3) as operational,
  round(least(1.0, (single_source::int + least(1 / 5.0::double, 1.0)) / 2.0), 3) as network, round(least(1.0, (least(recent_events / 10.0::double, 1.0) + least(critical_events / 5.0::double, 1.0)) / 2.0), 3) as event_load from feat""")
def pillar_scores(t):
    return features.pillars(_features(t))


@query(COUNTRY_SQL + """select supplier_id, case when f.country in (select country from country) then 'cached' else 'static_fallback' end as stability_source,
  ((recent_events > 0)::int + (critical_events > 0)::int + (proximity > 0.1)::int + (congestion > 0)::int + (f.country in (select country from country))::int + single_source::int) || '/13' as live from feat f""")
def feature_provenance(t):
    return features.provenance(_features(t), _countries(t))


def _band(cuts: str) -> str:
    return f"select supplier_id, case {cuts} end as band from sup"


@query(_band("when risk_score is null then 'UNKNOWN' when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' when risk_score >= 0.2 then 'LOW' else 'NONE'"))
def risk_band_api(t):
    return t.suppliers.select("supplier_id", ex.band_api(F.col("risk_score")).alias("band"))


@query(_band("when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' else 'LOW'"))
def risk_band_map(t):
    return t.suppliers.select("supplier_id", ex.band_map(F.col("risk_score")).alias("band"))


@query(_band("when risk_score >= 0.75 then 'CRITICAL' when risk_score >= 0.5 then 'HIGH' when risk_score >= 0.25 then 'MEDIUM' else 'LOW'"))
def risk_band_methodology(t):
    return t.suppliers.select("supplier_id", ex.band_methodology(F.col("risk_score")).alias("band"))


@query(_band("when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' when risk_score >= 0.2 then 'LOW' else 'MINIMAL'"))
def risk_band_view(t):
    return t.suppliers.select("supplier_id", ex.band_view(F.col("risk_score")).alias("band"))


@query("""select event_id, round(case when event_id % 4 <> 0 and (event_id % 41 - 20) <> 0 then round(greatest(0.1, least(1.0, abs((event_id % 41 - 20) / 2.0::double) / 10)), 3)
  else case kind when 'protest' then 0.55 else 0.5 end end::double, 6) as severity from ev""")
def severity_estimate(t):
    e = F.col("event_id")
    scale = F.when(e % 4 != 0, (e % 41 - 20) / 2.0)
    return t.events.select("event_id", r6(ex.severity(scale, F.col("kind"))).alias("severity"))


@query("""select event_id, case when c = '' then 'unknown' else coalesce(map {'01': 'make_statement', '02': 'yield', '03': 'disapprove', '04': 'reject', '05': 'threaten', '06': 'protest', '07': 'coerce', '08': 'assault', '09': 'fight', '10': 'use_force', '11': 'mass_violence', '13': 'threaten_conflict', '14': 'protest_violence', '15': 'conflict', '16': 'fight_conflict', '17': 'violence_conflict', '18': 'assault_conflict', '19': 'force_conflict', '20': 'mass_violence_conflict'}[substr(c, 1, 2)], 'other') end as kind
from (select event_id, case when event_id % 29 = 0 then '' else lpad((event_id % 23)::varchar, 2, '0') || '1' end as c from ev)""")
def cameo_map(t):
    e = F.col("event_id")
    code = F.when(e % 29 == 0, "").otherwise(F.concat(F.lpad((e % 23).cast("string"), 2, "0"), F.lit("1")))
    return t.events.select("event_id", ex.root_type(code).alias("kind"))


# ---- roll-ups and views


@query("""select *, round(0.35 * (1 - missing_geo / greatest(suppliers, 1)::double) + 0.25 * with_events / greatest(suppliers, 1)::double + 0.25 * (1 - without_ports / greatest(suppliers, 1)::double) + 0.15 * least(tier2_links / greatest(suppliers, 1)::double, 1.0), 3) as completeness, 'healthy' as status from (
  select (select count(*) from sup) as suppliers, (select count(*) from sup where lat is null or lon is null) as missing_geo, (select count(*) from sup where supplier_id not in (select supplier_id from via)) as without_ports,
    (select count(distinct supplier_id) from aff) as with_events, (select round(avg(confidence), 3) from aff) as avg_confidence, (select count(confidence) from aff) as links,
    (select count(*) from supplies where tier >= 2) as tier2_links, (select count(*) from ev) as events)""")
def graph_health(t):
    return analytics.graph_health(t.suppliers, t.events, t.affects, t.ships_via, t.supplies)


@query(""", sector as (select * from (values ('semiconductors', ['semiconductor', 'electronics', 'chip', 'taiwan']), ('energy', ['energy', 'oil', 'lng', 'chemical', 'rotterdam']), ('automotive', ['auto', 'motor', 'vehicle', 'parts']), ('shipping', ['port', 'shipping', 'maritime', 'logistics'])) v(sector, words)),
m as (select sector, s.*, row_number() over (partition by sector order by risk_score desc, supplier_id) as r from sector, sup s where len([w for w in words if contains(lower(name || ' ' || industry), w)]) > 0)
select sector.sector, count(m.supplier_id) as suppliers, coalesce(round(avg(risk_score), 3), 0.0) as avg_risk, coalesce(max(risk_score), 0.0) as max_risk, count(*) filter (critical) as critical, coalesce(string_agg(name, ',' order by r) filter (r <= 5), '') as top_suppliers
from sector left join m on m.sector = sector.sector group by sector.sector""")
def sector_rollup(t):
    return analytics.sector_rollup(t.suppliers)


@query("select kind, count(*) as n from ev, now where ts > as_of - interval 7 day group by kind order by n desc, kind limit 5")
def weekly_event_types(t):
    return analytics.weekly_types(t.events, t.as_of)


@query("""select count(*) as events, count(*) filter (severity >= 0.75) as critical, (select count(distinct supplier_id) from aff where event_id in (select event_id from ev, now where ts > as_of - interval 7 day)) as suppliers_hit,
  (select kind from ev, now where ts > as_of - interval 7 day group by kind order by count(*) desc, kind limit 1) as leading, count(*) || ' events, ' || count(*) filter (severity >= 0.75) || ' critical, mostly ' || (select kind from ev, now where ts > as_of - interval 7 day group by kind order by count(*) desc, kind limit 1) as summary
from ev, now where ts > as_of - interval 7 day""")
def weekly_digest(t):
    return analytics.digest(t.events, t.affects, t.suppliers, t.as_of)


@query("select supplier_id, name, risk_score from sup order by risk_score desc, supplier_id limit 10")
def top_risky_suppliers(t):
    return t.suppliers.orderBy(F.desc("risk_score"), "supplier_id").limit(10).select("supplier_id", "name", "risk_score")


@query("select supplier_id, name, country from sup order by name, supplier_id limit 20 offset 10")
def suppliers_page(t):
    return analytics.page(t.suppliers, ["name", "supplier_id"], 10, 20).select("supplier_id", "name", "country")


@query("select supplier_id, name from sup where supplier_id not in (select supplier_id from via)")
def suppliers_without_port(t):
    return t.suppliers.join(t.ships_via, "supplier_id", "left_anti").select("supplier_id", "name")


@query("select supplier_id, name from sup where supplier_id in (select supplier_id from aff)")
def suppliers_with_events(t):
    return t.suppliers.join(t.affects, "supplier_id", "left_semi").select("supplier_id", "name")


@query("select supplier_id, name, country from sup where contains(lower(name), '5') or contains(lower(country), 'an') and contains(lower(industry), 'oil')")
def supplier_search(t):
    return t.suppliers.where(F.lower("name").contains("5") | (F.lower("country").contains("an") & F.lower("industry").contains("oil"))).select("supplier_id", "name", "country")


@query(""", best as (select * from ev order by severity desc, event_id limit 50),
h as (select distinct b.event_id, s.supplier_id, s.name from best b join aff a using (event_id) join sup s on s.supplier_id = a.supplier_id),
f as (select *, row_number() over (partition by event_id order by name, supplier_id) as r from h)
select b.event_id, b.ts, b.kind, b.severity, coalesce((select string_agg(name, ',' order by r) from f where f.event_id = b.event_id and r <= 3), '') as suppliers from best b""")
def event_timeline(t):
    return analytics.timeline(t.events, t.affects, t.suppliers)


@query("""select supplier_id, lat, lon, risk_score, case when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' else 'LOW' end as band
from sup where risk_score >= 0.3 and lat is not null order by risk_score desc, supplier_id limit 500""")
def risk_map_points(t):
    return analytics.risk_points(t.suppliers, 0.3).drop("feature")


@query("""select * from (select 'ships_via' as kind, name as origin, port_name as target from via join sup using (supplier_id) join port on port.port_id = via.port_id where is_primary order by supplier_id limit 50)
union select * from (select 'passes_through', port_name, chokepoint_name from port join choke using (chokepoint_id) order by port_id limit 50)""")
def trade_routes_union(t):
    return analytics.trade_routes(t.suppliers, t.ships_via, t.ports, t.chokepoints)


EDGES_SQL = """, edge as (
  select 'supplier-' || src as src, 'supplier' as src_type, 'SUPPLIES' as rel, 'supplier-' || dst as dst, 'supplier' as dst_type from supplies
  union all select 'supplier-' || supplier_id, 'supplier', 'SHIPS_VIA', 'port-' || port_id, 'port' from via
  union all select 'port-' || port_id, 'port', 'PASSES_THROUGH', 'chokepoint-' || chokepoint_id, 'chokepoint' from port),
near as (select src as node, src_type as node_type, rel, dst as next, dst_type as next_type from edge union select dst, dst_type, rel, src, src_type from edge)
"""


@query(EDGES_SQL + "select distinct edge.* from edge join (select 'supplier-' || supplier_id as node from (select supplier_id from sup order by risk_score desc, supplier_id limit 50)) b on b.node = src or b.node = dst")
def network_edges(t):
    return analytics.network(t.suppliers, graph.supply_edges(t))


@query("select tier, count(a.event_id) as n from (values ('critical'), ('warning'), ('info')) v(tier) left join (select *, case when severity >= 0.85 then 'critical' when severity >= 0.4 then 'warning' else 'info' end as t from ev) a on a.t = v.tier group by tier")
def weekly_alert_stats(t):
    return analytics.alert_counts(t.events.select(alerts.tier_of(F.col("severity")).alias("tier")))


@query("""select event_id as alert_id, ts, case when severity >= 0.85 then 'critical' when severity >= 0.4 then 'warning' else 'info' end as tier, supplier_id::varchar as entity_id, text as title
from ev, now where severity >= 0.75 and ts > as_of - interval 24 hour order by severity desc, event_id limit 10""")
def high_alerts(t):
    return alerts.emit_high(t.events, t.as_of, 24)


@query("select supplier_id, name, risk_score from sup where risk_score >= 0.5 order by risk_score desc, supplier_id limit 15")
def historical_replay(t):
    return t.suppliers.where("risk_score >= 0.5").orderBy(F.desc("risk_score"), "supplier_id").limit(15).select("supplier_id", "name", "risk_score")


@query("select country, count(*) as suppliers, round(avg(risk_score), 6) as avg_risk, string_agg(distinct industry, ',' order by industry) as industries from sup group by country")
def community_by_country(t):
    return t.suppliers.groupBy("country").agg(F.count("*").alias("suppliers"), r6(F.avg("risk_score")).alias("avg_risk"), F.array_join(F.array_sort(F.collect_set("industry")), ",").alias("industries"))


@query("select country, round(sum(share * share), 6) as concentration from (select country, revenue / sum(revenue) over (partition by country) as share from sup where revenue > 0) group by country")
def revenue_concentration(t):
    s = t.suppliers.where("revenue > 0").withColumn("share", F.col("revenue") / F.sum("revenue").over(Window.partitionBy("country")))
    return s.groupBy("country").agg(r6(F.sum(F.col("share") * F.col("share"))).alias("concentration"))


@query("select o_orderstatus as status, o_orderpriority as priority, count(*) as orders, round(sum(o_totalprice), 2) as volume from orders group by all", domain=False)
def order_volume(t):
    return t.raw("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("volume"))


@query("""select l_suppkey as supplier_id, count(distinct l_partkey) as products, count(*) as lines, round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue, round(avg(l_quantity), 6) as avg_quantity from lineitem group by l_suppkey""", domain=False)
def supplier_volume(t):
    return t.raw("lineitem").groupBy(F.col("l_suppkey").alias("supplier_id")).agg(F.countDistinct("l_partkey").alias("products"), F.count("*").alias("lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), r6(F.avg("l_quantity")).alias("avg_quantity"))


# ---- links and joins


@query("""select event_id, supplier_id, round(d, 3) as distance_km from (
  select event_id, supplier_id, 2 * 6371.0 * atan2(sqrt(a), sqrt(1 - a)) as d from (
    select event_id, s.supplier_id, pow(sin(radians(s.lat - e.lat) / 2), 2) + cos(radians(e.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - e.lon) / 2), 2) as a
    from ev e, sup s where e.lat is not null and s.lat is not null)) where d <= 250""")
def event_supplier_geo_link(t):
    return links.geo_links(t.events, t.suppliers).select("event_id", "supplier_id", F.round("distance_km", 3).alias("distance_km"))


@query("select event_id, s.supplier_id, 'country_match' as method, 0.7::double as confidence from ev e join sup s on upper(e.country) = upper(s.country)")
def event_supplier_country_link(t):
    return links.country_links(t.events, t.suppliers)


@query("select event_id, supplier_id, min_by(method, linked_at::varchar || seq) as method, max(least(1.0, greatest(0.0, confidence))) as confidence, min(linked_at) as linked_at from aff group by event_id, supplier_id")
def affects_merge_max_conf(t):
    return links.merge_links(t.affects)


@query("select a.supplier_id as a, b.supplier_id as b, a.country from sup a join sup b on a.country = b.country and a.supplier_id < b.supplier_id")
def same_country_pairs(t):
    return links.same_country_pairs(t.suppliers)


@query("select s.supplier_id, s.name, count(e.event_id) as events, count(*) filter (e.severity >= 0.75) as critical, max(e.severity) as max_severity from sup s left join (select ev.* from ev, now where ts > as_of - interval 7 day) e on e.supplier_id = s.supplier_id group by all")
def optional_event_features(t):
    s = features.event_signals(t.events, t.as_of, 7)
    return t.suppliers.join(s, "supplier_id", "left").select("supplier_id", "name", F.coalesce("recent_events", F.lit(0)).alias("events"), F.coalesce("critical_events", F.lit(0)).alias("critical"), "max_severity")


@query("select s.supplier_id, c.chokepoint_name, count(*) as lanes, max(c.vessel_count) as vessels from sup s join via v using (supplier_id) join port p on p.port_id = v.port_id join choke c on c.chokepoint_id = p.chokepoint_id group by all")
def two_hop_exposure(t):
    lanes = t.suppliers.select("supplier_id").join(t.ships_via, "supplier_id").join(t.ports.select("port_id", "chokepoint_id"), "port_id").join(t.chokepoints, "chokepoint_id")
    return lanes.groupBy("supplier_id", "chokepoint_name").agg(F.count("*").alias("lanes"), F.max("vessel_count").alias("vessels"))


@query(""", snap as (select supplier_id, date_trunc('day', ts)::timestamp as day, max(severity) as score from ev group by all), first as (select supplier_id, min_by(score, day) as score from snap group by 1)
select event_id, e.supplier_id, round(coalesce(s.score, f.score), 6) as score from (select event_id, supplier_id, ts - interval 1 day as ts from ev) e asof left join snap s on s.supplier_id = e.supplier_id and e.ts >= s.day left join first f on f.supplier_id = e.supplier_id""")
def asof_snapshot(t):
    """Each event with its supplier's score of the day before, or the first one where there is none so early."""
    snap = t.events.groupBy("supplier_id", F.date_trunc("day", "ts").alias("day")).agg(F.max("severity").alias("score"))
    want = t.events.select("event_id", "supplier_id", (F.col("ts") - F.make_dt_interval(F.lit(1))).alias("ts"))
    return links.as_of_join(want, snap, "supplier_id", "ts", "day", "score").select("event_id", "supplier_id", r6("score").alias("score"))


@query("""select vessel_id as mmsi, case when c is not null then 'chokepoint_transit' when speed < 1 then 'port_call' else 'vessel_position' end as event_type, c as chokepoint from (
  select event_id as vessel_id, event_id % 20 / 2.0 as speed, lat, lon, (select chokepoint from (select 1 as ord, 'suez' as chokepoint, 30.0::double as clat, 32.5::double as clon, 900.0::double as r union all select 2, 'hormuz', 26.5, 56.3, 900.0 union all select 3, 'malacca', 2.5, 101.0, 1200.0) k
    where 2 * 3440.065 * atan2(sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)), sqrt(1 - (pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) <= r order by ord limit 1) as c
  from ev where lat is not null)""")
def vessel_chokepoint(t):
    v = t.events.select(F.col("event_id").alias("mmsi"), "ts", "lat", "lon", (F.col("event_id") % 20 / 2.0).alias("speed"))
    k = t.spark.createDataFrame([(1, "suez", 30.0, 32.5, 900.0), (2, "hormuz", 26.5, 56.3, 900.0), (3, "malacca", 2.5, 101.0, 1200.0)], "ord int, chokepoint string, lat double, lon double, radius_nm double")
    return links.vessel_events(v, k).select("mmsi", "event_type", "chokepoint")


# ---- series


@query(""", d as (select supplier_id, ts::date as day, count(*) as n from ev, now where ts::date > as_of::date - 30 group by all),
spine as (select supplier_id, unnest(generate_series((select as_of::date - 29 from now), (select as_of::date from now), interval 1 day))::date as day from (select distinct supplier_id from d))
select s.supplier_id, s.day::varchar as day, coalesce(n, 0)::bigint as n from spine s left join d on d.supplier_id = s.supplier_id and d.day = s.day""")
def daily_counts_spine(t):
    return signals.daily_counts(t.events, "supplier_id", t.as_of).withColumn("day", F.col("day").cast("string"))


DAILY_SQL = """, d as (select kind, ts::date as day, count(*) as n from ev, now where ts::date > as_of::date - 30 group by all),
spine as (select kind, unnest(generate_series((select as_of::date - 29 from now), (select as_of::date from now), interval 1 day))::date as day from (select distinct kind from d)),
daily as (select s.kind, s.day, coalesce(n, 0)::double as n from spine s left join d on d.kind = s.kind and d.day = s.day)
"""


def _daily(t: Tables) -> DataFrame:
    return signals.daily_counts(t.events, "kind", t.as_of)


@query(DAILY_SQL + """select kind, day::varchar as day, round(m, 6) as mean, round(s, 6) as std, t as top, round(coalesce(b, 0), 6) + 0.0 as slope from (
  select kind, day, avg(n) over w as m, stddev_pop(n) over w as s, max(n) over w as t, regr_slope(n, x) over w as b, count(*) over w as c from (select *, row_number() over (partition by kind order by day)::double as x from daily)
  window w as (partition by kind order by day rows 6 preceding)) where c = 7""")
def sliding_window_features(t):
    return signals.window_features(_daily(t), "kind", "n").select("kind", F.col("day").cast("string").alias("day"), r6("mean").alias("mean"), r6("std").alias("std"), "top", (F.coalesce(r6("slope"), F.lit(0.0)) + 0.0).alias("slope"))


@query(DAILY_SQL + """, a as (select kind, list(n order by day)[-14:] as w from daily group by kind)
select kind, round(list_reduce(list_prepend(0.0::double, w), lambda s, x: greatest(0.0, s + x - list_sum(w[:-2]) / (len(w) - 1) - 0.5)), 6) as statistic, round(list_sum(w[:-4]) / (len(w) - 3), 6) as baseline_rate, round(list_sum(w[-3:]) / 3, 6) as current_rate,
  list_reduce(list_prepend(0.0::double, w), lambda s, x: greatest(0.0, s + x - list_sum(w[:-2]) / (len(w) - 1) - 0.5)) >= 5 as detected from a""")
def cusum(t):
    c = signals.changepoint(signals.as_series(_daily(t), "kind", "n"), "kind")
    return c.select("kind", r6("statistic").alias("statistic"), r6("baseline_rate").alias("baseline_rate"), r6("current_rate").alias("current_rate"), "detected")


RATE_SQL = """, r0 as (select country, ts::date as day, count(*) as n, avg(severity) as s from ev, now where ts::date > as_of::date - 30 group by all),
rate as (select country, day, 0.5 * n / max(n) over (partition by country) + 0.5 * s as rate from r0)
"""


@query(RATE_SQL + "select country, day::varchar as day, round(rate, 6) as rate from rate")
def regional_rate(t):
    return signals.regional_rate(t.events, "country", t.as_of).select("country", F.col("day").cast("string").alias("day"), r6("rate").alias("rate"))


@query(RATE_SQL + """, m as (select country, avg(rate) as x from (select *, row_number() over (partition by country order by day desc) as r from rate) where r <= 7 group by country)
select country, round(x, 6) as rate, case when x >= 0.75 then 'crisis' when x >= 0.45 then 'escalation' else 'stable' end as regime,
  round(case when x >= 0.75 then least(0.95, 0.6 + x * 0.3) when x >= 0.45 then least(0.9, 0.5 + x * 0.35) else least(0.9, 0.55 + (1 - x) * 0.3) end, 6) as confidence from m""")
def regime_threshold(t):
    s = signals.as_series(signals.regional_rate(t.events, "country", t.as_of), "country", "rate")
    return signals.threshold_regime(s, "country").select("country", r6("rate").alias("rate"), "regime", r6("confidence").alias("confidence"))


@query(RATE_SQL + """, x as (select country, rate, row_number() over (partition by country order by day) - 1 as i from rate), f as (select country, regr_slope(rate, i) as b, regr_intercept(rate, i) as a, count(*) as n from x group by country)
select country, round(b, 6) as slope, case when b > 0.01 then 'increasing' when b < -0.01 then 'decreasing' else 'stable' end as direction, round(greatest(0.0, least(1.0, a + b * n)), 6) as next from f""")
def linear_trend(t):
    s = signals.as_series(signals.regional_rate(t.events, "country", t.as_of), "country", "rate")
    return signals.trend(s, "country").select("country", r6("slope").alias("slope"), "direction", r6(F.col("forecast")[0]).alias("next"))


@query(DAILY_SQL + "select kind, day::varchar as day, array_to_string([x::int for x in inputs], ',') as inputs, n as label from (select kind, day, n, list(n) over (partition by kind order by day rows between 7 preceding and 1 preceding) as inputs from daily) where len(inputs) = 7")
def training_sequences(t):
    return signals.training_sequences(_daily(t), "kind", "n").select("kind", F.col("day").cast("string").alias("day"), F.array_join(F.transform("inputs", lambda x: x.cast("int").cast("string")), ",").alias("inputs"), "label")


@query()
def hmm_regime(t):
    return signals.hidden_regime(signals.as_series(signals.regional_rate(t.events, "country", t.as_of), "country", "rate"), "country")


@query()
def isolation_forest(t):
    w = signals.window_features(_daily(t), "kind", "n")
    return signals.anomalies(w.na.fill(0.0), "kind", ["mean", "std", "top", "slope"])


# ---- graph


@query(EDGES_SQL + """, hop1 as (select distinct next as node from near where node = 'supplier-1' and next <> 'supplier-1'),
hop2 as (select distinct n.next as node from near n join hop1 h on h.node = n.node where n.next <> 'supplier-1' and n.next not in (select node from hop1)),
hop3 as (select distinct n.next as node from near n join hop2 h on h.node = n.node where n.next <> 'supplier-1' and n.next not in (select node from hop1) and n.next not in (select node from hop2))
select 'supplier-1' as start, 'supplier-1' as node, 0 as hops union all select 'supplier-1', node, 1 from hop1 union all select 'supplier-1', node, 2 from hop2 union all select 'supplier-1', node, 3 from hop3""")
def path_reachability(t):
    return graph.reachable(graph.supply_edges(t), t.spark.createDataFrame([("supplier-1",)], "node string"), 3)


def _spread(t: Tables, runs: list[tuple], depth: int = 5) -> DataFrame:
    return graph.propagate(graph.supply_edges(t), t.spark.createDataFrame(runs, "run_id string, node string, node_type string, impact double"), depth)


def _spread_sql(runs: str, depth: int) -> str:
    """Breadth-first levels l0, l1, ... and their union ``spread``, from runs(run_id, node, node_type, impact)."""
    decay = "case rel " + " ".join(f"when '{r}' then {v[0]}" for r, v in graph.DECAY.items()) + " else 0.5 end"
    hours = "case rel " + " ".join(f"when '{r}' then {v[1]}" for r, v in graph.DECAY.items()) + " else 48.0 end"
    out = EDGES_SQL + f", runs as ({runs}), nb as (select distinct * from near), a0 as (select run_id, node, node_type, 0 as depth, impact::double as impact, 0.0::double as delay_hours, 0::bigint as parent_step, '' as via from runs)"
    for d in range(depth):
        before = " union all ".join(f"select run_id, node from l{i}" for i in range(d)) or "select '' as run_id, '' as node where false"
        out += f""",
b{d} as materialized ({before}),
t{d} as (select * from (select a.*, row_number() over (partition by run_id, node order by parent_step, via) as k from a{d} a where impact >= 0.1 and not exists (select 1 from b{d} b where b.run_id = a.run_id and b.node = a.node)) where k = 1),
l{d} as materialized (select t.*, (row_number() over (partition by run_id order by parent_step, via, node) + (select count(*) from b{d} b where b.run_id = t.run_id))::bigint as step from t{d} t)"""
        if d + 1 < depth:
            out += f""",
a{d + 1} as (select run_id, next as node, next_type as node_type, {d + 1} as depth, impact * {decay} as impact, delay_hours + {hours} as delay_hours, step as parent_step, rel as via from l{d} join nb using (node) where l{d}.node_type in ('supplier', 'port', 'chokepoint'))"""
    return out + ", spread as (" + " union all ".join(f"select run_id, step, node, node_type, depth, impact, delay_hours from l{d}" for d in range(depth)) + ")"


@query(_spread_sql("select * from (values ('r1', 'chokepoint-1', 'chokepoint', 0.9), ('r2', 'supplier-3', 'supplier', 0.6)) v(run_id, node, node_type, impact)", 5) + " select run_id, step, node, depth, round(impact, 6) as impact, delay_hours from spread")
def bfs_propagation(t):
    return _spread(t, [("r1", "chokepoint-1", "chokepoint", 0.9), ("r2", "supplier-3", "supplier", 0.6)]).select("run_id", "step", "node", "depth", r6("impact").alias("impact"), "delay_hours")


SKU_SQL = ", sku as (select l_suppkey as supplier_id, count(distinct l_partkey) as n from lineitem group by l_suppkey)"


def _skus(t: Tables) -> DataFrame:
    return t.raw("lineitem").groupBy(F.col("l_suppkey").alias("supplier_id")).agg(F.countDistinct("l_partkey").alias("n"))


@query(SKU_SQL + " select supplier_id, n, (select sum(greatest(50000.0, 250000.0 * (1 - 0.05 * i))) from range(0, n) r(i))::double as revenue from sku")
def revenue_closed_form(t):
    return _skus(t).select("supplier_id", "n", graph.revenue(F.col("n")).alias("revenue"))


@query(SKU_SQL + " select supplier_id, trunc((supplier_id % 200) / 24.0::double + 7 + greatest(least(0.5 * (supplier_id % 40), 14), least(0.1 * n, 21)))::int as days from sku")
def recovery_days(t):
    return _skus(t).select("supplier_id", graph.recovery_days(F.col("supplier_id") % 200, F.col("supplier_id") % 40, F.col("n")).alias("days"))


_PATH_RISK_SQL = "greatest(0.0, least(1.0, 0.4 * impact + 0.5 * least(revenue_at_risk / 1e6, 1.0) - 0.05 * step))"


@query(_spread_sql("select 'chokepoint-' || chokepoint_id as run_id, 'chokepoint-' || chokepoint_id as node, 'chokepoint' as node_type, 0.5 as impact from choke", 3) + SKU_SQL + f""", hit as (select run_id as source, step, depth, impact, coalesce((select sum(greatest(50000.0, 250000.0 * (1 - 0.05 * i))) from range(0, (select n from sku where supplier_id = 2)) r(i)), 0)::double as revenue_at_risk from spread where node = 'supplier-2')
select source, step, depth, round(impact, 6) as impact, revenue_at_risk, round({_PATH_RISK_SQL}, 6) as risk, case when {_PATH_RISK_SQL} > 0.7 then 'HIGH' else 'MEDIUM' end as priority from hit""")
def critical_paths(t):
    found = graph.critical_paths(graph.supply_edges(t), _chokepoint_nodes(t), "supplier-2", _sku_nodes(t))
    return found.withColumn("impact", r6("impact")).withColumn("risk", r6("risk"))


def _chokepoint_nodes(t: Tables) -> DataFrame:
    return t.chokepoints.select(F.concat(F.lit("chokepoint-"), F.col("chokepoint_id").cast("string")).alias("node"), F.lit("chokepoint").alias("node_type"))


def _paths_sql(depth: int, best: int) -> str:
    share = "case rel " + " ".join(f"when '{r}' then {v[0]}" for r, v in graph.DECAY.items()) + " else 0.5 end"
    out = EDGES_SQL + f", shr as materialized (select node, next, max({share})::double as share from near group by all), f0 as (select 'chokepoint-' || chokepoint_id as start, 'chokepoint-' || chokepoint_id as node, 0 as hops, ['chokepoint-' || chokepoint_id] as path, 1.0::double as impact from choke)"
    for h in range(1, depth + 1):
        out += f""",
f{h} as materialized (select start, node, hops, path, impact from (select *, row_number() over (partition by start, node order by impact desc, array_to_string(path, '>')) as k from (
  select start, next as node, {h} as hops, list_append(path, next) as path, round(impact * share, 9) as impact from f{h - 1} join shr using (node) where not list_contains(path, next))) where k <= {best})"""
    every = " union all ".join(f"select * from f{h}" for h in range(1, depth + 1))
    return out + f" select start, node, rank::int as rank, hops::int as hops, array_to_string(path, '>') as path, impact from (select *, row_number() over (partition by start, node order by impact desc, hops, array_to_string(path, '>')) as rank from ({every})) where rank <= {best}"


@query(_paths_sql(3, 3))
def supply_paths(t):
    """The three strongest paths of three links at most from each chokepoint to every node."""
    return graph.paths(graph.supply_edges(t), _chokepoint_nodes(t), 3, 3)


def _labels_sql(rounds: int) -> str:
    out = EDGES_SQL + ", link as (select distinct node, next from near where rel = 'SUPPLIES'), c0 as (select 'supplier-' || supplier_id as node, 'supplier-' || supplier_id as community from sup)"
    for i in range(rounds):
        out += f""",
v{i} as (select node, community, row_number() over (partition by node order by count(*) desc, community) as k from (select l.node, c.community from link l join c{i} c on c.node = l.next) group by node, community),
c{i + 1} as materialized (select c.node, coalesce(v.community, c.community) as community from c{i} c left join v{i} v on v.node = c.node and v.k = 1)"""
    return out + f" select * from c{rounds}"


@query(_labels_sql(3))
def label_communities(t):
    nodes = t.suppliers.select(F.concat(F.lit("supplier-"), F.col("supplier_id").cast("string")).alias("node"))
    e = graph.supply_edges(t).where("rel = 'SUPPLIES'")
    return graph.communities(e, nodes, 3)


def _scenarios(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("suez", "chokepoint-0", "chokepoint", 0.8, 0.5, 14), ("strike", "port-3", "port", 0.5, 0.3, 7), ("fire", "supplier-4", "supplier", 0.6, 0.2, 30)], "scenario_id string, node string, node_type string, severity double, probability double, duration_days int")


def _sku_nodes(t: Tables) -> DataFrame:
    return _skus(t).select(F.concat(F.lit("supplier-"), F.col("supplier_id").cast("string")).alias("node"), "n")


@query("select kind, quantile_cont(severity, 0.1) as p10, quantile_cont(severity, 0.5) as p50, quantile_cont(severity, 0.9) as p90, round(avg(severity), 6) as mean from ev group by kind")
def percentile_bands(t):
    p = lambda q: F.percentile("severity", F.lit(q))
    return t.events.groupBy("kind").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), r6(F.avg("severity")).alias("mean"))


# ---- statistics and evaluation


@query("select list_sort(list(severity))[(ceil(0.9 * (count(*) - 1)))::int + 1] as quantile from ev")
def conformal_quantile(t):
    return analytics.quantile_higher(t.events, "severity", 0.9)


@query(", p as (select s.supplier_id, s.risk_score, count(e.event_id)::double as n from sup s left join ev e using (supplier_id) group by all) select count(*) as n, round(corr(risk_score, n), 6) as r, case when count(*) < 5 then 'insufficient_data' else 'association_only' end as verdict from p")
def pearson_corr(t):
    e = t.events.groupBy("supplier_id").agg(F.count("*").cast("double").alias("n"))
    p = t.suppliers.join(e, "supplier_id", "left").select("risk_score", F.coalesce("n", F.lit(0.0)).alias("n"))
    return analytics.correlation(p, "risk_score", "n").withColumn("r", F.round("r", 6))


@query()
def bootstrap_ci(t):
    e = t.events.groupBy("supplier_id").agg(F.count("*").cast("double").alias("n"))
    return analytics.bootstrap_correlation(t.suppliers.join(e, "supplier_id").select("risk_score", "n"), "risk_score", "n")


@query("select doc_id % 50 as supplier_id, max(toxic)::int as disrupted, max(quality)::int as quality from labels group by 1", domain=False)
def label_max(t):
    return t.raw("labels").groupBy((F.col("doc_id") % 50).alias("supplier_id")).agg(F.max("toxic").cast("int").alias("disrupted"), F.max("quality").cast("int").alias("quality"))


@query(""", l as (select l.doc_id as id, toxic as disrupted, case when l.doc_id % 7 <> 0 then (l.doc_id * 37 % 101) / 100.0::double end as score, l.doc_id % 30 as lead_days from labels l),
b as (select * from l where score is not null order by score desc, id limit 20)
select count(*) filter (disrupted = 1 and coalesce(score, 0) >= 0.5) as tp, count(*) filter (disrupted <> 1 and coalesce(score, 0) >= 0.5) as fp, count(*) filter (disrupted = 1 and coalesce(score, 0) < 0.5) as fn, count(*) filter (disrupted <> 1 and coalesce(score, 0) < 0.5) as tn,
  round(case when tp + fp > 0 then tp / (tp + fp)::double else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn)::double else 0 end, 6) as recall,
  (select list_sort(list(lead_days))[count(*) // 2 + 1] from l where disrupted = 1 and score >= 0.5) as median_lead, (select count(*) filter (disrupted = 1) / greatest(count(*), 1)::double from b) as precision_at_k from l""")
def backtest_metrics(t):
    d = F.col("doc_id")
    rows = t.raw("labels").select(d.alias("id"), F.col("toxic").alias("disrupted"), F.when(d % 7 != 0, (d * 37 % 101) / 100.0).alias("score"), (d % 30).alias("lead_days"))
    return analytics.backtest(rows)


# ---- text and retrieval


@query("""select event_id, case when regexp_matches(t, '\\b(war|invasion|airstrike|missile|bombing|armed conflict)\\b') then 'armed_conflict' when regexp_matches(t, '\\b(blockade|port closed|canal blocked|shipping halted)\\b') then 'port_disruption'
  when regexp_matches(t, '\\b(sanction|embargo|export ban|trade restriction)\\b') then 'sanctions' when regexp_matches(t, '\\b(protest|strike|riot|demonstration|unrest)\\b') then 'civil_unrest' when regexp_matches(t, '\\b(hurricane|earthquake|flood|wildfire|typhoon|cyclone)\\b') then 'natural_disaster'
  when regexp_matches(t, '\\b(congestion|delay|backlog|shortage)\\b') then 'logistics_delay' else 'general_signal' end as event_type from (select event_id, lower(text) as t from ev)""")
def event_classifier(t):
    return t.events.select("event_id", text.event_class(F.col("text"))[0].alias("event_type"))


def _risk_sql() -> str:
    """Common table expressions ``risk``(event_id, level, confidence): the words of each level counted in the text."""
    count = lambda words: " + ".join(f"contains(t, '{w}')::int" for w in words)
    counts = ", ".join(f"{count(words)} as {level}" for level, words in text.RISK_WORDS.items())
    best = "greatest(" + ", ".join(text.RISK_WORDS) + ")"
    total = " + ".join(text.RISK_WORDS)
    ladder = " ".join(f"when {level} = {best} then '{level}'" for level in reversed(text.RISK_WORDS))
    return f", risk as (select event_id, case when {total} = 0 then 'NONE' {ladder} end as level, case when {total} = 0 then 1.0 else {best}::double / ({total}) end::double as confidence from (select event_id, {counts} from (select event_id, lower(text) as t from ev)))"


def _kind_sql() -> str:
    """Common table expression ``kinds``(event_id, event_type): the first rule that matches."""
    ladder = " ".join(f"when regexp_matches(t, '{pattern}') then '{name}'" for pattern, name, _ in text.EVENT_RULES)
    return f", kinds as (select event_id, case when length(t) < 5 then 'unknown' {ladder} else 'general_signal' end as event_type from (select event_id, lower(trim(text)) as t from ev))"


@query(_risk_sql() + " select event_id, level, confidence from risk")
def keyword_classifier(t):
    return text.risk_levels(t.events.select("event_id", "text")).select("event_id", "level", "confidence")


@query("""select q.vec_id as query_id, r.rank, r.id, r.score from (select * from embeddings where vec_id % 100 = 0) q, lateral (
  select e.vec_id as id, round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) as score, row_number() over (order by round(list_cosine_similarity(q.embedding::double[], e.embedding::double[]), 6) desc, e.vec_id)::int as rank from embeddings e where e.vec_id <> q.vec_id) r where r.rank <= 5""", domain=False)
def vector_topk(t):
    e = t.raw("embeddings")
    return text.vector_top_k(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 5)


@query("""select a.supplier_id, b.alt, b.score, b.rank from sup a, lateral (select s.supplier_id as alt, round(1 - s.risk_score, 6) as score, row_number() over (order by round(1 - s.risk_score, 6) desc, s.supplier_id)::int as rank from sup s where s.industry = a.industry and s.supplier_id <> a.supplier_id) b where rank <= 3""")
def alternatives_rank(t):
    s = t.suppliers.select("supplier_id", "industry", "risk_score")
    a = s.select("supplier_id", "industry")
    b = s.select(F.col("supplier_id").alias("alt"), "industry", F.round(1 - F.col("risk_score"), 6).alias("score"))
    # only the four best of an industry can be among anyone's three best others
    best = b.withColumn("_n", F.row_number().over(Window.partitionBy("industry").orderBy(F.desc("score"), "alt"))).where("_n <= 4").drop("_n")
    rank = Window.partitionBy("supplier_id").orderBy(F.desc("score"), "alt")
    return a.join(best, "industry").where("alt <> supplier_id").withColumn("rank", F.row_number().over(rank)).where("rank <= 3").select("supplier_id", "alt", "score", "rank")


@query("select source, min(doc_id) as doc_id from documents where source <> '' group by source", domain=False)
def dedupe_by_source(t):
    return text.dedupe_by(t.raw("documents").select("doc_id", "source"), "source", "doc_id").select("source", "doc_id")


@query("""select conv_id, turn, substr(text, 1, (4000 - before)::int) as text from (select conv_id, turn, text, coalesce(sum(length(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as before from conversations) where before < 4000""", domain=False)
def context_budget(t):
    return text.within_budget(t.raw("conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text")


@query("select conv_id, count(*) as turns, sum(length(text))::bigint as chars, count(*) filter (role = 'user') as user_turns from conversations group by conv_id", domain=False)
def conversation_stats(t):
    return t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("""select kind, entity, count(*) as n from (
  select 'chokepoint' as kind, unnest(regexp_extract_all(text, '(?i)\\b(suez canal|panama canal|strait of hormuz|bab el mandeb|strait of malacca|bosphorus|strait of gibraltar|red sea|black sea|taiwan strait|south china sea|cape of good hope)\\b')) as entity from ev
  union all select 'port', unnest(regexp_extract_all(text, '\\b(?:[Pp]ort of [A-Z][a-z]+(?: [A-Z][a-z]+)?|[A-Z][a-z]+ [Pp]ort)\\b')) from ev
  union all select 'supplier', unnest(regexp_extract_all(text, '\\b[A-Z][\\w&]*(?: [A-Z][\\w&]*)* (?:Corp|Corporation|Inc|Ltd|GmbH|AG|Co|Company|Group|Holdings)\\b|\\bSupplier#\\d+\\b')) from ev) group by all""")
def ner_entities(t):
    """Entities of all event texts by kind (spans of these texts do not overlap, so the SQL takes each kind by itself)."""
    return text.entities(t.events.select("event_id", "text")).groupBy("kind", "entity").agg(F.count("*").alias("n"))


@query("select 'the ' || upper(name) || ' plant' as mention, supplier_id as id, name, 100.0::double as score, 1::int as rank from sup")
def fuzzy_match(t):
    """All suppliers' names, respelled, against all names: each has all words of its own."""
    mentions = t.suppliers.select(F.concat(F.lit("the "), F.upper("name"), F.lit(" plant")).alias("mention"))
    return text.fuzzy_match(mentions, t.suppliers.select(F.col("supplier_id").alias("id"), "name"))


@query("select 'suplier ' || name[10:] as mention, supplier_id as id, name, round(200.0 * (7 + length(name) - 9 + 1) / (7 + 8 + 2 * (length(name) - 9 + 1)), 6)::double as score, 1::int as rank from sup")
def fuzzy_match_misspelled(t):
    """Names with a letter missing: all numbers share most digits, so most pairs are near, and only the best is wanted."""
    mentions = t.suppliers.select(F.concat(F.lit("suplier "), F.substring("name", 10, 100)).alias("mention"))
    return text.fuzzy_match(mentions, t.suppliers.select(F.col("supplier_id").alias("id"), "name")).withColumn("score", r6("score"))


@query()
def hash_embed(t):
    return text.hash_embedding(t.raw("benchmark").select("item_id", "text")).select("item_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(""", d as (select doc_id, [trim(p) for p in string_split(coalesce(text, ''), chr(10)) if trim(p) <> ''] as parts from documents),
walk as (
  select doc_id, parts, 1 as i, 0::bigint as chunks, 0::bigint as open, 0::bigint as longest from d
  union all
  select doc_id, parts, i + 1, case when open > 0 and open + len(parts[i]) + 2 > 600 then chunks + 1 else chunks end, case when open = 0 then len(parts[i]) when open + len(parts[i]) + 2 <= 600 then open + len(parts[i]) + 2 else len(parts[i]) end,
    case when open > 0 and open + len(parts[i]) + 2 > 600 then greatest(longest, open) else longest end from walk where i <= len(parts))
select doc_id, chunks + 1 as chunks, greatest(longest, open) as longest from walk where i = len(parts) + 1 and len(parts) > 0""")
def chunked_documents(t):
    return text.chunks(t.raw("documents").select("doc_id", F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n")).alias("text"))).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("chunk")).alias("longest"))


# ---- alerts and upserts


@query(""", a as (select event_id as alert_id, epoch_us(ts) / 60e6 as minute, case when severity >= 0.85 then 'critical' else 'warning' end as tier, md5(supplier_id || '|' || case when severity >= 0.85 then 'critical' else 'warning' end || '|' || substr(text, 1, 50)) as key, row_number() over (partition by severity >= 0.85 order by ts, event_id) as i from ev where severity >= 0.75),
lim as (select * from (values ('critical', 5), ('warning', 30)) v(tier, rate)),
fold as (
  select tier, rate, 0::bigint as i, null::bigint as alert_id, '' as outcome, map([]::varchar[], []::double[]) as sent, null::double as at from lim
  union all
  select f.tier, f.rate, a.i, a.alert_id, case when a.minute - sent[a.key] < 60 then 'duplicate' when a.minute - f.at < rate then 'rate_limited' else 'sent' end,
    case when coalesce(a.minute - sent[a.key] < 60, false) or coalesce(a.minute - f.at < rate, false) then sent else map_from_entries([e for e in map_entries(sent) if a.minute - e.value < 60 and e.key <> a.key] || [{'key': a.key, 'value': a.minute}]) end,
    case when coalesce(a.minute - sent[a.key] < 60, false) or coalesce(a.minute - f.at < rate, false) then f.at else a.minute end
  from fold f join a on a.tier = f.tier and a.i = f.i + 1)
select alert_id, tier, outcome from fold where i > 0""")
def alert_dedup_fold(t):
    a = t.events.where("severity >= 0.75").select(F.col("event_id").alias("alert_id"), "ts", alerts.tier_of(F.col("severity")).alias("tier"), F.col("supplier_id").cast("string").alias("entity_id"), F.col("text").alias("title"))
    return alerts.gate(a).select("alert_id", "tier", "outcome")


@query("select supplier_id, kind, max_by(event_id, ts::varchar || lpad(event_id::varchar, 12, '0')) as event_id from ev group by all")
def event_upsert(t):
    e = t.events.select(F.concat_ws("|", F.col("supplier_id").cast("string"), "kind").alias("key"), "supplier_id", "kind", "event_id", F.struct("ts", "event_id").alias("o"))
    return sinks.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "key", "o").select("supplier_id", "kind", "event_id")


@query("select r_regionkey as chokepoint_id, r_name as chokepoint_name, vessel_count + (select count(*) from ev where event_id % 5 = r_regionkey) as vessel_count from choke join region on r_regionkey = chokepoint_id")
def vessel_counter(t):
    arrivals = t.events.select((F.col("event_id") % 5).cast("int").alias("chokepoint_id"))
    return sinks.counted(t.chokepoints, arrivals, "chokepoint_id", "vessel_count")


@query("select supplier_id, name, country from sup where risk_score >= 0.65 or critical")
def fallback_labels(t):
    return t.suppliers.where("risk_score >= 0.65 or critical").select("supplier_id", "name", "country")


@query()
def boosted_tree_score(t):
    from ..operators import learning

    return learning.boosted_scores(features.vector(_features(t)), t.suppliers.select("supplier_id", F.when((F.col("risk_score") >= 0.65) | F.col("critical"), 1.0).otherwise(0.0).alias("label")))


@query()
def ridge_forecast(t):
    from ..operators import learning

    return learning.ridge_forecast(signals.training_sequences(_daily(t), "kind", "n"), "kind")


# ---- reports


@query(""", best as (select * from ev order by severity desc, event_id limit 100),
p as (select b.event_id, min_by({'lat': s.lat, 'lon': s.lon}, s.supplier_id) as s from best b join (select distinct event_id, supplier_id from aff) a using (event_id) join sup s on s.supplier_id = a.supplier_id where s.lat is not null group by b.event_id)
select b.event_id, kind, severity, coalesce(b.lat, p.s.lat) as lat, case when b.lat is not null then b.lon else p.s.lon end as lon, b.lat is not null as own_place from best b left join p using (event_id) where b.lat is not null or p.s.lat is not null""")
def map_events(t):
    return reports.map_events(t.events, t.affects, t.suppliers).drop("feature")


@query("""select supplier_id, case when regexp_matches(x, 'semiconductor|chip|electronics|taiwan') then 'semiconductors' when regexp_matches(x, 'energy|oil|lng|chemical') then 'energy' when regexp_matches(x, 'auto|motor|vehicle|parts') then 'automotive' when regexp_matches(x, 'port|shipping|maritime|logistics') then 'shipping' else 'automotive' end as sector from (select supplier_id, lower(name || ' ' || industry) as x from sup)""")
def sector_first_match(t):
    return t.suppliers.select("supplier_id", reports.first_sector(F.col("name"), F.col("industry")).alias("sector"))


@query(COUNTRY_SQL + """, f as (select s.supplier_id, s.risk_score, unnest(case when critical or single_source or coalesce(recent_events, 0) > 0 or s.country in ('NATION_1', 'NATION_2') then
  [x for x in [case when critical then {'feature': 'critical_supplier', 'contribution': 0.22::double} end, case when single_source then {'feature': 'single_source', 'contribution': 0.2::double} end, case when coalesce(recent_events, 0) > 0 then {'feature': 'active_disruptions', 'contribution': least(0.35::double, 0.12::double * recent_events)} end, case when s.country in ('NATION_1', 'NATION_2') then {'feature': 'geopolitical_exposure', 'contribution': 0.18::double} end] if x is not null]
  else [{'feature': 'baseline', 'contribution': 0.05::double}] end) as x from sup s left join sig using (supplier_id))
select supplier_id, x.feature as feature, round(x.contribution, 6) as contribution from f""")
def supplier_explanations(t):
    e = reports.explanations(t.suppliers, features.event_signals(t.events, t.as_of), ["NATION_1", "NATION_2"])
    return e.select("supplier_id", F.explode("factors").alias("x")).select("supplier_id", "x.feature", r6("x.contribution").alias("contribution"))


@query("""select ('0x' || substr(sha256('suppliers:' || supplier_id), 1, 15))::bigint as id, 'supplier/' || supplier_id as source, name || '. Country: ' || country || '. Industry: ' || industry || '. Tier ' || tier || case when critical then '. Critical supplier.' else '.' end as text from sup""")
def supplier_documents(t):
    return reports.supplier_documents(t.suppliers)


@query("""select ('0x' || substr(sha256('events:' || event_id), 1, 15))::bigint as id, 'event/' || event_id as source, case kind when 'shipment_delay' then 'Shipment Delay' else upper(kind[1]) || kind[2:] end || ' in ' || country || '. ' || text as text from ev""")
def event_documents(t):
    return reports.event_documents(t.events)


@query(_risk_sql() + _kind_sql() + """ select event_id, event_type, level, case when level in ('HIGH', 'CRITICAL') then 0.7 else 0.1 end::double as proximity,
  1 - case level when 'CRITICAL' then 1.0 when 'HIGH' then 0.75 when 'MEDIUM' then 0.5 when 'LOW' then 0.25 when 'NONE' then 0.0 else 0.5 end::double as stability from risk join kinds using (event_id)""")
def analyzed_events(t):
    return reports.analyze(t.events).select("event_id", "event_type", "level", "proximity", "stability")


@query("""select d.day::varchar as day, coalesce(n, 0)::bigint as n, case when n is null then ['quiet', 'calm', 'no news'][(d.day - date '1970-01-01') % 3 + 1] end as note from (select unnest(generate_series((select min(ts)::date from ev), (select max(ts)::date from ev), interval 1 day))::date as day) d
left join (select ts::date as day, count(*) as n from ev group by 1) e on e.day = d.day""")
def timeline_gaps(t):
    return reports.gap_filled(t.events, ["quiet", "calm", "no news"]).withColumn("day", F.col("day").cast("string"))


@query(RATE_SQL + """, m as (select country, avg(rate) as x from (select *, row_number() over (partition by country order by day desc) as r from rate) where r <= 7 group by country)
select count(*) as regions, count(*) filter (x < 0.45) as stable, count(*) filter (x >= 0.45 and x < 0.75) as escalation, count(*) filter (x >= 0.75) as crisis from m""")
def regime_counts(t):
    s = signals.as_series(signals.regional_rate(t.events, "country", t.as_of), "country", "rate")
    return reports.regime_summary(signals.threshold_regime(s, "country"))


@query("select count(distinct ts::date) as days, min(ts::date)::varchar as first, max(ts::date)::varchar as last, count(*) as rows, count(distinct ts::date) >= 7 as ready from ev")
def snapshot_manifest(t):
    m = reports.snapshot_manifest(t.events.select(F.to_date("ts").alias("snapshot_date")))
    return m.withColumn("first", F.col("first").cast("string")).withColumn("last", F.col("last").cast("string"))


@query(EDGES_SQL + """, n as (select distinct node, next from near where node_type = 'supplier' and next_type = 'supplier'), r as (select n.node, n.next, s.risk_score, row_number() over (partition by node order by risk_score desc, next) as rank from n join sup s on 'supplier-' || s.supplier_id = n.next)
select node, rank::int as rank, next as neighbour, round(0.8 * risk_score, 6) as weight from r where rank <= 5""")
def influential_neighbours(t):
    return reports.influential(graph.supply_edges(t), t.suppliers).withColumn("weight", r6("weight"))


@query(""", p as (select s.supplier_id, s.risk_score as x, count(e.event_id) / 100.0::double as y from sup s left join ev e using (supplier_id) group by all),
r as (select *, x - avg(x) over (partition by supplier_id % 7) as dx, y - avg(y) over (partition by supplier_id % 7) as dy, ('0x' || substr(md5(supplier_id || '|11'), 1, 8))::bigint % 1000 / 1000.0::double as placebo from p),
a as (select count(*) as n, corr(x, y) as r, regr_slope(dy, dx) as slope, regr_slope(dy, placebo) * stddev_pop(placebo) as placebo, stddev_pop(dx) as spread from r)
select n, case when n < 5 then 'insufficient_data' when n < 30 then 'association_only' else 'adjusted_regression' end as method, round(case when n >= 30 then slope when n >= 5 then r end, 6) as effect, coalesce(n >= 30 and abs(slope) > 0.05 and abs(placebo) < 0.5 * abs(slope) * spread, false) as causal_claim_allowed from a""")
def causal_pairs(t):
    e = t.events.groupBy("supplier_id").agg((F.count("*") / 100.0).alias("y"))
    p = t.suppliers.join(e, "supplier_id", "left").select("supplier_id", F.col("risk_score").alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    return reports.causal_assessment(p, "x", "y", "supplier_id")


@query()
def supplier_embeddings(t):
    return reports.embeddings(t.suppliers, t.supplies.select(F.col("src").alias("supplier_id"), F.col("dst").alias("neighbour"))).select("supplier_id", F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


@query(""", q as (select * from (values (1, 'Which oil suppliers are at risk?'), (2, 'What about semiconductor fabs?')) v(question_id, question)),
w as (select question_id, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z]{3,}'))) as word from q),
said as (select supplier_id, name, country, risk_score, unnest(list_distinct(regexp_extract_all(lower(name || ' ' || country || ' ' || industry), '[a-z]{3,}'))) as word from sup),
hit as (select distinct question_id, supplier_id, name, country, risk_score from w join said using (word) where word not in ('the', 'and', 'for', 'are', 'what', 'which', 'how', 'why', 'who', 'our', 'with', 'from', 'that', 'this', 'does', 'have', 'has', 'was', 'were', 'any', 'about')),
r as (select *, row_number() over (partition by question_id order by risk_score desc, supplier_id) as rank from hit)
select question_id, rank::int as rank, name || ' in ' || country || ' is rated ' || case when risk_score >= 0.8 then 'CRITICAL' when risk_score >= 0.6 then 'HIGH' when risk_score >= 0.4 then 'MEDIUM' when risk_score >= 0.2 then 'LOW' else 'NONE' end as fact from r where rank <= 5""")
def question_facts(t):
    q = t.spark.createDataFrame([(1, "Which oil suppliers are at risk?"), (2, "What about semiconductor fabs?")], "question_id int, question string")
    return reports.facts(q, t.suppliers)


@query("select event_id, 'supplier' as target, supplier_id::varchar as id, 100.0::double as score from ev union all select event_id, 'chokepoint', '1', 100.0 from ev where contains(lower(text), 'suez canal')")
def resolved_links(t):
    """Entities of all event texts, resolved to all suppliers and two chokepoints."""
    e = t.events.select("event_id", F.concat("text", F.lit(" hits Supplier#"), F.lpad(F.col("supplier_id").cast("string"), 9, "0")).alias("text"))
    k = t.spark.createDataFrame([(1, "Suez Canal"), (2, "Strait of Hormuz")], "chokepoint_id int, chokepoint_name string")
    return reports.resolved_links(e, t.suppliers, k)


from . import insight, landed, models, more, streams  # noqa: E402, F401  they register their queries beside these
