"""Batch twins of the stream operators: the same functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import pipelines
from .catalog import query

REPORT_SQL = ", rep as (select supplier_id as mmsi, ts, country, event_id % 20 / 2.0::double as speed, severity from ev)"


def _reports(t):
    """Events as reports of a vessel that has the supplier's number."""
    return t.events.select(F.col("supplier_id").alias("mmsi"), "ts", "country", (F.col("event_id") % 20 / 2.0).alias("speed"), "severity", "event_id", "kind")


@query(REPORT_SQL + """, g as (select *, case when ts - lag(ts) over (partition by mmsi order by ts) < interval 6 hour then 0 else 1 end as opens from rep), s as (select *, sum(opens) over (partition by mmsi order by ts rows unbounded preceding) as session from g)
select mmsi, min(ts)::varchar as start, (max(ts) + interval 6 hour)::varchar as "end", count(*) as reports, max(speed) as max_speed from s group by mmsi, session""")
def vessel_sessions(t):
    s = pipelines.vessel_sessions(_reports(t))
    return s.withColumns({c: F.col(c).cast("string") for c in ("start", "end")})


@query(""", w as (select kind, severity, to_timestamp(floor(epoch(ts) / 21600) * 21600 - 21600 * i)::timestamp as start from ev, range(0, 4) r(i))
select start::varchar as start, kind, count(*) as n, max(severity) as max_severity from w group by all""")
def sliding_counts(t):
    return pipelines.sliding_counts(t.events).withColumn("start", F.col("start").cast("string"))


@query(REPORT_SQL + " select event_id, count(*) as reports, min(r.ts)::varchar as first, max(r.ts)::varchar as last from ev join rep r on r.country = ev.country and r.ts >= ev.ts and r.ts <= ev.ts + interval 2 hour group by event_id")
def reports_after_events(t):
    n = pipelines.report_counts(_reports(t), t.events)
    return n.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})
