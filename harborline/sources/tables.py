"""The domain tables (suppliers, ports, chokepoints, events and their links) derived from the star-schema test tables.

Each is a lazy DataFrame over Parquet, so only the columns a query uses are read.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Views of one data folder. ``DOMAIN_SQL`` says the same in SQL, for checks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def suppliers(self) -> DataFrame:
        k = F.col("s_suppkey")
        s = self.raw("supplier").join(self.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        industry = F.element_at(F.array(*map(F.lit, ("semiconductor fab", "oil terminal", "auto parts", "container shipping"))), (k % 4 + 1).cast("int"))
        return s.select(
            k.alias("supplier_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("country"),
            F.col("s_nationkey").alias("port_id"),
            F.col("n_regionkey").alias("chokepoint_id"),
            ((k * 37 % 101) / 100.0).alias("risk_score"),
            (k % 3 == 0).alias("single_source"),
            (k % 5 == 0).alias("critical"),
            (k % 3 + 1).cast("int").alias("tier"),
            industry.alias("industry"),
            F.when(k % 17 != 0, (k * 13 % 160 - 80).cast("double")).alias("lat"),
            (k * 29 % 340 - 170).cast("double").alias("lon"),
            F.col("s_acctbal").alias("revenue"),
        )

    @cached_property
    def ports(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.raw("nation").select(n.alias("port_id"), F.col("n_name").alias("port_name"), F.col("n_regionkey").alias("chokepoint_id"), (n * 6 - 70).cast("double").alias("lat"), (n * 13 - 160).cast("double").alias("lon"))

    @cached_property
    def chokepoints(self) -> DataFrame:
        """Chokepoints with the vessels (orders) of the nations behind them."""
        per_customer = self.raw("orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))  # counted before the join
        lanes = per_customer.join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("orders").alias("n"))
        vessels = lanes.join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey").agg(F.sum("n").alias("vessel_count"))
        return self.raw("region").join(vessels, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_regionkey").alias("chokepoint_id"), F.col("r_name").alias("chokepoint_name"), F.coalesce("vessel_count", F.lit(0)).alias("vessel_count"))

    @cached_property
    def ships_via(self) -> DataFrame:
        s = self.suppliers.where("supplier_id % 13 <> 0")
        return s.select("supplier_id", F.explode(F.array(F.struct(F.col("port_id").alias("port_id"), F.lit(True).alias("is_primary")), F.struct(((F.col("supplier_id") + 7) % 25).cast("int").alias("port_id"), F.lit(False).alias("is_primary")))).alias("p")).select("supplier_id", "p.port_id", "p.is_primary")

    @cached_property
    def n_suppliers(self) -> int:
        return max(1, self.raw("supplier").count())

    @cached_property
    def supplies(self) -> DataFrame:
        s = F.col("supplier_id")
        return self.suppliers.select(s.alias("src"), ((s * 3 + 1) % self.n_suppliers).alias("dst"), (s % 3 + 2).cast("int").alias("tier")).where("src <> dst")

    @cached_property
    def events(self) -> DataFrame:
        """Events with severity, kind, place and a text made from their kind."""
        e = F.col("event_id")
        kind = F.element_at(F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair]), F.col("event_type"))
        title = F.element_at(F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair]), F.col("event_type"))
        nation = self.raw("nation").select(F.col("n_nationkey").alias("_n"), F.col("n_name").alias("country"))
        ev = self.raw("events").withColumn("_n", (e % 25).cast("int")).join(F.broadcast(nation), "_n")
        return ev.select(
            "event_id",
            F.col("ts"),
            kind.alias("kind"),
            F.least(F.col("value") / 100.0, F.lit(1.0)).alias("severity"),
            "country",
            F.when(e % 23 != 0, (e * 7 % 150 - 75).cast("double")).alias("lat"),
            (e * 11 % 340 - 170).cast("double").alias("lon"),
            (F.col("user_id") % self.n_suppliers).alias("supplier_id"),
            F.concat(title, F.lit(" in "), "country").alias("text"),
        )

    @cached_property
    def disruption_labels(self) -> DataFrame:
        """Labels of suppliers, several for each."""
        return self.raw("labels").select((F.col("doc_id") % self.n_suppliers).alias("supplier_id"), F.col("toxic").alias("disrupted"))

    @cached_property
    def as_of(self):
        """The latest event time: every window is relative to it, never to the clock."""
        return self.raw("events").agg(F.max("ts")).first()[0]

    @cached_property
    def affects(self) -> DataFrame:
        """Event-supplier links as they arrive: several methods may link the same pair."""
        e = self.events.select("event_id", "supplier_id", "ts")
        rows = F.explode(F.array(F.struct(F.lit("text").alias("method"), (0.5 + F.col("event_id") % 5 / 10.0).alias("confidence"), F.lit(1).alias("seq")), F.struct(F.lit("geo").alias("method"), (0.4 + F.col("event_id") % 7 / 10.0).alias("confidence"), F.lit(2).alias("seq"))))
        return e.select("event_id", "supplier_id", F.col("ts").alias("linked_at"), rows.alias("l")).select("event_id", "supplier_id", "linked_at", "l.*")

    def as_views(self) -> SparkSession:
        """The domain tables as temporary views, and the score bands as SQL functions; returns the session to ask."""
        for name in ("suppliers", "ports", "chokepoints", "ships_via", "supplies", "events", "affects"):
            getattr(self, name).createOrReplaceTempView(name)
        for name, cuts in BANDS.items():
            whens = " ".join(f"when score >= {cut} then '{band}'" for cut, band in cuts[:-1])
            self.spark.sql(f"create or replace temporary function {name}(score double) returns string return case {whens} else '{cuts[-1][1]}' end")
        return self.spark


#: SQL functions of ``as_views``: score bands from the top down.
BANDS = {
    "band_map": [(0.8, "CRITICAL"), (0.6, "HIGH"), (0.4, "MEDIUM"), (0.0, "LOW")],
    "band_methodology": [(0.75, "CRITICAL"), (0.5, "HIGH"), (0.25, "MEDIUM"), (0.0, "LOW")],
}

#: The kinds and text templates that stand in for each event type.
KINDS = {"click": "protest", "error": "attack", "purchase": "shipment_delay", "signup": "sanction", "view": "weather"}
TITLES = {
    "click": "Protest and strike at factory near Suez Canal",
    "error": "Missile attack on port facilities",
    "purchase": "Container shipping delay and congestion",
    "signup": "Sanctions and export ban announced",
    "view": "Typhoon and flood warning",
}

DOMAIN_SQL = """
with recursive sup as (
  select s_suppkey as supplier_id, s_name as name, n_name as country, s_nationkey as port_id, n_regionkey as chokepoint_id,
    (s_suppkey * 37 % 101) / 100.0::double as risk_score, s_suppkey % 3 = 0 as single_source, s_suppkey % 5 = 0 as critical,
    (s_suppkey % 3 + 1)::int as tier, ['semiconductor fab', 'oil terminal', 'auto parts', 'container shipping'][s_suppkey % 4 + 1] as industry,
    case when s_suppkey % 17 <> 0 then (s_suppkey * 13 % 160 - 80)::double end as lat, (s_suppkey * 29 % 340 - 170)::double as lon, s_acctbal as revenue
  from supplier join nation on s_nationkey = n_nationkey),
port as (select n_nationkey as port_id, n_name as port_name, n_regionkey as chokepoint_id, (n_nationkey * 6 - 70)::double as lat, (n_nationkey * 13 - 160)::double as lon from nation),
choke as (
  select r_regionkey as chokepoint_id, r_name as chokepoint_name, coalesce(v.n, 0)::bigint as vessel_count
  from region left join (select n_regionkey, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1) v on v.n_regionkey = r_regionkey),
via as (
  select supplier_id, port_id, true as is_primary from sup where supplier_id % 13 <> 0
  union all select supplier_id, ((supplier_id + 7) % 25)::int, false from sup where supplier_id % 13 <> 0),
supplies as (select * from (select supplier_id as src, (supplier_id * 3 + 1) % (select count(*) from supplier) as dst, (supplier_id % 3 + 2)::int as tier from sup) where src <> dst),
ev as (
  select event_id, ts, case event_type when 'click' then 'protest' when 'error' then 'attack' when 'purchase' then 'shipment_delay' when 'signup' then 'sanction' when 'view' then 'weather' end as kind,
    least(value / 100.0::double, 1.0::double) as severity, n_name as country,
    case when event_id % 23 <> 0 then (event_id * 7 % 150 - 75)::double end as lat, (event_id * 11 % 340 - 170)::double as lon,
    user_id % (select count(*) from supplier) as supplier_id,
    case event_type when 'click' then 'Protest and strike at factory near Suez Canal' when 'error' then 'Missile attack on port facilities' when 'purchase' then 'Container shipping delay and congestion' when 'signup' then 'Sanctions and export ban announced' when 'view' then 'Typhoon and flood warning' end || ' in ' || n_name as text
  from events join nation on n_nationkey = event_id % 25),
aff as (
  select event_id, supplier_id, ts as linked_at, 'text' as method, 0.5::double + event_id % 5 / 10.0::double as confidence, 1 as seq from ev
  union all select event_id, supplier_id, ts, 'geo', 0.4::double + event_id % 7 / 10.0::double, 2 from ev),
lab as (select doc_id % (select count(*) from supplier) as supplier_id, toxic as disrupted from labels),
now as (select max(ts) as as_of from events)
"""
