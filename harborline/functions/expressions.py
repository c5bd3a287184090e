"""Scalar rules as column expressions: bands, distances, severities, types, titles, rings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_NM, EARTH_KM = 3440.065, 6371.0


def band_api(score: Column) -> Column:
    """Cut at .2, .4, .6, .8; null is UNKNOWN."""
    return F.when(score.isNull(), "UNKNOWN").when(score >= 0.8, "CRITICAL").when(score >= 0.6, "HIGH").when(score >= 0.4, "MEDIUM").when(score >= 0.2, "LOW").otherwise("NONE")


def band_map(score: Column) -> Column:
    """Cut at .4, .6, .8 for map layers; null counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 0.8, "CRITICAL").when(s >= 0.6, "HIGH").when(s >= 0.4, "MEDIUM").otherwise("LOW")


def band_methodology(score: Column) -> Column:
    """Cut at .25, .5, .75 as the methodology describes."""
    return F.when(score >= 0.75, "CRITICAL").when(score >= 0.5, "HIGH").when(score >= 0.25, "MEDIUM").otherwise("LOW")


def band_view(score: Column) -> Column:
    """The view's names: the API's cuts with MINIMAL for the lowest."""
    s = F.coalesce(score, F.lit(0.0))
    return F.when(s >= 0.8, "CRITICAL").when(s >= 0.6, "HIGH").when(s >= 0.4, "MEDIUM").when(s >= 0.2, "LOW").otherwise("MINIMAL")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


#: Two-digit event codes and their types; default severities by type.
ROOT_TYPES = {
    "01": "make_statement",
    "02": "yield",
    "03": "disapprove",
    "04": "reject",
    "05": "threaten",
    "06": "protest",
    "07": "coerce",
    "08": "assault",
    "09": "fight",
    "10": "use_force",
    "11": "mass_violence",
    "13": "threaten_conflict",
    "14": "protest_violence",
    "15": "conflict",
    "16": "fight_conflict",
    "17": "violence_conflict",
    "18": "assault_conflict",
    "19": "force_conflict",
    "20": "mass_violence_conflict",
}
TYPE_SEVERITY = {"mass_violence": 0.95, "fight": 0.85, "assault": 0.8, "conflict": 0.75, "protest": 0.55}


def _lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def root_type(code: Column) -> Column:
    """Event type of a conflict code by its first two digits; empty is unknown, others are other."""
    return F.when(F.coalesce(code, F.lit("")) == "", "unknown").otherwise(F.coalesce(_lookup(ROOT_TYPES, F.substring(code, 1, 2)), F.lit("other")))


def severity(goldstein: Column, kind: Column) -> Column:
    """|Goldstein| / 10 within .1 to 1 to three places; a missing or zero value falls to the type's default, then .5."""
    by_scale = F.round(F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.abs(goldstein) / 10)), 3)
    return F.when(goldstein.isNotNull() & (goldstein != 0), by_scale).otherwise(F.coalesce(_lookup(TYPE_SEVERITY, kind), F.lit(0.5)))


def title(kind: Column, actors: Column, region: Column) -> Column:
    """"Type — first actor (region)", or "Type in region" without actors."""
    name = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    first = F.try_element_at(actors, F.lit(1))
    return F.when(first.isNotNull(), F.concat(name, F.lit(" — "), first, F.lit(" ("), region, F.lit(")"))).otherwise(F.concat(name, F.lit(" in "), region))


def slug(text: Column) -> Column:
    """Lower case, other than letters and digits as single dashes, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def point(lon: Column, lat: Column, **properties: Column) -> Column:
    """A GeoJSON point feature as text, longitude first."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def ring(lon: Column, lat: Column, radius_km: Column, corners: int = 32) -> Column:
    """A closed ring of corners + 1 [lon, lat] points about a centre."""
    step = 2 * 3.141592653589793 / corners
    east = radius_km / (111.32 * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    north = radius_km / 110.574
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda i: F.array(lon + east * F.cos(i * step), lat + north * F.sin(i * step)))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "yes", "1", "y")


def number(text: Column) -> Column:
    """A number that may hold thousands commas or a dollar sign; null if it is none."""
    return F.regexp_replace(text, "[,$]", "").try_cast("double")


def line(points: list[tuple[Column, Column]], **properties: Column) -> Column:
    """A GeoJSON line feature as text through (lon, lat) points."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(*[F.array(lon, lat) for lon, lat in points]).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def polygon(corners: Column, **properties: Column) -> Column:
    """A GeoJSON polygon feature as text from a closed ring of [lon, lat]."""
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(corners).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties")))


def tier_of_probability(p: Column) -> Column:
    """The alert tier of a simulated probability."""
    return F.when(p > 0.7, "critical").when(p > 0.4, "warning").otherwise("info")


def node_kind(kind: Column, node: Column) -> Column:
    """A node's type: its own where known under some name, else by the words of its id."""
    k, n = F.lower(F.coalesce(kind, F.lit(""))), F.lower(F.coalesce(node, F.lit("")))
    known = F.when(k.isin("supplier", "vendor", "company"), "supplier").when(k.isin("port", "harbor", "harbour"), "port").when(k.isin("chokepoint", "strait", "canal"), "chokepoint").when(k.isin("event", "incident"), "event")
    return F.coalesce(known, F.when(n.contains("supplier"), "supplier").when(n.contains("port"), "port").when(n.contains("choke"), "chokepoint").when(n.contains("event"), "event").otherwise("other"))


def stability_index(estimate: Column) -> Column:
    """A governance estimate of -2.5 to 2.5 as 0 to 1, to four places."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (estimate + 2.5) / 5.0)), 4)
