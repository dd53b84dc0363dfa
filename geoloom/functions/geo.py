"""Fixed-point coordinates, tiers, rings, containment and distances, as native columns.

Coordinates are integers of 1e-7 degrees; products are taken in 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
TIERS = {2: "country", 4: "state", 8: "city", 9: "suburb", 10: "suburb", 11: "suburb"}
EDGE = "array<struct<lat0:bigint,lon0:bigint,lat1:bigint,lon1:bigint>>"


def to_e7(degrees: Column) -> Column:
    """Truncates, as a cast does."""
    return (degrees * 1e7).cast("int")


def from_e7(e7: Column) -> Column:
    return e7 / F.lit(1e7)


def tier(level: Column) -> Column:
    """country, state, city or suburb; null for other levels."""
    out = F
    for k, v in TIERS.items():
        out = out.when(level == k, v)
    return out.otherwise(None)


def admin_level(text: Column) -> Column:
    """The number that the text begins with, as one unsigned byte; 0 without one."""
    digits = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.when(digits == "", 0).otherwise(digits.cast("long").bitwiseAND(255)).cast("short")


def centroid(coords: Column) -> tuple[Column, Column]:
    """Mean of the vertices, truncated towards 0; a closing vertex counts twice."""
    mean = lambda f: F.when(F.size(coords) > 0, F.call_function("div", F.aggregate(coords, F.lit(0).cast("long"), lambda s, c: s + c[f]), F.size(coords).cast("long"))).cast("int")
    return mean("lat"), mean("lon")


def bbox(coords: Column) -> list[Column]:
    """min_lat, max_lat, min_lon, max_lon."""
    of = lambda f: F.transform(coords, lambda c: c[f])
    return [F.array_min(of("lat")).alias("min_lat"), F.array_max(of("lat")).alias("max_lat"), F.array_min(of("lon")).alias("min_lon"), F.array_max(of("lon")).alias("max_lon")]


def edges(ring: Column) -> Column:
    """Consecutive vertices and the closing edge, without horizontal ones."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    both = F.zip_with(ring, nxt, lambda a, b: F.struct(a["lat"].cast("long").alias("lat0"), a["lon"].cast("long").alias("lon0"), b["lat"].cast("long").alias("lat1"), b["lon"].cast("long").alias("lon1")))
    return F.filter(both, lambda e: e["lat0"] != e["lat1"])


def area2(ring: Column) -> Column:
    """Twice the absolute area; 0 for fewer than three vertices."""
    nxt = F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, nxt, lambda a, b: a["lon"].cast("long") * b["lat"].cast("long") - b["lon"].cast("long") * a["lat"].cast("long"))
    return F.when(F.size(ring) < 3, F.lit(0).cast("long")).otherwise(F.abs(F.aggregate(cross, F.lit(0).cast("long"), lambda s, x: s + x)))


def inside(edge_list: Column, lat: Column, lon: Column) -> Column:
    """Even-odd ray towards greater longitudes, in integers; an edge includes its lower end only."""
    lat, lon = lat.cast("long"), lon.cast("long")

    def crosses(e):
        dy, dx = e["lat1"] - e["lat0"], e["lon1"] - e["lon0"]
        left = (e["lon0"] - lon) * dy + (lat - e["lat0"]) * dx
        return ((e["lat0"] > lat) != (e["lat1"] > lat)) & F.when(dy > 0, left > 0).otherwise(left < 0)

    return F.size(F.filter(edge_list, crosses)) % 2 == 1


def inside_degrees(edge_list: Column, lat: Column, lon: Column) -> Column:
    """The same rule in double precision, by dividing."""

    def crosses(e):
        y0, x0, y1, x1 = (e[k] / F.lit(1e7) for k in ("lat0", "lon0", "lat1", "lon1"))
        return ((y0 > lat) != (y1 > lat)) & ((x1 - x0) * (lat - y0) / (y1 - y0) + x0 > lon)

    return F.size(F.filter(edge_list, crosses)) % 2 == 1


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between two places in degrees."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    return haversine_of(p1, F.cos(p1), lon1, p2, F.cos(p2), lon2)


def haversine_of(phi1: Column, cos1: Column, lon1: Column, phi2: Column, cos2: Column, lon2: Column) -> Column:
    """haversine() of latitudes in radians and their cosines, which a join of many pairs takes once a place."""
    y, x = F.sin((phi2 - phi1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(y * y + cos1 * cos2 * (x * x), F.lit(1.0))))


def millimetres(metres: Column) -> Column:
    """Metres of 0 and more, rounded to three digits in binary, as SQL's round() does; Spark's goes by way of decimal text."""
    return F.floor(metres * 1000 + 0.5) / 1000


def in_bbox(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def bboxes_meet(min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, west: float, south: float, east: float, north: float) -> Column:
    return (max_lat >= south) & (min_lat <= north) & (max_lon >= west) & (min_lon <= east)
