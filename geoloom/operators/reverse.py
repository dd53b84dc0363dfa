"""Batch reverse geocoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

LEVELS = {"country": 2, "state": 4, "city": 8}
NEIGHBOURS = 20


def object_kind(zoom: Column) -> Column:
    return F.when(zoom >= 15, "house").when(zoom >= 10, "city").when(zoom >= 7, "state").otherwise("country")


def containing(queries: DataFrame, admins: DataFrame) -> DataFrame:
    """`queries` (lat, lon in degrees) with hits: all admins, of any level, that hold each, by rays in degrees."""
    polys = spatial.polygons(admins, tiers_only=False)
    rows = queries.withColumns({"lat_e7": geo.to_e7(F.col("lat")), "lon_e7": geo.to_e7(F.col("lon"))})
    return spatial.with_hits(rows, polys, "name", "bbox_area", test=geo.inside_degrees).drop("lat_e7", "lon_e7")


def reverse_geocode(queries: DataFrame, points: DataFrame, admins: DataFrame) -> DataFrame:
    """For queries (query_id, lat, lon, zoom): object_kind, kind, id, admin_level, name, distance_m,
    country, state, city, suburb.

    The nearest point gives what it has of the four; the smallest area (by bounding box) that
    holds the place gives what is missing, at levels 2, 4, 8 and for suburbs 10, 9, 11; and
    what is still missing comes from the nearest of 20 neighbours that has it. The object is
    that point from zoom 15 on, otherwise the smallest area at the level of the zoom, or of
    any. Queries without an object have null in kind and id.
    """
    tiers = spatial.TIER_NAMES
    near = spatial.nearest(queries, points, NEIGHBOURS, carry=tiers)
    vote = near.groupBy("query_id").agg(
        F.min(F.when(F.col("rank") == 1, F.struct("rank", "id", "distance_m", *tiers))).alias("n"),
        *[F.min(F.when(F.col(t).isNotNull(), F.struct("rank", t)))[t].alias(f"vote_{t}") for t in tiers],
    )
    rows = containing(queries, admins).join(vote, "query_id", "left")
    at = lambda level: spatial.smallest(F.col("hits"), level, "bbox_area")
    filled = {t: F.coalesce(F.col(f"n.{t}"), *[at(x)["name"] for x in ((LEVELS[t],) if t in LEVELS else (10, 9, 11))], f"vote_{t}") for t in tiers}
    rows = rows.withColumn("object_kind", object_kind(F.col("zoom")))
    rows = rows.withColumn("object_kind", F.when((F.col("object_kind") == "house") & F.col("n").isNull(), "country").otherwise(F.col("object_kind")))
    area = F.coalesce(F.when(F.col("object_kind") == "city", at(8)).when(F.col("object_kind") == "state", at(4)).otherwise(at(2)), at(-1))
    rows = rows.withColumns(filled).withColumn("area", F.when(F.col("object_kind") != "house", area))
    house = F.col("object_kind") == "house"
    return rows.select(
        "query_id", "object_kind", F.when(house, "point").when(F.col("area").isNotNull(), "area").alias("kind"), F.when(house, F.col("n.id")).otherwise(F.col("area.node_id")).alias("id"),
        F.col("area.level").alias("admin_level"), F.col("area.name").alias("name"), F.when(house, F.col("n.distance_m")).alias("distance_m"), *tiers,
    )
