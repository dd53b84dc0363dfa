"""Counts over areas and points that reports are made of: one row each, or a few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import spatial

TIERS = spatial.TIER_NAMES


def tier_counts(admins: DataFrame) -> DataFrame:
    """One row: areas with a ring by tier, and dropped, those whose level has none."""
    tier = geo.tier(F.col("admin_level"))
    rows = admins.where(F.size("ring") > 0)
    return rows.agg(F.count_if(tier.isNull()).alias("dropped"), *[F.count_if(F.coalesce(tier == t, F.lit(False))).alias(t) for t in TIERS])


def pip_bench(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: queries, empty chains, average and largest depth of a chain."""
    rows = spatial.with_chain(points.select("id", "lat_e7", "lon_e7"), nodes).select(F.size("_chain").alias("n"))
    return rows.agg(F.count("*").alias("queries"), F.count_if(F.col("n") == 0).alias("empty"), F.round(F.avg("n"), 6).alias("avg_depth"), F.max("n").cast("long").alias("max_depth"))


def is_building() -> Column:
    return F.coalesce("type", "street", "housenumber").isNotNull()


def layered(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: buildings, skipped points, and misses and hits of three layers.

    Each building asks whether it lies in the city of its chain (t1), the city's first vertex
    in the chain's state (t2) and the state's first vertex in the chain's country (t3), by
    the polygon alone. A layer misses where the chain lacks either of the two. Buildings
    of one chain ask alike, so they are counted before a polygon is looked at; a point lies
    in all areas of its chain.
    """
    kind = is_building()
    rows = spatial.with_chain(points.withColumn("_building", kind), nodes, "tier")
    last = lambda t: F.try_element_at(F.filter("_chain", lambda h: h["tier"] == t), F.lit(-1))["node_id"]
    alike = rows.select("_building", *[F.when(F.col("_building"), last(t)).alias(t) for t in TIERS[:3]]).groupBy("_building", *TIERS[:3]).agg(F.count("*").alias("n"))
    place = lambda t: nodes.select(F.col("node_id").alias(t), F.col("rep_lat").alias(f"{t}_lat"), F.col("rep_lon").alias(f"{t}_lon"), F.col("edges").alias(f"{t}_edges"))
    for t in TIERS[:3]:
        alike = alike.join(place(t), t, "left")
    asked = lambda below, above: F.col(below).isNotNull() & F.col(above).isNotNull()
    inside = lambda below, above: asked(below, above) & geo.inside(F.col(f"{above}_edges"), F.col(f"{below}_lat"), F.col(f"{below}_lon"))
    total = lambda condition: F.coalesce(F.sum(F.when(F.col("_building") & condition, F.col("n"))), F.lit(0))
    layers = {"t1": (F.col("city").isNotNull(), F.col("city").isNotNull()), "t2": (asked("city", "state"), inside("city", "state")), "t3": (asked("state", "country"), inside("state", "country"))}
    out = [total(F.lit(True)).alias("buildings"), F.coalesce(F.sum(F.when(~F.col("_building"), F.col("n"))), F.lit(0)).alias("skipped")]
    for name, (has, hit) in layers.items():
        out += [total(~has).alias(f"{name}_misses"), total(hit).alias(f"{name}_hits")]
    return alike.agg(*out)


def addresses(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, country, state, city, suburb by the chain alone: no tags, no smallest area.

    The last named area of a tier counts; of suburbs the one of highest level, and the
    first of several.
    """
    rows = spatial.with_chain(points.select("id", "lat_e7", "lon_e7"), nodes, "tier", "name")
    named = lambda t: F.filter("_chain", lambda h: (h["tier"] == t) & h["name"].isNotNull())
    last = [F.try_element_at(named(t), F.lit(-1))["name"].alias(t) for t in TIERS[:3]]
    deepest = F.aggregate(named("suburb"), F.lit(None).cast("struct<level:int,name:string>"), lambda best, h: F.when(best.isNull() | (h["level"] > best["level"]), F.struct(h["level"].alias("level"), h["name"].alias("name"))).otherwise(best))
    return rows.select("id", *last, deepest["name"].alias("suburb"))


def address_text() -> Column:
    """What there is of suburb, city, state and country, joined by commas."""
    return F.concat_ws(", ", "suburb", "city", "state", "country")


def address_sample(points: DataFrame, nodes: DataFrame, n: int = 5) -> DataFrame:
    """id, lat_e7, lon_e7 and address of the first n points, by id, that have any tier."""
    found = addresses(points, nodes).where(F.coalesce(*TIERS).isNotNull()).orderBy("id").limit(n)
    return found.join(points.select("id", "lat_e7", "lon_e7"), "id").select("id", "lat_e7", "lon_e7", address_text().alias("address"))


def first_pairs(pairs: DataFrame, polys: DataFrame, n: int = 5) -> DataFrame:
    """The first n crossing pairs, by a and b, with their level."""
    few = pairs.orderBy("a", "b").limit(n)
    return few.join(polys.select(F.col("node_id").alias("a"), "level"), "a").select("a", "b", "level")
