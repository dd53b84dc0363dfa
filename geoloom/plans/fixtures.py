"""Map data derived from the driver's tables by integer formulas; oracles.py has the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

STEMS, ENDS = ("Haupt", "Bahnhof", "Königs", "Müller", "Garten"), ("straße", "platz", "weg", "allee", "gasse")
#: Half the extent of a diamond (every tenth is four times as large), and the steps of a street, in 1e-7 degrees.
RADIUS, STREET_LAT, STREET_LON = 1_500_000, 20_000_000, 15_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(k: Column) -> Column:
    return (F.lit(470_000_000) + k * F.lit(7_919_131).cast("long") % 80_000_000).cast("int")


def lon(k: Column) -> Column:
    return (F.lit(60_000_000) + k * F.lit(10_472_903).cast("long") % 90_000_000).cast("int")


def street_name(i: Column) -> Column:
    return F.concat(F.get(F.array(*map(F.lit, STEMS)), (i % 5).cast("int")), F.get(F.array(*map(F.lit, ENDS)), (F.floor(i / 5) % 5).cast("int")))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (even ids) and customers (odd ids)."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    size = part.agg(F.count("*").alias("n_parts"))  # one row
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.lit(0).alias("odd"), F.col("o_orderpriority").alias("t"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.lit(1).alias("odd"), F.col("c_mktsegment").alias("t"))
    k = F.col("k")
    some = lambda n, value: F.when(k % n == 0, value)
    rows = o.unionByName(c).crossJoin(F.broadcast(size)).withColumn("p_partkey", k % F.col("n_parts")).join(part, "p_partkey", "left")
    none = F.lit(None).cast("string")
    return rows.select(
        (k * 2 + F.col("odd")).alias("id"), F.when(F.col("odd") == 0, "n").otherwise("w").alias("osm_type"), lat(k).alias("lat_e7"), lon(k).alias("lon_e7"),
        some(3, F.col("p_name")).alias("name"), some(2, F.col("t")).alias("type"), some(4, street_name(k % 25)).alias("street"), some(4, (k % 50 + 1).cast("string")).alias("housenumber"),
        none.alias("postcode"), none.alias("country"), none.alias("state"), some(10, F.lit("Addr City")).alias("city"), some(7, F.lit("Addr Suburb")).alias("suburb"),
    )


def _coord(a: Column, b: Column) -> Column:
    return F.struct(a.cast("int").alias("lat"), b.cast("int").alias("lon"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey").cast("long")
    y, x = lat(s), lon(s)
    coords = F.array(_coord(y, x), _coord(y + STREET_LAT // 2, x + STREET_LON), _coord(y + STREET_LAT, x))
    rows = table(spark, sf_dir, "supplier").select(s.alias("id"), street_name(s % 25).alias("name"), F.lit("residential").alias("type"), F.lit(None).cast("string").alias("ref"), coords.alias("coords"))
    return rows.select("*", *geo.bbox(F.col("coords")))


def _ring(*pairs: tuple[Column, Column]) -> Column:
    return F.array(*[_coord(a, b) for a, b in (*pairs, pairs[0])])


def _box(lat0: Column, lat1: Column, lon0: Column, lon1: Column) -> Column:
    return _ring((lat0, lon0), (lat0, lon1), (lat1, lon1), (lat1, lon0))


def admins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A country, a state for each region, a city for each nation and a diamond for each supplier."""
    n = lambda x: F.lit(x).cast("long")
    row = lambda i, level, name, ring: [i.cast("long").alias("id"), level.cast("short").alias("admin_level"), name.alias("name"), ring.alias("ring")]
    country = spark.range(1).select(*row(F.lit(1_000_000), F.lit(2), F.lit("Country"), _box(n(470_000_000), n(550_000_000), n(60_000_000), n(150_000_000))))
    r = F.col("r_regionkey").cast("long")
    x = n(60_000_000) + r * 18_000_000
    state = table(spark, sf_dir, "region").select(*row(r + 2_000_000, F.lit(4), F.col("r_name"), _box(n(470_000_000), n(550_000_000), x, x + 18_000_000)))
    k = F.col("n_nationkey").cast("long")
    x, y = n(60_000_000) + F.col("n_regionkey") * 18_000_000, n(470_000_000) + F.floor(k / 5) * 16_000_000
    city = table(spark, sf_dir, "nation").select(*row(k + 3_000_000, F.lit(8), F.col("n_name"), _box(y, y + 16_000_000, x, x + 18_000_000)))
    s = F.col("s_suppkey").cast("long")
    y, x = lat(s + 500_000).cast("long"), lon(s + 500_000).cast("long")
    r = F.when(s % 10 == 0, 4 * RADIUS).otherwise(RADIUS)
    diamond = _ring((y, x + r), (y + r, x), (y, x - r), (y - r, x))
    suburb = table(spark, sf_dir, "supplier").select(*row(s + 4_000_000, s % 3 + 9, F.col("s_name"), diamond))
    return country.unionByName(state).unionByName(city).unionByName(suburb)


def osm(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, ways, relations): nodes from parts and orders, ways from orders with their lineitems as
    nodes, and a boundary relation for each supplier, its square cut into four shuffled ways."""
    tag = lambda k, v: F.struct(F.lit(k).alias("k"), v.alias("v"))
    keep = lambda tags: F.filter(tags, lambda t: t["v"].isNotNull())
    p = F.col("p_partkey").cast("long")
    tags = F.array(tag("name", F.when(p % 3 == 0, F.col("p_name"))), tag("building", F.when(p % 2 == 0, F.lit("yes"))), tag("amenity", F.when(p % 5 == 0, F.col("p_brand"))), tag("addr:city", F.when(p % 4 == 0, F.lit("Ulm"))), tag("note", F.when(p % 6 == 0, F.col("p_type"))))
    nodes = table(spark, sf_dir, "part").select(p.alias("id"), lat(p).alias("lat_e7"), lon(p).alias("lon_e7"), keep(tags).alias("tags"))
    o = F.col("o_orderkey").cast("long")
    refs = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("o")).agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("long").alias("p")))).alias("r"))
    value = lambda n, v: F.when(o % n == 0, v)
    tags = F.array(tag("highway", value(2, F.lit("residential"))), tag("building", value(3, F.lit("yes"))), tag("waterway", value(5, F.lit("river"))), tag("name", value(4, F.col("o_orderpriority"))), tag("leisure", value(9, F.lit("park"))), tag("ref", value(8, F.lit("B1"))), tag("railway", value(12, F.lit("tram"))))
    ways = table(spark, sf_dir, "orders").join(refs, F.col("o_orderkey") == F.col("o"), "left")
    # One reference of each way has no node.
    ways = ways.select(o.alias("id"), F.concat(F.coalesce(F.transform("r", lambda x: x["p"]), F.array().cast("array<bigint>")), F.array(F.lit(-1).cast("long"))).alias("refs"), keep(tags).alias("tags"))
    s = F.col("s_suppkey").cast("long")
    corners = table(spark, sf_dir, "supplier").select(s.alias("s"), F.explode(F.array(*map(F.lit, range(4)))).alias("c"))
    side = F.col("c").isin(1, 2).cast("int"), F.col("c").isin(2, 3).cast("int")
    base = F.lit(10_000_000).cast("long")
    node_id = base + F.col("s") * 4 + F.col("c")
    more = corners.select(node_id.alias("id"), (lat(F.col("s")) + side[0] * 100_000).alias("lat_e7"), (lon(F.col("s")) + side[1] * 100_000).alias("lon_e7"), F.array().cast("array<struct<k:string,v:string>>").alias("tags"))
    end = base + F.col("s") * 4 + (F.col("c") + 1) % 4
    # Every other segment runs backwards.
    segs = corners.select(node_id.alias("id"), F.when(F.col("c") % 2 == 0, F.array(node_id, end)).otherwise(F.array(end, node_id)).alias("refs"), F.array().cast("array<struct<k:string,v:string>>").alias("tags"))
    member = lambda c, role="outer": F.struct(F.lit("w").alias("type"), (base + s * 4 + c).alias("ref"), F.lit(role).alias("role"))
    members = F.array(member(0), member(2, ""), member(1), member(3), member(0, "inner"))
    tags = F.array(tag("type", F.when(s % 7 != 6, F.lit("boundary")).otherwise(F.lit("route"))), tag("admin_level", F.concat((s % 3 + 8).cast("string"), F.when(s % 4 == 0, ";9").otherwise(""))), tag("name", F.col("s_name")))
    relations = table(spark, sf_dir, "supplier").select(s.alias("id"), members.alias("members"), tags.alias("tags"))
    return nodes.unionByName(more), ways.unionByName(segs), relations
