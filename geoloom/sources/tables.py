"""Datasets as Parquet folders: <root>/<dataset>/{points,lines,admins}; also JSON, merging and the catalog."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

COORDS = "array<struct<lat:int,lon:int>>"
TAGS = "array<struct<k:string,v:string>>"
_BOX = "min_lat int, max_lat int, min_lon int, max_lon int"
POINTS = f"id long, osm_type string, lat_e7 int, lon_e7 int, name string, type string, street string, housenumber string, postcode string, country string, state string, city string, suburb string, extra_tags {TAGS}"
LINES = f"id long, name string, type string, ref string, coords {COORDS}, {_BOX}"
ADMINS = f"id long, admin_level short, name string, ring {COORDS}, {_BOX}"
KINDS = {"points": POINTS, "lines": LINES, "admins": ADMINS}
#: Tags of a point in the order in which JSON has them.
FIELDS = ("name", "type", "street", "housenumber", "postcode", "country", "state", "city", "suburb")


def dataset_name(pbf: str) -> str:
    """The file's name without .osm.pbf or .pbf."""
    return re.sub(r"(\.osm)?\.pbf$", "", pbf.replace("\\", "/").rpartition("/")[2])


def write_dataset(root: str, dataset: str, points: DataFrame, lines: DataFrame, admins: DataFrame) -> None:
    """Write the three tables. Points are clustered by place, so that a box reads few row groups."""
    cell = [F.floor(F.col(c) / 500_000) for c in ("lat_e7", "lon_e7")]
    points.repartitionByRange(*cell).sortWithinPartitions(*cell).write.mode("overwrite").parquet(f"{root}/{dataset}/points")
    lines.write.mode("overwrite").parquet(f"{root}/{dataset}/lines")
    admins.write.mode("overwrite").parquet(f"{root}/{dataset}/admins")


def read_dataset(spark: SparkSession, root: str, dataset: str, kind: str) -> DataFrame:
    return spark.read.schema(KINDS[kind]).parquet(f"{root}/{dataset}/{kind}")


def merge(spark: SparkSession, root: str, datasets: list[str], kind: str) -> DataFrame:
    """All rows of several datasets with the column dataset; objects in two of them stay twice."""
    return reduce(DataFrame.unionByName, [read_dataset(spark, root, d, kind).withColumn("dataset", F.lit(d)) for d in datasets])


def list_datasets(spark: SparkSession, root: str) -> list[str]:
    """Sorted names of the folders below `root` that hold points, on any file system of Spark's."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    paths = [s.getPath() for s in fs.listStatus(top) if s.isDirectory()]
    return sorted(p.getName() for p in paths if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "points")))


def select_datasets(spark: SparkSession, root: str, wanted: str) -> list[str]:
    """all, a list separated by commas (empty items are skipped), or one name."""
    if wanted == "all":
        return list_datasets(spark, root)
    return [w for w in wanted.split(",") if w]


def dataset_counts(spark: SparkSession, root: str, datasets: list[str]) -> DataFrame:
    """One row: points, lines, admins."""
    counts = [merge(spark, root, datasets, k).agg(F.count("*").alias(k)) for k in KINDS]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])


def _degrees(e7: Column) -> Column:
    return F.format_string("%.7f", geo.from_e7(e7))


def _object(*members: Column) -> Column:
    """A JSON object of members that may be null."""
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def _member(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}":'), _string(text))


def _string(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _coords(coords: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(coords, lambda c: F.concat(F.lit("["), _degrees(c["lat"]), F.lit(","), _degrees(c["lon"]), F.lit("]"))), ","), F.lit("]"))


def _bbox() -> Column:
    return F.concat(F.lit('"bbox":['), F.concat_ws(",", *[_degrees(F.col(c)) for c in ("min_lat", "max_lat", "min_lon", "max_lon")]), F.lit("]"))


def points_json(points: DataFrame) -> DataFrame:
    """value: a JSON object a row, with id, lat, lon and tags."""
    extra = F.transform(F.coalesce("extra_tags", F.array().cast(TAGS)), lambda t: F.concat(_string(t["k"]), F.lit(":"), _string(t["v"])))
    known = F.filter(F.array(*[F.when(F.col(c).isNotNull(), _member(c, F.col(c))) for c in FIELDS]), lambda x: x.isNotNull())
    tags = F.concat(F.lit('"tags":{'), F.array_join(F.concat(known, extra), ","), F.lit("}"))
    plain = [F.concat(F.lit('"id":'), F.col("id")), F.concat(F.lit('"lat":'), _degrees(F.col("lat_e7"))), F.concat(F.lit('"lon":'), _degrees(F.col("lon_e7")))]
    return points.select(_object(*plain, tags).alias("value"))


def lines_json(lines: DataFrame) -> DataFrame:
    some = [F.when(F.col(c).isNotNull(), _member(c, F.col(c))) for c in ("name", "type", "ref")]
    return lines.select(_object(F.concat(F.lit('"id":'), F.col("id")), *some, _bbox(), F.concat(F.lit('"coords":'), _coords(F.col("coords")))).alias("value"))


def admins_json(admins: DataFrame) -> DataFrame:
    name = F.when(F.col("name").isNotNull(), _member("name", F.col("name")))
    ring = F.concat(F.lit('"outer_ring":'), _coords(F.col("ring")))
    return admins.select(_object(F.concat(F.lit('"id":'), F.col("id")), F.concat(F.lit('"admin_level":'), F.col("admin_level")), name, _bbox(), ring).alias("value"))


def read_points_json(spark: SparkSession, path: str) -> DataFrame:
    """Points as points_json() writes them, a row each or in one array; unknown tags become extra_tags."""
    raw = spark.read.schema("id long, lat double, lon double, tags map<string,string>").json(path)
    known = [F.nullif(F.try_element_at("tags", F.lit(c)), F.lit("")).alias(c) for c in FIELDS]
    extra = F.transform(F.filter(F.map_entries(F.coalesce("tags", F.create_map().cast("map<string,string>"))), lambda e: ~e["key"].isin(*FIELDS)), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return raw.select("id", F.lit(None).cast("string").alias("osm_type"), _e7("lat").alias("lat_e7"), _e7("lon").alias("lon_e7"), *known, extra.alias("extra_tags"))


def _e7(c: str) -> Column:
    return F.round(F.col(c) * 1e7).cast("int")


def _read_coords(c: str) -> Column:
    return F.transform(c, lambda p: F.struct(F.round(p[0] * 1e7).cast("int").alias("lat"), F.round(p[1] * 1e7).cast("int").alias("lon")))


def read_lines_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("id long, name string, type string, ref string, coords array<array<double>>").json(path)
    rows = raw.withColumn("coords", _read_coords("coords"))
    return rows.select("id", "name", "type", "ref", "coords", *geo.bbox(F.col("coords")))


def read_admins_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("id long, admin_level short, name string, outer_ring array<array<double>>").json(path)
    rows = raw.withColumn("ring", _read_coords("outer_ring"))
    return rows.select("id", "admin_level", "name", "ring", *geo.bbox(F.col("ring")))
