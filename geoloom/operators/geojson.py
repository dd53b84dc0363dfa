"""GeoJSON features as text, a row each, and feature collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import cut
from . import textsearch


def _number(e7: Column) -> Column:
    return F.format_string("%.7f", geo.from_e7(e7))


def _pair(lat: Column, lon: Column) -> Column:
    return F.concat(F.lit("["), _number(lon), F.lit(","), _number(lat), F.lit("]"))


def _path(coords: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(coords, lambda c: _pair(c["lat"], c["lon"])), ","), F.lit("]"))


def quoted(text: Column) -> Column:
    """A JSON string."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _field(name: str, value: Column) -> Column:
    ""","name":"value", or nothing for null and empty values."""
    return F.when(value.isNull() | (value == ""), "").otherwise(F.concat(F.lit(f',"{name}":'), quoted(value)))


def _begun(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.concat(F.lit(f'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":'), coordinates, F.lit('},"properties":{'), properties)


def _feature(kind: str, coordinates: Column, properties: Column) -> Column:
    return F.concat(_begun(kind, coordinates, properties), F.lit("}}"))


def points(df: DataFrame) -> DataFrame:
    props = F.concat(F.lit('"id":'), F.col("id"), *[_field(c, F.col(c)) for c in ("name", "type", "street", "housenumber", "postcode")])
    return df.select("id", _feature("Point", _pair(F.col("lat_e7"), F.col("lon_e7")), props).alias("feature"))


def lines(df: DataFrame) -> DataFrame:
    props = F.concat(F.lit('"id":'), F.col("id"), *[_field(c, F.col(c)) for c in ("name", "type", "ref")])
    return df.select("id", _feature("LineString", _path(F.col("coords")), props).alias("feature"))


def admins(df: DataFrame) -> DataFrame:
    props = F.concat(F.lit('"id":'), F.col("id"), F.lit(',"admin_level":'), F.col("admin_level"), _field("name", F.col("name")))
    return df.select("id", _feature("Polygon", F.concat(F.lit("["), _path(F.col("ring")), F.lit("]")), props).alias("feature"))


def drawn(results: DataFrame, kind: int, objs: DataFrame, begun: Column) -> DataFrame:
    """id and `begun`, the feature up to what differs by query, of each object of a kind among the results, once each."""
    ids = results.where(F.col("kind") == kind).select("id").distinct()
    return objs.join(ids, "id", "left_semi").select("id", begun.alias("begun"))


def search(results: DataFrame, pts: DataFrame, lns: DataFrame, adms: DataFrame) -> DataFrame:
    """Features of search results: query_id, rank, feature."""
    results = cut(results)  # read twice for each kind
    head = lambda k: F.concat(F.lit(f'"kind":"{k}","id":'), F.col("id"))
    fields = lambda *names: [_field(c, F.col(c)) for c in names]
    a = _begun("Point", _pair(F.col("lat_e7"), F.col("lon_e7")), F.concat(head("poi"), *fields("name", "type", "street", "housenumber", "city", "state", "country")))
    b = _begun("LineString", _path(F.col("coords")), F.concat(head("street"), *fields("name", "type")))
    level = F.concat(F.lit(',"admin_level":'), F.col("admin_level"))
    c = _begun("Polygon", F.concat(F.lit("["), _path(F.col("ring")), F.lit("]")), F.concat(head("admin"), level, *fields("name")))
    kinds = (textsearch.POI, pts, a), (textsearch.STREET, lns, b), (textsearch.ADMIN, adms, c)
    a, b, c = (drawn(results, kind, objs, begun).withColumn("kind", F.lit(kind)) for kind, objs, begun in kinds)
    tail = F.concat(F.format_string(',"score":%.2f,"matched":%d', F.col("score"), F.col("matched")), _field("reason", F.col("reason")), F.lit("}}"))
    return results.join(a.unionByName(b).unionByName(c), ["kind", "id"]).select("query_id", "rank", F.concat("begun", tail).alias("feature"))


def reverse(found: DataFrame, pts: DataFrame, adms: DataFrame) -> DataFrame:
    """Features of reverse_geocode(): query_id, feature (null where nothing was found)."""
    tiers = F.concat(*[F.concat(F.lit(f',"{t}":'), quoted(F.coalesce(F.col(f"f.{t}"), F.lit("")))) for t in ("country", "state", "city", "suburb")])
    f = cut(found).alias("f")  # read once for each kind
    head = lambda level: F.concat(F.lit('"object_kind":"'), F.col("f.object_kind"), F.lit('","id":'), F.col("f.id"), F.lit(',"admin_level":'), level)
    house = F.concat(head(F.lit("null")), F.format_string(',"distance_m":%.2f', F.col("f.distance_m")), *[_field(c, F.col(f"p.{c}")) for c in ("name", "type", "street", "housenumber", "postcode")], tiers)
    a = f.where("f.kind = 'point'").join(pts.alias("p"), F.col("f.id") == F.col("p.id")).select("f.query_id", _feature("Point", _pair(F.col("p.lat_e7"), F.col("p.lon_e7")), house).alias("feature"))
    area = F.concat(head(F.col("f.admin_level")), F.lit(',"name":'), quoted(F.coalesce("f.name", F.lit(""))), tiers)
    b = f.where("f.kind = 'area'").join(adms.alias("a"), F.col("f.id") == F.col("a.id")).select("f.query_id", _feature("Polygon", F.concat(F.lit("["), _path(F.col("a.ring")), F.lit("]")), area).alias("feature"))
    none = f.where("f.kind is null").select("f.query_id", F.lit(None).cast("string").alias("feature"))
    return a.unionByName(b).unionByName(none)


def collection(features: DataFrame, *order: str) -> DataFrame:
    """One row: all features as a FeatureCollection. For results of an API call, which are small."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(*order, "feature"))), lambda x: x["feature"])
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(rows, ","), F.lit("]}")).alias("geojson"))
