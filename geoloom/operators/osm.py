"""Classification of nodes, ways and relations into points, lines and administrative areas."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..session import ship

AREA_KEYS = ("building", "amenity", "leisure", "natural", "landuse")
LINE_KEYS = ("highway", "bridge", "railway", "waterway")
POINT_TYPE_KEYS = ("building", "amenity", "leisure")
LINE_TYPE_KEYS = ("highway", "railway", "bridge")
ADDRESS = ("street", "housenumber", "postcode", "country", "state", "city", "suburb")
COORDS = "array<struct<lat:int,lon:int>>"


def tag_value(tags: Column, key: str) -> Column:
    """The first value of a key."""
    return F.get(F.filter(tags, lambda t: t["k"] == key), 0)["v"]


def last_value(tags: Column, *keys: str) -> Column:
    """The value of the last tag whose key is one of `keys`; an empty one counts as none."""
    return F.nullif(F.try_element_at(F.filter(tags, lambda t: t["k"].isin(*keys)), F.lit(-1))["v"], F.lit(""))


def has_any(tags: Column, keys: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.transform(tags, lambda t: t["k"]), F.array(*map(F.lit, keys)))


def point_fields(tags: Column) -> list[Column]:
    """name, type, address fields and extra_tags of a tag list."""
    known = ("name", *POINT_TYPE_KEYS, *[f"addr:{a}" for a in ADDRESS])
    extra = F.filter(tags, lambda t: ~t["k"].isin(*known)).alias("extra_tags")
    return [last_value(tags, "name").alias("name"), last_value(tags, *POINT_TYPE_KEYS).alias("type"), *[last_value(tags, f"addr:{a}").alias(a) for a in ADDRESS], extra]


def line_fields(tags: Column) -> list[Column]:
    return [last_value(tags, "name").alias("name"), last_value(tags, *LINE_TYPE_KEYS).alias("type"), last_value(tags, "ref").alias("ref")]


def is_boundary(tags: Column) -> Column:
    return (F.coalesce(tag_value(tags, "type"), F.lit("")) == "boundary") & tag_value(tags, "admin_level").isNotNull()


def way_classes(ways: DataFrame) -> DataFrame:
    """`ways` with is_area and is_line; a way may be both or neither."""
    return ways.withColumns({"is_area": has_any(F.col("tags"), AREA_KEYS), "is_line": has_any(F.col("tags"), LINE_KEYS)})


def needed_ways(relations: DataFrame) -> DataFrame:
    """way_id of all way members of boundary relations, once each."""
    rows = relations.where(is_boundary(F.col("tags"))).select(F.explode("members").alias("m"))
    return rows.where("m.type = 'w'").select(F.col("m.ref").alias("way_id")).distinct()


def resolve_coords(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """`ways` with coords in the order of refs; refs without a node are skipped."""
    refs = ways.select("id", F.posexplode("refs").alias("pos", "ref"))
    found = refs.join(nodes.select(F.col("id").alias("ref"), "lat_e7", "lon_e7"), "ref")
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("lat_e7").alias("lat"), F.col("lon_e7").alias("lon")))).alias("c"))
    lists = lists.select("id", F.transform("c", lambda x: F.struct(x["lat"], x["lon"])).alias("coords"))
    return ways.join(lists, "id", "left").withColumn("coords", F.coalesce("coords", F.array().cast(COORDS)))


def points(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Tagged nodes, and area ways at their centroids. ways: with coords."""
    kinds = ["id", "osm_type", "lat_e7", "lon_e7"]
    a = nodes.where(F.size("tags") > 0).select("id", F.lit("n").alias("osm_type"), "lat_e7", "lon_e7", *point_fields(F.col("tags")))
    lat, lon = geo.centroid(F.col("coords"))
    b = way_classes(ways).where(F.col("is_area") & (F.size("coords") > 0)).select("id", F.lit("w").alias("osm_type"), lat.alias("lat_e7"), lon.alias("lon_e7"), *point_fields(F.col("tags")))
    return a.unionByName(b).select(*kinds, *[c for c in a.columns if c not in kinds])


def lines(ways: DataFrame) -> DataFrame:
    """Line ways with their coordinates and bounding boxes."""
    rows = way_classes(ways).where(F.col("is_line") & (F.size("coords") > 0))
    return rows.select("id", *line_fields(F.col("tags")), "coords", *geo.bbox(F.col("coords")))


def _stitch(segments: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    """From each segment on, whatever continues the end is appended; the longest result stays.

    Of several that continue it the first in order does. Segments are looked up by their end
    points, and a start is left out if all that hangs together with it could not make a
    longer ring than the best so far.
    """
    segments = [s for s in segments if s]
    if len(segments) < 2:
        return segments[0] if segments else []
    at: dict[tuple[int, int], list[int]] = {}
    for i, s in enumerate(segments):
        for end in {s[0], s[-1]}:
            at.setdefault(end, []).append(i)
    # The most points that a ring may have from each segment on: all that is connected with it.
    most = [0] * len(segments)
    for i in range(len(segments)):
        if most[i]:
            continue
        group, todo, most[i] = [], [i], -1
        while todo:
            j = todo.pop()
            group.append(j)
            for end in (segments[j][0], segments[j][-1]):
                for k in at[end]:
                    if not most[k]:
                        most[k] = -1
                        todo.append(k)
        bound = 1 + sum(len(segments[j]) - 1 for j in group)
        for j in group:
            most[j] = bound
    best, size = [], 0
    for seed in range(len(segments)):
        if most[seed] <= size:
            continue
        used, tried = {seed}, {}
        path, points, end = [(seed, False)], len(segments[seed]), segments[seed][-1]
        while True:
            here, k = at[end], tried.get(end, 0)
            while k < len(here) and here[k] in used:
                k += 1
            tried[end] = k
            if k == len(here):
                break
            s = segments[here[k]]
            used.add(here[k])
            path.append((here[k], s[0] != end))
            points, end = points + len(s) - 1, s[0] if s[0] != end else s[-1]
        if points > size:
            best, size = path, points
    ring = list(segments[best[0][0]])
    for i, backwards in best[1:]:
        ring += segments[i][-2::-1] if backwards else segments[i][1:]
    return ring


def stitch(segments: Column) -> Column:
    """One ring from a relation's segments in member order; an Arrow UDF over one relation at a time."""

    ship()

    @F.arrow_udf(COORDS)
    def ring(rows: pa.Array) -> pa.Array:
        out = [_stitch([[(c["lat"], c["lon"]) for c in s or []] for s in segs or []]) for segs in rows.to_pylist()]
        kind = pa.list_(pa.struct([("lat", pa.int32()), ("lon", pa.int32())]))
        return pa.array([[{"lat": a, "lon": b} for a, b in r] for r in out], kind)

    return ring(segments)


def admin_areas(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """id, admin_level, name, ring and bounding box of boundary relations with some ring.

    Way members of role outer or none are taken in order; of rows that share a way id the least
    geometry is.
    """
    rows = relations.where(is_boundary(F.col("tags")))
    members = rows.select("id", F.posexplode("members").alias("pos", "m")).where("m.type = 'w' AND m.role IN ('outer', '')")
    geometry = ways.where(F.size("coords") > 0).groupBy(F.col("id").alias("way_id")).agg(F.min("coords").alias("coords"))
    segments = members.join(geometry, F.col("m.ref") == F.col("way_id")).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "coords"))).alias("s"))
    segments = segments.select("id", stitch(F.transform("s", lambda x: x["coords"])).alias("ring")).where(F.size("ring") > 0)
    found = rows.join(segments, "id")
    return found.select("id", geo.admin_level(tag_value(F.col("tags"), "admin_level")).alias("admin_level"), F.nullif(tag_value(F.col("tags"), "name"), F.lit("")).alias("name"), "ring", *geo.bbox(F.col("ring")))


def open_rings(admins: DataFrame) -> DataFrame:
    """One row: rings of two vertices and more that don't end where they begin."""
    closed = F.col("ring")[0] == F.try_element_at("ring", F.lit(-1))
    return admins.agg(F.count_if((F.size("ring") >= 2) & ~closed).alias("open_rings"))


def parse(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, lines, admins). Only ways that become something get coordinates."""
    wanted = way_classes(ways).where("is_area or is_line").select("id")
    wanted = wanted.unionByName(needed_ways(relations).withColumnRenamed("way_id", "id")).distinct()
    resolved = resolve_coords(ways.join(wanted, "id", "left_semi"), nodes)
    return points(nodes, resolved), lines(resolved), admin_areas(relations, resolved)
