"""What the engine answers to its callers: parsing, boxes, reverse and forward geocoding, statistics."""

from __future__ import annotations

import datetime
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import geojson, osm, reverse, spatial, textsearch
from ..session import cut
from ..sources import pbf, tables
from . import reports

WORLD = (-180.0, -90.0, 180.0, 90.0)


def parse_bbox(text: str | None) -> tuple[float, float, float, float]:
    """w,s,e,n; what is missing or no number keeps the world's value, and so does all after it."""
    out = list(WORLD)
    for i, part in enumerate((text or "").split(",")[:4]):
        m = re.match(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", part)
        if not m:
            break
        out[i] = float(m[0])
        if m[0] != part:
            break
    return tuple(out)


def _first(df: DataFrame, limit: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(max(0, limit))


def points_in_bbox(points: DataFrame, bbox=WORLD, limit: int = 1_000) -> DataFrame:
    """Features of the first `limit` points, by id, in a box; the box reaches the scan as integers."""
    w, s, e, n = bbox
    near = F.col("lat_e7").between(int(s * 1e7) - 1, int(n * 1e7) + 1) & F.col("lon_e7").between(int(w * 1e7) - 1, int(e * 1e7) + 1)
    exact = geo.in_bbox(geo.from_e7(F.col("lat_e7")), geo.from_e7(F.col("lon_e7")), w, s, e, n)
    return geojson.points(_first(points.where(near & exact), limit, "id"))


def _met(rows: DataFrame, bbox) -> DataFrame:
    return rows.where(geo.bboxes_meet(*[geo.from_e7(F.col(c)) for c in ("min_lat", "max_lat", "min_lon", "max_lon")], *bbox))


def lines_in_bbox(lines: DataFrame, bbox=WORLD, limit: int = 500) -> DataFrame:
    return geojson.lines(_first(_met(lines, bbox), limit, "id"))


def admins_in_bbox(admins: DataFrame, bbox=WORLD) -> DataFrame:
    return geojson.admins(_met(admins, bbox))


def reverse_geocode(queries: DataFrame, points: DataFrame, admins: DataFrame) -> DataFrame:
    """Features for queries (query_id, lat, lon, zoom)."""
    return geojson.reverse(reverse.reverse_geocode(queries, points, admins), points, admins)


def search(queries: DataFrame, points: DataFrame, lines: DataFrame, admins: DataFrame, limit: int = 20) -> DataFrame:
    """Features for queries (query_id, q)."""
    limit = limit if limit > 0 else 20
    return geojson.search(textsearch.search(queries, points, lines, admins, limit=limit), points, lines, admins)


def dataset_info(spark: SparkSession, root: str, wanted: str) -> dict:
    names = tables.select_datasets(spark, root, wanted)
    return {"dataset": wanted} | tables.dataset_counts(spark, root, names).first().asDict()


def search_response(queries: DataFrame, points: DataFrame, lines: DataFrame, admins: DataFrame, limit: int = 20) -> dict[int, str]:
    """For each query that found something a FeatureCollection, with the number returned and milliseconds.

    For the queries of one call: the driver holds their features, `limit` a query.
    """
    began, found = time.perf_counter(), {}
    for r in search(queries, points, lines, admins, limit).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["feature"])
    took = (time.perf_counter() - began) * 1e3
    tail = lambda n: f'],"returned":{n},"query_ms":{took:.3f}}}'
    return {q: '{"type":"FeatureCollection","features":[' + ",".join(f) + tail(len(f)) for q, f in found.items()}


def parse(spark: SparkSession, path: str, root: str, *, with_admin: bool = True, measures: bool = True) -> dict:
    """A PBF file to a dataset below `root`; returns the figures that report() prints.

    measures: whether to count what the reports of containment, layers and attachment tell.
    """
    name, began, clock = tables.dataset_name(path), time.perf_counter(), reports.Clock()
    points, lines, admins = osm.parse(*pbf.read(spark, path))
    clock("lines and areas", lambda: (lines.write.mode("overwrite").parquet(f"{root}/{name}/lines"), admins.write.mode("overwrite").parquet(f"{root}/{name}/admins")))
    lines, admins = (tables.read_dataset(spark, root, name, k) for k in ("lines", "admins"))
    result = {"dataset": name, "source": path, "stats": {"open_rings": osm.open_rings(admins).first()[0]}}
    kept = points.columns
    if with_admin:
        polys = spatial.polygons(admins)
        nodes = clock("hierarchy", lambda: spatial.hierarchy(polys))
        attached = spatial.attach_admin(points, nodes)
        if measures:
            attached = cut(attached)  # read for its counts and to be written
            result["measures"] = reports.measure(attached, admins, nodes, polys, attached, clock)
        points = attached.select(*kept)
    clock("points", lambda: points.write.mode("overwrite").parquet(f"{root}/{name}/points"))
    result["stats"] |= tables.dataset_counts(spark, root, [name]).first().asDict()
    return result | {"seconds": time.perf_counter() - began, "steps": clock.took}


duration, size = reports.duration, reports.size


def report(result: dict, when: datetime.datetime) -> tuple[str, str]:
    """(file name, Markdown) of parse()'s result."""
    return reports.markdown(result, when)


def print_report(result: dict) -> None:
    """parse()'s result for a console."""
    print(reports.console(result))
