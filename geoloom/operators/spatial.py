"""Containment, hierarchy, admin chains, intersections and nearest neighbours.

Polygons become an index of grid cells: each cell lists the polygons that cover it, with those
edges only that lie in the cell's latitudes, or with none where the cell lies wholly inside.
A point looks up the one cell it is in and tests the listed polygons in place, so points get
an array of hits, and need no further shuffle for chains, smallest containing areas or
statistics. If all rings together are small, which a count of their vertices tells first, the
index is broadcast as arrays and batches of points are tested at once (grid.py). Otherwise
it is a table, both sides are shuffled by cell, and AQE may split crowded cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geo
from ..session import cut, ship
from .grid import CELLS_PER_POLYGON, SIZES, Grid

#: Bytes of rings, at 64 a vertex, that the driver may hold and broadcast.
BROADCAST_BYTES = 64 << 20


def polygons(admins: DataFrame, *, tiers_only: bool = True) -> DataFrame:
    """Areas as node_id, level, name, tier, edges, area2, bbox_area, ring and bounding box."""
    rows = admins.where(F.size("ring") > 0)
    if tiers_only:
        rows = rows.where(geo.tier(F.col("admin_level")).isNotNull())
    out = rows.select(
        F.col("id").alias("node_id"), F.col("admin_level").cast("int").alias("level"), "name", geo.tier(F.col("admin_level")).alias("tier"),
        geo.edges(F.col("ring")).alias("edges"), geo.area2(F.col("ring")).alias("area2"), "ring", *geo.bbox(F.col("ring")),
    )
    return out.withColumn("bbox_area", (geo.from_e7(F.col("max_lat")) - geo.from_e7(F.col("min_lat"))) * (geo.from_e7(F.col("max_lon")) - geo.from_e7(F.col("min_lon"))))


def _cell(x: Column, size: int) -> Column:
    return F.floor(x / F.lit(size)).cast("int")


def index(polys: DataFrame, *fields: str, size: int) -> DataFrame:
    """(cy, cx, polys): for each grid cell the polygons that cover some of it.

    fields: columns of `polys` that hits shall carry besides node_id, level and bounding box.
    """
    lat0, lon0 = F.col("cy").cast("long") * size, F.col("cx").cast("long") * size
    lat1, lon1 = lat0 + size, lon0 + size
    rows = polys.withColumn("cy", F.explode(F.sequence(_cell(F.col("min_lat"), size), _cell(F.col("max_lat"), size))))
    band = F.filter("edges", lambda e: (F.least(e["lat0"], e["lat1"]) < lat1) & (F.greatest(e["lat0"], e["lat1"]) > lat0))
    rows = rows.withColumn("edges", band).withColumn("cx", F.explode(F.sequence(_cell(F.col("min_lon"), size), _cell(F.col("max_lon"), size))))
    touched = F.exists("edges", lambda e: (F.least(e["lon0"], e["lon1"]) <= lon1) & (F.greatest(e["lon0"], e["lon1"]) >= lon0))
    # Horizontal edges have no part in the ray, and border the cell where they touch it.
    ring_next = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    level = F.exists(F.zip_with("ring", ring_next, lambda a, b: (a["lat"] == b["lat"]) & a["lat"].between(lat0, lat1) & (F.least(a["lon"], b["lon"]) <= lon1) & (F.greatest(a["lon"], b["lon"]) >= lon0)), lambda x: x)
    whole = ~touched & ~level
    rows = rows.withColumn("whole", whole).where(~F.col("whole") | geo.inside(F.col("edges"), lat0, lon0))
    edges = F.when(F.col("whole"), F.array().cast(geo.EDGE)).otherwise(F.col("edges")).alias("edges")
    item = F.struct("node_id", "level", *fields, "min_lat", "max_lat", "min_lon", "max_lon", "whole", edges)
    return rows.groupBy("cy", "cx").agg(F.collect_list(item).alias("polys"))


def cell_size(polys: DataFrame) -> tuple[int, int]:
    """The smallest cell size that keeps the index in proportion, and an upper bound of its bytes."""
    each = []
    for size in SIZES:
        high, wide = ((_cell(F.col(f"max_{c}"), size) - _cell(F.col(f"min_{c}"), size) + 1).cast("long") for c in ("lat", "lon"))
        each += [F.sum(high * wide).alias(f"n{size}"), F.sum(high * wide * 160 + F.size("edges") * wide * 64).alias(f"b{size}")]
    row = polys.agg(F.count("*").alias("n"), *each).first()
    most = max(4_096, CELLS_PER_POLYGON * row["n"])
    size = next((s for s in SIZES if (row[f"n{s}"] or 0) <= most), SIZES[-1])
    return size, row[f"b{size}"] or 0


def small(polys: DataFrame) -> bool:
    """Whether the rings may be broadcast; one row tells."""
    row = polys.agg(F.count("*").alias("n"), F.sum(F.size("ring").cast("long")).alias("vertices")).first()
    return 64 * ((row["vertices"] or 0) + 4 * row["n"]) <= BROADCAST_BYTES


def _parents(known: pa.Table) -> np.ndarray:
    """The row of each polygon's parent, -1 without one."""
    node, up = known.column("node_id").to_numpy(), known.column("parent_id").fill_null(0).to_numpy()
    if not len(node):
        return np.zeros(0, np.int64)
    order = np.argsort(node)
    return np.where(known.column("parent_id").is_null().to_numpy(), -1, order[np.minimum(np.searchsorted(node[order], up), len(node) - 1)])


def _grid_hits(grid, known: pa.Table, kind: pa.DataType, lat: int, lon: int, names: list[str], chains: bool):
    def run(batches):
        parent = _parents(known) if chains else None
        levels = known.to_struct_array()
        levels = levels.combine_chunks() if isinstance(levels, pa.ChunkedArray) else levels
        levels = levels.cast(kind)
        for b in batches:
            place, poly = _places(grid.value, b.column(lat), b.column(lon))
            lists = []
            for i, p in ((place, poly), *([grid.value.chains(place, poly, parent, len(geo.TIERS))] if chains else ())):
                offsets = np.searchsorted(i, np.arange(b.num_rows + 1))
                lists.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), levels.take(pa.array(p))))
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*names, "hits", "_chain"][: len(names) + len(lists)])

    return run


def _places(grid: Grid, y: pa.Array, x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hits of all rows; rows with a null have none."""
    valid = y.is_valid().to_numpy(zero_copy_only=False) & x.is_valid().to_numpy(zero_copy_only=False)
    place, poly = grid.hits(*(v.fill_null(0).to_numpy() for v in (y, x)))
    keep = valid[place]
    return place[keep], poly[keep]


#: What attach_admin() looks up: names of tiers along the chain, and of the smallest area of a level.
_LEVELS = (2, 4, 8, 10, 9, 11)
_FOUND = (*(f"_in_{t}" for t in ("country", "state", "city", "suburb")), *(f"_at_{x}" for x in _LEVELS))


def _grid_names(grid, known: pa.Table, lat: int, lon: int, names: list[str]):
    """Rows with _FOUND and chain, for a broadcast index."""

    def run(batches):
        parent, name = _parents(known), known.column("name").combine_chunks().cast(pa.string())
        named = name.is_valid().to_numpy(zero_copy_only=False)
        node, level, area = (known.column(c).to_numpy() for c in ("node_id", "level", "area2"))
        tier = np.array(known.column("tier").to_pylist(), object)
        for b in batches:
            place, poly = _places(grid.value, b.column(lat), b.column(lon))
            deep, link = grid.value.chains(place, poly, parent, len(geo.TIERS))

            def first(p, x):
                out = np.full(b.num_rows, -1)  # noqa: B023
                at, one = np.unique(p, return_index=True)
                out[at] = x[one]
                return name.take(pa.array(out, mask=out < 0))  # noqa: B023

            found = []
            for t in TIER_NAMES:
                some = np.flatnonzero((tier[link] == t) & named[link])
                some = some[::-1] if t == "suburb" else some  # the deepest one
                found.append(first(deep[some], link[some]))
            for x in _LEVELS:
                some = np.flatnonzero(level[poly] == x)
                some = some[np.lexsort((node[poly[some]], area[poly[some]], place[some]))]
                found.append(first(place[some], poly[some]))
            offsets = np.searchsorted(deep, np.arange(b.num_rows + 1))
            found.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(node[link], pa.int64())))
            yield pa.RecordBatch.from_arrays([*b.columns, *found], [*names, *_FOUND, "chain"])

    return run


def _with_names(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """`points` with _FOUND and chain."""
    points = points.drop(*_FOUND, "chain")
    if small(nodes):
        table, grid = _broadcast(nodes, ("parent_id", "tier", "name", "area2"), geo.inside)
        more = [*[T.StructField(c, T.StringType()) for c in _FOUND], T.StructField("chain", T.ArrayType(T.LongType()))]
        run = _grid_names(grid, table, points.columns.index("lat_e7"), points.columns.index("lon_e7"), points.columns)
        return points.mapInArrow(run, T.StructType([*points.schema.fields, *more]))
    rows = with_chain(points, nodes, "tier", "name", "area2")
    named = lambda t: F.filter("_chain", lambda h: (h["tier"] == t) & h["name"].isNotNull())
    rows = rows.withColumns({f"_in_{t}": F.try_element_at(named(t), F.lit(-1 if t == "suburb" else 1))["name"] for t in TIER_NAMES})
    rows = rows.withColumns({f"_at_{x}": smallest(F.col("hits"), x)["name"] for x in _LEVELS})
    return rows.withColumn("chain", F.transform("_chain", lambda h: h["node_id"])).drop("hits", "_chain")


def _broadcast(polys: DataFrame, fields, test) -> tuple[pa.Table, object]:
    """The polygons in the order of hits, and their index."""
    ship(polys.sparkSession)
    table = polys.select("level", "node_id", *fields, "ring").toArrow()  # small() bounds it
    order = np.lexsort((table.column("node_id").to_numpy(), table.column("level").to_numpy()))
    table = table.take(pa.array(order))
    grid = polys.sparkSession.sparkContext.broadcast(Grid(table.column("ring"), degrees=test is not geo.inside))
    return table.drop_columns(["ring"]), grid


def _with_grid(points: DataFrame, polys: DataFrame, fields, test, lat: str, lon: str, chains: bool = False) -> DataFrame:
    table, grid = _broadcast(polys, fields, test)
    hit = T.StructType([polys.schema[f] for f in ("level", "node_id", *fields)])
    names = points.columns
    run = _grid_hits(grid, table, to_arrow_type(hit), names.index(lat), names.index(lon), names, chains)
    more = [T.StructField(c, T.ArrayType(hit)) for c in ("hits", "_chain")[: 1 + chains]]
    return points.mapInArrow(run, T.StructType([*points.schema.fields, *more]))


def with_hits(points: DataFrame, polys: DataFrame, *fields: str, test=geo.inside, lat: str = "lat_e7", lon: str = "lon_e7") -> DataFrame:
    """`points` with hits: the polygons that contain each, ordered by level and node_id."""
    points = points.drop("hits")
    if small(polys):
        return _with_grid(points, polys, fields, test, lat, lon)
    size, _ = cell_size(polys)
    built = index(polys, *fields, size=size)
    rows = points.withColumns({"cy": _cell(F.col(lat), size), "cx": _cell(F.col(lon), size)}).join(built, ["cy", "cx"], "left")
    y, x = (F.col(lat), F.col(lon)) if test is geo.inside else (geo.from_e7(F.col(lat)), geo.from_e7(F.col(lon)))

    def holds(p):
        near = F.col(lat).between(p["min_lat"], p["max_lat"]) & F.col(lon).between(p["min_lon"], p["max_lon"])
        return near & (p["whole"] | test(p["edges"], y, x))

    keep = lambda p: F.struct(p["level"].alias("level"), p["node_id"].alias("node_id"), *[p[f].alias(f) for f in fields])
    hits = F.transform(F.filter("polys", holds), keep)
    empty = F.array().cast(f"array<{_hit_type(polys, fields)}>")
    return rows.withColumn("hits", F.coalesce(F.array_sort(hits), empty)).drop("polys", "cy", "cx")


def _hit_type(polys: DataFrame, fields) -> str:
    kinds = dict(polys.dtypes)
    return "struct<" + ",".join(f"{f}:{kinds[f]}" for f in ("level", "node_id", *fields)) + ">"


def smallest(hits: Column, level: int, by: str = "area2") -> Column:
    """The hit at `level` of least area, then least node_id."""
    key = lambda h: F.struct(h[by].alias("by"), h["node_id"].alias("node_id"), h.alias("hit"))
    some = hits if level < 0 else F.filter(hits, lambda h: h["level"] == level)
    return F.array_min(F.transform(some, key))["hit"]


def hierarchy(polys: DataFrame) -> DataFrame:
    """`polys` with parent_id: of the areas of a lower level that contain the first vertex,
    the one of highest level, then least area, then least node_id."""
    few = small(polys)
    # Few beside the points, and read several times: kept by the driver or in the shared folder.
    polys = polys.sparkSession.createDataFrame(polys.toArrow(), polys.schema) if few else cut(polys)
    reps = polys.withColumns({"rep_lat": F.col("ring")[0]["lat"], "rep_lon": F.col("ring")[0]["lon"]})
    found = with_hits(reps, polys, "area2", lat="rep_lat", lon="rep_lon")
    key = lambda h: F.struct((-h["level"]).alias("l"), h["area2"].alias("a"), h["node_id"].alias("node_id"))
    above = F.filter("hits", lambda h: h["level"] < F.col("level"))
    found = found.withColumn("parent_id", F.array_min(F.transform(above, key))["node_id"]).drop("hits")
    return found.sparkSession.createDataFrame(found.toArrow(), found.schema) if few else cut(found)


def hierarchy_stats(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: nodes, roots, max_depth, intersecting pairs. A parent's level is lower than its child's."""
    depth = nodes.select("node_id", F.lit(1).alias("depth"), "parent_id")
    up = nodes.select(F.col("node_id").alias("n"), F.col("parent_id").alias("p"))
    for _ in geo.TIERS:
        depth = depth.join(up, F.col("parent_id") == F.col("n"), "left").select("node_id", (F.col("depth") + F.col("n").isNotNull().cast("int")).alias("depth"), F.col("p").alias("parent_id"))
    sizes = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("parent_id").isNull()).alias("roots"))
    deep = depth.agg(F.coalesce(F.max("depth"), F.lit(0)).cast("long").alias("max_depth"))
    return sizes.crossJoin(deep).crossJoin(pairs.agg(F.count("*").alias("pairs")))  # one row each


def chain(hits: Column) -> Column:
    """From the first root among the hits down: each time the first child, by level and node_id."""
    first = F.slice(F.filter(hits, lambda h: h["parent_id"].isNull()), 1, 1)
    step = lambda acc, _: F.concat(acc, F.slice(F.filter(hits, lambda h: h["parent_id"] == F.try_element_at(acc, F.lit(-1))["node_id"]), 1, 1))
    return F.aggregate(F.sequence(F.lit(2), F.lit(len(geo.TIERS))), first, step)


def with_chain(points: DataFrame, nodes: DataFrame, *fields: str) -> DataFrame:
    """`points` with hits and _chain (see chain()); fields: columns of `nodes` besides level, node_id and parent_id."""
    fields = ("parent_id", *fields)
    if small(nodes):
        return _with_grid(points.drop("hits", "_chain"), nodes, fields, geo.inside, "lat_e7", "lon_e7", True)
    return with_hits(points, nodes, *fields).withColumn("_chain", chain(F.col("hits")))


TIER_NAMES = ("country", "state", "city", "suburb")


def attach_admin(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """`points` with country, state, city and suburb filled from the areas that contain them.

    The chain fills what is empty, except that its deepest named suburb replaces any; then
    the smallest area at levels 2, 4, 8 and, for suburbs, 10, 9, 11 fills what is still empty.
    Adds was_<tier> (present before) and chain (node_ids).
    """
    rows = _with_names(points, nodes).withColumns({f"was_{t}": F.col(t).isNotNull() for t in TIER_NAMES})
    filled = {
        "country": F.coalesce("country", "_in_country", "_at_2"),
        "state": F.coalesce("state", "_in_state", "_at_4"),
        "city": F.coalesce("city", "_in_city", "_at_8"),
        "suburb": F.coalesce("_in_suburb", "suburb", "_at_10", "_at_9", "_at_11"),
    }
    return rows.withColumns(filled).drop(*_FOUND)


def attach_stats(attached: DataFrame) -> DataFrame:
    """One row: points, newly filled of each tier, points with any tier."""
    new = [F.count_if(~F.col(f"was_{t}") & F.col(t).isNotNull()).alias(f"{t}_filled") for t in TIER_NAMES]
    any_ = F.count_if(F.coalesce(*TIER_NAMES).isNotNull()).alias("points_with_any")
    return attached.agg(F.count("*").alias("points"), *new, any_)


def intersections(polys: DataFrame) -> DataFrame:
    """(a, b): polygons of one level, a < b, some edges of which properly cross.

    Edges meet by grid cell, so that rings of any length cost their edges only; shared
    borders, touching and collinear overlap are no crossing.
    """
    size, _ = cell_size(polys)
    nxt = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edge = polys.select("node_id", "level", F.explode(F.arrays_zip(F.col("ring").alias("p"), nxt.alias("q"))).alias("e"))
    edge = edge.select("node_id", "level", *[F.col(f"e.{v}.{c}").cast("long").alias(f"{v}{c}") for v in "pq" for c in ("lat", "lon")])
    span = lambda c: F.explode(F.sequence(_cell(F.least(f"p{c}", f"q{c}"), size), _cell(F.greatest(f"p{c}", f"q{c}"), size)))
    cells = edge.withColumn("cy", span("lat")).withColumn("cx", span("lon"))
    a = cells
    b = cells.select(*[F.col(c).alias("b_" + c) for c in cells.columns])
    near = (
        (F.col("level") == F.col("b_level")) & (F.col("cy") == F.col("b_cy")) & (F.col("cx") == F.col("b_cx")) & (F.col("node_id") < F.col("b_node_id"))
        & (F.least("plat", "qlat") <= F.greatest("b_plat", "b_qlat")) & (F.least("b_plat", "b_qlat") <= F.greatest("plat", "qlat"))
    )

    def side(p, q, r):
        lat, lon = (lambda v: F.col(f"{v}lat")), (lambda v: F.col(f"{v}lon"))
        return F.signum((lon(q) - lon(p)) * (lat(r) - lat(p)) - (lat(q) - lat(p)) * (lon(r) - lon(p)))

    cross = (side("p", "q", "b_p") * side("p", "q", "b_q") < 0) & (side("b_p", "b_q", "p") * side("b_p", "b_q", "q") < 0)
    return a.join(b, near & cross).select(F.col("node_id").alias("a"), F.col("b_node_id").alias("b")).distinct()


def nearest(queries: DataFrame, points: DataFrame, k: int = 1, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest points of each query: query_id, rank, id, distance_m and `carry`.

    queries: query_id, lat, lon in degrees; points: id, lat_e7, lon_e7. Exact: a grid is
    searched in the nine cells round each query, and queries whose k-th distance may reach
    beyond them go on in a grid of four times the cell size. Ties go to the smaller id.
    """
    extent = points.agg(F.count("*").alias("n"), *[f(c).alias(g + c) for c in ("lat_e7", "lon_e7") for f, g in ((F.min, "lo_"), (F.max, "hi_"))]).first()
    if not extent["n"]:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("double").alias("distance_m"), *[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in carry]).where("false")
    high, wide = ((extent[f"hi_{c}"] - extent[f"lo_{c}"]) / 1e7 for c in ("lat_e7", "lon_e7"))
    size = max(1e-4, (max(high, 1e-4) * max(wide, 1e-4) * 2 * k / extent["n"]) ** 0.5)
    # Points crowd in places: the grid begins with cells in which a point has few neighbours on average.
    while size > 1e-5:
        cells = points.groupBy(*[F.floor(F.col(c) / F.lit(size * 1e7)).alias(c) for c in ("lat_e7", "lon_e7")]).agg(F.count("*").alias("n"))
        if cells.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("s")).first()["s"] <= 16 * k * extent["n"]:
            break
        size /= 4
    p = points.select("id", (F.col("lat_e7") / F.lit(1e7)).alias("plat"), (F.col("lon_e7") / F.lit(1e7)).alias("plon"), *carry)
    open_, done, most = queries.select("query_id", "lat", "lon"), None, min(k, extent["n"])
    best = Window.partitionBy("query_id").orderBy("distance_m", "id")
    while True:
        last = size >= 360
        cell = lambda c, d=0: (F.floor(c / F.lit(size)) + d).cast("long")  # noqa: B023, E731
        around = open_.withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
        around = around.withColumns({"cy": cell(F.col("lat"), F.col("dy")), "cx": cell(F.col("lon"), F.col("dx"))}).drop("dy", "dx")
        found = around.join(p.withColumns({"cy": cell(F.col("plat")), "cx": cell(F.col("plon"))}), ["cy", "cx"])
        found = found.withColumn("distance_m", geo.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")))
        found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        if last:  # every point is in the nine cells
            final = found.select("query_id", "rank", "id", "distance_m", *carry)
            return final if done is None else done.unionByName(final)
        # No point outside the nine cells is nearer than one cell's height, or than the meridian one cell away.
        safe = F.least(F.radians(F.lit(size)), F.asin(F.sin(F.radians(F.lit(min(size, 90.0)))) * F.cos(F.radians("qlat")))) * geo.RADIUS
        found = cut(found)  # each round reads the one before from the shared folder
        full = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("distance_m").alias("far"), F.first("lat").alias("qlat"))
        sure = cut(full.where((F.col("n") == most) & (F.col("far") < safe)).select("query_id"))
        step = found.join(sure, "query_id", "left_semi").select("query_id", "rank", "id", "distance_m", *carry)
        done = step if done is None else done.unionByName(step)
        open_ = cut(open_.join(sure, "query_id", "left_anti"))
        size *= 4
        if open_.isEmpty():
            return done
