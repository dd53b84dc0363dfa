import math
import random

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import grid, reverse, spatial

RING = "array<struct<lat:int,lon:int>>"


def areas(spark, rows):
    return spark.createDataFrame([(i, lv, n, ring) for i, lv, n, ring in rows], f"id long, admin_level short, name string, ring {RING}")


def holds(ring, lat, lon):
    odd = False
    for (y0, x0), (y1, x1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > lat) != (y1 > lat):
            left = (x0 - lon) * (y1 - y0) + (lat - y0) * (x1 - x0)
            odd ^= left > 0 if y1 > y0 else left < 0
    return odd


def star(rng, cy, cx, r, n):
    return [(int(cy + r * rng.uniform(0.3, 1) * math.sin(2 * math.pi * i / n)), int(cx + r * rng.uniform(0.3, 1) * math.cos(2 * math.pi * i / n))) for i in range(n)]


def made(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        level = rng.choice([2, 4, 8, 9, 10, 11, 6])
        r = {2: 60_000_000, 4: 30_000_000}.get(level, 4_000_000)
        ring = star(rng, rng.randint(-40_000_000, 40_000_000), rng.randint(-40_000_000, 40_000_000), r, rng.randint(3, 40))
        rows.append((i, level, None if i % 9 == 0 else f"A{i}", ring))
    rows.append((60, 8, "box", [(0, 0), (0, 10_000_000), (10_000_000, 10_000_000), (10_000_000, 0), (0, 0)]))
    rows.append((61, 8, "beside", [(0, 10_000_000), (0, 20_000_000), (10_000_000, 20_000_000), (10_000_000, 10_000_000), (0, 10_000_000)]))
    rows.append((62, 9, "flat", [(5, 5), (5, 9)]))
    pts = [(i, rng.randint(-50_000_000, 50_000_000), rng.randint(-50_000_000, 50_000_000)) for i in range(700)]
    pts += [(1_000 + i, y, x) for i, (y, x) in enumerate((y, x) for y in (0, 5_000_000, 10_000_000) for x in (0, 10_000_000, 20_000_000))]
    return rows, pts


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_hits_against_all_edges(spark, monkeypatch, most):
    """As arrays in a broadcast and as a table of cells, in cells of several sizes."""
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", most)
    monkeypatch.setattr(grid, "_PAIRS", 500)
    rows, pts = made()
    polys = spatial.polygons(areas(spark, rows))
    points = spark.createDataFrame(pts, "id long, lat_e7 int, lon_e7 int")
    box = {i: (min(y for y, _ in r), max(y for y, _ in r), min(x for _, x in r), max(x for _, x in r)) for i, _, _, r in rows}
    want = {p: sorted((lv, i) for i, lv, _, ring in rows if lv in geo.TIERS and box[i][0] <= y <= box[i][1] and box[i][2] <= x <= box[i][3] and holds(ring, y, x)) for p, y, x in pts}
    for size in (None, 50_000_000, 3_000_000):
        if size:
            monkeypatch.setattr(spatial, "cell_size", lambda _, s=size: (s, 0))
            monkeypatch.setattr(grid, "SIZES", (size,))
        got = {r["id"]: [(h["level"], h["node_id"]) for h in r["hits"]] for r in spatial.with_hits(points, polys).collect()}
        assert got == want
    assert sum(map(len, want.values())) > 300


def tree(rows):
    """Parents by the rule, in plain Python."""
    area = {i: abs(sum(x0 * y1 - x1 * y0 for (y0, x0), (y1, x1) in zip(r, r[1:] + r[:1], strict=True))) if len(r) > 2 else 0 for i, _, _, r in rows}
    out = {}
    for i, lv, _, ring in rows:
        if lv in geo.TIERS:
            y, x = ring[0]
            above = [(-l2, area[j], j) for j, l2, _, r2 in rows if l2 in geo.TIERS and l2 < lv and holds(r2, y, x)]
            out[i] = min(above)[2] if above else None
    return out, area


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_hierarchy_chain_and_attachment(spark, monkeypatch, most):
    monkeypatch.setattr(spatial, "BROADCAST_BYTES", most)
    rows, pts = made(2)
    parent, area = tree(rows)
    nodes = spatial.hierarchy(spatial.polygons(areas(spark, rows)))
    assert {r["node_id"]: r["parent_id"] for r in nodes.collect()} == parent
    level, name = {i: lv for i, lv, _, _ in rows}, {i: n for i, _, n, _ in rows}
    points = spark.createDataFrame([(i, y, x, None, None, "Tagged" if i % 5 == 0 else None, "Tag" if i % 3 == 0 else None) for i, y, x in pts], "id long, lat_e7 int, lon_e7 int, country string, state string, city string, suburb string")
    got = {r["id"]: r for r in spatial.attach_admin(points, nodes).collect()}
    tiers = {t: [k for k, v in geo.TIERS.items() if v == t] for t in spatial.TIER_NAMES}
    for i, y, x in pts:
        hit = sorted((level[j], j) for j, lv, _, r in rows if lv in geo.TIERS and holds(r, y, x))
        chain, now = [], None
        while step := [j for _, j in hit if parent[j] == now]:
            now = step[0]
            chain.append(now)
        has = {"country": None, "state": None, "city": "Tagged" if i % 5 == 0 else None, "suburb": "Tag" if i % 3 == 0 else None}
        for j in chain:
            t = geo.TIERS[level[j]]
            if name[j] and (t == "suburb" or not has[t]):
                has[t] = name[j]
        for t in spatial.TIER_NAMES:
            for lv in [10, 9, 11] if t == "suburb" else tiers[t]:
                some = [(area[j], j) for l2, j in hit if l2 == lv]
                if not has[t] and some:
                    has[t] = name[min(some)[1]]
        assert got[i]["chain"] == chain and {t: got[i][t] for t in has} == has, i


def test_intersections(spark):
    rows, _ = made(3)
    sign = lambda v: (v > 0) - (v < 0)
    side = lambda p, q, r: sign((q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1]))
    edges = {i: list(zip(r, r[1:] + r[:1], strict=True)) for i, _, _, r in rows}
    cross = lambda a, b: side(*a, b[0]) * side(*a, b[1]) < 0 and side(*b, a[0]) * side(*b, a[1]) < 0
    want = {(i, j) for i, a, _, _ in rows for j, b, _, _ in rows if i < j and a == b and a in geo.TIERS and any(cross(e, f) for e in edges[i] for f in edges[j])}
    got = {tuple(r) for r in spatial.intersections(spatial.polygons(areas(spark, rows))).collect()}
    assert got == want and len(want) > 5 and (60, 61) not in want


def test_nearest_is_exact(spark):
    rng = random.Random(5)
    pts = [(i, rng.randint(470_000_000, 480_000_000), rng.randint(80_000_000, 90_000_000)) for i in range(300)] + [(900, -330_000_000, 1_500_000_000), (901, 475_000_000, 85_000_000), (902, 475_000_000, 85_000_000)]
    qs = [(0, 47.5, 8.5), (1, 47.0, 8.0), (2, 60.0, 25.0), (3, -33.0, 151.0), (4, 0.0, 0.0), (5, 47.9, 8.9)]
    points, queries = spark.createDataFrame(pts, "id long, lat_e7 int, lon_e7 int"), spark.createDataFrame(qs, "query_id long, lat double, lon double")

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    for k in (1, 20):
        want = {q: [i for _, i in sorted((round(metres(y, x, a / 1e7, b / 1e7), 6), i) for i, a, b in pts)[:k]] for q, y, x in qs}
        got: dict = {}
        for r in spatial.nearest(queries, points, k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["id"])
        assert got == want
    assert spatial.nearest(queries, points.where("id < 0"), 3).count() == 0
    assert spatial.nearest(queries, points.where("id < 4"), 20).count() == 24


def test_reverse_without_points_or_areas(spark):
    rows, _ = made(4)
    queries = spark.createDataFrame([(1, 0.5, 0.5, 16), (2, 0.5, 0.5, 11), (3, 80.0, 80.0, 3)], "query_id long, lat double, lon double, zoom int")
    points = spark.createDataFrame([], "id long, lat_e7 int, lon_e7 int, country string, state string, city string, suburb string")
    got = {r["query_id"]: r for r in reverse.reverse_geocode(queries, points, areas(spark, rows)).collect()}
    assert got[1]["object_kind"] == "country" and got[1]["kind"] == "area"
    assert got[2]["city"] in ("box", *[n for _, lv, n, _ in rows if lv == 8]) and got[3]["kind"] is None


def test_levels(spark):
    cases = {"8": 8, "8;9": 8, "abc": 0, " 6": 6, "-1": 255, "260": 4, "": 0}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", geo.admin_level(F.col("v")))
    assert {r[0]: r[1] for r in rows.collect()} == cases
