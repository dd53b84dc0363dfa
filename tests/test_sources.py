import datetime
import json
import random
import struct
import time
import zlib

import pytest

from geoloom.operators import osm
from geoloom.plans import api, reports
from geoloom.sources import binary, pbf, tables
from geoloom.streaming import enrich


def number(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def zig(n):
    return number(n << 1 if n >= 0 else (-n << 1) - 1)


def field(n, value):
    return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value


def deltas(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values, strict=False))


def make_pbf(path, nodes, ways, relations, raw=False):
    """A file of one block for each kind of entity, dense nodes included."""
    strings = [""]

    def s(text):
        if text not in strings:
            strings.append(text)
        return strings.index(text)

    pack = lambda values: b"".join(map(number, values))
    groups = []
    flat = b"".join(b"".join(number(s(k)) + number(s(v)) for k, v in tags) + b"\0" for *_, tags in nodes[1:])
    dense = field(1, deltas([n[0] for n in nodes[1:]])) + field(8, deltas([n[1] for n in nodes[1:]])) + field(9, deltas([n[2] for n in nodes[1:]])) + field(10, flat)
    i, y, x, tags = nodes[0]
    one = number(8) + zig(i) + field(2, pack([s(k) for k, _ in tags])) + field(3, pack([s(v) for _, v in tags])) + number(64) + zig(y) + number(72) + zig(x)
    groups.append(field(1, one) + field(2, dense))
    groups.append(b"".join(field(3, field(1, i) + field(2, pack([s(k) for k, _ in t])) + field(3, pack([s(v) for _, v in t])) + field(8, deltas(refs))) for i, refs, t in ways))
    groups.append(b"".join(field(4, field(1, i) + field(2, pack([s(k) for k, _ in t])) + field(3, pack([s(v) for _, v in t])) + field(8, pack([s(r) for *_, r in m])) + field(9, deltas([r for _, r, _ in m])) + field(10, pack(["nwr".index(k) for k, *_ in m]))) for i, m, t in relations))
    with open(path, "wb") as f:
        for kind, body in [("OSMHeader", b""), *[("OSMData", field(1, b"".join(field(1, x.encode()) for x in strings)) + field(2, g)) for g in groups]]:
            blob = field(1, body) if raw else field(2, len(body)) + field(3, zlib.compress(body))
            header = field(1, kind.encode()) + field(3, len(blob))
            f.write(struct.pack(">I", len(header)) + header + blob)


NODES = [(7, 0, 0, [("name", "Café"), ("amenity", "cafe"), ("leisure", "park"), ("x", "y")]), (1, 0, 0, []), (2, 0, 1_000_000, []), (3, 1_000_000, 1_000_000, []), (-4, 1_000_000, 0, [("name", "n"), ("building", "yes"), ("addr:city", "")])]
WAYS = [(10, [1, 2], []), (11, [3, 2], []), (12, [3, -4, 1], []), (20, [1, 2, 3, -4, 1], [("building", "house"), ("name", "B")]), (21, [1, 99, 3], [("highway", "primary"), ("leisure", "track"), ("ref", "B1")]), (22, [1], [("waterway", "river")]), (23, [1, 2], [("natural", "wood")]), (24, [98], [("highway", "x")])]
RELATIONS = [(5, [("w", 10, "outer"), ("n", 1, "label"), ("w", 12, ""), ("w", 11, "outer"), ("w", 20, "inner"), ("w", 77, "outer")], [("type", "boundary"), ("admin_level", "8;9"), ("name", "Town")]), (6, [("w", 10, "outer")], [("type", "route"), ("admin_level", "2")]), (8, [("w", 10, "outer")], [("type", "boundary"), ("admin_level", "abc")])]


@pytest.mark.parametrize("raw", [False, True])
def test_parse_a_file(spark, tmp_path, raw):
    path = f"{tmp_path}/tiny.osm.pbf"
    make_pbf(path, NODES, WAYS, RELATIONS, raw)
    nodes, ways, relations = pbf.read(spark, path)
    assert {(r["id"], tuple(map(tuple, r["tags"]))) for r in nodes.collect()} == {(i, tuple(t)) for i, _, _, t in NODES}
    assert {r["id"]: (r["lat_e7"], r["lon_e7"]) for r in nodes.collect()}[3] == (1_000_000, 1_000_000)
    assert {(r["id"], tuple(r["refs"])) for r in ways.collect()} == {(i, tuple(x)) for i, x, _ in WAYS}
    assert [tuple(map(tuple, r["members"])) for r in relations.orderBy("id").collect()] == [tuple(m) for _, m, _ in RELATIONS]
    points, lines, admins = osm.parse(nodes, ways, relations)
    got = {(r["osm_type"], r["id"]): r for r in points.collect()}
    assert set(got) == {("n", 7), ("n", -4), ("w", 20), ("w", 21), ("w", 23)}
    assert got["n", 7]["type"] == "park" and [tuple(t) for t in got["n", 7]["extra_tags"]] == [("x", "y")] and got["n", -4]["city"] is None
    assert (got["w", 20]["lat_e7"], got["w", 20]["lon_e7"]) == (400_000, 400_000) and got["w", 23]["type"] is None
    line = {r["id"]: r for r in lines.collect()}
    assert set(line) == {21, 22} and line[21]["ref"] == "B1" and len(line[21]["coords"]) == 2 and line[22]["type"] is None
    area = {r["id"]: r for r in admins.collect()}
    assert set(area) == {5, 8} and area[5]["admin_level"] == 8 and area[8]["admin_level"] == 0
    assert [tuple(c) for c in area[5]["ring"]] == [(0, 0), (0, 1_000_000), (1_000_000, 1_000_000), (1_000_000, 0), (0, 0)]
    assert osm.open_rings(admins).first()[0] == 1
    with open(path, "rb") as f:
        whole = f.read()
    with open(f"{tmp_path}/cut.pbf", "wb") as f:
        f.write(whole[:-5])
    with pytest.raises(pbf.PbfError):
        pbf.blocks(f"{tmp_path}/cut.pbf")


def test_stitch():
    a, b, c, d = (0, 0), (0, 1), (1, 1), (1, 0)
    assert osm._stitch([]) == [] and osm._stitch([[], [a, b]]) == [a, b]
    assert osm._stitch([[a, b], [d, c], [b, c], [d, a]]) == [a, b, c, d, a]
    assert osm._stitch([[a, b], [(5, 5), (6, 6)], [(6, 6), (7, 7)]]) == [(5, 5), (6, 6), (7, 7)]
    assert osm._stitch([[a, b], [b, a, c]]) == [a, b, a, c]


def greedy(segments):
    """The contract of stitching, step by step."""
    segments, best = [s for s in segments if s], []
    for seed in range(len(segments)):
        ring, left = list(segments[seed]), [s for i, s in enumerate(segments) if i != seed]
        while len(segments) > 1 and (fit := next((i for i, s in enumerate(left) if ring[-1] in (s[0], s[-1])), None)) is not None:
            s = left.pop(fit)
            ring += (s if s[0] == ring[-1] else s[::-1])[1:]
        best = ring if len(ring) > len(best) else best
    return best


def test_stitch_follows_the_contract():
    rng = random.Random(3)
    for n in range(400):
        at = [(0, i) for i in range(rng.randint(2, 9))]
        segments = [[rng.choice(at), *[(1, rng.randint(0, 99)) for _ in range(rng.randint(0, 3))], rng.choice(at)][: rng.randint(0, 5)] for _ in range(n % 12)]
        assert osm._stitch(segments) == greedy(segments)
    ring = [(i, i * i % 997) for i in range(5_000)]
    parts = [[ring[i], ring[(i + 1) % 5_000]][:: rng.choice((1, -1))] for i in range(5_000)]
    rng.shuffle(parts)
    began = time.perf_counter()
    assert len(osm._stitch(parts)) == 5_001 and time.perf_counter() - began < 1


def test_folders_load_binary_or_json(spark, tmp_path):
    path = f"{tmp_path}/tiny.osm.pbf"
    make_pbf(path, NODES, WAYS, RELATIONS)
    points, lines, admins = osm.parse(*pbf.read(spark, path))
    (tmp_path / "set").mkdir()
    binary.write(points, f"{tmp_path}/set/points.bin", "points")
    tables.lines_json(lines).write.text(f"{tmp_path}/set/lines.json")
    tables.admins_json(admins).write.text(f"{tmp_path}/set/admins.json")
    assert [binary.load(spark, f"{tmp_path}/set", k).count() for k in ("points", "lines", "admins")] == [points.count(), lines.count(), admins.count()]


def test_dataset_from_parse_to_answers(spark, tmp_path):
    path, root = f"{tmp_path}/tiny.osm.pbf", f"{tmp_path}/sets"
    make_pbf(path, NODES, WAYS, RELATIONS)
    result = api.parse(spark, path, root)
    assert result["dataset"] == "tiny" and result["stats"]["points"] == 5 and result["stats"]["admins"] == 2 and result["stats"]["open_rings"] == 1
    name, text = api.report(result, datetime.datetime(2024, 5, 6, 7, 8, 9))
    assert name == "tiny_2024-05-06_070809.md" and "| points | 5 |" in text
    assert tables.list_datasets(spark, root) == ["tiny"] and tables.list_datasets(spark, f"{tmp_path}/none") == []
    assert tables.select_datasets(spark, root, "all") == ["tiny"] and tables.select_datasets(spark, root, "a,,b") == ["a", "b"]
    assert api.dataset_info(spark, root, "tiny,tiny") == {"dataset": "tiny,tiny", "points": 10, "lines": 4, "admins": 4}
    points, lines, admins = (tables.read_dataset(spark, root, "tiny", k) for k in tables.KINDS)
    assert {r["city"] for r in points.where("osm_type = 'w' and id = 20").collect()} == {"Town"}
    assert api.points_in_bbox(points, (-1, -1, 1, 1), 2).count() == 2 and api.points_in_bbox(points, limit=0).count() == 0
    assert api.lines_in_bbox(lines).count() == 2 and api.admins_in_bbox(admins, (50, 50, 60, 60)).count() == 0
    queries = spark.createDataFrame([(1, 0.05, 0.05, 16), (2, 0.05, 0.05, 11)], "query_id long, lat double, lon double, zoom int")
    got = {r["query_id"]: json.loads(r["feature"])["properties"] for r in api.reverse_geocode(queries, points, admins).collect()}
    assert got[1]["object_kind"] == "house" and got[1]["city"] == "Town" and got[2] == {"object_kind": "city", "id": 5, "admin_level": 8, "name": "Town", "country": "", "state": "", "city": "Town", "suburb": ""}
    found = api.search(spark.createDataFrame([(0, "town")], "query_id long, q string"), points, lines, admins).collect()
    assert json.loads(found[0]["feature"])["properties"]["kind"] == "admin"
    answer = json.loads(api.search_response(spark.createDataFrame([(0, "town"), (1, "nothing")], "query_id long, q string"), points, lines, admins)[0])
    assert answer["returned"] == len(answer["features"]) > 0 and answer["query_ms"] > 0
    for part in ("## 2. Hierarchy", "## 3. Points in areas", "T2 city in state: queries", "share of points with any", "First addresses", "| country |"):
        assert part in text, part
    assert "LAYERS" in reports.console(result) and "T3 misses" in reports.console(result)
    plain = api.parse(spark, path, f"{tmp_path}/plain", with_admin=False)
    assert "measures" not in plain and tables.read_dataset(spark, f"{tmp_path}/plain", "tiny", "points").where("city = 'Town'").count() == 0


def test_json_and_binary_round_trips(spark, tmp_path):
    path = f"{tmp_path}/tiny.osm.pbf"
    make_pbf(path, NODES, WAYS, RELATIONS)
    sets = dict(zip(("points", "lines", "admins"), osm.parse(*pbf.read(spark, path)), strict=True))
    writers = {"points": (tables.points_json, tables.read_points_json), "lines": (tables.lines_json, tables.read_lines_json), "admins": (tables.admins_json, tables.read_admins_json)}
    for kind, df in sets.items():
        columns = [c for c in df.columns if c != "osm_type"]
        want = sorted(df.select(*columns).collect(), key=str)
        put, get = writers[kind]
        put(df).write.text(f"{tmp_path}/{kind}.json")
        assert sorted(get(spark, f"{tmp_path}/{kind}.json").select(*columns).collect(), key=str) == want
        binary.write(df, f"{tmp_path}/{kind}.bin", kind)
        plain = [c for c in columns if c != "extra_tags"]
        assert sorted(binary.read(spark, f"{tmp_path}/{kind}.bin", kind).select(*plain).collect(), key=str) == sorted(df.select(*plain).collect(), key=str)
        with open(f"{tmp_path}/{kind}.bin", "rb") as f:
            whole = f.read()
        for bad in (whole[:-1], whole[:10], b"\0" * 40):
            with pytest.raises(binary.BinaryError):
                binary.decode(kind, bad)


def test_parameters():
    assert api.parse_bbox("1,2,3,4") == (1, 2, 3, 4) and api.parse_bbox("1,2") == (1, 2, 180, 90) and api.parse_bbox("x,2,3,4") == api.WORLD and api.parse_bbox(None) == api.WORLD
    assert tables.dataset_name("/a/b/city-1.osm.pbf") == "city-1" and tables.dataset_name("c.pbf") == "c"
    assert (api.duration(0.0123), api.duration(2.5), api.duration(85), api.size(10), api.size(2048)) == ("12.3 ms", "2.50 s", "1m 25s", "10 B", "2.00 KB")


def test_streams(spark, tmp_path):
    from geoloom.operators import spatial

    ring = [(0, 0), (0, 1_000_000), (1_000_000, 1_000_000), (1_000_000, 0), (0, 0)]
    areas = spark.createDataFrame([(1, 8, "Town", ring)], "id long, admin_level short, name string, ring array<struct<lat:int,lon:int>>")
    nodes = spatial.hierarchy(spatial.polygons(areas))
    at = datetime.datetime(2024, 1, 1, 12)
    rows = spark.createDataFrame([(i, 500_000 if i % 2 else 5_000_000, 500_000, None, None, None, None, at + datetime.timedelta(minutes=i)) for i in range(20)], "id long, lat_e7 int, lon_e7 int, country string, state string, city string, suburb string, ts timestamp")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    enrich.start(enrich.attach_admin(stream, nodes).select("id", "city"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [(i, "Town" if i % 2 else None) for i in range(20)]
    enrich.start(enrich.counts_by_area(stream, nodes), f"{tmp_path}/counts", f"{tmp_path}/cp2").awaitTermination()
    counted = spark.read.parquet(f"{tmp_path}/counts").collect()
    assert all(r["node_id"] == 1 for r in counted) and sum(r["n"] for r in counted) <= 10
