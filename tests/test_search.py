from pyspark.sql import functions as F

from geoloom.operators import geojson, textsearch

COORDS = "array<struct<lat:int,lon:int>>"


def world(spark):
    p = [(1, 100, 100, "Stuttgart", None, None, None, None), (2, 10, 10, None, None, "Königstraße", "13", "Ulm"), (3, 11, 11, None, None, "Koenigstr.", "13", None), (4, 900, 900, None, None, "Königstraße", "13", None), (5, 5, 5, "Café \"Zur Post\"", "cafe", None, None, None), (6, 1, 1, "Hauptbahnhof", None, None, None, None)]
    points = spark.createDataFrame([(i, y, x, n, t, s, h, None, None, None, c, None) for i, y, x, n, t, s, h, c in p], "id long, lat_e7 int, lon_e7 int, name string, type string, street string, housenumber string, postcode string, country string, state string, city string, suburb string")
    lines = spark.createDataFrame([(1, "Königstraße", "residential", None, [(0, 0), (20, 20)], 0, 20, 0, 20), (2, "Stuttgart", None, None, [(0, 0)], 0, 0, 0, 0)], f"id long, name string, type string, ref string, coords {COORDS}, min_lat int, max_lat int, min_lon int, max_lon int")
    ring = [(0, 0), (0, 9), (9, 9), (0, 0)]
    admins = spark.createDataFrame([(1, 8, "Stuttgart", ring), (2, 4, "Düsseldorf", ring)], f"id long, admin_level short, name string, ring {COORDS}")
    return points, lines, admins


def ask(spark, *qs, limit=10):
    out: dict = {q: [] for q in qs}
    rows = textsearch.search(spark.createDataFrame(list(enumerate(qs)), "query_id long, q string"), *world(spark), limit=limit).orderBy("query_id", "rank")
    for r in rows.collect():
        out[qs[r["query_id"]]].append((r["kind"], r["id"], round(r["score"], 3), r["reason"]))
    return out


def test_scores(spark):
    got = ask(spark, "stuttgart", "Dusseldorf", "12", "", "Aalen Stuttgart")
    assert [x[:3] for x in got["stuttgart"]] == [(textsearch.STREET, 2, 81.154), (textsearch.POI, 1, 80.0), (textsearch.ADMIN, 1, 78.846)]
    assert got["Dusseldorf"] == [(textsearch.ADMIN, 2, 18.846, "match 0/1")] or got["Dusseldorf"][0][2] < 30
    assert got["12"] == got[""] == got["Aalen Stuttgart"] == []


def test_paths(spark):
    got = ask(spark, "main station", "Stuttgrat", "Königstraße 13", "koenigstr 99")
    assert got["main station"][0][:2] == (textsearch.POI, 6) and "via 'main station' → 'hauptbahnhof'" in got["main station"][0][3]
    assert "fuzzy: 'stuttgrat' → 'stuttgart'" in got["Stuttgrat"][0][3] and len(got["Stuttgrat"]) == 3
    assert got["Königstraße 13"][0][:2] == (textsearch.POI, 2) and got["Königstraße 13"][0][3] == "street match + housenumber 13"
    assert got["koenigstr 99"][0][:2] == (textsearch.STREET, 1)
    assert len(ask(spark, "stuttgart", limit=1)["stuttgart"]) == 1


def test_features_are_json(spark):
    import json

    points, lines, admins = world(spark)
    results = textsearch.search(spark.createDataFrame([(0, "cafe"), (1, "stuttgart")], "query_id long, q string"), points, lines, admins)
    features = geojson.search(results, points, lines, admins)
    whole = json.loads(geojson.collection(features, "query_id", "rank").first()[0])
    assert len(whole["features"]) == results.count() and {f["geometry"]["type"] for f in whole["features"]} == {"Point", "LineString", "Polygon"}
    assert "Café \"Zur Post\"" in {f["properties"].get("name") for f in whole["features"]} | {json.loads(r[0])["properties"].get("name") for r in geojson.points(points).select("feature").collect()}
    for df in (geojson.points(points), geojson.lines(lines), geojson.admins(admins)):
        assert all(json.loads(r["feature"])["type"] == "Feature" for r in df.where(F.col("feature").isNotNull()).collect())
