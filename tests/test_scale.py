"""Plans whose work must not grow with what equal rows repeat, nor wait for one task."""

import json
import os

import pytest
from pyspark.sql import functions as F

from geoloom.functions import geo
from geoloom.operators import geojson, textsearch
from geoloom.plans import catalogue
from geoloom.session import cut

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@needs_data
def test_distances_are_dealt_evenly(spark):
    sizes = catalogue.haversine(spark, DATA).rdd.glom().map(len).collect()
    assert len(sizes) >= 4 and max(sizes) < sum(sizes) / 2


def test_distances_of_prepared_places(spark):
    rows = spark.createDataFrame([(48.1, 9.2, 47.3, 10.9), (48.1, 9.2, 48.1, 9.2), (0.0, 0.0, 0.0, 180.0), (-89.9, -179.9, 89.9, 179.9)], "a double, b double, p double, q double")
    p1, p2 = F.radians("a"), F.radians("p")
    plain = 2 * geo.RADIUS * F.asin(F.sqrt(F.least(F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(F.col("q") - F.col("b")) / 2), 2), F.lit(1.0))))
    got = rows.select(geo.haversine(*map(F.col, "abpq")).alias("x"), plain.alias("y")).collect()
    assert all(r.x == r.y for r in got) and got[1].x == 0
    values = [0.0, 0.0004, 0.0005, 1234.5675, 999.9995, 20015086.7962]
    rounded = spark.createDataFrame([(v,) for v in values], "v double").select(geo.millimetres(F.col("v"))).collect()
    assert [r[0] for r in rounded] == [0.0, 0.0, 0.001, 1234.568, 1000.0, 20015086.796]


def _named(spark, rows, schema, **more):
    return spark.createDataFrame(rows, schema).select("*", *[F.lit(v).cast(t).alias(k) for k, (v, t) in more.items()])


def crowd(spark, n_points=60, n_lines=40):
    """Points of one name (ids repeat, one id has a second name), streets of one name with houses, an area."""
    text, none = (None, "string"), (0, "int")
    rows = [(i % 50 + 1, "Rote Schraube", None, None) for i in range(n_points)] + [(1, "Rote Schraube alt", None, None)] + [(1000 + i, None, "Königstraße", str(i % 7)) for i in range(70)]
    points = _named(spark, rows, "id long, name string, street string, housenumber string", type=text, postcode=text, country=text, state=text, city=text, suburb=text, lat_e7=none, lon_e7=none)
    lines = spark.createDataFrame([(100 + i, "Königstraße", [(0, 0), (i, i)]) for i in range(n_lines)], "id long, name string, coords array<struct<lat:int,lon:int>>")
    lines = lines.select("*", F.lit(None).cast("string").alias("type"), *[F.lit(v).alias(c) for c, v in (("min_lat", -1), ("max_lat", 1), ("min_lon", -1), ("max_lon", 1))])
    admins = spark.createDataFrame([(7, 4, "Schraube", [(0, 0), (0, 9), (9, 9), (0, 0)])], "id long, admin_level short, name string, ring array<struct<lat:int,lon:int>>")
    return points, lines, admins


def asked(spark, text, n=30, first=0):
    return spark.createDataFrame([(first + i, text) for i in range(n)], "query_id long, q string")


@pytest.fixture
def kept(monkeypatch):
    """Numbers of rows of the tables that a search keeps."""
    counts = []

    def keep(df):
        out = cut(df)
        counts.append(out.count())
        return out

    monkeypatch.setattr(textsearch, "cut", keep)
    return counts


def test_equal_texts_and_objects_are_ranked_once(spark):
    points, lines, admins = crowd(spark)
    objs = textsearch.counted(points, lines, admins)
    queries = textsearch.prepare(asked(spark, "Königstr. 5"))
    got = textsearch.rank(queries, objs).collect()
    assert sorted((r["text"], r["k"], r["kind"], r["n"]) for r in got) == [("koenig strasse", k, textsearch.STREET, 40) for k in range(3)]
    assert {r["n"] for r in objs.where("kind = 0").collect()} == {60, 1}  # repeated rows of an id count


def test_search_keeps_no_rows_that_cannot_be_returned(spark, kept):
    got = textsearch.search(asked(spark, "koenigstrasse"), *crowd(spark), limit=3).collect()
    assert max(kept) <= 30 * 3
    assert len(got) == 90 and {(r["rank"], r["kind"], r["id"]) for r in got} == {(1, 1, 100), (2, 1, 101), (3, 1, 102)}


def test_first_objects_of_groups_are_whole(spark):
    for limit in (1, 2, 3, 51, 60):
        got = textsearch.search(asked(spark, "Schraube", 1).unionByName(asked(spark, "rote schraube", 1, 1)), *crowd(spark), limit=limit).orderBy("query_id", "rank").collect()
        found = [[(r["kind"], r["id"]) for r in got if r["query_id"] == q] for q in (0, 1)]
        assert found[0] == ([(2, 7)] + [(0, i) for i in range(1, 51)])[:limit] and found[1] == [(0, i) for i in range(1, 51)][:limit]
        assert {r["reason"] for r in got if r["query_id"] == 1} == {"match 2/2, exact"}


def test_two_texts_of_one_query(spark):
    queries = asked(spark, "Schraube", 1).unionByName(asked(spark, "koenigstrasse", 1))
    got = textsearch.search(queries, *crowd(spark), limit=4).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4] and len({(r["kind"], r["id"]) for r in got}) == 4


def test_equal_wants_find_their_house_once(spark):
    points, lines, admins = crowd(spark)
    queries = cut(asked(spark, "Königstr. 5").unionByName(asked(spark, "Königstr. 6", 5, 100)))
    ranked = cut(textsearch.search(queries.withColumn("q", F.lit("Königstr.")), points, lines, admins, limit=2))
    numbered, want = textsearch.wanted(ranked, textsearch.asking(queries))
    assert numbered.count() == 35 and sorted(map(tuple, want.collect())) == [("5", "koenig strasse", 100), ("6", "koenig strasse", 100)]
    got = textsearch.search(queries, points, lines, admins, limit=2).where("rank = 1").collect()
    assert {(r["query_id"], r["kind"], r["id"]) for r in got} == {(q, 0, 1005) for q in range(30)} | {(100 + q, 0, 1006) for q in range(5)}


def test_equal_texts_are_translated_once(spark, kept):
    queries = textsearch.asking(asked(spark, "king street"))
    kept.clear()
    got = textsearch._translated(queries).collect()
    assert kept == [1] and {(r["query_id"], r["path"], tuple(r["words"]), r["note"]) for r in got} == {(q, 1, ("king", "strasse"), "via 'street' → 'strasse'") for q in range(30)}


def test_an_object_is_drawn_once_for_all_queries(spark):
    points, lines, admins = crowd(spark)
    results = cut(textsearch.search(asked(spark, "koenigstrasse"), points, lines, admins, limit=2))
    assert sorted(r["id"] for r in geojson.drawn(results, textsearch.STREET, lines, F.lit("{")).collect()) == [100, 101]
    got = geojson.search(results, points, lines, admins).collect()
    assert len(got) == results.count() == 60 and len({r["feature"] for r in got}) == 2
    shown = json.loads(got[0]["feature"])
    assert shown["geometry"]["type"] == "LineString" and list(shown["properties"]) == ["kind", "id", "name", "score", "matched", "reason"]


def test_equal_typos_are_corrected_once(spark, kept):
    got = textsearch.search(asked(spark, "koenigstrase"), *crowd(spark), limit=2).collect()
    assert {(r["query_id"], r["rank"], r["id"]) for r in got} == {(q, k, 99 + k) for q in range(30) for k in (1, 2)}
    assert all("fuzzy: " in r["reason"] for r in got) and max(kept) <= 30 * 2
