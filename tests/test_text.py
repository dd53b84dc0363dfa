import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions import text

DIN = {
    "Düsseldorf": "duesseldorf", "DUSSELDORF": "dusseldorf", "düsseldorf": "duesseldorf", "Duesseldorf": "duesseldorf", "München": "muenchen", "Würzburg": "wuerzburg", "Köln": "koeln",
    "Straße": "strasse", "Aßlar": "asslar", "Zürich": "zuerich", "Genève": "geneve", "Español": "espanol", "Poznań": "poznan", "Košice": "kosice", "Aalen": "aalen", "Hauptstrasse": "hauptstrasse",
    "Hauptstraße 10": "hauptstrasse 10", "a–b": "ab", "a b": "ab", "ü": "u", "×": "", "Œuvre": "oeuvre", "Þór": "thor", "ẞ": "", "\u212a": "", "İ": "i",
}
STRIP = {"Düsseldorf": "dusseldorf", "München": "munchen", "Straße": "strase", "Aßlar": "aslar"}
TOKENS = {
    "Bahnhofstraße": "bahnhof strasse", "Marienplatz": "marien platz", "Königsallee": "koenigs allee", "Str. der Republik": "strasse der republik", "Marienpl.": "marien platz",
    "Stuttgart Hbf.": "stuttgart haupt bahnhof", "Aalen, Hauptstraße 10": "aalen haupt strasse 10", "Am Neckartor 12": "am neckartor 12", "  Nürnberger  Str.  ": "nuernberger strasse",
    "Bahnhof-Str.": "bahnhof strasse", ".": "", "St.Pauli": "st pauli", "weg": "weg", "Heidelberg": "heidel berg", "hauptstr": "haupt strasse", "abcstr": "abcstr", "nuremberg": "nurem berg", "hauptstrstrasse": "hauptstr strasse",
}


def column(spark, values, *columns):
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", *columns)
    return {r[0]: r[1] for r in rows.collect()}


def test_normalisation(spark):
    assert column(spark, DIN, text.normalize_din(F.col("v"))) == DIN
    assert column(spark, STRIP, text.normalize_strip(F.col("v"))) == STRIP
    assert column(spark, [None], text.normalize_din(F.col("v"))) == {None: None}


def test_tokens(spark):
    assert column(spark, TOKENS, F.array_join(text.tokenize_din(F.col("v")), " ")) == TOKENS
    assert {k: " ".join(text.tokens_of(k)) for k in TOKENS} == TOKENS
    assert column(spark, ["Hauptstraße"], F.array_join(text.tokenize_strip(F.col("v")), " ")) == {"Hauptstraße": "hauptstrase"}


def test_synonyms(spark):
    cases = {
        "munich main station": ("muenchen haupt bahnhof", True), "main train station": ("main bahnhof", True), "botanical garden": ("botanischer garten", True), "bodensee": ("bodensee", False),
        "": ("", False), "main": ("main", False), "main station station": ("haupt bahnhof bahnhof", True), "lake constance": ("bodensee", True),
    }
    s = text.apply_synonyms(F.filter(F.split("v", " "), lambda t: t != ""))
    assert column(spark, cases, F.struct(F.array_join(s["tokens"], " "), s["changed"])) == cases


def test_distance(spark):
    cases = {("ca", "abc"): 3, ("ab", "ba"): 1, ("", "abc"): 3, ("abc", "abc"): 0, ("kitten", "sitting"): 3}
    rows = spark.createDataFrame(list(cases), "a string, b string").withColumn("d", text.osa_distance(F.col("a"), F.col("b")))
    assert {(r["a"], r["b"]): r["d"] for r in rows.collect()} == cases


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_words_within_two_edits_share_a_deletion(a, b):
    def left(w, k):
        return {"".join(c for i, c in enumerate(w) if i not in gone) for n in range(k + 1) for gone in itertools.combinations(range(len(w)), min(n, len(w)))}

    d = text._osa(a, b)
    assert d == text._osa(b, a)
    for k in (1, 2):
        if d <= k:
            assert left(a, k) & left(b, k)


@pytest.mark.parametrize("k", [0, 1, 2])
def test_deletions(spark, k):
    got = set(column(spark, ["abcd"], text.deletions(F.col("v"), k))["abcd"])
    assert got == {"".join(c) for n in range(k + 1) for c in itertools.combinations("abcd", 4 - n)}
