"""German-aware normalisation, tokens, synonyms and edit distance, as native columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship

# --- Fixed values -----------------------------------------------------------------------
#: Letters that fold otherwise than to the base letter of their decomposition.
SPECIAL = {
    "æ": "ae", "ð": "d", "þ": "th", "ø": "o", "×": "", "÷": "", "đ": "d", "ħ": "h", "ı": "i", "ĳ": "ij",
    "ĸ": "k", "ŀ": "l", "ł": "l", "ŉ": "n", "ŋ": "n", "œ": "oe", "ŧ": "t", "ſ": "s",
}
DIN_UMLAUTS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
STRIP_UMLAUTS = {"ä": "a", "ö": "o", "ü": "u", "ß": "s"}
ABBREVIATIONS = {"str": "strasse", "strass": "strasse", "pl": "platz", "gass": "gasse", "g": "gasse", "hbf": "hauptbahnhof", "bhf": "bahnhof", "bf": "bahnhof", "rathaus": "rathaus", "kirche": "kirche"}
SUFFIXES = ("hauptbahnhof", "bahnhof", "bruecke", "strasse", "platz", "allee", "gasse", "steig", "damm", "berg", "ring", "ufer", "weg")
SHORT_SUFFIXES = {"str": "strasse", "pl": "platz"}
BIGRAMS = {
    "main station": "hauptbahnhof", "central station": "hauptbahnhof", "train station": "bahnhof", "city hall": "rathaus", "town hall": "rathaus",
    "market square": "markt", "market place": "markt", "high school": "gymnasium", "botanical garden": "botanischer garten", "old town": "altstadt",
    "new town": "neustadt", "lower saxony": "niedersachsen", "black forest": "schwarzwald", "lake constance": "bodensee",
}
UNIGRAMS = {
    "station": "bahnhof", "airport": "flughafen", "port": "hafen", "harbour": "hafen", "harbor": "hafen", "cathedral": "dom", "castle": "schloss", "palace": "schloss",
    "fortress": "burg", "church": "kirche", "chapel": "kapelle", "monastery": "kloster", "square": "platz", "plaza": "platz", "market": "markt", "hall": "halle",
    "street": "strasse", "road": "strasse", "avenue": "allee", "lane": "gasse", "way": "weg", "bridge": "bruecke", "lake": "see", "river": "fluss", "mountain": "berg",
    "hill": "berg", "forest": "wald", "garden": "garten", "university": "universitaet", "hospital": "krankenhaus", "school": "schule", "library": "bibliothek",
    "theatre": "theater", "theater": "theater", "stadium": "stadion",
}
EXONYMS = {
    "munich": "muenchen", "cologne": "koeln", "nuremberg": "nuernberg", "hanover": "hannover", "brunswick": "braunschweig", "bavaria": "bayern", "saxony": "sachsen",
    "hesse": "hessen", "thuringia": "thueringen", "westphalia": "westfalen", "franconia": "franken", "swabia": "schwaben", "palatinate": "pfalz", "rhineland": "rheinland",
    "rhine": "rhein", "danube": "donau", "moselle": "mosel", "bodensee": "bodensee",
}
# --- End of fixed values ----------------------------------------------------------------


def fold_table(umlauts: dict[str, str]) -> dict[str, str]:
    """What each letter of A-Z and U+00C0 to U+017F becomes, by Unicode's decomposition."""
    out = {chr(c): chr(c + 32) for c in range(65, 91)}
    for c in [chr(c) for c in range(0xC0, 0x180)]:
        low = c.lower() if len(c.lower()) == 1 else "i"
        base = unicodedata.normalize("NFD", low)[0]
        out[c] = umlauts.get(low, SPECIAL.get(low, base if base.isascii() else ""))
    return out


def _normalise(text: Column, umlauts: dict[str, str]) -> Column:
    table = fold_table(umlauts)
    folded = text
    for c, to in table.items():
        if len(to) > 1:
            folded = F.replace(folded, F.lit(c), F.lit(to))
    single = {c: to for c, to in table.items() if len(to) == 1}
    rest = F.regexp_replace(F.translate(folded, "".join(single), "".join(single.values())), r"[^\x00-\x7F]", "")
    # Plain ASCII, which has as many bytes as characters, needs no table of letters.
    ascii_only = lambda x: F.octet_length(x) == F.length(x)
    return F.when(ascii_only(text), F.lower(text)).when(ascii_only(folded), F.lower(folded)).otherwise(rest)


def normalize_din(text: Column) -> Column:
    """Lower case without diacritics, umlauts written out; other characters than ASCII go."""
    return _normalise(text, DIN_UMLAUTS)


def normalize_strip(text: Column) -> Column:
    """Lower case without diacritics, umlauts as their base letters; other characters than ASCII go."""
    return _normalise(text, STRIP_UMLAUTS)


def _lookup(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(key == k, v)
    return out.otherwise(otherwise)


def expand_abbreviation(token: Column) -> Column:
    """The token without one trailing full stop, written out if it is an abbreviation."""
    bare = F.regexp_replace(token, r"\.$", "")
    return _lookup(bare, ABBREVIATIONS, bare)


_PART = "\x01"
#: A suffix that ends a word after three characters and more: the first that does is the longest. Letters
#: that begin none are passed over before anything else is looked at.
_LONG = rf"(?=[{''.join(sorted({s[0] for s in SUFFIXES}))}])(?<=[a-z0-9]{{3}})(?:{'|'.join(SUFFIXES)})\b"


def _split(text: Column) -> Column:
    """Suffixes of the words in `text` set off by _PART; a word is split once."""
    text = F.regexp_replace(text, _LONG, f"{_PART}$0")
    for short, full in SHORT_SUFFIXES.items():
        text = F.regexp_replace(text, rf"{short}\b(?<=[a-z0-9]{{{4 + len(short)}}})(?!{_PART})", f"{_PART}{full}")
    return text


def split_suffix(token: Column) -> Column:
    """[token], or its stem and suffix."""
    return F.split(_split(token), _PART)


def tokenize(normalised: Column) -> Column:
    """Words of normalised text, abbreviations written out and suffixes set off."""
    # Each word has spaces of its own on both sides, so that neighbours are replaced alike.
    text = F.concat(F.lit(" "), F.regexp_replace(normalised, "[^a-z0-9]+", "  "), F.lit(" "))
    for short, full in ABBREVIATIONS.items():
        if short != full:
            text = F.replace(text, F.lit(f" {short} "), F.lit(f" {full} "))
    return F.array_remove(F.split(_split(text), f"[ {_PART}]+"), "")


def tokenize_din(text: Column) -> Column:
    return tokenize(normalize_din(text))


def tokenize_strip(text: Column) -> Column:
    return tokenize(normalize_strip(text))


def token_set(text: Column) -> Column:
    """Distinct tokens of both spellings."""
    return F.array_distinct(F.concat(tokenize_din(text), tokenize_strip(text)))


def tokens_of(text: str) -> list[str]:
    """tokenize_din for one Python string, for constants."""
    table = fold_table(DIN_UMLAUTS)
    out = []
    for w in re.findall("[a-z0-9]+", "".join(table.get(c, c if c.isascii() else "") for c in text)):
        w = ABBREVIATIONS.get(w, w)
        m = re.fullmatch(f"(.{{3,}}?)({'|'.join(SUFFIXES)})", w)
        s = None if m else re.fullmatch(f"(.{{4,}}?)({'|'.join(SHORT_SUFFIXES)})", w)
        out += [m[1], m[2]] if m else [s[1], SHORT_SUFFIXES[s[2]]] if s else [w]
    return out


def is_numeric(token: Column) -> Column:
    return token.rlike("^[0-9]+$")


def split_numeric(tokens: Column) -> tuple[Column, Column]:
    """(words, numbers)."""
    return F.filter(tokens, lambda t: ~is_numeric(t)), F.filter(tokens, is_numeric)


_ARROW = " → "


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _token_map(table: dict[str, str]) -> Column:
    """Replacements as tokens, space-joined."""
    return _map({k: " ".join(tokens_of(v)) for k, v in table.items()})


def apply_synonyms(tokens: Column) -> Column:
    """struct(tokens, changed, trace): bigrams from left to right, then single words.

    A bigram consumes both words; replacements are tokenised like any text.
    """
    single = {**EXONYMS, **UNIGRAMS}  # unigrams come first
    seed = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("trace"), F.lit(False).alias("skip"))

    def pair(s, i):
        key = F.concat_ws(" ", F.get(tokens, i), F.get(tokens, i + 1))
        hit = F.element_at(_token_map(BIGRAMS), key)
        note = F.concat(F.lit("'"), key, F.lit(f"'{_ARROW}'"), F.element_at(_map(BIGRAMS), key), F.lit("'"))
        return (
            F.when(s["skip"], F.struct(s["out"].alias("out"), s["trace"].alias("trace"), F.lit(False).alias("skip")))
            .when(hit.isNotNull() & (i + 1 < F.size(tokens)), F.struct(F.concat(s["out"], F.split(hit, " ")).alias("out"), F.concat(s["trace"], F.array(note)).alias("trace"), F.lit(True).alias("skip")))
            .otherwise(F.struct(F.concat(s["out"], F.array(F.get(tokens, i))).alias("out"), s["trace"].alias("trace"), F.lit(False).alias("skip")))
        )

    none = F.array().cast("array<int>")
    first = F.aggregate(F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(none), seed, pair)

    def finish(s):
        out = F.flatten(F.transform(s["out"], lambda t: F.split(F.coalesce(F.element_at(_token_map(single), t), t), " ")))
        notes = F.transform(F.filter(s["out"], lambda t: F.element_at(_map(single), t).isNotNull()), lambda t: F.concat(F.lit("'"), t, F.lit(f"'{_ARROW}'"), F.element_at(_map(single), t), F.lit("'")))
        return F.struct(out.alias("tokens"), (out != tokens).alias("changed"), F.array_join(F.concat(s["trace"], notes), ", ").alias("trace"))

    return F.transform(F.array(first), finish)[0]


def fuzzy_threshold(token: Column) -> Column:
    """How many edits a word may have: 1 up to four bytes, else 2."""
    return F.when(F.length(token) <= 4, 1).otherwise(2)


def _osa(a: str, b: str) -> int:
    before, last = None, list(range(len(b) + 1))
    for i in range(1, len(a) + 1):
        row = [i]
        for j in range(1, len(b) + 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (a[i - 1] != b[j - 1]))
            if before and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def osa_distance(a: Column, b: Column) -> Column:
    """Edits of the optimal string alignment: insert, delete, replace, swap neighbours.

    For pairs that a join has already narrowed down; an Arrow UDF.
    """

    ship()

    @F.pandas_udf("int")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _osa(p, q) for p, q in zip(x, y, strict=True)], dtype="Int32")

    return distance(a, b)


def deletions(word: Column, k: int) -> Column:
    """The word and all that is left of it after up to k deletions.

    Words within k edits of one another (swaps included) have one of these in common.
    """
    shorter = lambda w: F.transform(F.when(F.length(w) > 0, F.sequence(F.lit(1), F.length(w))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array(word)
    layer = out
    for _ in range(k):
        layer = F.array_distinct(F.flatten(F.transform(layer, shorter)))
        out = F.concat(out, layer)
    return F.array_distinct(out)
