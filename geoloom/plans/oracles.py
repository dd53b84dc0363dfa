"""The DuckDB equivalents of the catalogue's queries."""

from __future__ import annotations

from ..functions import geo, text
from ..operators import textsearch as S
from . import catalogue as C
from . import fixtures as X


def _fold(x: str, umlauts: dict[str, str]) -> str:
    table = text.fold_table(umlauts)
    for c, to in table.items():
        if len(to) > 1:
            x = f"replace({x}, '{c}', '{to}')"
    one = {c: to for c, to in table.items() if len(to) == 1}
    return f"regexp_replace(translate({x}, '{''.join(one)}', '{''.join(one.values())}'), '[^\\x00-\\x7F]', '', 'g')"


def din(x: str) -> str:
    return _fold(x, text.DIN_UMLAUTS)


def strip(x: str) -> str:
    return _fold(x, text.STRIP_UMLAUTS)


def _expand(w: str) -> str:
    return f"CASE {w} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.ABBREVIATIONS.items()) + f" ELSE {w} END"


def _parts(w: str) -> str:
    long = "|".join(text.SUFFIXES)
    out = f"CASE WHEN regexp_full_match({w}, '.{{3,}}?({long})') THEN regexp_replace({w}, '^(.{{3,}}?)({long})$', '\\1 \\2')"
    for k, v in text.SHORT_SUFFIXES.items():
        out += f" WHEN regexp_full_match({w}, '.{{4,}}{k}') THEN regexp_replace({w}, '{k}$', ' {v}')"
    return out + f" ELSE {w} END"


def tokens(norm: str) -> str:
    words = f"list_transform(regexp_extract_all({norm}, '[a-z0-9]+'), lambda w: {_expand('w')})"
    return f"list_filter(string_split(array_to_string(list_transform({words}, lambda w: {_parts('w')}), ' '), ' '), lambda t: t <> '')"


def lat(k: str) -> str:
    return f"CAST(470000000 + (CAST({k} AS BIGINT) * 7919131) % 80000000 AS INT)"


def lon(k: str) -> str:
    return f"CAST(60000000 + (CAST({k} AS BIGINT) * 10472903) % 90000000 AS INT)"


def street(i: str) -> str:
    lists = [f"[{', '.join(repr(x) for x in v)}]" for v in (X.STEMS, X.ENDS)]
    return f"{lists[0]}[CAST({i} % 5 AS INT) + 1] || {lists[1]}[CAST(({i} // 5) % 5 AS INT) + 1]"


POINTS = f"""points AS (
    SELECT k * 2 + odd AS id, CASE odd WHEN 0 THEN 'n' ELSE 'w' END AS osm_type, {lat("k")} AS lat_e7, {lon("k")} AS lon_e7, CASE WHEN k % 3 = 0 THEN p_name END AS name,
           CASE WHEN k % 2 = 0 THEN t END AS type, CASE WHEN k % 4 = 0 THEN {street("(k % 25)")} END AS street, CASE WHEN k % 4 = 0 THEN CAST(k % 50 + 1 AS VARCHAR) END AS housenumber,
           CAST(NULL AS VARCHAR) AS postcode, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS state, CASE WHEN k % 10 = 0 THEN 'Addr City' END AS city, CASE WHEN k % 7 = 0 THEN 'Addr Suburb' END AS suburb
    FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, 0 AS odd, o_orderpriority AS t FROM orders UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer)
    LEFT JOIN part ON p_partkey = k % (SELECT count(*) FROM part))"""
LINES = f"""lines AS (
    SELECT *, list_min(list_transform(coords, lambda c: c.lat)) AS min_lat, list_max(list_transform(coords, lambda c: c.lat)) AS max_lat,
           list_min(list_transform(coords, lambda c: c.lon)) AS min_lon, list_max(list_transform(coords, lambda c: c.lon)) AS max_lon
    FROM (SELECT CAST(s_suppkey AS BIGINT) AS id, {street("(s_suppkey % 25)")} AS name, 'residential' AS type, CAST(NULL AS VARCHAR) AS ref,
                 [{{'lat': y, 'lon': x}}, {{'lat': y + {X.STREET_LAT // 2}, 'lon': x + {X.STREET_LON}}}, {{'lat': y + {X.STREET_LAT}, 'lon': x}}] AS coords
          FROM (SELECT s_suppkey, {lat("s_suppkey")} AS y, {lon("s_suppkey")} AS x FROM supplier)))"""


def _box(a: str, b: str, c: str, d: str) -> str:
    return f"[{{'lat': {a}, 'lon': {c}}}, {{'lat': {a}, 'lon': {d}}}, {{'lat': {b}, 'lon': {d}}}, {{'lat': {b}, 'lon': {c}}}, {{'lat': {a}, 'lon': {c}}}]"


_R = f"CASE WHEN s_suppkey % 10 = 0 THEN {4 * X.RADIUS} ELSE {X.RADIUS} END"
ADMINS = f"""admins AS (
    SELECT 1000000::BIGINT AS id, 2 AS admin_level, 'Country' AS name, {_box("470000000", "550000000", "60000000", "150000000")} AS ring
    UNION ALL SELECT r_regionkey + 2000000, 4, r_name, {_box("470000000", "550000000", "60000000 + 18000000 * r_regionkey", "78000000 + 18000000 * r_regionkey")} FROM region
    UNION ALL SELECT n_nationkey + 3000000, 8, n_name, {_box("470000000 + (n_nationkey // 5) * 16000000", "486000000 + (n_nationkey // 5) * 16000000", "60000000 + 18000000 * n_regionkey", "78000000 + 18000000 * n_regionkey")} FROM nation
    UNION ALL SELECT s_suppkey + 4000000, 9 + s_suppkey % 3, s_name, [{{'lat': y, 'lon': x + {_R}}}, {{'lat': y + {_R}, 'lon': x}}, {{'lat': y, 'lon': x - {_R}}}, {{'lat': y - {_R}, 'lon': x}}, {{'lat': y, 'lon': x + {_R}}}]
              FROM (SELECT *, {lat("(s_suppkey + 500000)")} AS y, {lon("(s_suppkey + 500000)")} AS x FROM supplier))"""
POLYS = """edges AS (SELECT id, i, ring[i].lat::BIGINT AS plat, ring[i].lon::BIGINT AS plon, ring[i % len(ring) + 1].lat::BIGINT AS qlat, ring[i % len(ring) + 1].lon::BIGINT AS qlon FROM (SELECT id, ring, unnest(range(1, len(ring) + 1)) AS i FROM admins)),
areas AS (SELECT id, CAST(abs(sum(plon * qlat - qlon * plat)) AS BIGINT) AS area2, min(plat) AS min_lat, max(plat) AS max_lat, min(plon) AS min_lon, max(plon) AS max_lon FROM edges GROUP BY id),
polys AS (SELECT a.id AS node_id, CAST(admin_level AS INT) AS level, name, ring, area2, min_lat, max_lat, min_lon, max_lon, (max_lat / 1e7 - min_lat / 1e7) * (max_lon / 1e7 - min_lon / 1e7) AS bbox_area,
          CASE admin_level WHEN 2 THEN 'country' WHEN 4 THEN 'state' WHEN 8 THEN 'city' WHEN 9 THEN 'suburb' WHEN 10 THEN 'suburb' WHEN 11 THEN 'suburb' END AS tier FROM admins a JOIN areas USING (id))"""


def _hits(name: str, points: str, pid: str, y: str, x: str) -> str:
    """Pairs of points and polygons that hold them."""
    return f"""{name} AS (
    SELECT p.{pid} AS pid, n.node_id FROM {points} p JOIN polys n ON p.{y} BETWEEN n.min_lat AND n.max_lat AND p.{x} BETWEEN n.min_lon AND n.max_lon
    JOIN edges e ON e.id = n.node_id AND e.plat <> e.qlat AND (e.plat > p.{y}) <> (e.qlat > p.{y})
     AND CASE WHEN e.qlat > e.plat THEN (e.plon - p.{x}) * (e.qlat - e.plat) + (p.{y} - e.plat) * (e.qlon - e.plon) > 0 ELSE (e.plon - p.{x}) * (e.qlat - e.plat) + (p.{y} - e.plat) * (e.qlon - e.plon) < 0 END
    GROUP BY p.{pid}, n.node_id HAVING count(*) % 2 = 1)"""


BIG = "pts AS (SELECT *, lat_e7::BIGINT AS y, lon_e7::BIGINT AS x FROM points)"
HITS = _hits("hits", "pts", "id", "y", "x")
REPS = "reps AS (SELECT node_id AS id, ring[1].lat::BIGINT AS y, ring[1].lon::BIGINT AS x FROM polys)"
PARENTS = f"""{REPS}, {_hits("up", "reps", "id", "y", "x")},
parents AS (SELECT c.node_id, arg_min(p.node_id, {{'l': -p.level, 'a': p.area2, 'n': p.node_id}}) AS parent_id FROM up JOIN polys c ON c.node_id = up.pid JOIN polys p ON p.node_id = up.node_id WHERE p.level < c.level GROUP BY c.node_id),
nodes AS (SELECT polys.*, parent_id FROM polys LEFT JOIN parents USING (node_id))"""
CHAIN = """h AS (SELECT pid, n.* FROM hits JOIN nodes n USING (node_id)),
c1 AS (SELECT pid, 1 AS depth, arg_min(node_id, {'l': level, 'n': node_id}) AS node_id FROM h WHERE parent_id IS NULL GROUP BY pid),
""" + ",\n".join(f"c{i} AS (SELECT h.pid, {i} AS depth, arg_min(h.node_id, {{'l': h.level, 'n': h.node_id}}) AS node_id FROM h JOIN c{i - 1} c ON c.pid = h.pid AND h.parent_id = c.node_id GROUP BY h.pid)" for i in range(2, 7)) + """,
links AS (""" + " UNION ALL ".join(f"SELECT * FROM c{i}" for i in range(1, 7)) + ")"


def _at(level: int, what: str = "name", by: str = "area2", where: str = "level = {}") -> str:
    return f"arg_min({what}, {{'a': {by}, 'n': node_id}}) FILTER ({where.format(level)})"


ATTACH = f"""small AS (SELECT pid, {", ".join(f"{_at(x)} AS at_{x}" for x in (2, 4, 8, 9, 10, 11))} FROM h GROUP BY pid),
named AS (SELECT pid, {", ".join(f"arg_min(name, depth) FILTER (tier = '{t}' AND name IS NOT NULL) AS {t}" for t in ("country", "state", "city"))}, arg_max(name, depth) FILTER (tier = 'suburb' AND name IS NOT NULL) AS suburb FROM links JOIN polys USING (node_id) GROUP BY pid),
attached AS (SELECT p.* REPLACE (coalesce(p.country, n.country, at_2) AS country, coalesce(p.state, n.state, at_4) AS state, coalesce(p.city, n.city, at_8) AS city, coalesce(n.suburb, p.suburb, at_10, at_9, at_11) AS suburb),
             p.country IS NOT NULL AS was_country, p.state IS NOT NULL AS was_state, p.city IS NOT NULL AS was_city, p.suburb IS NOT NULL AS was_suburb
             FROM points p LEFT JOIN named n ON n.pid = p.id LEFT JOIN small s ON s.pid = p.id)"""
#: Of each building the last area of each tier in its chain.
LAYERED = """b AS (SELECT p.id, """ + ", ".join(f"arg_max(node_id, depth) FILTER (tier = '{t}') AS {t}" for t in ("city", "state", "country")) + """
    FROM points p LEFT JOIN links ON links.pid = p.id LEFT JOIN polys USING (node_id) WHERE p.type IS NOT NULL OR p.street IS NOT NULL OR p.housenumber IS NOT NULL GROUP BY p.id)"""


def _layer(below: str, above: str, places: str) -> str:
    """Buildings whose place `below` lies in the polygon `above`, by a ray alone."""
    return f"""(SELECT count(*) FROM (SELECT b.id FROM b JOIN {places} p ON p.id = b.{below} JOIN edges e ON e.id = b.{above} AND (e.plat > p.y) <> (e.qlat > p.y)
        AND (e.qlon - e.plon)::DOUBLE * (p.y - e.plat) / (e.qlat - e.plat) + e.plon > p.x GROUP BY b.id HAVING count(*) % 2 = 1))"""


#: Names by the chain alone.
PLAIN = """named_links AS (SELECT * FROM links JOIN polys USING (node_id) WHERE name IS NOT NULL),
plain AS (SELECT p.id, """ + ", ".join(f"arg_max(n.name, n.depth) FILTER (n.tier = '{t}') AS {t}" for t in ("country", "state", "city")) + """, arg_max(n.name, {'l': n.level, 'd': -n.depth}) FILTER (n.tier = 'suburb') AS suburb
    FROM points p LEFT JOIN named_links n ON n.pid = p.id GROUP BY p.id)"""
GEO = ",\n".join((POINTS, ADMINS, POLYS, BIG, HITS))
ALL = ",\n".join((GEO, PARENTS, CHAIN, ATTACH))


def _haversine(a: str, b: str, c: str, d: str) -> str:
    return f"2 * {geo.RADIUS} * asin(sqrt(least(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))"


PLACES = f"SELECT CAST(s_suppkey AS BIGINT) AS query_id, {lat('(s_suppkey + {0})')} / 1e7 + 0.00123 AS lat, {lon('(s_suppkey + {0})')} / 1e7 + 0.00321 AS lon FROM supplier"
NEAR = f"""near AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank, id, d FROM (
    SELECT query_id, p.id, {_haversine("q.lat", "q.lon", "p.lat_e7 / 1e7", "p.lon_e7 / 1e7")} AS d FROM places q, points p) QUALIFY rank <= 20)"""


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PHRASES = "phrases AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_q(p)})" for i, p in enumerate(C.PHRASES)) + ") t(query_id, q))"
ASKED = f"""{PHRASES},
asked0 AS (SELECT * FROM phrases UNION ALL SELECT min(p_partkey) + 1000000, p_name FROM part GROUP BY p_name UNION ALL SELECT id + 2000000, name || ' ' || CAST(id % 50 + 1 AS VARCHAR) FROM lines UNION ALL SELECT n_nationkey + 3000000, n_name FROM nation),
asked AS (SELECT query_id, q, list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+')) AS words, list_filter(t, lambda x: regexp_full_match(x, '[0-9]+')) AS nums FROM (SELECT *, {tokens(din("q"))} AS t FROM asked0))"""
OBJECTS = f"""named_things AS (
    SELECT 0 AS kind, id, name, CAST(NULL AS INT) AS level, concat_ws(' ', nullif({din("country")}, ''), nullif({din("state")}, ''), nullif({din("city")}, ''), nullif({din("suburb")}, '')) AS blob FROM points WHERE name IS NOT NULL
    UNION ALL SELECT 1, id, name, NULL, '' FROM lines WHERE name IS NOT NULL UNION ALL SELECT 2, id, name, admin_level, {din("name")} FROM admins WHERE name IS NOT NULL),
objs AS (SELECT *, {tokens(din("name"))} AS name_tokens, list_distinct(list_concat({tokens(din("name"))}, {tokens(strip("name"))})) AS tokens FROM named_things),
postings AS (SELECT unnest(tokens) AS token, kind, id FROM objs), vocab AS (SELECT DISTINCT token FROM postings WHERE strlen(token) >= 3)"""
SEARCH_BASE = ",\n".join((POINTS, LINES, ADMINS, ASKED, OBJECTS))
#: What the phrases become by synonyms: number, tokens, changed, trace.
SYNONYMS = (
    (8, "haupt bahnhof", True, "'main station' → 'hauptbahnhof'"),
    (9, "rathaus", True, "'city hall' → 'rathaus'"),
    (10, "muenchen haupt bahnhof", True, "'main station' → 'hauptbahnhof', 'munich' → 'muenchen'"),
    (11, "botanischer garten", True, "'botanical garden' → 'botanischer garten'"),
    (12, "garten strasse", True, "'garden' → 'garten', 'street' → 'strasse'"),
    (13, "bodensee", False, "'bodensee' → 'bodensee'"),
    (23, "markt berg", True, "'market square' → 'markt', 'hill' → 'berg'"),
)
SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {_q(t)}, {str(c).lower()}, {_q(tr)})" for i, t, c, tr in SYNONYMS) + ") t(query_id, t, changed, trace))"


def _hits_all(queries: str) -> str:
    """Objects that have all words of each query."""
    return f"SELECT q.*, o.kind, o.id, o.name, o.level, o.name_tokens, o.blob FROM {queries} q JOIN objs o ON list_has_all(o.tokens, q.words) WHERE len(q.words) > 0"


def _scored(hits: str) -> str:
    m, s, a, e = S.WEIGHTS
    return f"""SELECT query_id, path, k, kind, id, matched, (
        (matched / n) * {m} + CASE WHEN kind = 1 THEN 0.7 WHEN kind = 0 THEN 0.6 WHEN level >= 8 THEN 0.5 WHEN level >= 4 THEN 0.3 ELSE 0.2 END * {s} + adm_share * {a} + exact * {e}) * 100.0 / {sum(S.WEIGHTS)} AS score,
        'match ' || matched || '/' || n || CASE WHEN adm_share > 0.5 THEN ', admin ok' ELSE '' END || CASE WHEN exact = 1 THEN ', exact' WHEN exact > 0 THEN ', substr' ELSE '' END || coalesce('{S.NOTE}' || note, '') AS reason
    FROM (SELECT *, CASE WHEN len(obj) = 0 OR len(name_tokens) = 0 THEN 0.0 WHEN obj = name_tokens THEN 1.0 WHEN matched = len(obj) THEN 0.5 ELSE 0.0 END AS exact FROM (
        SELECT *, len(words) AS n, len(list_filter(words, lambda t: list_contains(name_tokens, t) OR (blob <> '' AND contains(blob, t)))) AS matched,
               CASE WHEN len(adm) = 0 THEN 0.5 ELSE len(list_filter(adm, lambda t: blob <> '' AND contains(blob, t))) / len(adm) END AS adm_share
        FROM (SELECT *, words[1:k] AS obj, words[k + 1:] AS adm FROM (SELECT *, unnest(range(0, len(words) + 1)) AS k FROM ({hits})))))"""


BEST = "SELECT query_id, kind, id, (b).score AS score, (b).matched AS matched, (b).reason AS reason FROM (SELECT query_id, kind, id, max({{'score': score, 'path': -path, 'k': -k, 'matched': matched, 'reason': reason}}) AS b FROM {} GROUP BY ALL)"
SEARCH = f"""{SEARCH_BASE}, {SYN},
plain AS (SELECT query_id, 0 AS path, words, CAST(NULL AS VARCHAR) AS note FROM asked WHERE len(words) > 0),
other AS (SELECT query_id, 1 AS path, string_split(t, ' ') AS words, 'via ' || trace AS note FROM syn WHERE changed),
both_paths AS (SELECT * FROM plain UNION ALL SELECT * FROM other),
scored AS ({_scored(_hits_all("both_paths"))}),
weak AS (SELECT * FROM plain WHERE query_id NOT IN (SELECT query_id FROM scored GROUP BY query_id HAVING max(score) >= {S.FUZZY_BELOW})),
each_word AS (SELECT query_id, pos, words[pos] AS token FROM (SELECT *, unnest(range(1, len(words) + 1)) AS pos FROM weak)),
fixed AS (SELECT token, arg_min(word, {{'d': d, 'w': word}}) AS best FROM (SELECT t.token, v.token AS word, damerau_levenshtein(t.token, v.token) AS d FROM (SELECT DISTINCT token FROM each_word) t JOIN vocab v ON abs(strlen(v.token) - strlen(t.token)) <= 2)
          WHERE d <= CASE WHEN strlen(token) <= 4 THEN 1 ELSE 2 END GROUP BY token),
third AS (SELECT query_id, 2 AS path, list(coalesce(best, token) ORDER BY pos) AS words, 'fuzzy: ' || string_agg('''' || token || ''' → ''' || best || '''', ', ' ORDER BY pos) FILTER (best <> token) AS note, count(*) FILTER (best <> token) AS n FROM each_word LEFT JOIN fixed USING (token) GROUP BY query_id),
third_path AS (SELECT query_id, path, words, note FROM third WHERE n > 0),
all_scored AS (SELECT * FROM scored UNION ALL {_scored(_hits_all("third_path"))}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, kind, id) AS rank FROM ({BEST.format("all_scored")})),
first_street AS (SELECT query_id, min(rank) AS at, arg_min(id, rank) AS line_id FROM ranked WHERE kind = 1 GROUP BY query_id),
house AS (SELECT f.query_id, f.at, a.nums[1] AS number, arg_min(p.id, {{'b': CASE WHEN contains(coalesce({din("p.city")}, '') || ' ' || coalesce({din("p.state")}, ''), array_to_string(a.words, ' ')) THEN -2 ELSE 0 END, 'i': p.id}}) AS house_id
          FROM first_street f JOIN asked a USING (query_id) JOIN lines l ON l.id = f.line_id JOIN points p ON p.housenumber = a.nums[1] AND {din("p.street")} = {din("l.name")} AND p.lat_e7 BETWEEN l.min_lat AND l.max_lat AND p.lon_e7 BETWEEN l.min_lon AND l.max_lon
          WHERE len(a.nums) > 0 GROUP BY ALL),
found AS (SELECT r.query_id, CAST(rank AS INT) AS rank, CASE WHEN house_id IS NULL THEN kind ELSE 0 END AS kind, coalesce(house_id, id) AS id, CASE WHEN house_id IS NULL THEN score ELSE least(100.0, score + {S.HOUSE_BONUS}) END AS score,
          CAST(matched AS INT) AS matched, CASE WHEN house_id IS NULL THEN reason ELSE 'street match + housenumber ' || number END AS reason
          FROM ranked r LEFT JOIN house h ON h.query_id = r.query_id AND h.at = r.rank WHERE rank <= 10)"""


def _search(where: str) -> str:
    return f"WITH {SEARCH} SELECT query_id, rank, kind, id, round(score, 6) AS score, matched, reason FROM found WHERE {where}"


def _norm(f) -> str:
    return f"SELECT doc_id, md5({f('text')}) AS norm FROM documents"


def _doc_tokens(f) -> str:
    return f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {tokens(f('text'))} AS t FROM documents)"


_WORDS = f"SELECT DISTINCT unnest(regexp_extract_all({din('text')}, '[a-z0-9]+')) AS w FROM documents"
_W, _S, _E, _N = C.BBOX

NODES = f"""onodes AS (SELECT CAST(p_partkey AS BIGINT) AS id, {lat("p_partkey")} AS lat_e7, {lon("p_partkey")} AS lon_e7 FROM part
    UNION ALL SELECT 10000000 + s * 4 + c, {lat("s")} + CASE WHEN c IN (1, 2) THEN 100000 ELSE 0 END, {lon("s")} + CASE WHEN c IN (2, 3) THEN 100000 ELSE 0 END FROM (SELECT CAST(s_suppkey AS BIGINT) AS s, unnest(range(0, 4)) AS c FROM supplier)),
refs AS (SELECT CAST(l_orderkey AS BIGINT) AS id, l_linenumber AS pos, CAST(l_partkey AS BIGINT) AS ref FROM lineitem
    UNION ALL SELECT 10000000 + s * 4 + c, 1, 10000000 + s * 4 + CASE c % 2 WHEN 0 THEN c ELSE (c + 1) % 4 END FROM (SELECT CAST(s_suppkey AS BIGINT) AS s, unnest(range(0, 4)) AS c FROM supplier)
    UNION ALL SELECT 10000000 + s * 4 + c, 2, 10000000 + s * 4 + CASE c % 2 WHEN 1 THEN c ELSE (c + 1) % 4 END FROM (SELECT CAST(s_suppkey AS BIGINT) AS s, unnest(range(0, 4)) AS c FROM supplier)),
way_ids AS (SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders UNION ALL SELECT 10000000 + s_suppkey * 4 + c FROM supplier, (SELECT unnest(range(0, 4)) AS c)),
coords AS (SELECT r.id, r.pos, n.id AS ref, n.lat_e7 AS lat, n.lon_e7 AS lon FROM refs r JOIN onodes n ON n.id = r.ref WHERE r.id IN (SELECT id FROM way_ids)),
ordered AS (SELECT id, list({{'lat': lat, 'lon': lon}} ORDER BY pos, ref) AS c FROM coords GROUP BY id)"""

FEATURE = """'{{"type":"Feature","geometry":{{"type":"{kind}","coordinates":' || {coords} || '}},"properties":{{' || {props} || '}}}}'"""


def _field(name: str, x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE ',\"{name}\":' || to_json({x}) END"


def _xy(y: str, x: str) -> str:
    return f"'[' || printf('%.7f', {x} / 1e7) || ',' || printf('%.7f', {y} / 1e7) || ']'"


def _path(c: str) -> str:
    return f"'[' || array_to_string(list_transform({c}, lambda c: {_xy('c.lat', 'c.lon')}), ',') || ']'"


def _feature(kind: str, coords: str, props: str) -> str:
    return FEATURE.format(kind=kind, coords=coords, props=props)


def _reverse(zoom: int) -> str:
    kind = "house" if zoom >= 15 else "city" if zoom >= 10 else "state" if zoom >= 7 else "country"
    level = {"city": 8, "state": 4, "country": 2}.get(kind, 0)
    tier = {"country": "n.country, b_2, vote_country", "state": "n.state, b_4, vote_state", "city": "n.city, b_8, vote_city", "suburb": "n.suburb, b_10, b_9, b_11, vote_suburb"}
    area = "coalesce(b.area, b.whole)"
    house = kind == "house"
    pick = lambda x, typ: f"CAST(NULL AS {typ})" if house else f"{area}.{x}"
    return f"""
WITH {ALL}, places AS ({PLACES.format(77)}), {NEAR},
qp AS (SELECT query_id AS id, CAST(trunc(lat * 1e7) AS BIGINT) AS y, CAST(trunc(lon * 1e7) AS BIGINT) AS x FROM places), {_hits("qhits", "qp", "id", "y", "x")},
b AS (SELECT pid, {", ".join(f"{_at(x, 'name', 'bbox_area')} AS b_{x}" for x in (2, 4, 8, 9, 10, 11))},
      {_at(level, "{'node_id': node_id, 'level': level, 'name': name}", "bbox_area")} AS area, {_at(0, "{'node_id': node_id, 'level': level, 'name': name}", "bbox_area", "true")} AS whole FROM qhits JOIN polys USING (node_id) GROUP BY pid),
v AS (SELECT query_id, {", ".join(f"arg_min(a.{t}, rank) FILTER (a.{t} IS NOT NULL) AS vote_{t}" for t in tier)} FROM near JOIN attached a USING (id) GROUP BY query_id),
n AS (SELECT near.query_id, near.d, a.* FROM near JOIN attached a USING (id) WHERE rank = 1)
SELECT p.query_id, '{kind}' AS object_kind, {"'point'" if house else f"CASE WHEN {area} IS NOT NULL THEN 'area' END"} AS kind, {"n.id" if house else f"{area}.node_id"} AS id, {pick("level", "INT")} AS admin_level, {pick("name", "VARCHAR")} AS name,
       {"round(n.d, 3)" if house else "CAST(NULL AS DOUBLE)"} AS distance_m, {", ".join(f"coalesce({x}) AS {t}" for t, x in tier.items())}
FROM places p LEFT JOIN b ON b.pid = p.query_id LEFT JOIN v ON v.query_id = p.query_id LEFT JOIN n ON n.query_id = p.query_id"""


def _tag(n: int, v: str) -> str:
    return f"CASE WHEN k % {n} = 0 THEN {v} END"


def sql() -> dict[str, str]:
    """By query name."""
    out = {
        "norm_din": _norm(din),
        "norm_strip": _norm(strip),
        "tokens_din": _doc_tokens(din),
        "tokens_strip": _doc_tokens(strip),
        "token_postings": f"SELECT token, count(*) AS n_docs FROM (SELECT unnest(list_distinct(list_concat({tokens(din('text'))}, {tokens(strip('text'))}))) AS token FROM documents) GROUP BY token",
        "abbrev_expand": f"SELECT w, {_expand('w')} AS expanded FROM ({_WORDS} UNION SELECT unnest([{', '.join(map(repr, text.ABBREVIATIONS))}]))",
        "suffix_split": f"WITH {LINES} SELECT w, {_parts('w')} AS parts FROM ({_WORDS} UNION SELECT {din('name')} FROM lines)",
        "synonym_expand": f"WITH {PHRASES}, {SYN} SELECT query_id, coalesce(s.t, array_to_string({tokens(din('q'))}, ' ')) AS tokens, coalesce(s.changed, false) AS changed, coalesce(s.trace, '') AS trace FROM phrases LEFT JOIN syn s USING (query_id)",
        "numeric_split": f"""WITH {POINTS} SELECT id, array_to_string(list_filter(t, lambda x: NOT regexp_full_match(x, '[0-9]+')), ' ') AS words, array_to_string(list_filter(t, lambda x: regexp_full_match(x, '[0-9]+')), ' ') AS nums
            FROM (SELECT id, {tokens(din("concat_ws(' ', street, housenumber, city)"))} AS t FROM points WHERE street IS NOT NULL)""",
        "osa_pairs": """WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), t AS (SELECT DISTINCT unnest([substr(word, 2, 1) || substr(word, 1, 1) || substr(word, 3), substr(word, 2), word || 'x', word]) AS typo FROM w)
            SELECT typo, word, CAST(damerau_levenshtein(typo, word) AS INT) AS distance FROM t, w WHERE damerau_levenshtein(typo, word) <= 1""",
        "index_postings": f"WITH {POINTS}, {LINES}, {ADMINS}, {OBJECTS} SELECT token, kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM postings GROUP BY token, kind",
        "index_stats": f"WITH {POINTS}, {LINES}, {ADMINS}, {OBJECTS} SELECT count(DISTINCT token) AS tokens, count(*) AS entries, count(DISTINCT token) FILTER (strlen(token) >= 3) AS fuzzy_tokens FROM postings",
        "and_query": f"WITH {SEARCH_BASE} SELECT query_id, kind, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM ({_hits_all('asked')}) GROUP BY query_id, kind",
        "rank_scores": f"""WITH {SEARCH_BASE}, plain AS (SELECT query_id, 0 AS path, words, CAST(NULL AS VARCHAR) AS note FROM asked WHERE len(words) > 0)
            SELECT query_id, kind, CAST(k AS INT) AS k, count(*) AS n, round(max(score), 6) AS best, round(min(score), 6) AS worst, max(matched) AS matched FROM ({_scored(_hits_all("plain"))}) GROUP BY ALL""",
        "search_topk": _search("true"),
        "search_fuzzy": _search("contains(reason, 'fuzzy')"),
        "search_synonym": _search("contains(reason, 'via ')"),
        "search_housenumber": _search("contains(reason, 'housenumber')"),
        "bbox_points": f"WITH {POINTS} SELECT id, lat_e7, lon_e7, name, type FROM points WHERE lat_e7 / 1e7 BETWEEN {_S} AND {_N} AND lon_e7 / 1e7 BETWEEN {_W} AND {_E}",
        "bbox_lines": f"WITH {LINES} SELECT id, name, min_lat, max_lat, min_lon, max_lon FROM lines WHERE max_lat / 1e7 >= {_S} AND min_lat / 1e7 <= {_N} AND max_lon / 1e7 >= {_W} AND min_lon / 1e7 <= {_E}",
        "bbox_admins": f"WITH {ADMINS}, {POLYS} SELECT node_id AS id, name, CAST(level AS SMALLINT) AS admin_level FROM polys WHERE max_lat / 1e7 >= {_S} AND min_lat / 1e7 <= {_N} AND max_lon / 1e7 >= {_W} AND min_lon / 1e7 <= {_E}",
        "e7_roundtrip": f"WITH {POINTS} SELECT id, lat_e7 / 1e7 AS lat, lon_e7 / 1e7 AS lon, CAST(trunc(lat_e7 / 1e7 * 1e7) AS INT) - lat_e7 AS d_lat, CAST(trunc(lon_e7 / 1e7 * 1e7) AS INT) - lon_e7 AS d_lon FROM points",
        "tier_map": "SELECT CAST(i AS INT) AS level, CASE WHEN i = 2 THEN 'country' WHEN i = 4 THEN 'state' WHEN i = 8 THEN 'city' WHEN i IN (9, 10, 11) THEN 'suburb' ELSE 'none' END AS tier FROM range(0, 16) t(i)",
        "admin_level_parse": """SELECT s_suppkey, value, CAST(coalesce(TRY_CAST(nullif(regexp_extract(value, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) & 255 AS INT) AS level
            FROM (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN ' ' WHEN 2 THEN '-' ELSE '' END || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN ';9' ELSE '' END AS value FROM supplier)""",
        "way_classify": """SELECT CAST(k AS BIGINT) AS id, k % 3 = 0 OR k % 9 = 0 AS is_area, k % 2 = 0 OR k % 5 = 0 OR k % 12 = 0 AS is_line FROM (SELECT o_orderkey AS k FROM orders)
            UNION ALL SELECT 10000000 + s_suppkey * 4 + c, false, false FROM supplier, (SELECT unnest(range(0, 4)) AS c)""",
        "point_tags": """SELECT CAST(k AS BIGINT) AS id, CASE WHEN k % 3 = 0 THEN p_name END AS name, CASE WHEN k % 5 = 0 THEN p_brand WHEN k % 2 = 0 THEN 'yes' END AS type, CASE WHEN k % 4 = 0 THEN 'Ulm' END AS city, CAST(CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_extra
            FROM (SELECT *, p_partkey AS k FROM part) WHERE k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0""",
        "line_tags": f"""SELECT CAST(k AS BIGINT) AS id, {_tag(4, "o_orderpriority")} AS name, CASE WHEN k % 12 = 0 THEN 'tram' WHEN k % 2 = 0 THEN 'residential' END AS type, {_tag(8, "'B1'")} AS ref
            FROM (SELECT *, o_orderkey AS k FROM orders) WHERE k % 2 = 0 OR k % 5 = 0 OR k % 12 = 0""",
        "needed_ways": "SELECT 10000000 + CAST(s_suppkey AS BIGINT) * 4 + c AS way_id FROM supplier, (SELECT unnest(range(0, 4)) AS c) WHERE s_suppkey % 7 <> 6",
        "resolve_coords": f"WITH {NODES} SELECT w.id, CAST(coalesce(len(c), 0) AS BIGINT) AS n, c[1].lat AS first_lat, c[1].lon AS first_lon, c[-1].lat AS last_lat, c[-1].lon AS last_lon FROM way_ids w LEFT JOIN ordered o USING (id)",
        "centroid": f"WITH {NODES} SELECT id, CAST(sum(lat::BIGINT) // count(*) AS INT) AS lat_e7, CAST(sum(lon::BIGINT) // count(*) AS INT) AS lon_e7 FROM coords GROUP BY id",
        "coord_bbox": f"WITH {NODES} SELECT id, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM coords GROUP BY id",
        "ring_area": f"""WITH {NODES}, e AS (SELECT id, len(c) AS n, c[i].lon::BIGINT * c[i % len(c) + 1].lat - c[i % len(c) + 1].lon::BIGINT * c[i].lat AS x FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM ordered))
            SELECT w.id, CAST(coalesce(a, 0) AS BIGINT) AS area2 FROM way_ids w LEFT JOIN (SELECT id, CASE WHEN any_value(n) < 3 THEN 0 ELSE abs(sum(x)) END AS a FROM e GROUP BY id) USING (id)""",
        "ring_stitch": f"""SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_suppkey % 3 + 8 AS INT) AS admin_level, s_name AS name, 5::BIGINT AS n, true AS closed, 20000000000 AS area2, y AS min_lat, y + 100000 AS max_lat, x AS min_lon, x + 100000 AS max_lon
            FROM (SELECT *, {lat("s_suppkey")} AS y, {lon("s_suppkey")} AS x FROM supplier) WHERE s_suppkey % 7 <> 6""",
        "parse_counts": f"""WITH {NODES}, w AS (SELECT k, EXISTS (SELECT 1 FROM coords c WHERE c.id = k) AS has_any FROM (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders))
            SELECT (SELECT count(*) FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0) + (SELECT count(*) FROM w WHERE has_any AND k % 3 = 0) AS points,
                   (SELECT count(*) FROM w WHERE has_any AND (k % 2 = 0 OR k % 5 = 0 OR k % 12 = 0)) AS lines, (SELECT count(*) FROM supplier WHERE s_suppkey % 7 <> 6) AS admins""",
        "haversine": f"""SELECT c_custkey, s_suppkey, round({_haversine("a", "b", "p", "q")}, 3) AS metres FROM (SELECT c_custkey, c_nationkey AS n, {lat("c_custkey")} / 1e7 AS a, {lon("c_custkey")} / 1e7 AS b FROM customer)
            JOIN (SELECT s_suppkey, s_nationkey AS n, {lat("s_suppkey")} / 1e7 AS p, {lon("s_suppkey")} / 1e7 AS q FROM supplier) USING (n)""",
        "nearest_point": f"WITH {POINTS}, places AS ({PLACES.format(0)}), {NEAR} SELECT query_id, id, round(d, 3) AS metres FROM near WHERE rank = 1",
        "knn20": f"WITH {POINTS}, places AS ({PLACES.format(0)}), {NEAR} SELECT query_id, CAST(rank AS INT) AS rank, id, round(d, 3) AS metres FROM near",
        "pip_counts": f"WITH {GEO} SELECT level, node_id, count(*) AS n FROM hits JOIN polys USING (node_id) GROUP BY level, node_id",
        "pip_level": f"WITH {GEO} SELECT p.id, {', '.join(_at(x, 'node_id') + f' AS at_{x}' for x in (2, 4, 8, 9, 10, 11))} FROM points p LEFT JOIN hits ON hits.pid = p.id LEFT JOIN polys USING (node_id) GROUP BY p.id",
        "pip_smallest": f"WITH {GEO} SELECT p.id, arg_min(node_id, {{'a': bbox_area, 'n': node_id}}) AS node_id FROM points p LEFT JOIN hits ON hits.pid = p.id LEFT JOIN polys USING (node_id) GROUP BY p.id",
        "hierarchy_parent": f"WITH {ADMINS}, {POLYS}, {PARENTS} SELECT node_id, level, tier, parent_id FROM nodes",
        "chain": f"WITH {ALL} SELECT p.id, coalesce(string_agg(CAST(node_id AS VARCHAR), '>' ORDER BY depth), '') AS chain FROM points p LEFT JOIN links ON links.pid = p.id GROUP BY p.id",
        "attach_admin": f"WITH {ALL} SELECT id, country, state, city, suburb FROM attached",
        "attach_stats": f"WITH {ALL} SELECT count(*) AS points, {', '.join(f'count(*) FILTER (NOT was_{t} AND {t} IS NOT NULL) AS {t}_filled' for t in ('country', 'state', 'city', 'suburb'))}, count(*) FILTER (coalesce(country, state, city, suburb) IS NOT NULL) AS points_with_any FROM attached",
        "address_format": f"WITH {ALL} SELECT id, concat_ws(', ', suburb, city, state, country) AS address FROM attached",
        "pip_bench_stats": f"WITH {ALL}, d AS (SELECT p.id, count(node_id) AS n FROM points p LEFT JOIN links ON links.pid = p.id GROUP BY p.id) SELECT count(*) AS queries, count(*) FILTER (n = 0) AS empty, round(avg(n), 6) AS avg_depth, max(n) AS max_depth FROM d",
        "layered_stats": f"""WITH {ALL}, {LAYERED}
            SELECT (SELECT count(*) FROM b) AS buildings, (SELECT count(*) FROM points) - (SELECT count(*) FROM b) AS skipped,
                   (SELECT count(*) FROM b WHERE city IS NULL) AS t1_misses, {_layer("id", "city", "pts")} AS t1_hits,
                   (SELECT count(*) FROM b WHERE city IS NULL OR state IS NULL) AS t2_misses, {_layer("city", "state", "reps")} AS t2_hits,
                   (SELECT count(*) FROM b WHERE state IS NULL OR country IS NULL) AS t3_misses, {_layer("state", "country", "reps")} AS t3_hits""",
        "tier_counts": f"""WITH {ADMINS}, l AS (SELECT admin_level AS v FROM admins UNION ALL SELECT 6 FROM admins WHERE admin_level = 9)
            SELECT count(*) FILTER (v NOT IN (2, 4, 8, 9, 10, 11)) AS dropped, count(*) FILTER (v = 2) AS country, count(*) FILTER (v = 4) AS state, count(*) FILTER (v = 8) AS city, count(*) FILTER (v IN (9, 10, 11)) AS suburb FROM l""",
        "query_address": f"WITH {ALL}, {PLAIN} SELECT * FROM plain",
        "address_sample": f"WITH {ALL}, {PLAIN} SELECT id, lat_e7, lon_e7, concat_ws(', ', a.suburb, a.city, a.state, a.country) AS address FROM plain a JOIN points p USING (id) WHERE coalesce(a.country, a.state, a.city, a.suburb) IS NOT NULL ORDER BY id LIMIT 5",
        "bbox_first_points": f"WITH {POINTS} SELECT id, {_feature('Point', _xy('lat_e7', 'lon_e7'), _id_and('name', 'type', 'street', 'housenumber', 'postcode'))} AS feature FROM points WHERE lat_e7 / 1e7 BETWEEN 48 AND 52 AND lon_e7 / 1e7 BETWEEN 8 AND 12 ORDER BY id LIMIT 20",
        "bbox_first_lines": f"WITH {LINES} SELECT id, {_feature('LineString', _path('coords'), _id_and('name', 'type', 'ref'))} AS feature FROM lines WHERE max_lat / 1e7 >= 48 AND min_lat / 1e7 <= 52 AND max_lon / 1e7 >= 8 AND min_lon / 1e7 <= 12 ORDER BY id LIMIT 7",
        "geojson_points": f"WITH {POINTS} SELECT id, {_feature('Point', _xy('lat_e7', 'lon_e7'), _id_and('name', 'type', 'street', 'housenumber', 'postcode'))} AS feature FROM points",
        "geojson_lines": f"WITH {LINES} SELECT id, {_feature('LineString', _path('coords'), _id_and('name', 'type', 'ref'))} AS feature FROM lines",
        "geojson_admin": f"""WITH {ADMINS} SELECT id, {_feature("Polygon", "'[' || " + _path("ring") + " || ']'", "'\"id\":' || id || ',\"admin_level\":' || admin_level || " + _field("name", "name"))} AS feature FROM admins""",
        "dataset_union": f"WITH {POINTS} SELECT 'set' || (id % 3) AS dataset, id, name FROM points",
        "dataset_counts": f"WITH {POINTS}, {LINES}, {ADMINS} SELECT {', '.join(f'(SELECT count(*) FROM {t} WHERE id % 3 <> 1) AS {t}' for t in ('points', 'lines', 'admins'))}",
    }
    cross = "sign(({q}lon - {p}lon) * ({r}lat - {p}lat) - ({q}lat - {p}lat) * ({r}lon - {p}lon))"
    side = lambda p, q, r: cross.format(p=p, q=q, r=r)
    pairs = f"""SELECT DISTINCT a.id AS a, b.id AS b FROM edges a JOIN polys m ON m.node_id = a.id JOIN polys n ON n.level = m.level AND n.node_id > m.node_id
        AND m.min_lat <= n.max_lat AND n.min_lat <= m.max_lat AND m.min_lon <= n.max_lon AND n.min_lon <= m.max_lon JOIN edges b ON b.id = n.node_id
        WHERE {side("a.p", "a.q", "b.p")} * {side("a.p", "a.q", "b.q")} < 0 AND {side("b.p", "b.q", "a.p")} * {side("b.p", "b.q", "a.q")} < 0"""
    out["poly_intersections"] = f"WITH {ADMINS}, {POLYS} {pairs}"
    out["first_pairs"] = f"WITH {ADMINS}, {POLYS}, few AS ({pairs} ORDER BY a, b LIMIT 5) SELECT a, b, level FROM few JOIN polys ON node_id = a"
    out["hierarchy_stats"] = f"""WITH RECURSIVE {ADMINS}, {POLYS}, {PARENTS}, up_to AS (SELECT node_id, parent_id, 1 AS depth FROM nodes UNION ALL SELECT u.node_id, n.parent_id, depth + 1 FROM up_to u JOIN nodes n ON n.node_id = u.parent_id)
        SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM nodes WHERE parent_id IS NULL) AS roots, (SELECT max(depth) FROM up_to)::BIGINT AS max_depth, (SELECT count(*) FROM ({pairs})) AS pairs"""
    head = lambda kind: f"'\"kind\":\"{kind}\",\"id\":' || o.id || "
    tail = "printf(',\"score\":%.2f,\"matched\":%d', score, matched) || " + _field("reason", "reason")
    some = lambda *names: " || ".join(_field(n, f"o.{n}") for n in names) + " || "
    ring = "'[' || " + _path("o.ring") + " || ']'"
    out["geojson_search"] = f"""WITH {SEARCH}
        SELECT query_id, rank, {_feature("Point", _xy("o.lat_e7", "o.lon_e7"), head("poi") + some("name", "type", "street", "housenumber", "city", "state", "country") + tail)} AS feature FROM found f JOIN points o ON o.id = f.id WHERE kind = 0
        UNION ALL SELECT query_id, rank, {_feature("LineString", _path("o.coords"), head("street") + some("name", "type") + tail)} FROM found f JOIN lines o ON o.id = f.id WHERE kind = 1
        UNION ALL SELECT query_id, rank, {_feature("Polygon", ring, head("admin") + "',\"admin_level\":' || o.admin_level || " + some("name") + tail)} FROM found f JOIN admins o ON o.id = f.id WHERE kind = 2"""
    tiers = " || ".join(f"',\"{t}\":' || to_json(coalesce(f.{t}, ''))" for t in ("country", "state", "city", "suburb"))
    house = "'\"object_kind\":\"house\",\"id\":' || f.id || ',\"admin_level\":null' || printf(',\"distance_m\":%.2f', f.distance_m) || " + some("name", "type", "street", "housenumber", "postcode") + tiers
    area = "'\"object_kind\":\"' || f.object_kind || '\",\"id\":' || f.id || ',\"admin_level\":' || f.admin_level || ',\"name\":' || to_json(coalesce(f.name, '')) || " + tiers
    out["geojson_reverse"] = f"""WITH far AS ({_reverse(16)}), near AS ({_reverse(11)}), {ADMINS}, {POINTS},
        f AS (SELECT * FROM far WHERE query_id % 2 = 0 UNION ALL SELECT * FROM near WHERE query_id % 2 = 1)
        SELECT f.query_id, {_feature("Point", _xy("o.lat_e7", "o.lon_e7"), house)} AS feature FROM f JOIN points o ON o.id = f.id WHERE f.kind = 'point'
        UNION ALL SELECT f.query_id, {_feature("Polygon", ring, area)} FROM f JOIN admins o ON o.id = f.id WHERE f.kind = 'area' UNION ALL SELECT query_id, NULL FROM f WHERE kind IS NULL"""
    out |= {name: _reverse(zoom) for name, zoom in C.REVERSE_ZOOMS.items()}
    return out


def _id_and(*fields: str) -> str:
    return "'\"id\":' || id || " + " || ".join(_field(f, f) for f in fields)
