"""DuckDB SQL for the queries that SQL can express on whole tables."""

_SPACED = "'[^\\x20\\x09-\\x0D]+'"
_ALNUM = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"


def _low(x: str) -> str:
    return f"translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


OP1 = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id JOIN c ON c.a = e.vec_id
"""

OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS w FROM documents),
p AS (SELECT r, i, array_to_string(w[i : i + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS n FROM p) WHERE n > 1),
c AS (SELECT DISTINCT r, i + j AS x FROM m, (SELECT unnest(range(0, 35)) AS j)),
g AS (SELECT r, list(x) AS gone FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""

OP8 = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_low("text")}, {_ALNUM}) AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("text")}, {_ALNUM}) AS w FROM documents),
p AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n)),
m AS (SELECT p.r, p.i, p.n, k.item_id FROM p JOIN k ON p.k = k.k AND p.n = k.n),
h AS (SELECT r, count(DISTINCT i + j) AS n_hit FROM m, (SELECT unnest(range(0, 10)) AS j) WHERE j < n GROUP BY r),
t AS (SELECT r, list(DISTINCT CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(list_sort(ids), ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""

OP9 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS lead FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> lead THEN lead END AS refers_to
FROM q
"""


def op6(rules, order: int, alphabet: float, bins: int, digits: int) -> str:
    """The same counts, interpolation, calibration and verdicts in SQL."""
    fits = "".join(
        f" WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{}}".replace("{}", f"'{{{i}}}'") for i, (h, p, _) in enumerate(sorted(rules, key=lambda r: -len(r[0] + r[1])))
    )
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    case = lambda f: "CASE" + fits.format(*[f(r) for r in ordered]) + " END"

    def level(x: str) -> str:
        p = f"CASE WHEN w.n0{x} > 0 THEN (coalesce(max({x}) FILTER (k = 0), 0) + w.t0{x} / {alphabet}) / (w.n0{x} + w.t0{x}) ELSE 1 / {alphabet} END"
        for k in range(1, order + 1):
            n, t, c = (f"CAST(coalesce(max({v}) FILTER (k = {k}), 0) AS DOUBLE)" for v in (f"n{x}", f"t{x}", x))
            p = f"CASE WHEN {n} > 0 THEN ({c} + {t} * ({p})) / ({n} + {t}) ELSE {p} END"
        return f"ln({p})"

    return f"""
WITH u AS (SELECT page_id, {_low("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, {case(lambda r: r[0] + r[1])} AS rule, {case(lambda r: r[2])} AS ruled, chr(2) || host || path || chr(3) AS s FROM u),
t AS (SELECT s, ruled AS v, count(*) AS n, ruled IS NOT NULL AND substr(md5(s), 1, 1) IN ('0', '1', '2') AS held FROM r GROUP BY s, ruled),
g AS (SELECT s, v, n, held, substr(s, greatest(1, i - {order}), least(i, {order + 1})) AS g FROM (SELECT *, unnest(range(2, length(s) + 1)) AS i FROM t)),
c AS (SELECT k, right(g, k + 1) AS gram, sum(n) FILTER (v = 'allow') AS a, sum(n) FILTER (v = 'block') AS b
      FROM (SELECT *, unnest(range(0, length(g))) AS k FROM g WHERE v IS NOT NULL AND NOT held) GROUP BY ALL),
x AS (SELECT k, left(gram, k) AS context, sum(a) AS na, sum(b) AS nb, count(a) AS ta, count(b) AS tb FROM c GROUP BY ALL),
w AS (SELECT coalesce(max(na), 0)::DOUBLE AS n0a, coalesce(max(nb), 0)::DOUBLE AS n0b, coalesce(max(ta), 0)::DOUBLE AS t0a, coalesce(max(tb), 0)::DOUBLE AS t0b FROM x WHERE k = 0),
q AS (SELECT g, unnest(range(0, length(g))) AS k FROM (SELECT DISTINCT g FROM g WHERE v IS NULL OR held)),
j AS (SELECT q.g, q.k, c.a::DOUBLE AS a, c.b::DOUBLE AS b, x.na, x.nb, x.ta, x.tb FROM q LEFT JOIN c ON c.gram = right(q.g, q.k + 1) LEFT JOIN x ON x.k = q.k AND x.context = left(right(q.g, q.k + 1), q.k)),
m AS (SELECT g, {level("a")} - {level("b")} AS llr FROM (SELECT g, k, a, b, na, nb, ta, tb FROM j) j, w GROUP BY g, w.n0a, w.n0b, w.t0a, w.t0b),
z AS (SELECT s, round(sum(llr) / (length(s) - 1), {digits}) AS score FROM g JOIN m USING (g) WHERE v IS NULL OR held GROUP BY s),
h AS (SELECT CAST(floor(least(greatest(score, -10), 10) * {bins}) AS INT) AS bin, sum(n) FILTER (v = 'allow') AS a, sum(n) FILTER (v = 'block') AS b FROM t JOIN z USING (s) WHERE held GROUP BY bin),
f AS (SELECT bin, coalesce(sum(a) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) / sum(a) OVER () + coalesce(sum(b) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(b) OVER () AS gain FROM h),
e AS (SELECT coalesce(min(bin) FILTER (gain > (SELECT max(gain) FROM f) - 1e-12) / {float(bins)}, 0) AS threshold FROM f)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN z.score >= e.threshold THEN 'allow' ELSE 'block' END) AS verdict, CASE WHEN ruled IS NULL THEN z.score END AS score
FROM r LEFT JOIN z USING (s), e
"""


def op2(templates, base: int, coverage: float = 0.8) -> str:
    """All places of key phrases, and the share of each template's words that stand round them."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = []
    for i, t in enumerate(templates):
        words, key = t.words, t.key.split()
        at = next(k for k in range(len(words)) if words[k : k + len(key)] == key)
        rows.append(f"({i < base}, '{t.label}', {quoted(words)}, {quoted(key)}, {at})")
    return f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS v(base, label, x, key, k)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_low("text")}, {_ALNUM}) AS w FROM documents),
p AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
a AS (SELECT p.r, p.p - t.k AS s, t.* FROM p JOIN t ON p.word = t.key[1]),
f AS (SELECT a.r, a.base, a.label, a.s, list_sum(list_transform(range(0, len(a.x)), lambda i: CASE WHEN a.s + i >= 1 AND d.w[a.s + i] = a.x[i + 1] THEN 1 ELSE 0 END)) / len(a.x) AS share
      FROM a JOIN d ON a.r = d.r WHERE d.w[a.s + a.k : a.s + a.k + len(a.key) - 1] = a.key),
m AS (SELECT r, CAST(count(*) FILTER (base) AS BIGINT) AS n, CAST(min(s) FILTER (base) - 1 AS BIGINT) AS lo, CAST(max(s) FILTER (base) - 1 AS BIGINT) AS hi,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l, max(share) AS share FROM f WHERE share >= {coverage} GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(b, '') AS base_labels, coalesce(l, '') AS labels, CAST(coalesce(share, 0) AS DOUBLE) AS score
FROM d LEFT JOIN m USING (r)
"""
