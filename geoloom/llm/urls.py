"""URL filters: rules, and a ratio of two character language models for the rest.

Native throughout: columns, aggregates and joins only. URLs that an allow or a block rule
decides train one smoothed variable-order Markov model each: the probability of a character
after up to three others interpolates all shorter contexts by Witten-Bell weights. A URL's
score is the difference of its log-likelihoods by the two models over its length, and the
threshold is the one that parts the held-out ruled URLs best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._env import cut

#: (host, start of the path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
ORDER = 3
#: Size of the alphabet of the lowest order.
ALPHABET = 256.0
#: A model table of so many rows is broadcast (some 10 MB). Of a larger one, those n-grams are that
#: make up more than one in so many of all positions; so they are fewer. All others are joined by
#: shuffles, in which no key then has a larger share.
BROADCAST_ROWS = 200_000
BEGIN, END = "\x02", "\x03"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Scores are held to so many digits before they are compared or binned.
DIGITS, BINS = 9, 100


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _ruled(h: Column, p: Column, rules) -> tuple[Column, Column]:
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((h == name) | F.endswith(h, F.lit("." + name))) & F.startswith(p, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _positions(texts: DataFrame, *keep: str) -> DataFrame:
    """A row for each character after the first: g, the character after up to ORDER others."""
    at = texts.select(*keep, "s", F.explode(F.sequence(F.lit(2), F.length("s"))).alias("i"))
    return at.select(*keep, "s", F.expr(f"substr(s, greatest(1, i - {ORDER}), least(i, {ORDER + 1}))").alias("g"))


def _suffixes(grams: DataFrame, *keep: str) -> DataFrame:
    """For each g and context length k its last k + 1 characters."""
    each = grams.select(*keep, "g", F.explode(F.sequence(F.lit(0), F.length("g") - 1)).alias("k"))
    return each.select(*keep, "g", "k", F.expr("right(g, k + 1)").alias("gram"))


def model(counts: DataFrame, grams: DataFrame) -> DataFrame:
    """(g, llr) for each distinct g of `grams`: log P(last | others) if accepted less that if rejected.

    counts: (g, a, b), how often each g stands in accepted and in rejected URLs.
    """
    table = _suffixes(counts, "a", "b").groupBy("k", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    table = cut(table)
    contexts = table.groupBy("k", F.expr("left(gram, k)").alias("context")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("b") > 0).alias("tb"))
    contexts = cut(contexts)
    whole = contexts.where("k = 0").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c + "0") for c in ("na", "nb", "ta", "tb")])  # one row
    asked = cut(grams.select("g").distinct())
    parts = _suffixes(asked).join(table.select("gram", "a", "b"), "gram", "left")
    parts = parts.withColumn("context", F.expr("left(gram, k)"))
    lone = parts.where("k = 0").withColumns({c: F.lit(None).cast("long") for c in ("na", "nb", "ta", "tb")})
    longer = cut(parts.where("k > 0")).join(contexts.where("k > 0").drop("k"), "context", "left")
    cells = lone.unionByName(longer)
    pick = lambda c, k: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0)).cast("double").alias(f"{c}_{k}")
    wide = cells.groupBy("g").agg(*[pick(c, k) for k in range(ORDER + 1) for c in ("a", "b", "na", "nb", "ta", "tb")])
    wide = wide.crossJoin(F.broadcast(whole))

    def log_p(x: str) -> Column:
        n, t = F.col(f"n{x}0"), F.col(f"t{x}0")
        p = F.when(n > 0, (F.col(f"{x}_0") + t / ALPHABET) / (n + t)).otherwise(1 / ALPHABET)
        for k in range(1, ORDER + 1):
            n, t = F.col(f"n{x}_{k}"), F.col(f"t{x}_{k}")
            p = F.when(n > 0, (F.col(f"{x}_{k}") + t * p) / (n + t)).otherwise(p)
        return F.log(p)

    return wide.select("g", (log_p("a") - log_p("b")).alias("llr"))


def judge(pages: DataFrame, *, rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, verdict and score.

    A rule fits its host and all subdomains where the path starts with the rule's; the
    longest that fits gives the verdict. Other URLs are allowed if their score reaches the
    threshold. score is null where a rule decides; a null url or one without :// has an empty
    host and path, which the models judge like any other. Without ruled URLs of both kinds
    the threshold is 0. Three in sixteen of the ruled URLs, by digest, are left out of the
    counts and set the threshold: the least that reaches the best mean of both kinds' shares.
    Rows that share a page_id are judged by themselves, an empty table gives an empty one; a
    long URL makes a row for each character. Columns of these names are replaced, all others pass unchanged.
    """
    out = ["host", "path", "rule", "verdict", "score"]
    pages = pages.drop(*out)
    s_name = "_s"
    while s_name in pages.columns:
        s_name += "_"
    url = pages["url"].cast("string")
    rows = pages.withColumns({"host": host(url), "path": path(url)})
    rule, verdict = _ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict, s_name: F.concat(F.lit(BEGIN), "host", "path", F.lit(END))})
    # Equal URLs are counted before anything else; their verdict by rules is the same.
    texts = cut(rows.groupBy(F.col(s_name).alias("s"), F.col("verdict").alias("v")).agg(F.count("*").alias("n")))
    texts = texts.withColumn("held", F.col("v").isNotNull() & F.substring(F.md5(F.col("s").cast("binary")), 1, 1).isin("0", "1", "2"))
    taught = _positions(texts.where("v is not null and not held"), "v", "n").groupBy("g").agg(*[F.sum(F.when(F.col("v") == v, F.col("n")).otherwise(0)).alias(x) for v, x in (("allow", "a"), ("block", "b"))])
    scored = texts.where("v is null or held")
    at = _positions(scored)
    asked = cut(at.groupBy("g").agg(F.count("*").alias("n")))
    size = asked.agg(F.count("*").alias("grams"), F.sum("n").alias("positions")).first()
    ratio = cut(model(cut(taught), asked))
    if size["grams"] <= BROADCAST_ROWS:
        told = at.join(F.broadcast(ratio), "g").select("s", "llr")
    else:
        hot = ratio.join(asked.where(F.col("n") > size["positions"] / max(1, BROADCAST_ROWS)).select("g"), "g", "left_semi")
        first = at.join(F.broadcast(hot), "g", "left")
        rest = first.where("llr is null").drop("llr").join(ratio, "g")
        told = first.where("llr is not null").select("s", "llr").unionByName(rest.select("s", "llr"))
    sums = told.groupBy("s").agg(F.sum("llr").alias("llr"))
    score = F.round(F.col("llr") / (F.length("s") - 1), DIGITS)
    scores = cut(sums.select("s", score.alias("score")))
    held = scored.where("held").join(scores.withColumnRenamed("s", "s2"), F.col("s") == F.col("s2"))
    # A histogram of bounded size: bins of 1 / BINS between -10 and 10.
    bin_ = F.floor(F.least(F.greatest(F.col("score"), F.lit(-10.0)), F.lit(10.0)) * BINS).cast("int").alias("bin")
    seen = held.groupBy(bin_).agg(*[F.sum(F.when(F.col("v") == v, F.col("n")).otherwise(0)).alias(v) for v in ("allow", "block")]).orderBy("bin").collect()
    threshold = _threshold(seen)
    told = rows.where("verdict is null").join(scores, F.col(s_name) == F.col("s"), "left")
    told = told.withColumn("verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    sure = rows.where("verdict is not null").withColumn("score", F.lit(None).cast("double"))
    return sure.unionByName(told.drop("s")).select(*pages.columns, *out)


def _threshold(bins) -> float:
    """The lower edge of the bin from which on allowing is best."""
    allow, block = sum(r["allow"] for r in bins), sum(r["block"] for r in bins)
    if not allow or not block:
        return 0.0
    best, at, a, b = -1.0, 0.0, allow, 0
    for r in bins:
        # Allowing from this bin on.
        gain = a / allow + b / block
        if gain > best + 1e-12:
            best, at = gain, r["bin"] / BINS
        a, b = a - r["allow"], b + r["block"]
    return at
