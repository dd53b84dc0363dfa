"""Inverted index, ranking and batch forward geocoding.

A batch of queries is one plan: no loop over queries and no scan of hot posting lists. Each
query's rarest token proposes its candidates, whose own token sets are then tested for the
other tokens in place. Equal texts are searched once, and objects whose names and addresses
are equal are one candidate: what many queries and objects repeat costs rows of the result only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut

POI, STREET, ADMIN = 0, 1, 2
KINDS = {POI: "poi", STREET: "street", ADMIN: "admin"}
# --- Fixed values: weights of match, specificity, admin and exactness, and when typos are tried.
WEIGHTS = (10.0, 3.0, 8.0, 5.0)
FUZZY_BELOW = 30.0
HOUSE_BONUS = 15.0
# --- End of fixed values.
NOTE = "  ·  "
ADDRESS = ("country", "state", "city", "suburb")
#: Objects that share these have the same tokens and scores.
ALIKE = ("kind", "name", "level", *ADDRESS)
#: Characters of a word from which on candidates for corrections are found by length.
LONG = 48


def kind_name(kind: Column) -> Column:
    out = F
    for k, v in KINDS.items():
        out = out.when(kind == k, v)
    return out.otherwise(None)


def specificity(kind: Column, level: Column) -> Column:
    return F.when(kind == STREET, 0.7).when(kind == POI, 0.6).when(level >= 8, 0.5).when(level >= 4, 0.3).otherwise(0.2)


def _named(points: DataFrame, lines: DataFrame, admins: DataFrame) -> DataFrame:
    """id and ALIKE of all named objects; only points have an address."""
    none = F.lit(None).cast("int").alias("level")
    address = [F.lit(None).cast("string").alias(c) for c in ADDRESS]
    rows = points.select(F.lit(POI).alias("kind"), "id", "name", none, *ADDRESS)
    rows = rows.unionByName(lines.select(F.lit(STREET).alias("kind"), "id", "name", none, *address))
    rows = rows.unionByName(admins.select(F.lit(ADMIN).alias("kind"), "id", "name", F.col("admin_level").cast("int").alias("level"), *address))
    return rows.where("name is not null")


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of few bytes that take long each, dealt to all cores: by their size they would share one task."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def _described(rows: DataFrame, *more: str) -> DataFrame:
    """kind, `more`, name, level, blob, name_tokens (DIN, in order) and tokens (both spellings) of rows with ALIKE."""
    blob = F.concat_ws(" ", *[F.nullif(text.normalize_din(F.col(c)), F.lit("")) for c in ADDRESS])
    blob = F.when(F.col("kind") == ADMIN, text.normalize_din(F.col("name"))).otherwise(blob)
    return rows.select("kind", *more, "name", "level", blob.alias("blob"), text.tokenize_din(F.col("name")).alias("name_tokens"), text.token_set(F.col("name")).alias("tokens"))


def objects(points: DataFrame, lines: DataFrame, admins: DataFrame) -> DataFrame:
    """kind, id, name, level, blob, name_tokens (DIN, in order) and tokens (both spellings) of all named objects."""
    return _described(_named(points, lines, admins), "id")


def counted(points: DataFrame, lines: DataFrame, admins: DataFrame) -> DataFrame:
    """The named objects, one row for all that are alike: the columns of objects() with n, how many, in place of the id."""
    return _described(_named(points, lines, admins).groupBy(*ALIKE).agg(F.count("*").alias("n")), "n")


def smallest(points: DataFrame, lines: DataFrame, admins: DataFrame, limit: int) -> DataFrame:
    """The named objects, one row for all that are alike: the columns of objects() with ids, their `limit` smallest, in place of the id.

    No more of them can be among the first `limit` of any query, as ties go to the smaller id.
    """
    order = Window.partitionBy(*ALIKE).orderBy("id")
    # A rank that counts repeated rows of an id once. The filter stands at the window: tasks send the smallest ids only.
    first = _named(points, lines, admins).withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= limit)
    return _described(_dealt(first.groupBy(*ALIKE).agg(F.array_sort(F.collect_set("id")).alias("ids"))), "ids")


def postings(objs: DataFrame) -> DataFrame:
    """(token, kind, id), once for each token of an object."""
    return objs.select(F.explode("tokens").alias("token"), "kind", "id")


def vocabulary(objs: DataFrame) -> DataFrame:
    """(token, n): every token and how many objects have it."""
    return objs.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def query_all(queries: DataFrame, objs: DataFrame, *keys: str) -> DataFrame:
    """keys, words and all columns but the tokens of the objects that have all `words`.

    queries: keys, words. A query without words finds nothing. The keys are no columns of the objects.
    """
    each = queries.select(*keys, "words", F.explode(F.array_distinct("words")).alias("token"))
    known = each.join(vocabulary(objs), "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = known.groupBy(*keys).agg(F.min(F.struct("n", "token")).alias("r"), F.first("words").alias("words")).where("r.n > 0")
    rare = rare.select(*keys, "words", F.col("r.token").alias("token"))
    held = objs.select("*", F.explode("tokens").alias("token"))
    return rare.join(held, "token").where(F.size(F.array_except("words", "tokens")) == 0).drop("token", "tokens")


def score_columns(obj: Column, adm: Column, kind: Column, level: Column, names: Column, blob: Column) -> dict[str, Column]:
    """score, matched and reason of one object for object tokens and admin tokens."""
    q = F.concat(obj, adm)
    in_blob = lambda t: (blob != "") & F.contains(blob, t)
    matched = F.size(F.filter(q, lambda t: F.array_contains(names, t) | in_blob(t)))
    share = F.when(F.size(q) > 0, matched / F.size(q)).otherwise(0.0)
    of_adm = F.when(F.size(adm) == 0, 0.5).otherwise(F.size(F.filter(adm, in_blob)) / F.size(adm))
    exact = F.when((F.size(obj) == 0) | (F.size(names) == 0), 0.0).when(obj == names, 1.0).when(matched == F.size(obj), 0.5).otherwise(0.0)
    m, s, a, e = WEIGHTS
    score = (share * m + specificity(kind, level) * s + of_adm * a + exact * e) * 100.0 / sum(WEIGHTS)
    reason = F.concat(F.lit("match "), matched, F.lit("/"), F.size(q), F.when(of_adm > 0.5, ", admin ok").otherwise(""), F.when(exact == 1.0, ", exact").when(exact > 0, ", substr").otherwise(""))
    return {"score": score, "matched": matched.cast("int"), "reason": reason}


def as_text(words: Column) -> Column:
    """The words, which hold no spaces, as a key."""
    return F.array_join(words, " ")


def rank(queries: DataFrame, objs: DataFrame) -> DataFrame:
    """Every row of `objs` that has all words of a text, split into object and admin words in all ways, with its score.

    queries: words and more; equal words are taken once. Returns text (as_text() of the words), k, score, matched,
    reason and the columns of `objs` that do not describe a name.
    """
    texts = queries.select("words").distinct().withColumn("text", as_text(F.col("words")))
    splits = query_all(texts, objs, "text").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("words"))))
    cols = score_columns(F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words")), F.col("kind"), F.col("level"), F.col("name_tokens"), F.col("blob"))
    return splits.withColumns(cols).drop("words", "name", "level", "name_tokens", "blob")


def first_of(queries: DataFrame, objs: DataFrame, limit: int) -> DataFrame:
    """The first `limit` objects of every path of every query: query_id, path, k, kind, id, score, matched, reason.

    queries: query_id, path, words, note (null or what the path is to be told by); objs: smallest() with a column
    `group` that numbers its rows. What is not among the first of a path is not among the first of its query either.
    """
    key = F.max(F.struct("score", (-F.col("k")).alias("k"), "matched", "reason")).alias("b")
    alike = rank(queries, objs).groupBy("text", "group").agg(key, F.first("kind").alias("kind"), F.first("ids").alias("ids"))
    # Rows of one id may differ in name, and so be in several groups.
    each = alike.select("text", "kind", F.explode("ids").alias("id"), "b").groupBy("text", "kind", "id").agg(F.max("b").alias("b"))
    order = Window.partitionBy("text").orderBy(F.desc("b.score"), "kind", "id")
    first = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit).select("text", (-F.col("b.k")).alias("k"), "kind", "id", "b.score", "b.matched", "b.reason")
    found = queries.select("query_id", "path", "note", as_text(F.col("words")).alias("text")).join(first, "text")
    return found.withColumn("reason", F.concat("reason", F.coalesce(F.concat(F.lit(NOTE), "note"), F.lit("")))).drop("text", "note")


def best_of(scored: DataFrame) -> DataFrame:
    """The best score of each object; on a tie the earliest path and split. Splits are reduced before any shuffle."""
    key = F.max(F.struct("score", (-F.col("path")).alias("path"), (-F.col("k")).alias("k"), "matched", "reason")).alias("b")
    best = scored.groupBy("query_id", "kind", "id").agg(key)
    return best.select("query_id", (-F.col("b.path")).alias("path"), (-F.col("b.k")).alias("k"), "kind", "id", "b.score", "b.matched", "b.reason")


def prepare(queries: DataFrame) -> DataFrame:
    """`queries` (query_id, q) with words and nums."""
    words, nums = text.split_numeric(text.tokenize_din(F.col("q")))
    return queries.withColumns({"words": words, "nums": nums})


def asking(queries: DataFrame) -> DataFrame:
    """prepare() of the queries that have words, kept in the shared folder.

    The filter comes afterwards: it would else go below whatever made the texts distinct.
    """
    return cut(prepare(queries)).where(F.size("words") > 0)


def corrections(words: DataFrame, objs: DataFrame) -> DataFrame:
    """(token, best): for each distinct token the word of the index within its threshold of edits,
    the nearest one and then the first in order; tokens without one are left out.

    Candidates share a string that up to two deletions leave of both: an equality join. Of
    words of over LONG characters, which have thousands of such strings and are few, those
    of nearly the same length are candidates. A swap is two edits without swaps, which tells
    most candidates apart before the distance is taken.
    """
    asked = words.select("token").distinct().withColumn("k", text.fuzzy_threshold(F.col("token")))
    known = cut(vocabulary(objs).where(F.octet_length("token") >= 3).select(F.col("token").alias("word")))
    size = F.length("token")
    near = F.when(F.col("k") == 1, text.deletions(F.col("token"), 1)).otherwise(text.deletions(F.col("token"), 2))
    left = asked.where(size <= LONG).select("token", "k", F.explode(near).alias("left"))
    right = _dealt(known.where(F.length("word") <= LONG + 2)).select("word", F.explode(text.deletions(F.col("word"), 2)).alias("left"))
    long = asked.where(size > LONG).select("token", "k", F.explode(F.sequence(size - 2, size + 2)).alias("size"))
    alike = long.join(known.where(F.length("word") > LONG - 2).withColumn("size", F.length("word")), "size").select("token", "k", "word")
    pairs = left.join(right, "left").select("token", "k", "word").distinct().unionByName(alike)
    pairs = pairs.where(F.levenshtein("token", "word") <= 2 * F.col("k"))
    found = pairs.withColumn("d", text.osa_distance(F.col("token"), F.col("word"))).where("d <= k")
    return found.groupBy("token").agg(F.min(F.struct("d", "word"))["word"].alias("best"))


def _translated(asked: DataFrame) -> DataFrame:
    """Path 1: the queries whose words have synonyms, which are looked up once for equal words."""
    # Kept, as the filter and each field would else take the synonyms again.
    texts = cut(asked.select("words").distinct().withColumn("s", text.apply_synonyms(F.col("words"))))
    texts = texts.where("s.changed and size(s.tokens) > 0").select("words", F.col("s.tokens").alias("other"), F.concat(F.lit("via "), "s.trace").alias("note"))
    return asked.join(texts, "words").select("query_id", F.lit(1).alias("path"), F.col("other").alias("words"), "note")


def _fuzzy(weak: DataFrame, objs: DataFrame) -> DataFrame:
    each = weak.select("query_id", F.posexplode("words").alias("pos", "token"))
    fixed = each.join(corrections(each, objs), "token", "left").withColumn("word", F.coalesce("best", "token"))
    note = F.when(F.col("word") != F.col("token"), F.concat(F.lit("'"), "token", F.lit("' → '"), "word", F.lit("'")))
    rows = fixed.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "word", note.alias("note")))).alias("w"))
    notes = F.filter(F.transform("w", lambda x: x["note"]), lambda n: n.isNotNull())
    rows = rows.select("query_id", F.lit(2).alias("path"), F.transform("w", lambda x: x["word"]).alias("words"), F.concat(F.lit("fuzzy: "), F.array_join(notes, ", ")).alias("note"), F.size(notes).alias("n"))
    return rows.where("n > 0").drop("n")


def search(queries: DataFrame, points: DataFrame, lines: DataFrame, admins: DataFrame, *, limit: int = 10) -> DataFrame:
    """Results of free-text queries (query_id, q): query_id, rank, kind, id, score, matched, reason.

    All words must be in an object's name. Path 0 takes the words as they are, path 1 their
    translations, and path 2, for queries whose best score is below 30, corrected words. A
    number picks the house of that number on the first street of the results. Ties go to the
    smaller kind and id. The ranks are cut to `limit` (10 where it is not positive).
    """
    limit = limit if limit > 0 else 10
    # The index and the scores are read several times below: they are kept in the shared folder.
    objs = cut(smallest(points, lines, admins, limit).withColumn("group", F.monotonically_increasing_id()))
    asked = asking(queries)
    plain = asked.select("query_id", F.lit(0).alias("path"), "words", F.lit(None).cast("string").alias("note"))
    scored = cut(first_of(plain.unionByName(_translated(asked)), objs, limit))
    good = scored.groupBy("query_id").agg(F.max("score").alias("top")).where(F.col("top") >= FUZZY_BELOW)
    weak = asked.join(good, "query_id", "left_anti")
    scored = best_of(scored.unionByName(first_of(cut(_fuzzy(weak, objs)), objs, limit)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "kind", "id")
    # The filter stands at the window, so that each task sorts and sends `limit` rows of a query only.
    ranked = cut(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
    return _houses(ranked, asked, points, lines).select("query_id", "rank", "kind", "id", "score", "matched", "reason")


def wanted(ranked: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query_id, number, all_words, at, line_id) of queries with a number that find a street; the houses they want, once each."""
    numbered = asked.where(F.size("nums") > 0).select("query_id", F.col("nums")[0].alias("number"), as_text(F.col("words")).alias("all_words"))
    first = ranked.where(F.col("kind") == STREET).groupBy("query_id").agg(F.min(F.struct("rank", "id")).alias("f")).select("query_id", F.col("f.rank").alias("at"), F.col("f.id").alias("line_id"))
    numbered = numbered.join(first, "query_id")
    return numbered, numbered.select("number", "all_words", "line_id").distinct()


def _houses(ranked: DataFrame, asked: DataFrame, points: DataFrame, lines: DataFrame) -> DataFrame:
    """The first street of each query with a number, replaced by the house if there is one."""
    numbered, want = wanted(ranked, asked)
    street = lines.where("name is not null").select(F.col("id").alias("line_id"), text.normalize_din(F.col("name")).alias("norm"), "min_lat", "max_lat", "min_lon", "max_lon")
    house = points.where("housenumber is not null and street is not null").select(
        F.col("id").alias("house_id"), F.col("housenumber").alias("number"), F.coalesce(text.normalize_din(F.col("street")), F.lit("")).alias("norm"), "lat_e7", "lon_e7",
        F.concat(F.coalesce(text.normalize_din(F.col("city")), F.lit("")), F.lit(" "), F.coalesce(text.normalize_din(F.col("state")), F.lit(""))).alias("place"),
    )
    met = want.join(street, "line_id").join(house, ["number", "norm"]).where("lat_e7 between min_lat and max_lat and lon_e7 between min_lon and max_lon")
    bonus = F.when(F.contains("place", "all_words"), 2).otherwise(0)
    each = met.groupBy("number", "all_words", "line_id").agg(F.min(F.struct((-bonus).alias("b"), "house_id")).alias("h"))
    best = numbered.join(each, ["number", "all_words", "line_id"]).groupBy("query_id", "at", "number").agg(F.min("h")["house_id"].alias("house_id"))
    out = ranked.join(best.withColumnRenamed("query_id", "q2"), (F.col("query_id") == F.col("q2")) & (F.col("rank") == F.col("at")), "left")
    is_house = F.col("house_id").isNotNull()
    return out.select(
        "query_id", "rank", F.when(is_house, POI).otherwise(F.col("kind")).alias("kind"), F.coalesce("house_id", "id").alias("id"),
        F.when(is_house, F.least(F.lit(100.0), F.col("score") + HOUSE_BONUS)).otherwise(F.col("score")).alias("score"), "matched",
        F.when(is_house, F.concat(F.lit("street match + housenumber "), "number")).otherwise(F.col("reason")).alias("reason"),
    )
