"""Toxicity scores: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams (3 to 5 code points, A-Z lower-cased,
hashed) anywhere in it. Document frequencies by class give each n-gram its smoothed naive
Bayes log-count ratio; the n-grams that tell most between the classes (likelihood-ratio
statistic) are kept, their indicators are multiplied by the ratio, and a logistic regression
with L2 penalty is fitted to them. Only labels and texts of the training rows are used.

Fitting uses at most ``max_rows`` labelled documents, those whose ids hash lowest; that bound
makes the label side small enough to broadcast and the fit small enough for the driver. The
model has ``max_features`` n-grams; on held-out rows more of them predict worse (README).
Scoring reads every row once, with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._env import cut, free_name, ship, widened

BITS = 20
SIZES = (3, 4, 5)
_ALPHA = 0.5


@dataclass
class ToxicityModel:
    """features: hashed n-grams, ascending; weights: ratio times coefficient of each; bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _grams(data: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size, (n-gram hashes, position of each in code points); none crosses a row."""
    leads = (data & 0xC0) != 0x80
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(leads, out=at[1:])
    bounds = at[rows]
    chars = np.frombuffer(W._LOWER[data].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(chars)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)  # characters left in the row
    h = np.zeros(n, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(1, max(SIZES) + 1):
            if n < k:
                return
            h = h[: n - k + 1] * np.uint32(0x01000193) + chars[k - 1 :] * np.uint32(0x9E3779B1)
            if k in SIZES:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k * 0x27D4EB2F & 0xFFFFFFFF)
                fit = np.flatnonzero(left[: n - k + 1] >= k)
                yield (x >> np.uint32(32 - BITS))[fit], fit


def _row_of(data: np.ndarray, rows: np.ndarray, position: np.ndarray) -> np.ndarray:
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    return np.searchsorted(at[rows], position, side="right") - 1


#: Bytes of a text that is cut into pieces.
_LONG = 1_000_000


def _long_features(data: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    """The distinct features of one long text, ascending, from overlapping pieces of it."""
    seen = np.zeros(1 << BITS, bool)
    for lo in range(0, len(data), _LONG):
        while lo and lo < len(data) and data[lo] & 0xC0 == 0x80:  # to the next character
            lo += 1
        hi = min(len(data), lo + _LONG + 4 * max(SIZES))  # a character has four bytes at most
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        for h, _ in _grams(data[lo:hi], np.array([0, hi - lo])):
            h = h if wanted is None else wanted[h]
            seen[h[h >= 0]] = True
    return np.flatnonzero(seen)


def _pairs(data: np.ndarray, rows: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), by row; wanted: a table with -1 at the features to leave out."""
    if len(rows) == 2 and len(data) > 2 * _LONG:
        feature = _long_features(data, wanted)
        return np.zeros(len(feature), np.int64), feature
    row, feature = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for h, position in _grams(data, rows):
        if wanted is not None:
            h = wanted[h]
            hit = h >= 0
            h, position = h[hit], position[hit]
        row.append(_row_of(data, rows, position))
        feature.append(h.astype(np.int64))
    key = np.unique(np.concatenate(row) << BITS | np.concatenate(feature))
    return key >> BITS, key & ((1 << BITS) - 1)


def _counts(batches):
    """Rows (feature, pos, neg) of document frequencies, and feature -1 for the documents."""
    total = np.zeros((2, 1 << BITS), np.int64)
    docs = np.zeros(2, np.int64)
    for b in batches:
        y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        docs += np.bincount(y, minlength=2)[:2]
        for at, end, data, rows in W.chunks(b.column(0), 1_000_000):
            row, feature = _pairs(data, rows, None)
            cls = y[at:end][row]
            for c in (0, 1):
                total[c] += np.bincount(feature[cls == c], minlength=1 << BITS)
    some = np.flatnonzero(total.sum(0))
    for i in range(0, len(some), 50_000):
        f = some[i : i + 50_000]
        yield pa.RecordBatch.from_pydict({"feature": f.astype(np.int64), "pos": total[1][f], "neg": total[0][f]})
    yield pa.RecordBatch.from_pydict({"feature": np.array([-1]), "pos": docs[1:], "neg": docs[:1]})


def _table(features: np.ndarray) -> np.ndarray:
    table = np.full(1 << BITS, -1, np.int32)
    table[features] = np.arange(len(features))
    return table


def _design(features: np.ndarray):
    def run(batches):
        table = _table(features)
        for b in batches:
            ids, y = b.column(2), b.column(1).to_numpy(zero_copy_only=False)
            for at, end, data, rows in W.chunks(b.column(0), 1_000_000):
                row, feature = _pairs(data, rows, table)
                ends = np.searchsorted(row, np.arange(end - at + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays([ids.slice(at, end - at), pa.array(y[at:end], pa.int32()), lists], ["id", "y", "x"])

    return run


def _logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, l2: float, steps: int = 120) -> tuple[np.ndarray, float]:
    """Coefficients and bias of the penalised fit, by limited-memory BFGS."""
    k, n = len(scale), len(y)
    v = scale[cols]

    def loss(w):
        z = np.bincount(rows, v * w[cols], n) + w[-1]
        p = np.logaddexp(0, z) - y * z
        d = 1 / (1 + np.exp(-z)) - y
        g = np.append(np.bincount(cols, v * d[rows], k) + l2 * w[:-1], d.sum())
        return p.sum() + l2 / 2 * (w[:-1] @ w[:-1]), g

    w = np.zeros(k + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, used = -g, []
        for s, t in reversed(past):
            a = (s @ d) / (s @ t)
            used.append(a)
            d = d - a * t
        if past:
            s, t = past[-1]
            d = d * (s @ t) / (t @ t)
        for (s, t), a in zip(past, reversed(used), strict=True):
            d = d + (a - (t @ d) / (s @ t)) * s
        step = 1.0 if past else 1 / max(1.0, np.linalg.norm(g))
        for _ in range(30):
            f2, g2 = loss(w + step * d)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, t = step * d, g2 - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t)]
        done = f - f2 < 1e-6 * max(1.0, abs(f))
        w, f, g = w + s, f2, g2
        if done:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3: such labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = 30_000, max_features: int = 1_024, l2: float = 1.0) -> ToxicityModel:
    """Learn from the labelled rows of `docs` that are not held out.

    labels: doc_id, toxic; rows with a null in either are left out, and a document with
    several labels counts as toxic if one says so. Of rows that share a doc_id each counts
    for the ratios, and one, of the least list of features, for the coefficients. Without
    rows of both classes, as with empty tables, the model has no features and its bias gives
    the (smoothed) share of toxic rows.
    """
    ship(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("_y"))
    n = known.count()
    if n > max_rows:
        # A threshold first, so that tasks send about max_rows rows in all, and then the limit.
        place = F.pmod(F.xxhash64("_id"), F.lit(1 << 40))
        known = known.where(place < int((1 << 40) * min(1.0, 1.1 * max_rows / n + 1e-3))).orderBy(place, "_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(cut(known)), F.col("doc_id") == F.col("_id")).select("text", "_y", F.col("_id").cast("string").alias("_id"))
    found = cut(rows.mapInArrow(_counts, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    size = found.where("feature < 0").first()
    np_, nn_ = (size["pos"], size["neg"]) if size else (0, 0)
    # Likelihood-ratio statistic of "has the n-gram" against the class; sums over the corpus stay in Spark.
    a, b, p, n = F.col("pos").cast("double"), F.col("neg").cast("double"), F.lit(float(np_)), F.lit(float(nn_))
    part = lambda x, of, among: F.when(x > 0, x * F.log(x / (of * among / (p + n)))).otherwise(0.0)
    g2 = part(a, p, a + b) + part(b, n, a + b) + part(p - a, p, p + n - a - b) + part(n - b, n, p + n - a - b)
    top = []
    if np_ and nn_:
        top = found.where("feature >= 0 and pos + neg >= 3").withColumn("g2", g2).orderBy(F.desc("g2"), "feature").limit(max_features).select("feature", "pos", "neg").collect()
    if not top:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log((np_ + 0.5) / (nn_ + 0.5))))
    top.sort(key=lambda r: r["feature"])
    features = np.array([r["feature"] for r in top], np.int64)
    ratio = np.log((np.array([r["pos"] for r in top]) + _ALPHA) / (np_ + 2 * _ALPHA)) - np.log((np.array([r["neg"] for r in top]) + _ALPHA) / (nn_ + 2 * _ALPHA))
    design = rows.mapInArrow(_design(features), "id string, y int, x array<int>")
    got = design.groupBy("id").agg(F.max("y").alias("y"), F.min("x").alias("x")).orderBy("id").toArrow()  # max_rows rows at most
    x = got.column("x").combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    cols = x.flatten().to_numpy().astype(np.int64)
    at = np.repeat(np.arange(len(y)), x.value_lengths().to_numpy())
    w, bias = _logistic(at, cols, ratio, y, l2)
    return ToxicityModel(features, w * ratio, bias)


def score(docs: DataFrame, model: ToxicityModel, *, out: str = "score") -> DataFrame:
    """`docs` with a column `out`: 0 to 1, higher where a toxic label is likelier.

    Whole texts count; those of over 2 MB are taken in overlapping pieces. A null text has no
    n-grams, like an empty one: its score is that of the bias. Repeated rows are scored alike,
    an empty table gives an empty one. A column of the same name is replaced; all others pass
    unchanged.
    """
    ship(docs.sparkSession)
    docs = docs.drop(out)
    text = docs.columns.index("text")
    kinds = widened(docs, **{out: "double"})
    features, weights, bias = model.features, model.weights, model.bias

    def run(batches):
        table, w = _table(features), weights
        for b in batches:
            z = np.full(b.num_rows, bias)
            for at, end, data, rows in W.chunks(b.column(text), 1_000_000):
                row, feature = _pairs(data, rows, table)
                z[at:end] += np.bincount(row, w[feature], end - at)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p)], [*b.schema.names, out])

    return docs.mapInArrow(run, kinds)


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **how) -> DataFrame:
    """The rows of `docs` that score below `threshold`, columns unchanged."""
    name = free_name("_toxicity", docs.columns)
    return score(docs, fit(docs, labels, **how), out=name).where(F.col(name) < threshold).drop(name)
