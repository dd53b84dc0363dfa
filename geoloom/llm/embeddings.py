"""Near-duplicate vectors by sorted projection passes.

Equal vectors become one class. In each pass several random projections hash a class: a
projection's digit is the coordinate of largest size after it, with its sign. Classes are
ordered lexicographically by their concatenated digits (range partitions, so that no key
must fit in a task; equal keys are dealt by a further hash), and each is compared with its
next neighbours in a window of fixed length, over the borders of partitions too. Verified
pairs of all passes are united.

How many passes it takes follows the data. Two vectors at the threshold agree in a digit
with a known probability p. A vector whose window reaches over all that share its first l
digits meets such a partner in one pass with probability p**l at least; the first passes
measure l for every vector, and passes go on until the mean chance of a miss is below a
bound. Vectors that link with half of their window are left out of that mean: passes
connect such a group anyhow.

A window cannot hold all neighbours of a vector that has thousands. Its passes connect the
group, and the links in it are then counted exactly: members within half the angle of the
group's smallest member are pairwise linked, which needs no comparison, and all others are
compared with the whole group in blocks, of which only counts leave. Small groups share
blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._env import cut, ship
from ._graph import components, forest

#: Digits of a key, and coordinates that a projection has.
DIGITS, COORDINATES = 8, 64
#: Passes that run before their number is known.
FIRST = 4
#: Members of a block, on either side, of two of which the vectors are compared at once.
BLOCK = 8_192
#: Groups of at most so many members share blocks.
SMALL = 512


def _units(column: pa.Array, kind: str) -> np.ndarray:
    """A binary column of equally long rows of floats, as unit vectors in double precision."""
    x = np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # neither overflow nor underflow in the norm
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _classify(kind: str):
    """Rows (vec_id, v, d): the vector's bytes, and a digest of its direction; null where it links with nothing."""

    def run(batches):
        import hashlib

        for b in batches:
            v, d = [], []
            for x in b.column(1):
                v.append(None)
                d.append(None)
                if x.is_valid and x.values is not None and len(x.values) and not x.values.null_count:
                    raw = x.values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(raw).all() and raw.any():
                        v[-1] = raw.tobytes()
                        u = _units(pa.array([v[-1]], pa.binary()), kind) + 0.0  # no negative zeros
                        d[-1] = hashlib.sha256(u.tobytes()).digest()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.binary()), pa.array(d, pa.binary())], ["vec_id", "v", "d"])

    return run


def agreement(threshold: float) -> float:
    """The probability that two vectors at a cosine of `threshold` agree in a digit, by simulation."""
    rng = np.random.default_rng(20_240_601)
    y, z = rng.standard_normal((2, 40_000, COORDINATES))
    z = threshold * y + np.sqrt(max(0.0, 1 - threshold**2)) * z
    a, b = np.abs(y).argmax(1), np.abs(z).argmax(1)
    at = np.arange(len(a))
    return float(((a == b) & (np.sign(y[at, a]) == np.sign(z[at, b]))).mean())


def _keys(passes: range, kind: str):
    """Rows (pass, size, key, id, v) for each pass."""

    def run(batches):
        known: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            sizes = np.array([len(x) for x in b.column(1).to_pylist()], np.int64)
            for n in np.unique(sizes):
                part = b.filter(pa.array(sizes == n))
                x = _units(part.column(1), kind)
                m, at = len(part), np.arange(len(part))
                for p in passes:
                    if (p, int(n)) not in known:
                        known[p, int(n)] = np.random.default_rng((p, x.shape[1])).standard_normal((DIGITS, x.shape[1], COORDINATES))
                    digits = np.empty((m, DIGITS), ">u2")
                    for k, r in enumerate(known[p, int(n)]):
                        y = x @ r
                        top = np.abs(y).argmax(1)
                        digits[:, k] = 2 * top + (y[at, top] > 0)
                    keys = pa.array([row.tobytes() for row in digits], pa.binary())
                    yield pa.RecordBatch.from_pydict({"pass": np.full(m, p, np.int32), "size": np.full(m, n, np.int32), "key": keys, "id": part.column(0), "v": part.column(1)})

    return run


_ORDERED = "kind int, a long, b long, part int, at long, size int, v binary"
_EDGE, _BORDER, _ROWS, _DEPTH = range(4)


def _windows(window: int, threshold: float, kind: str):
    """What a sorted partition yields, by kind.

    _EDGE: (a, b) of a spanning forest of the verified pairs of a batch, its predecessor's
    last rows included; _BORDER: the first and the last rows of the partition (a: the id,
    b: the pass), with their place in it; _ROWS: their number; _DEPTH: how many rows (b) need a digits to be alone in their window.
    """

    def out(n, **columns):
        kinds = {"kind": pa.int32(), "a": pa.int64(), "b": pa.int64(), "part": pa.int32(), "at": pa.int64(), "size": pa.int32(), "v": pa.binary()}
        full = [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in kinds.items()]
        return pa.RecordBatch.from_arrays(full, list(kinds))

    def border(b, at, me):
        n = b.num_rows
        return out(n, kind=np.full(n, _BORDER), a=b.column(3), b=b.column(0).to_numpy(), part=np.full(n, me), at=at, size=b.column(1).to_numpy(), v=b.column(4))

    def run(batches):
        from pyspark import TaskContext

        me, seen, tail, depths = TaskContext.get().partitionId(), 0, None, np.zeros(DIGITS + 1, np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            if seen < window:
                yield border(b.slice(0, window - seen), np.arange(seen, min(window, seen + b.num_rows)), me)
            seen += b.num_rows
            old = tail.num_rows if tail is not None else 0
            if old:
                b = pa.Table.from_batches([tail, b]).combine_chunks().to_batches()[0]
            group = b.column(0).to_numpy().astype(np.int64) << 32 | b.column(1).to_numpy()
            ids, n = b.column(3).to_numpy(), b.num_rows
            keys = np.frombuffer(b"".join(b.column(2).to_pylist()), ">u2").reshape(n, DIGITS)
            root = np.arange(n)
            bounds = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
            for lo, hi in zip(bounds, [*bounds[1:], n], strict=True):
                v = _units(b.column(4).slice(lo, hi - lo), kind)
                for i in range(0, hi - lo, 512):
                    near = v[i : i + 512] @ v[i : i + 512 + window].T >= threshold
                    p, q = np.nonzero(near)
                    ok = (q > p) & (q - p <= window)
                    p, q = p[ok], q[ok]
                    apart = root[p + lo + i] != root[q + lo + i]
                    if apart.any():
                        root = forest(np.concatenate([p[apart] + lo + i, np.arange(n)]), np.concatenate([q[apart] + lo + i, root]), n)
                    # Rows whose window ends in this batch and did not in the last one.
                    x = np.arange(max(i, old - window - lo if lo < old else 0), min(i + 512, hi - lo - window))
                    if len(x):
                        loose = np.bincount(p, minlength=512)[x - i] * 2 < window
                        same = np.cumprod(keys[lo + x] == keys[lo + x + window], axis=1).sum(1)[loose]
                        depths += np.bincount(np.minimum(same + 1, DIGITS), minlength=DIGITS + 1)
            some = np.flatnonzero(root != np.arange(n))
            if len(some):
                yield out(len(some), kind=np.full(len(some), _EDGE), a=ids[some], b=ids[root[some]])
            tail = b.slice(max(0, n - window))
        if seen:
            if seen > window:  # else the first rows are the last ones too
                at = np.arange(max(window, seen - tail.num_rows), seen)
                yield border(tail.slice(tail.num_rows - len(at)), at, me)
            yield out(1, kind=[_ROWS], a=[seen], part=[me])
            k = np.flatnonzero(depths)
            if len(k):
                yield out(len(k), kind=np.full(len(k), _DEPTH), a=k, b=depths[k])

    return run


def _borders(offsets: np.ndarray, window: int):
    """Rows (border, rank, right, group, id, v): each border row at every border that its window crosses."""

    def run(batches):
        for b in batches:
            part = b.column(3).to_numpy()
            rank = offsets[part] + b.column(4).to_numpy()
            group = b.column(2).to_numpy() << 32 | b.column(5).to_numpy()
            right = rank - offsets[part] < window
            row, border, side = [np.flatnonzero(right)], [part[right]], [np.ones(right.sum(), bool)]
            first = np.searchsorted(offsets, rank, side="right")  # the next partition that has rows
            last = np.searchsorted(offsets, rank + window, side="right")
            many = np.maximum(0, last - first)
            row.append(np.repeat(np.arange(len(part)), many))
            border.append(np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum())))
            side.append(np.zeros(int(many.sum()), bool))
            row, border, side = map(np.concatenate, (row, border, side))
            yield pa.RecordBatch.from_pydict({"border": border.astype(np.int32), "rank": rank[row], "right": side, "g": group[row], "id": b.column(1).take(pa.array(row)), "v": b.column(6).take(pa.array(row))})

    return run


def _cross(window: int, threshold: float, kind: str):
    """Edges between the two sides of a border."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("g", "ascending"), ("rank", "ascending")])
        n = table.num_rows
        rank, group, ids = (table.column(c).to_numpy() for c in ("rank", "g", "id"))
        right = table.column("right").to_numpy(zero_copy_only=False)
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        bounds = np.flatnonzero(np.diff(group, prepend=group[:1] - 1))
        for lo, hi in zip(bounds, [*bounds[1:], n], strict=True):
            if right[lo:hi].all() or not right[lo:hi].any():
                continue
            v = _units(table.column("v").slice(lo, hi - lo).combine_chunks(), kind)
            p, q = np.flatnonzero(~right[lo:hi]), np.flatnonzero(right[lo:hi])
            a, b = np.nonzero((v[p] @ v[q].T >= threshold) & (rank[lo + q][None] - rank[lo + p][:, None] <= window))
            x.append(p[a] + lo)
            y.append(q[b] + lo)
        root = forest(np.concatenate(x), np.concatenate(y), n)
        some = np.flatnonzero(root != np.arange(n))
        return pa.table({"a": ids[some], "b": ids[root[some]]})

    return run


def _passes(classes: DataFrame, passes: range, window: int, threshold: float, kind: str) -> tuple[DataFrame, np.ndarray]:
    """(edges that the passes find, how many rows need each number of digits)."""
    keyed = classes.select("id", "v").mapInArrow(_keys(passes, kind), "pass int, size int, key binary, id long, v binary")
    order = ["pass", "size", "key", "salt"]
    ordered = keyed.withColumn("salt", F.xxhash64("pass", "id")).repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut(ordered.select("pass", "size", "key", "id", "v").mapInArrow(_windows(window, threshold, kind), _ORDERED))
    # A row for each partition and one for each number of digits.
    told = found.where(F.col("kind").isin(_ROWS, _DEPTH)).groupBy("kind", "part", F.when(F.col("kind") == _DEPTH, F.col("a")).alias("k")).agg(F.sum(F.when(F.col("kind") == _DEPTH, F.col("b")).otherwise(F.col("a"))).alias("n")).collect()
    rows = {r["part"]: r["n"] for r in told if r["kind"] == _ROWS}
    depths = np.zeros(DIGITS + 1, np.int64)
    for r in told:
        if r["kind"] == _DEPTH:
            depths[r["k"]] += r["n"]
    edges = found.where(F.col("kind") == _EDGE).select("a", "b")
    if len(rows) > 1:
        sizes = np.zeros(max(rows) + 1, np.int64)
        for part, n in rows.items():
            sizes[part] = n
        offsets = np.cumsum(sizes) - sizes
        sides = found.where(F.col("kind") == _BORDER).mapInArrow(_borders(offsets, window), "border int, rank long, right boolean, g long, id long, v binary")
        edges = edges.unionByName(sides.groupBy("border").applyInArrow(_cross(window, threshold, kind), "a long, b long"))
    return cut(edges), depths


def passes_needed(depths: np.ndarray, p: float, miss: float) -> int:
    """The least number of passes whose mean chance of a miss is at most `miss`.

    depths[l]: vectors that need l digits to be alone in their window; p: see agreement().
    """
    n, total = 0, depths.sum()
    left = np.where(depths > 0, 1.0, 0.0)
    if not total:
        return 1
    while n < 1 or (left * depths).sum() > miss * total:
        left *= 1 - p ** np.arange(len(depths))
        n += 1
    return n


def _core(half: float, kind: str):
    """Rows (id, c, n, v, core): whether the member is within half the angle of its group's first."""

    def run(batches):
        for b in batches:
            out = np.zeros(b.num_rows, bool)
            sizes = np.array([len(x) for x in b.column(3).to_pylist()], np.int64)
            for n in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == n))
                x, y = (_units(b.column(i).take(at), kind) for i in (3, 4))
                out[at.to_numpy()] = (x * y).sum(1) >= half
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out)], ["id", "c", "n", "v", "core"])

    return run


def _count(threshold: float, kind: str):
    """Of one block: for each member, how many rows of the other side it links with.

    A pair of an asked and a core member counts for both; a pair of asked members for the first.
    """

    def run(table: pa.Table) -> pa.Table:
        ids, links = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        sizes = np.array([len(x) for x in table.column("v").to_pylist()], np.int64)
        for size in np.unique(sizes):
            part = table.filter(pa.array(sizes == size)).combine_chunks()
            asked = part.column("asked").to_numpy(zero_copy_only=False)
            x = _units(part.column("v").combine_chunks(), kind)
            me, n, c, core = (part.column(f).to_numpy(zero_copy_only=False) for f in ("id", "n", "c", "core"))
            q, h = np.flatnonzero(asked), np.flatnonzero(~asked)
            theirs = np.zeros(len(h), np.int64)
            for i in range(0, len(q), 256):
                some = q[i : i + 256]
                ok = (x[some] @ x[h].T >= threshold) & (me[some][:, None] != me[h][None]) & (c[some][:, None] == c[h][None])
                ids.append(me[some])
                links.append(ok @ n[h])
                theirs += n[some] @ ok
            held = core[h]
            ids.append(me[h][held])
            links.append(theirs[held])
        return pa.table({"id": np.concatenate(ids), "links": np.concatenate(links).astype(np.int64)})

    return run


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.9, window: int = 512, miss: float = 1e-3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    Rows link at a cosine of `threshold` or more, in double precision. n_links: rows linked
    directly, other rows of an equal vector included; component_id: the smallest vec_id
    reachable over links; kept: it is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different
    lengths; rows of a null vec_id have 0 links and null in the other columns. Rows that
    share a vec_id count as rows of their own, each compared by its vector. An empty table
    gives an empty one; other columns are not read.

    Passes go on until a pair at the threshold is missed with a mean probability of `miss`
    at most; a pair above it is missed more seldom.
    """
    spark = vectors.sparkSession
    ship(spark)
    element = vectors.schema["embedding"].dataType.elementType
    kind, held = ("<f4", T.FloatType()) if isinstance(element, T.FloatType) else ("<f8", T.DoubleType())
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(T.ArrayType(held)).alias("e"))
    rows = cut(rows.mapInArrow(_classify(kind), "vec_id long, v binary, d binary").withColumn("d", F.when(F.col("vec_id").isNotNull(), F.col("d"))))
    known = rows.where("d is not null")
    # least: the smallest vec_id of an equal vector; n: rows of it; id: a number for the class, whatever the vec_ids.
    classes = cut(known.groupBy("d").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.min("v").alias("v")).withColumn("id", F.xxhash64("d")))
    edges, depths = _passes(classes, range(FIRST), window, threshold, kind)
    needed = passes_needed(depths, agreement(threshold), miss)
    if needed > FIRST:
        edges = edges.unionByName(_passes(classes, range(FIRST, needed), window, threshold, kind)[0])
    comp = cut(components(edges).withColumnRenamed("node", "id"))
    members = cut(classes.join(comp, "id").select("id", F.col("component").alias("c"), "n", "v"))
    # Exact counts in each group of several classes.
    heads = cut(members.where("id = c").select(F.col("c").alias("c2"), F.col("v").alias("w")))
    half = float(np.cos(np.arccos(threshold) / 2)) + 1e-9
    members = cut(members.join(heads, F.col("c") == F.col("c2")).select("id", "c", "n", "v", "w").mapInArrow(_core(half, kind), "id long, c long, n long, v binary, core boolean"))
    sums = cut(members.groupBy("c").agg(F.sum(F.when(F.col("core"), F.col("n"))).alias("cores"), F.count("*").alias("size"), F.count(F.when(~F.col("core"), 1)).alias("others")).withColumnRenamed("c", "c3"))
    told = members.join(sums, F.col("c") == F.col("c3"))
    some = told.where("others > 0")
    few = F.col("size") <= SMALL
    # Groups of a few members are dealt to bins of about BLOCK members, others are their own.
    bins = 1 + (cut(sums.where(few & (F.col("others") > 0)).agg(F.sum("size").alias("n"))).first()["n"] or 0) // BLOCK
    group = F.when(few, F.pmod(F.xxhash64("c"), F.lit(bins))).otherwise(F.col("c")).alias("g")
    deal = lambda count, salt: F.when(few, 0).otherwise(F.pmod(F.xxhash64("id", F.lit(salt)), F.ceil(F.col(count) / BLOCK))).cast("int")
    each = lambda count: F.explode(F.when(few, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil(F.col(count) / BLOCK).cast("int") - 1)))
    q = some.where("not core").select(group, few.alias("few"), deal("others", 1).alias("i"), each("size").alias("j"), "c", "id", "n", "v", "core", F.lit(True).alias("asked"))
    h = some.select(group, few.alias("few"), each("others").alias("i"), deal("size", 2).alias("j"), "c", "id", "n", "v", "core", F.lit(False).alias("asked"))
    counted = q.unionByName(h).groupBy("few", "g", "i", "j").applyInArrow(_count(threshold, kind), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    per = told.join(cut(counted).withColumnRenamed("id", "id2"), F.col("id") == F.col("id2"), "left")
    links = F.coalesce("links", F.lit(0)) + F.when(F.col("core"), F.col("cores") - F.col("n")).otherwise(0)
    per = per.select(F.col("id").alias("id4"), "c", links.alias("others"))
    per = classes.select("id", "d", "n", "least").join(cut(per), F.col("id") == F.col("id4"), "left")
    per = cut(per.select(F.col("d").alias("d2"), "least", F.coalesce("c", "id").alias("c"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    first = cut(per.groupBy("c").agg(F.min("least").alias("component_id")).withColumnRenamed("c", "c5"))
    per = cut(per.join(first, F.col("c") == F.col("c5")).select("d2", "n_links", "component_id"))
    out = rows.join(per, F.col("d") == F.col("d2"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
