"""SimHash near-duplicates by vantage-point trees.

A fingerprint holds, for each of 64 bits, whether over half of the text's shingle hashes
have it set. Distinct fingerprints are dealt to shards by their Hamming distances from a
series of vantage points: each point halves the space at a fixed distance, and by the
triangle inequality two fingerprints within r of each other either fall on the same side or
both lie within r of the boundary. So a fingerprint is indexed in its own shard and asked in
every shard that its ball reaches, and no pair is lost. In a shard a vantage-point tree
answers the balls exactly; what leaves it is a spanning forest of the links, not the pairs.
The number of vantage points follows the number of fingerprints, and shards that hold many
are split by dealing out the questions over copies of the index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._env import cut, free_name, ship, widened
from ._graph import components, forest

_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


#: Tables of so many rows of two numbers are broadcast, larger ones are joined by shuffles.
BROADCAST_ROWS = 500_000


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each data[start:end]; slices of equal length go through each step together."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    lens = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    u64 = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    u32 = np.ndarray((len(data) + 1,), "<u4", padded, strides=(1,))
    order = np.argsort(lens, kind="stable")
    bounds = np.flatnonzero(np.diff(lens[order], prepend=-1))
    s0 = np.uint64(seed)
    with np.errstate(over="ignore"):
        for lo, hi in zip(bounds, [*bounds[1:], len(order)], strict=True):
            which = order[lo:hi]
            at, n = starts[which], int(lens[which[0]])
            p = 0
            if n >= 32:
                v = [np.full(len(at), x, np.uint64) for x in (s0 + _P1 + _P2, s0 + _P2, s0, s0 - _P1)]
                while p + 32 <= n:
                    for i in range(4):
                        v[i] = _rotl(v[i] + u64[at + p + 8 * i] * _P2, 31) * _P1
                    p += 32
                h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
                for x in v:
                    h = (h ^ (_rotl(x * _P2, 31) * _P1)) * _P1 + _P4
            else:
                h = np.full(len(at), s0 + _P5, np.uint64)
            h = h + np.uint64(n)
            while p + 8 <= n:
                h = _rotl(h ^ (_rotl(u64[at + p] * _P2, 31) * _P1), 27) * _P1 + _P4
                p += 8
            if p + 4 <= n:
                h = _rotl(h ^ (u32[at + p].astype(np.uint64) * _P1), 23) * _P2 + _P3
                p += 4
            while p < n:
                h = _rotl(h ^ (data[at + p].astype(np.uint64) * _P5), 11) * _P1
                p += 1
            h = (h ^ (h >> np.uint64(33))) * _P2
            h = (h ^ (h >> np.uint64(29))) * _P3
            out[which] = h ^ (h >> np.uint64(32))
    return out


#: Bytes of a text that is cut into pieces.
_LONG = 2_000_000


def _ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def _long_fingerprint(data: np.ndarray, shingle: int) -> np.uint64:
    """The fingerprint of one long text, piece by piece."""
    ones, n = np.zeros(64, np.int64), 0
    for w in W.overlapping(data, "spaced", True, shingle - 1, _LONG // 2):
        if len(w) < shingle:  # the whole text
            return _fingerprints(w.data, np.array([0, len(w.data)]), shingle)[0] if len(w) else np.uint64(0)
        text, begins = w.joined()
        first = np.arange(len(w) - shingle + 1)
        ones += _ones(xxh64(text, begins[first], begins[first + shingle] - 1))
        n += len(first)
    return ((2 * ones > n) * (np.uint64(1) << np.arange(64, dtype=np.uint64))).sum(dtype=np.uint64)


def _fingerprints(data: np.ndarray, rows: np.ndarray, shingle: int) -> np.ndarray:
    w = W.split(data, rows, "spaced", lower=True)
    if len(data) > _LONG and len(rows) == 2 and len(w) >= shingle:
        del w
        return np.array([_long_fingerprint(data, shingle)], np.uint64)
    text, begins = w.joined()
    counts, n = w.counts, len(rows) - 1
    first = w.windows(shingle)
    per_row = np.maximum(counts - shingle + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    starts = np.concatenate([begins[first], begins[w.first[short]]])
    ends = np.concatenate([begins[first + shingle] - 1, begins[w.first[short + 1]] - 1])
    h = xxh64(text, starts, ends)
    out = np.zeros(n, np.uint64)
    weight = np.uint64(1) << np.arange(64, dtype=np.uint64)
    some = np.flatnonzero(per_row)
    if len(some):
        at = np.concatenate([[0], np.cumsum(per_row[some])])
        lo = 0
        while lo < len(some):  # rows, whose bits are unpacked together
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 16), side="right")) - 1)
            bits = np.unpackbits(h[at[lo] : at[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, at[lo:hi] - at[lo], axis=0, dtype=np.int32)
            out[some[lo:hi]] = ((2 * ones > per_row[some[lo:hi], None]) * weight).sum(1, dtype=np.uint64)
            lo = hi
    out[short] = h[len(first) :]
    return out


def fingerprint(docs: DataFrame, *, shingle: int = 3, out: str = "fingerprint") -> DataFrame:
    """`docs` with the SimHash of each whole text as a signed long; zero where it has no words.

    Words are runs between ASCII white space, A-Z lower-cased; shingles count as often as
    they occur; a text of fewer words is one shingle. Null texts have no words. Texts of over
    2 MB are taken in pieces, so that memory follows their bytes and not 64 bits of each word.
    """
    ship(docs.sparkSession)
    docs = docs.drop(out)
    text = docs.columns.index("text")
    schema = widened(docs, **{out: "long"})

    def run(batches):
        for b in batches:
            f = np.zeros(b.num_rows, np.uint64)
            for at, end, data, rows in W.chunks(b.column(text), 500_000):
                f[at:end] = _fingerprints(data, rows, shingle)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(f.view(np.int64))], [*b.schema.names, out])

    return docs.mapInArrow(run, schema)


class VPTree:
    """Vantage-point tree over distinct uint64 fingerprints.

    A node splits what it holds at the median distance from its first member.
    """

    def __init__(self, points: np.ndarray, leaf: int = 64):
        self.points, self.leaf = points, leaf
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray) -> int:
        me = len(self.nodes)
        self.nodes.append(())
        if len(ids) > self.leaf:
            d = np.bitwise_count(self.points[ids] ^ self.points[ids[0]])
            m = int(np.median(d))
            near = d <= m
            if not near.all():
                self.nodes[me] = (self.points[ids[0]], m, self._build(ids[near]), self._build(ids[~near]))
                return me
        self.nodes[me] = (None, ids, 0, 0)
        return me

    def pairs(self, asked: np.ndarray, radius: int):
        """Yields (positions in `asked`, positions of points) within the radius, in blocks."""
        stack = [(self.root, np.arange(len(asked)))]
        while stack:
            node, q = stack.pop()
            if not len(q):
                continue
            v, m, near, far = self.nodes[node]
            if v is None:
                for i in range(0, len(q), 4096):
                    part = q[i : i + 4096]
                    for j in range(0, len(m), 1024):  # a leaf without spread in its distances may be large
                        ids = m[j : j + 1024]
                        x, y = np.nonzero(np.bitwise_count(asked[part, None] ^ self.points[None, ids]) <= radius)
                        if len(x):
                            yield part[x], ids[y]
                continue
            d = np.bitwise_count(asked[q] ^ v).astype(np.int64)
            stack.append((near, q[d - radius <= m]))
            stack.append((far, q[d + radius > m]))


def _vantage(k: int) -> np.ndarray:
    return W.mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _deal(depth: int, radius: int):
    """Rows (shard, f, home): each fingerprint in its own shard, and asked in later ones that its ball reaches."""

    def run(batches):
        points = _vantage(depth)
        for b in batches:
            f = b.column(0).to_numpy().view(np.uint64)
            own = np.zeros(len(f), np.int64)
            at, shard, used = np.arange(len(f)), np.zeros(len(f), np.int64), None
            for v in points:
                d = np.bitwise_count(f ^ v).astype(np.int64)
                own = own * 2 + (d > 31)
                low, high = d[at] - radius <= 31, d[at] + radius > 31
                at = np.concatenate([at[low], at[high]])
                shard = np.concatenate([shard[low] * 2, shard[high] * 2 + 1])
            used = shard >= own[at]  # a pair meets once, in the later of its two shards
            at, shard = at[used], shard[used]
            for i in range(0, len(at), 100_000):
                x, s = at[i : i + 100_000], shard[i : i + 100_000]
                yield pa.RecordBatch.from_pydict({"shard": s, "f": f[x].view(np.int64), "home": s == own[x]})

    return run


def _search(radius: int):
    def run(table: pa.Table) -> pa.Table:
        f = table.column("f").to_numpy().view(np.uint64)
        home, asked = table.column("home").to_numpy(zero_copy_only=False), table.column("asked").to_numpy(zero_copy_only=False)
        tree = VPTree(f[home])
        q = f[asked]
        nodes = np.concatenate([f[home], q])
        n, root = len(tree.points), None
        a, b = [], []
        held = 0
        root = np.arange(len(nodes))
        for x, y in tree.pairs(q, radius):
            a.append(root[x + n])
            b.append(root[y])
            held += len(x)
            if held > 2_000_000:  # links are folded into the forest as they come
                root = forest(np.concatenate([*a, np.arange(len(nodes))]), np.concatenate([*b, root]), len(nodes))
                a, b, held = [], [], 0
        root = forest(np.concatenate([*a, np.arange(len(nodes))]).astype(np.int64), np.concatenate([*b, root]).astype(np.int64), len(nodes))
        some = nodes != nodes[root]
        pairs = np.unique(np.stack([nodes[some].view(np.int64), nodes[root[some]].view(np.int64)], 1), axis=0) if some.any() else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def links(distinct: DataFrame, *, radius: int = 2, shard_rows: int = 4_096) -> DataFrame:
    """Edges (a, b) of a spanning forest of "differ in at most `radius` bits" over distinct longs `f`."""
    ship(distinct.sparkSession)
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_rows))))
    dealt = distinct.mapInArrow(_deal(depth, radius), "shard long, f long, home boolean")
    # Shards with many questions get copies of their index, and each copy some of the questions.
    sizes = dealt.groupBy("shard").count().where(F.col("count") > 4 * shard_rows)
    sizes = sizes.select("shard", F.ceil(F.col("count") / (4 * shard_rows)).cast("int").alias("copies"))
    sizes = cut(sizes)
    crowded = sizes.count()
    if not crowded:
        dealt = dealt.withColumn("copies", F.lit(1))
    else:
        sizes = F.broadcast(sizes) if crowded <= BROADCAST_ROWS else sizes
        dealt = dealt.join(sizes, "shard", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    mine = F.pmod(F.xxhash64("f"), F.col("copies"))
    part = F.explode(F.when(F.col("home"), F.sequence(F.lit(0).cast("long"), F.col("copies") - F.lit(1).cast("long"))).otherwise(F.array(mine)))
    dealt = dealt.select("shard", "f", "home", mine.alias("mine"), part.alias("part"))
    dealt = dealt.select("shard", "part", "f", "home", (F.col("mine") == F.col("part")).alias("asked"))
    return dealt.groupBy("shard", "part").applyInArrow(_search(radius), "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint as a signed long, component_id) for every row of `docs`.

    Rows link where their fingerprints differ in at most `radius` bits; component_id is the
    smallest doc_id reachable over links. Rows of a null doc_id have a fingerprint and a null
    component_id, and do not link. Texts without words have the fingerprint zero and link
    like any other.
    """
    prints = cut(fingerprint(docs.select("doc_id", "text"), shingle=shingle).select("doc_id", "fingerprint"))
    known = prints.where("doc_id is not null")
    classes = cut(known.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    comp = cut(components(links(classes.select("f"), radius=radius)))
    joined = classes.join(comp, F.col("f") == F.col("node"), "left").withColumn("c", F.coalesce("component", "f"))
    least = cut(joined.where("component is not null").groupBy("c").agg(F.min("least").alias("component_id")))
    told = joined.join(least.withColumnRenamed("c", "c2"), F.col("c") == F.col("c2"), "left")
    # Fingerprints of one document that link with none need no lookup.
    told = cut(told.where("component is not null or n > 1").select("f", F.coalesce("component_id", "least").alias("component_id")))
    out = prints.join(told, (F.col("fingerprint") == F.col("f")) & F.col("doc_id").isNotNull(), "left")
    return out.select("doc_id", "fingerprint", F.coalesce("component_id", "doc_id").alias("component_id"))


#: Shingles of a block, of two of which the texts are compared at once.
_BLOCK = 1 << 20
#: Min-wise hashes whose shingles make the SimHash of a sample.
_CHOSEN = 3


def _shingles(data: np.ndarray, rows: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each row, ascending and each once, and the rows' offsets in them; a text of fewer words is one shingle."""
    w = W.split(data, rows, "spaced", lower=True)
    h, first, counts = w.hashes(), w.windows(shingle), w.counts
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    starts = np.concatenate([first, w.first[short]])
    x = W.runs_hash(h, starts, np.concatenate([first + shingle, w.first[short + 1]]))
    row = np.searchsorted(w.first, starts, side="right") - 1
    order = np.lexsort((x, row))
    x, row = x[order], row[order]
    once = np.ones(len(x), bool)
    once[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    return x[once], np.searchsorted(row[once], np.arange(len(rows)))


def _samples(shingle: int, samples: int):
    """Rows (doc_id, k, samples): a number for the set of shingles, and fingerprints of samples."""

    def run(batches):
        with np.errstate(over="ignore"):
            factor = W.mix(np.arange(1, _CHOSEN * samples + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
        band = W.mix(np.arange(samples, dtype=np.uint64) + np.uint64(0x2545F491))
        for b in batches:
            for at, end, data, rows in W.chunks(b.column(1), 500_000):
                x, begins = _shingles(data, rows, shingle)
                least = np.full((end - at, len(factor)), 0xFFFFFFFF, np.uint32)
                some = np.flatnonzero(np.diff(begins))
                if len(some):
                    for k in range(len(factor)):
                        with np.errstate(over="ignore"):
                            least[some, k] = np.minimum.reduceat(((x * factor[k]) >> np.uint64(32)).astype(np.uint32), begins[some])
                f = np.empty((end - at, samples), np.uint64)
                for k in range(samples):
                    p, q, r = (W.mix(least[:, _CHOSEN * k + i].astype(np.uint64) + (np.uint64(i + 1) << np.uint64(40))) for i in range(_CHOSEN))
                    f[:, k] = ((p & q) | (p & r) | (q & r)) ^ band[k]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(end - at + 1) * samples, pa.int32()), pa.array(f.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), pa.array(W.runs_hash(x, begins[:-1], begins[1:]).view(np.int64)), lists], ["doc_id", "k", "samples"])

    return run


def _sets(shingle: int):
    """Rows (doc_id, k, n, shingles): a number for the set of shingles, their count and hashes."""

    def run(batches):
        for b in batches:
            for at, end, data, rows in W.chunks(b.column(1), 500_000):
                x, begins = _shingles(data, rows, shingle)
                held = pa.Array.from_buffers(pa.large_binary(), end - at, [None, pa.py_buffer(8 * begins), pa.py_buffer(x)]).cast(pa.binary())
                k = pa.array(W.runs_hash(x, begins[:-1], begins[1:]).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), k, pa.array(np.diff(begins)), held], ["doc_id", "k", "n", "shingles"])

    return run


def alike(sets: list[np.ndarray], asked: int, similarity: float) -> np.ndarray:
    """The smallest member of each set's component over links; sets hold distinct numbers.

    The first `asked` sets are compared with all others, or with one another if they are all.
    A pair is only left out if its sets are connected already or their sizes rule a link out.
    """
    total, root = len(sets), np.arange(len(sets))
    n = np.array([len(x) for x in sets])
    begins = np.concatenate([[0], np.cumsum(n)])
    names, code = np.unique(np.concatenate(sets), return_inverse=True)
    mine = np.zeros(len(names), bool)

    def shared(j: np.ndarray) -> np.ndarray:
        size = int(n[j].sum())
        if 4 * size > begins[total] - begins[j[0]]:  # most of what follows: no positions are needed
            sums = np.add.reduceat(mine[code[begins[j[0]] :]], begins[j[0] : total] - begins[j[0]], dtype=np.int64)
            return sums[j - j[0]]
        ends = np.cumsum(n[j])
        at = np.arange(size) + np.repeat(begins[j] - ends + n[j], n[j])
        return np.add.reduceat(mine[code[at]], ends - n[j], dtype=np.int64)

    for i in range(asked):
        lo = i + 1 if asked == total else asked
        j = lo + np.flatnonzero((root[lo:] != root[i]) & (np.minimum(n[lo:], n[i]) / np.maximum(n[lo:], n[i]) >= similarity))
        if not len(j):
            continue
        mine[code[begins[i] : begins[i + 1]]] = True
        first = np.zeros(len(j), bool)
        first[np.unique(root[j], return_index=True)[1]] = True
        for part in (j[first], j[~first]):  # one of each component, then those that are still apart
            part = part[root[part] != root[i]]
            if len(part):
                both = shared(part)
                met = np.zeros(total, bool)
                met[root[part[both / (n[part] + n[i] - both) >= similarity]]] = True
                if met.any():
                    met[root[i]] = True
                    root[met[root]] = np.flatnonzero(met)[0]
        mine[code[begins[i] : begins[i + 1]]] = False
    return root


def _compare(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.filter(pa.array(table.column("n").to_numpy() > 0))  # texts without words are one set
        one = table.column("one").to_numpy(zero_copy_only=False)
        order = np.argsort(~one, kind="stable")
        ids, sets = table.column("doc_id").to_numpy()[order], table.column("shingles").to_pylist()
        if len(order) < 2:
            return pa.table({"a": ids[:0], "b": ids[:0]})
        root = alike([np.frombuffer(sets[i], np.uint64) for i in order], int(one.sum()), similarity)
        some = np.flatnonzero(root != np.arange(len(ids)))
        return pa.table({"a": ids[some], "b": ids[root[some]]})

    return run


def similar(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, samples: int = 8, radius: int = 2) -> DataFrame:
    """(doc_id, component_id) of the rows of `docs` that share `similarity` of their shingles with another.

    One fingerprint of a whole text moves by about ten bits between texts of similarity 0.8,
    too far for a tree to search. So each text has `samples` fingerprints, each of three
    shingles that min-wise hashes choose: two texts of similarity s have one in common with
    probability 1 - (1 - s**3) ** samples, 0.997 at 0.8. Vantage-point trees find the
    fingerprints within `radius` bits. All texts of such a group are compared with one another
    and link if the sets of all their shingles have a Jaccard similarity of `similarity` or
    more. Large groups are dealt to blocks of about _BLOCK shingles, and each two blocks are
    compared in a task, so the work in a group of texts that do not link grows with the square
    of its size. component_id: the smallest doc_id over links; rows that share a doc_id are
    linked. Rows of a null doc_id are left out.
    """
    spark = docs.sparkSession
    ship(spark)
    known = docs.where("doc_id is not null").select("doc_id", "text")
    rows = cut(known.mapInArrow(_samples(shingle, samples), "doc_id long, k long, samples array<long>"))
    # Equal sets are one class, named by its smallest doc_id.
    classes = cut(rows.groupBy("k").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min("samples").alias("samples")))
    flat = classes.select("k", F.explode("samples").alias("f"))
    prints = cut(flat.groupBy("f").agg(F.count("*").alias("n")))
    comp = cut(components(links(prints.select("f"), radius=radius)))
    groups = prints.join(comp, F.col("f") == F.col("node"), "left").where("n > 1 or component is not null")
    groups = cut(groups.select(F.col("f").alias("f2"), F.coalesce("component", "f").alias("g")))
    members = cut(flat.join(groups, F.col("f") == F.col("f2")).select("g", "k").distinct())
    # Groups of the same members count once.
    told = members.groupBy("g").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64("k", F.lit(1))).alias("y")).where("n > 1")
    once = cut(told.groupBy("n", "x", "y").agg(F.min("g").alias("g")).select("g"))
    members = cut(members.join(once, "g", "left_semi"))
    # The sets of those texts only.
    wanted = cut(members.select("k").distinct().join(classes.select("k", "least"), "k").select("least").distinct())
    few = wanted.count() <= BROADCAST_ROWS
    texts = known.join(F.broadcast(wanted) if few else wanted, F.col("doc_id") == F.col("least"), "left_semi")
    sets = texts.mapInArrow(_sets(shingle), "doc_id long, k long, n long, shingles binary")
    sets = cut(sets.groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("shingles").alias("shingles")))
    sizes = members.join(cut(sets.select("k", "n")), "k").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > _BLOCK)
    sizes = cut(sizes.select("g", F.ceil(F.col("n") / _BLOCK).cast("int").alias("parts")))
    crowded = sizes.count()
    if not crowded:
        members = members.withColumn("parts", F.lit(1))
    else:
        sizes = F.broadcast(sizes) if crowded <= BROADCAST_ROWS else sizes
        members = members.join(sizes, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    members = members.withColumn("mine", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    dealt = members.select("g", "k", "mine", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select("g", "k", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") <= F.col("other")).alias("one"))
    pairs = cut(dealt).join(sets, "k").select("g", "i", "j", "one", "doc_id", "n", "shingles")
    edges = pairs.groupBy("g", "i", "j").applyInArrow(_compare(similarity), "a long, b long")
    same = rows.select("doc_id", "k").join(cut(classes.where("n > 1").select("k", "least")), "k").where("doc_id != least")
    edges = cut(edges).unionByName(same.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
    return components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` whose doc_id is the smallest of its group by similar(), columns unchanged.

    Rows of a null doc_id stay. Rows that share a doc_id stay or go together.
    """
    gone = similar(docs, **how).where("doc_id != component_id").select(F.col("doc_id").alias(free_name("_gone", docs.columns)))
    gone = cut(gone)
    few = gone.count() <= BROADCAST_ROWS  # else texts are shuffled by doc_id
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(gone.columns[0]), "left_anti")
