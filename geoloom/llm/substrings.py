"""Removal of repeated passages: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Every window's hash goes to the bucket of its leading bits, together with the number of the
block of documents that it comes from. A hash that a task has seen twice among some millions
of windows is known to be repeated: its bucket is told so once, whatever the number of its
places, and the answers for its blocks travel apart, dealt evenly over all buckets. So a
passage in a third of all documents costs its buckets one entry for each of those millions.
Buckets find the hashes that came more than once and send them back to their blocks; there
the documents are hashed again, windows with a repeated hash are marked and overlapping ones
merge into maximal intervals. Hashes travel in byte strings of 8 bytes each; texts are
shuffled once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._env import free_name, ship, widened

_WORD_BASE = 0xD6E8FEB86659FD93
#: A task sends what it has hashed after so many windows.
_FLUSH = 3_000_000
#: Block of an entry that only says that its hash is repeated.
_TOLD = -1


def _unique(h: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, block) of entries for buckets, and of answers that are known: each of a repeated hash's blocks once."""
    order = np.argsort(h)
    h, block = h[order], block[order]
    same = h[1:] == h[:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    hm, bm = h[many], block[many]
    order = np.lexsort((hm, bm))
    hm, bm = hm[order], bm[order]
    fresh = np.ones(len(hm), bool)
    fresh[1:] = (hm[1:] != hm[:-1]) | (bm[1:] != bm[:-1])
    told = np.unique(hm)
    return np.concatenate([h[~many], told]), np.concatenate([block[~many], np.full(len(told), _TOLD, block.dtype)]), hm[fresh], bm[fresh]


def _window_hashes(w: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    first = w.windows(size)
    return first, W.runs_hash(w.hashes(), first, first + size, _WORD_BASE)


def _send(size: int, buckets: int):
    def rows(h, block, place):
        h, block, known, of = _unique(np.concatenate(h), np.concatenate(block))
        bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.lexsort((block, bucket))
        yield from packed(h[order], block[order], bucket[order], False)
        # Answers go by any bucket; a run of them is about a bucket's share of these windows.
        step = max(1, -(-len(known) // buckets), 1 << 12)
        yield from packed(known, of, (place + np.arange(len(known)) // step) % buckets, True)

    def packed(h, block, bucket, known):
        if not len(h):
            return
        cut = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cut[1:], len(h))
        runs = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        lens = np.diff(np.append(runs, len(h))).astype(np.int32)
        at = np.searchsorted(runs, np.append(cut, len(h)))
        blocks = block[runs].astype(np.int32)
        yield pa.RecordBatch.from_pydict(
            {
                "bucket": bucket[cut],
                "hashes": pa.array([h[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()),
                "blocks": pa.array([blocks[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                "lens": pa.array([lens[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)], pa.binary()),
                "known": np.full(len(cut), known),
            }
        )

    def run(batches):
        from pyspark import TaskContext

        h, block, held, place = [], [], 0, TaskContext.get().partitionId() * 7_919
        for b in batches:
            of_row = b.column(0).to_numpy()
            for at, end, data, offsets in W.chunks(b.column(1)):
                w = W.split(data, offsets, "spaced", lower=False)
                first, x = _window_hashes(w, size)
                if len(x):
                    h.append(x)
                    block.append(of_row[at:end][np.searchsorted(w.first, first, side="right") - 1].astype(np.int32))
                    held += len(x)
                if held >= _FLUSH:
                    yield from rows(h, block, place)
                    h, block, held, place = [], [], 0, place + 104_729
        if held:
            yield from rows(h, block, place)

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of one bucket: for each block, those of its hashes that came more than once, and the known answers."""
    get = lambda name, kind, rows: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
    entries = lambda rows: (get("hashes", np.uint64, rows), np.repeat(get("blocks", np.int32, rows), get("lens", np.int32, rows)))
    h, block = entries(table.filter(pa.compute.invert(table.column("known"))))
    order = np.argsort(h)
    h, block = h[order], block[order]
    same = h[1:] == h[:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= same
    many[:-1] |= same
    many &= block != _TOLD
    known, of = entries(table.filter(table.column("known")))
    h, block = np.concatenate([h[many], known]), np.concatenate([block[many], of])
    order = np.lexsort((h, block))
    h, block = h[order], block[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (block[1:] != block[:-1])
    h, block = h[fresh], block[fresh]
    cut = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(cut[1:], len(h))
    return pa.table({"block": pa.array(block[cut], pa.int32()), "found": pa.array([h[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary())})


def _texts(out: np.ndarray, begins: np.ndarray, first: np.ndarray) -> pa.Array:
    """Rows first[i]:first[i+1] of space-joined words as strings."""
    lo, hi = begins[first[:-1]], begins[first[1:]]
    drop = hi[hi > lo] - 1
    body = np.delete(out, drop)
    offsets = np.concatenate([[0], np.cumsum(np.maximum(hi - lo - 1, 0))])
    return pa.LargeStringArray.from_buffers(len(lo), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(body.tobytes())).cast(pa.string())


def _mark(data: np.ndarray, offsets: np.ndarray, size: int, known: np.ndarray):
    """(words, removed words, their intervals, kept text) of each row."""
    w = W.split(data, offsets, "spaced", lower=False)
    n = len(w)
    covered = np.zeros(n, bool)
    if len(known) and n:
        first, h = _window_hashes(w, size)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = first[known[at] == h]
        steps = np.zeros(n + 1, np.int32)
        steps[hit] += 1  # no window begins twice
        steps[hit + size] -= 1
        covered = np.cumsum(steps[:n]) > 0
    row = w.row_of()
    removed = np.bincount(row[covered], minlength=len(offsets) - 1)
    edge = np.zeros(n + 1, bool)
    edge[w.first] = True
    prev, after = np.append(False, covered[:-1]), np.append(covered[1:], False)
    lo = np.flatnonzero(covered & (~prev | edge[:n]))
    hi = np.flatnonzero(covered & (~after | edge[1:])) + 1
    base = w.first[row[lo]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(row[lo], np.arange(len(offsets))), pa.int32()),
        pa.StructArray.from_arrays([pa.array(lo - base, pa.int64()), pa.array(hi - base, pa.int64())], ["first", "end"]),
    )
    kept_first = np.concatenate([[0], np.cumsum(~covered)])[w.first]
    w.starts, w.ends = w.starts[~covered], w.ends[~covered]
    return w.counts, removed, spans, _texts(*w.joined(), kept_first)


def _finish(size: int, columns: list[str], text: str, out: list[str]):
    def run(batches):
        now, found, known = None, [], None
        for b in batches:
            block, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(block, prepend=block[:1] - 1) != 0) | (np.diff(kind, prepend=-1) != 0))
            for lo, hi in zip(edges, [*edges[1:], b.num_rows], strict=True):
                if block[lo] != now:
                    now, found, known = block[lo], [], None
                part = b.slice(lo, hi - lo)
                if kind[lo] == 0:
                    found += part.column(2).to_pylist()
                    continue
                if known is None:
                    known = np.sort(np.frombuffer(b"".join(found), np.uint64))
                    found = []
                for at, end, data, offsets in W.chunks(part.column(3 + columns.index(text))):
                    rows = part.slice(at, end - at)
                    words, removed, spans, kept = _mark(data, offsets, size, known)
                    yield pa.RecordBatch.from_arrays([*rows.columns[3:], pa.array(words.astype(np.int64)), pa.array(removed.astype(np.int64)), spans, kept], [*columns, *out])

    return run


#: Bytes of text in a block, and windows in a bucket, about.
_BLOCK_BYTES, _BUCKET_WINDOWS = 2_000_000, 262_144


def repeats(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """`docs` with n_words, n_removed, removed and kept.

    A word is removed if a window of `window` consecutive words of one document covers it
    whose words, in order, also start anywhere else, in the same document or another.
    removed: maximal intervals of such words (first, end; from 0); kept: the other words,
    joined by one space. Words are runs between ASCII white space, unchanged; a null text
    has none, and texts of fewer words than a window lose none. Repeated rows are documents
    of their own; an empty table gives an empty one. Columns of these names are replaced, all
    others pass unchanged. Windows are compared by 64-bit hashes: among n different windows
    a given one is wrongly held for repeated with a chance of about n / 1.8e19, one in two
    million for 10**13 windows. A long text is one task's, with some tens of bytes a word.
    """
    spark = docs.sparkSession
    ship(spark)
    out = ["n_words", "n_removed", "removed", "kept"]
    docs = docs.drop(*out)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = 1 + size // _BLOCK_BYTES, 1 + size // (6 * _BUCKET_WINDOWS)
    taken = docs.columns
    block, kind, found = (free_name(x, taken) for x in ("_block", "_kind", "_found"))
    key = [F.col(c) for c in ("doc_id", "text") if c in taken]
    numbered = docs.select(F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int").alias(block), F.lit(1).alias(kind), F.lit(None).cast("binary").alias(found), *[docs[c] for c in taken])
    sent = numbered.select(block, "text").mapInArrow(_send(window, buckets), "bucket long, hashes binary, blocks binary, lens binary, known boolean")
    back = sent.groupBy("bucket").applyInArrow(_repeated, "block int, found binary")
    back = back.select(F.col("block").alias(block), F.lit(0).alias(kind), F.col("found").alias(found), *[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields])
    both = back.union(numbered).repartition(block).sortWithinPartitions(block, kind)
    schema = widened(docs, n_words="long", n_removed="long", removed="array<struct<first:long,end:long>>", kept="string")
    return both.mapInArrow(_finish(window, taken, "text", out), schema)


def cut_repeats(docs: DataFrame, *, window: int = 35) -> DataFrame:
    """All rows of `docs` with repeated passages cut from their texts, columns unchanged.

    Texts that lose nothing stay as they are, white space included; what is left of others
    is joined by single spaces. A column n_chars, if there is one, follows the new text.
    """
    own = ("n_words", "n_removed", "removed", "kept")
    aside = {c: free_name(f"_{c}", docs.columns) for c in docs.columns if c in own}
    found = repeats(docs.withColumnsRenamed(aside), window=window)
    cut = F.col("n_removed") > 0
    changed = {"text": F.when(cut, F.col("kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.withColumns(changed).drop(*own).withColumnsRenamed({new: old for old, new in aside.items()}).select(*docs.columns)
