"""Benchmark decontamination by suffix arrays of the training texts.

Each task indexes its texts shard by shard: a shard's suffix array holds every suffix of its
texts in the order of their words, as deep as the longest benchmark item. Every benchmark
suffix is binary-searched in it, word by word: the range of suffixes that begin like it
narrows until nothing fits, which gives the longest verbatim matches, and the range that
shares a whole window gives its places. Items that share a window share its range, and count
as one until items are named. A suffix with a word before the end of its window that the
shard lacks is not searched, as it cannot match.

The benchmark is read in blocks of bounded size, of which the driver holds one at a time and
a task searches one at a time; documents are read once and never shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._env import ship, widened

#: Bytes of benchmark text in a block, at most, unless one item is longer.
BLOCK_BYTES = 8 << 20
#: Bytes of training text in a shard, unless one text is longer.
SHARD_BYTES = 2_000_000


@dataclass
class Block:
    """Items of the benchmark: their ids, hashes of all their words, and where each item's begin."""

    names: list
    words: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[str | None, str]]) -> Block:
        data, offsets = W.buffers(pa.array([t for _, t in rows], pa.string()))
        w = W.split(data, offsets, "alnum", lower=True)
        return cls([i for i, _ in rows], w.hashes(), w.first)

    def needed(self, window: int) -> np.ndarray:
        """For the suffix at each word, the words it must share to count; 0 where none are enough."""
        size = np.diff(self.first)
        left = np.repeat(self.first[1:], size) - np.arange(len(self.words))
        need = np.repeat(np.minimum(window, size), size)
        return np.where(left >= need, need, 0)


class SuffixArray:
    """All suffixes of a shard's rows in the order of their words, to a depth of words.

    text: numbers of the words, in the order of their hashes, from 1; 0 after each row.
    order: the suffixes' starts in text.
    """

    def __init__(self, w: W.Words, depth: int):
        self.vocabulary, number = np.unique(w.hashes(), return_inverse=True)
        n = len(w) + len(w.rows) - 1
        self.row_first = w.first[:-1] + np.arange(len(w.rows) - 1)
        self.text = np.zeros(n, np.int64)
        self.text[np.arange(len(w)) + w.row_of()] = number.ravel() + 1
        self.order = np.argsort(self.text, kind="stable")
        first = self.text[self.order]
        self.bounds = np.searchsorted(first, np.arange(len(self.vocabulary) + 2))
        # rank: the first slot of all suffixes that agree so far; only those that share it are sorted on.
        rank = np.append(self.bounds[self.text], -1)
        open_ = self.order[len(w.rows) - 1 :]  # what begins with a row's end need not be sorted
        open_ = open_[np.diff(self.bounds)[self.text[open_]] > 1]
        k = 1
        while k < depth and len(open_):
            mine, after = rank[open_], rank[np.minimum(open_ + k, n)]
            sorted_ = np.argsort(mine * (n + 1) + after + 1)
            open_, mine, after = open_[sorted_], mine[sorted_], after[sorted_]
            fresh = np.append(True, mine[1:] != mine[:-1])
            begin = np.flatnonzero(fresh)
            slot = mine + np.arange(len(open_)) - np.repeat(begin, np.diff(np.append(begin, len(open_))))
            self.order[slot] = open_
            fresh |= np.append(True, after[1:] != after[:-1])
            begin = np.flatnonzero(fresh)
            size = np.diff(np.append(begin, len(open_)))
            rank[open_] = np.repeat(slot[begin], size)
            open_ = open_[np.repeat(size > 1, size)]
            k *= 2

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of word hashes; -1 for words that the shard lacks."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, -1)

    def narrow(self, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each range, whose suffixes agree in `depth` words, the part whose next word is `word`."""

        def bound(least: np.ndarray) -> np.ndarray:
            a, z = lo.copy(), hi.copy()
            while True:
                apart = np.flatnonzero(a < z)
                if not len(apart):
                    return a
                mid = (a[apart] + z[apart]) >> 1
                at = self.order[mid] + depth
                less = self.text[np.minimum(at, len(self.text) - 1)] < least[apart]
                a[apart[less]] = mid[less] + 1
                z[apart[~less]] = mid[~less]

        return bound(word), bound(word + 1)


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, x) with lo[i] <= x < hi[i]."""
    n = hi - lo
    i = np.repeat(np.arange(len(lo)), n)
    return i, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[i]


def _search(array: SuffixArray, block: Block, window: int):
    """(row, first, end, suffix) of the longest match at each place that has one, and distinct (row, item).

    first and end count words of the row; suffix: the word of the block where the match begins.
    """
    number, need = array.numbers(block.words), block.needed(window)
    # Words from here to the first one that the shard lacks, or to the end of the item.
    stop = np.append(np.where(number < 0, np.arange(len(number)), len(number)), len(number))
    stop = np.minimum.accumulate(stop[::-1])[::-1][:-1]
    stop = np.minimum(stop, np.repeat(block.first[1:], np.diff(block.first)))
    at = np.flatnonzero((need > 0) & (stop - np.arange(len(number)) >= need))
    best, whose = np.zeros(len(array.order), np.int32), np.zeros(len(array.order), np.int64)
    of_item = np.repeat(np.arange(len(block.names)), np.diff(block.first))
    lo, hi, depth = array.bounds[number[at]], array.bounds[number[at] + 1], 1
    rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(at):
        whole = np.flatnonzero(need[at] <= depth)
        if len(whole):
            # Ranges of one depth are equal or apart.
            begin, one, of = np.unique(lo[whole], return_index=True, return_inverse=True)
            i, slot = _expand(begin, hi[whole][one])
            best[slot], whose[slot] = depth, at[whole][one][i]
            new = need[at[whole]] == depth
            if new.any():
                row = np.searchsorted(array.row_first, array.order[slot], side="right") - 1
                pair = np.unique(np.stack([i, row], 1), axis=0)  # a row for each range and text
                member = np.unique(np.stack([of.ravel()[new], of_item[at[whole][new]]], 1), axis=0)  # and each range and item
                a = np.searchsorted(member[:, 0], pair[:, 0])
                z = np.searchsorted(member[:, 0], pair[:, 0], side="right")
                p, m = _expand(a, z)
                both = np.unique(pair[p, 1] * len(block.names) + member[m, 1])
                rows.append(both // len(block.names))
                items.append(both % len(block.names))
        on = np.flatnonzero(at + depth < stop[at])
        at, lo, hi = at[on], lo[on], hi[on]
        lo, hi = array.narrow(lo, hi, depth, number[at + depth] if len(at) else at)
        left = np.flatnonzero(lo < hi)
        at, lo, hi, depth = at[left], lo[left], hi[left], depth + 1
    slot = np.flatnonzero(best)
    place = array.order[slot]
    row = np.searchsorted(array.row_first, place, side="right") - 1
    first = place - array.row_first[row]
    both = np.unique(np.concatenate(rows) * max(1, len(block.names)) + np.concatenate(items))
    return row, first, first + best[slot], whose[slot], both // max(1, len(block.names)), both % max(1, len(block.names))


def _longest(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions of the matches that no other one of the row covers, by row and place."""
    order = np.lexsort((-end, first, row))
    row, end = row[order], end[order]
    # Ends in one ascending line for all rows: a match stays if it reaches beyond all before it.
    reach = row * (int(end.max(initial=0)) + 1) + end
    before = np.append(-1, np.maximum.accumulate(reach)[:-1])
    fresh = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    return order[fresh | (reach > before[: len(row)])]


_OUT = {"n_words": "long", "n_hit": "long", "items": "array<string>", "matches": "array<struct<first:long,end:long,item:string,offset:long>>"}


def _scan(blocks: list, window: int, depth: int, text: int, names: list[str]):
    """blocks: broadcast values, each a Block."""

    def run(batches):
        none = np.zeros(0, np.int64)
        for b in batches:
            for at, end, data, offsets in W.chunks(b.column(text), SHARD_BYTES):
                n = end - at
                w = W.split(data, offsets, "alnum", lower=True)
                array = SuffixArray(w, depth) if len(w) and blocks else None
                found, named = [], []
                for held in blocks if array is not None else ():
                    block = held.value
                    row, first, stop, suffix, of_row, item = _search(array, block, window)
                    mine = np.searchsorted(block.first, suffix, side="right") - 1
                    name = np.array([None, *block.names], object)
                    found.append((row, first, stop, name[mine + 1], suffix - block.first[mine]))
                    named.append((of_row, name[item + 1]))
                    if len(blocks) > 1:
                        held.__dict__.pop("_value", None)  # a worker keeps one block at a time; it is read again
                    del block
                del array
                row, first, stop, name, offset = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (none, none, none, none.astype(object), none)
                steps = np.zeros(len(w) + 1, np.int64)
                np.add.at(steps, first + w.first[row], 1)
                np.add.at(steps, stop + w.first[row], -1)
                hit = np.bincount(w.row_of()[np.cumsum(steps[:-1]) > 0], minlength=n)
                some = _longest(row, first, stop)
                row, first, stop, name, offset = (x[some] for x in (row, first, stop, name, offset))
                of_row, item = (np.concatenate(c) for c in zip(*named, strict=True)) if named else (none, none.astype(object))
                order = np.argsort(of_row, kind="stable")
                item, bounds = item[order], np.searchsorted(of_row[order], np.arange(n + 1))
                items = [sorted({x for x in item[a:z] if x is not None}) for a, z in zip(bounds, bounds[1:], strict=False)]
                matches = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()),
                    pa.StructArray.from_arrays([pa.array(first, pa.int64()), pa.array(stop, pa.int64()), pa.array(name, pa.string()), pa.array(offset, pa.int64())], ["first", "end", "item", "offset"]),
                )
                columns = [*b.slice(at, n).columns[: len(names)], pa.array(w.counts.astype(np.int64)), pa.array(hit.astype(np.int64)), pa.array(items, pa.list_(pa.string())), matches]
                yield pa.RecordBatch.from_arrays(columns, [*names, *_OUT])

    return run


def _blocks(benchmark: DataFrame) -> tuple[list, int]:
    """The benchmark as broadcast blocks, and the words of its longest item."""
    sc = benchmark.sparkSession.sparkContext
    out, rows, size, longest = [], [], 0, 0

    def put():
        block = Block.of(rows)
        out.append(sc.broadcast(block))
        return int(np.diff(block.first).max(initial=0))

    items = benchmark.where(F.length("text") > 0).select(F.col("item_id").cast("string"), "text")
    for r in items.toLocalIterator():  # a partition at a time
        rows.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= BLOCK_BYTES:
            longest, rows, size = max(longest, put()), [], 0
    if rows:
        longest = max(longest, put())
    return out, longest


def contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """`docs` with n_words, n_hit, items and matches.

    A window is `window` consecutive words of an item; an item of fewer, but not none, is one
    window. n_hit: words of the text inside any occurrence of a window; items: the item_ids
    (as strings, sorted, without nulls) that have an occurring window; matches: the longest
    verbatim matches (first and end word in the text, an item that holds the words, offset
    in it), without those that another one covers. Words are runs of letters, digits and
    non-ASCII characters, A-Z lower-cased, and equal if their 64-bit hashes are; null texts
    have none. Rows of one item_id are one item in `items`; repeated rows of `docs` get equal
    results. Columns of these names are replaced, all others pass unchanged; with an empty
    benchmark nothing is hit, and empty `docs` give an empty table. A long text is a shard of
    its own, with some hundred bytes a word.
    """
    ship(docs.sparkSession)
    docs = docs.drop(*_OUT)
    names = docs.columns
    blocks, longest = _blocks(benchmark)
    return docs.mapInArrow(_scan(blocks, window, longest, names.index("text"), names), widened(docs, **_OUT))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10) -> DataFrame:
    """The rows of `docs` that hold no benchmark window, columns unchanged."""
    from ._env import free_name

    kept = docs.withColumnsRenamed({c: free_name(f"_{c}", docs.columns) for c in docs.columns if c in _OUT})
    found = contamination(kept, benchmark, window=window).where("n_hit = 0").drop(*_OUT)
    return found.toDF(*docs.columns)


def words_of(text: str | None) -> list[str]:
    """The words of one text, by a regular expression; for small inputs and tests."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
