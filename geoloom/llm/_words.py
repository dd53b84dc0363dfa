"""Vectorised word splitting and hashing over the UTF-8 buffers of Arrow string columns.

No Python object is made for a word: a chunk of rows is one uint8 array, words are
(start, end) pairs into it, and word hashes come from prefix sums of a polynomial, so
that the cost of a row depends on its bytes only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows are handled in chunks of about so many bytes; a longer row is a chunk by itself.
CHUNK_BYTES = 2_000_000

_BASE = 0x9E3779B97F4A7C55 | 1
_MASK = (1 << 64) - 1


def _class(pattern: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[128:] = True
    for c in range(128):
        if pattern == "alnum":  # after lower-casing: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
            table[c] = 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A
        else:  # [^\x20\x09-\x0D]
            table[c] = not (c == 0x20 or 0x09 <= c <= 0x0D)
    return table


ALNUM, SPACED = _class("alnum"), _class("spaced")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    p, q = _powers.get(base, (np.zeros(0, np.uint64),) * 2)
    if len(p) < n:
        size = max(n, 1 << 16)
        inv = pow(base, -1, 1 << 64)
        p, q = np.full(size, base, np.uint64), np.full(size, inv, np.uint64)
        p[0] = q[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(p, out=p)
            np.cumprod(q, out=q)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = p, q
    return p[:n], q[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, for each element of a uint64 array."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair, by one prefix sum."""
    p, q = powers(len(values) + 1, base)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * p[: len(values)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * q[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _long_hash(values: np.ndarray, base: int = _BASE) -> np.uint64:
    """runs_hash() of all of `values`, block by block."""
    total, p = 0, powers(CHUNK_BYTES, base)[0]
    for at in range(0, len(values), CHUNK_BYTES):
        part = values[at : at + CHUNK_BYTES].astype(np.uint64)
        with np.errstate(over="ignore"):
            total += int((part * p[: len(part)]).sum(dtype=np.uint64)) * pow(base, at, 1 << 64)
    return mix(np.array([(total + len(values) * 0x9E3779B97F4A7C15) & _MASK], np.uint64))[0]


class Words:
    """The words of some rows.

    data: bytes of all rows; rows: offsets of rows in data; starts, ends: of words in
    data; first: offsets of rows in the list of words.
    """

    def __init__(self, data: np.ndarray, rows: np.ndarray, table: np.ndarray, lower: bool):
        self.raw = data
        self.data = _LOWER[data] if lower else data
        self.rows = rows
        n = len(data)
        inside = table[self.data]
        edge = np.zeros(n + 1, bool)
        edge[rows] = True
        prev = np.zeros(n, bool)
        prev[1:] = inside[:-1]
        begins = inside & (~prev | edge[:n])
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        closes = inside & (~after | edge[1:])
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.starts, rows)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """Hashes of the words; bytes are taken in blocks, so that a long row needs no long prefix sums."""
        n = len(self)
        if not n or self.ends[-1] <= 2 * CHUNK_BYTES:
            return runs_hash(self.data, self.starts, self.ends)
        out, i = np.empty(n, np.uint64), 0
        while i < n:
            lo = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, lo + CHUNK_BYTES, side="right")))
            if self.ends[j - 1] - lo <= CHUNK_BYTES:
                out[i:j] = runs_hash(self.data[lo : self.ends[j - 1]], self.starts[i:j] - lo, self.ends[i:j] - lo)
            else:
                out[i] = _long_hash(self.data[lo : self.ends[i]])
            i = j
        return out

    def windows(self, size: int) -> np.ndarray:
        """Starts of all windows of `size` words that lie in one row."""
        n = len(self)
        if n < size:
            return np.zeros(0, np.int64)
        last = np.repeat(self.first[1:], self.counts)  # end of the row of each word
        at = np.arange(n - size + 1)
        return at[at + size <= last[: n - size + 1]]

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """The words joined by single spaces in one new array, and where each begins in it."""
        lens = self.ends - self.starts
        begins = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens + 1, out=begins[1:])
        out = np.full(begins[-1], 32, np.uint8)
        shift = np.repeat(begins[:-1] - self.starts, lens)
        src = np.arange(int(lens.sum())) + np.repeat(self.starts - (begins[:-1] - np.arange(len(lens))), lens)
        out[src + shift] = self.data[src]
        return out, begins


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not large and not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows of about `size` bytes."""
    data, rows = buffers(column)
    n, at = len(rows) - 1, 0
    while at < n:
        end = int(np.searchsorted(rows, rows[at] + size, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[rows[at] : rows[end]], rows[at : end + 1] - rows[at]
        at = end


def overlapping(data: np.ndarray, kind: str, lower: bool, overlap: int, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of one long row in pieces; each begins with the last `overlap` words of the one before.

    So every run of overlap + 1 words is in one piece only.
    """
    table, lo, n = ALNUM if kind == "alnum" else SPACED, 0, len(data)
    if lower:
        data = _LOWER[data]
    while True:
        hi = min(lo + size, n)
        while hi < n and table[data[hi]]:  # to the end of the word
            gap = np.flatnonzero(~table[data[hi : hi + 65_536]])
            hi = hi + int(gap[0]) if len(gap) else min(hi + 65_536, n)
        w = Words(data[lo:hi], np.array([0, hi - lo]), table, False)
        if hi < n and len(w) <= overlap:  # too few words to go on from
            size *= 2
            continue
        yield w
        if hi == n:
            return
        lo += int(w.starts[len(w) - overlap]) if overlap else hi - lo


def split(data: np.ndarray, rows: np.ndarray, kind: str, lower: bool) -> Words:
    """kind "alnum": runs of a-z, 0-9 and non-ASCII bytes; "spaced": runs between ASCII white space."""
    return Words(data, rows, ALNUM if kind == "alnum" else SPACED, lower)
