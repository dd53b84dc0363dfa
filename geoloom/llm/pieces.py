"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

A text, with one space before it, is cut where a run of spaces begins; no piece reaches over
such a cut, so the piece lattice of a text is the product of the lattices of its parts.
Equal parts of a chunk of rows share one lattice. Its edges come from a descent of all
positions at once through a trie of the pieces; characters without a piece are covered by
byte pieces. Forward filtering sums the weights of all paths to each byte, and backward
sampling draws, for all parts at once, an incoming edge in proportion to the weight of the
paths through it. The draws are hashes of (seed, row key, number of the part, step): a row
gets the same pieces wherever and whenever it is encoded. Pieces hold their spaces as such,
a literal U+2581 goes through bytes, and so decoding gives every text back exactly.

A part of many bytes, as texts without spaces have, is filtered alone, in blocks of bytes
that carry the sums before them, in linear time and a few bytes of memory a byte. There a
draw belongs to a place: the edge into each place is drawn at once, and the path follows the
drawn edges back from the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words as W
from ._env import free_name, ship, widened

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose parts share lattices.
_CHUNK = 750_000
#: Bytes of a part that is filtered alone, and bytes of its blocks.
_LONG, _BLOCK = 4_096, 65_536
#: Log weight of a byte piece.
_BYTE = -16.0


class Pieces:
    """A model's pieces: their bytes, weights and trie."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.bytes: list[bytes] = []
        normal, byte = [], np.full(256, -1, np.int64)
        for i in range(n):
            name = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte[int(name[3:5], 16)] = i
                self.bytes.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes.append(b"")
            else:
                raw = name.replace("▁", " ").encode()
                self.bytes.append(raw)
                if b" " not in raw.lstrip(b" "):  # else it would reach over a cut
                    normal.append((sp.get_score(i), i))
        self.byte = byte
        if (byte < 0).any():
            raise ValueError("the model has no byte pieces: not every text could be encoded without loss")
        # Scores of a BPE model are ranks, not probabilities: weights follow Zipf's law of the rank.
        normal.sort(key=lambda x: (-x[0], x[1]))
        children: dict[tuple[int, int], int] = {}
        ids, logs = [-1], [0.0]
        for rank, (_, i) in enumerate(normal):
            node = 0
            for c in self.bytes[i]:
                node = children.setdefault((node, c), len(children) + 1)
                if node == len(ids):
                    ids.append(-1)
                    logs.append(0.0)
            if ids[node] < 0:
                ids[node], logs[node] = i, -float(np.log(rank + 10))
        self.piece, self.log = np.array(ids, np.int32), np.array(logs)
        self.longest = max([4, *(len(self.bytes[i]) for _, i in normal)])
        # The first two bytes are looked up directly, further ones in a hash table.
        self.one, self.two = np.zeros(256, np.int32), np.zeros(65_536, np.int32)
        for (node, c), to in children.items():
            if not node:
                self.one[c] = to
        at = {int(v): c for c, v in enumerate(self.one) if v}
        for (node, c), to in children.items():
            if node in at:
                self.two[at[node] * 256 + c] = to
        self._hash({k[0] * 256 + k[1]: v for k, v in children.items() if k[0] and k[0] not in at})
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in self.bytes])])

    def _hash(self, edges: dict[int, int]) -> None:
        """An open-addressing table of the trie's edges, filled in rounds of one probe each."""
        keys, to = np.array(list(edges), np.int64), np.array(list(edges.values()), np.int32)
        self.bits = int(np.ceil(np.log2(len(keys) * 4 + 2)))
        self.keys, self.to, self.probes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0
        while len(keys):
            slot = self._slot(keys, self.probes)
            free = self.keys[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.keys[slot[put]], self.to[slot[put]] = keys[put], to[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, to = keys[rest], to[rest]
            self.probes += 1

    def _slot(self, key: np.ndarray, probe: int) -> np.ndarray:
        x = (key.astype(np.uint64) + np.uint64(probe * 0x51_7C_C1)) * np.uint64(0x9E3779B97F4A7C15)
        return (x >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node at each byte; 0, the root, where there is none."""
        key = node.astype(np.int64) * 256 + byte
        out = np.zeros(len(key), np.int32)
        left = np.arange(len(key))
        for probe in range(self.probes):
            slot = self._slot(key[left], probe)
            there = self.keys[slot]
            hit = there == key[left]
            out[left[hit]] = self.to[slot[hit]]
            left = left[~hit & (there >= 0)]
            if not len(left):
                break
        return out


class _Lattice:
    """Lattices of byte strings data[lo:hi].

    Nodes are numbered by level: string i, in the order of falling lengths, has its node after
    j bytes at level[j] + rank[i]. So the edges into the nodes of a level are consecutive.
    """

    def __init__(self, p: Pieces, data: np.ndarray, lo: np.ndarray, hi: np.ndarray, alpha: float):
        lens = hi - lo
        order = np.argsort(-lens, kind="stable")
        rank = np.empty(len(lens), np.int64)
        rank[order] = np.arange(len(lens))
        lo, lens = lo[order], lens[order]
        most = int(lens[0]) if len(lens) else 0
        reach = len(lens) - np.searchsorted(lens[::-1], np.arange(most + 1))  # strings of j bytes and more
        level = np.concatenate([[0], np.cumsum(reach)])
        self.base, self.last = rank, (level[lens] + np.arange(len(lens)))[rank]
        # Every byte, level by level: its string, its offset there and its place in data.
        offset = np.repeat(np.arange(most), reach[1:])
        string = np.arange(len(offset)) - np.repeat(np.cumsum(reach[1:]) - reach[1:], reach[1:])
        place = lo[string] + offset
        byte = data[place]
        left = lens[string] - offset
        size = 1 + (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
        covered = np.zeros(len(byte), bool)  # bytes where a single character has a piece
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        at, node, depth = np.arange(len(byte)), p.one[byte], 1
        while True:
            fit = np.flatnonzero(node)
            at, node = at[fit], node[fit]
            ends = np.flatnonzero(p.piece[node] >= 0)
            x, piece = at[ends], node[ends]
            runs.append((level[offset[x]] + string[x], level[offset[x] + depth] + string[x], p.piece[piece], alpha * p.log[piece]))
            if depth <= 4:
                covered[x[size[x] == depth]] = True
            more = np.flatnonzero(left[at] > depth)
            at, node = at[more], node[more]
            if not len(at):
                break
            nxt = data[place[at] + depth]
            node = p.two[byte[at].astype(np.int64) * 256 + nxt] if depth == 1 else p.child(node, nxt)
            depth += 1
        lone = np.flatnonzero(((byte & 0xC0) != 0x80) & ~covered)
        for k in range(4 if len(lone) else 0):
            x = lone[(size[lone] > k) & (left[lone] > k)]
            start = level[offset[x] + k] + string[x]
            runs.append((start, level[offset[x] + k + 1] + string[x], p.byte[data[place[x] + k]].astype(np.int32), np.full(len(x), alpha * _BYTE)))
        # Edges by their end; no run has an end twice, so each takes the next free place of its node.
        total = int(level[-1])
        degree = np.zeros(total, np.int64)
        for _, end, _, _ in runs:
            degree[end] += 1
        self.first = np.cumsum(degree) - degree
        free, n = self.first.copy(), int(degree.sum())
        self.start, self.piece, log = np.empty(n, np.int64), np.empty(n, np.int32), np.empty(n)
        for start, end, piece, weight in runs:
            put = free[end]
            free[end] += 1
            self.start[put], self.piece[put], log[put] = start, piece, weight
        del runs, free
        # Sums are taken edge by edge within each node: no other string may move a draw by rounding.
        forward = np.full(total, -np.inf)
        forward[: reach[0] if len(reach) else 0] = 0.0
        for j in range(1, most + 1):
            a, z = level[j], level[j + 1]
            some = np.flatnonzero(degree[a:z]) + a
            if not len(some):
                continue
            e0, e1 = self.first[some[0]], self.first[some[-1]] + degree[some[-1]]
            v = forward[self.start[e0:e1]] + log[e0:e1]
            group = self.first[some] - e0
            top = np.maximum.reduceat(v, group)
            w = np.exp(v - np.repeat(np.where(np.isfinite(top), top, 0.0), degree[some]))
            with np.errstate(divide="ignore"):
                forward[some] = top + np.log(np.add.reduceat(w, group))
        self.cum = np.full(n, 2.0)  # the last edge of a node takes the rest
        node, k = np.flatnonzero(degree > 1), 0
        summed = np.zeros(len(node))
        while len(node):
            e = self.first[node] + k
            with np.errstate(invalid="ignore"):
                summed = summed + np.exp(forward[self.start[e]] + log[e] - forward[node])
            self.cum[e] = summed
            more = degree[node] > k + 2
            node, summed, k = node[more], summed[more], k + 1

    def sample(self, which: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, how many for each) of a path of lattice which[i], drawn from seed[i]."""
        at, live = self.last[which], np.arange(len(which))
        goal = self.base[which]
        count = np.zeros(len(which), np.int64)
        steps = []
        k = 0
        while len(live):
            with np.errstate(over="ignore"):
                u = (W.mix(seed[live] + np.uint64(k) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(11)) * 2.0**-53
            e = self.first[at]
            go = np.flatnonzero(u >= self.cum[e])
            while len(go):
                e[go] += 1
                go = go[u[go] >= self.cum[e[go]]]
            steps.append((live, self.piece[e]))
            at = self.start[e]
            count[live] += 1
            more = at > goal[live]
            live, at = live[more], at[more]
            k += 1
        ends = np.cumsum(count)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
        for k, (live, piece) in enumerate(steps):
            out[ends[live] - 1 - k] = piece
        return out, count


def _edges(p: Pieces, data: np.ndarray, lo: int, hi: int, alpha: float):
    """(start, end, piece, log weight) of the edges that begin in data[lo:hi], in the order of ends."""
    byte = data[lo:hi]
    size = 1 + (byte >= 0xC0).astype(np.int64) + (byte >= 0xE0) + (byte >= 0xF0)
    covered = np.zeros(hi - lo, bool)
    runs = []
    at, node, depth = np.arange(lo, hi), p.one[byte], 1
    while True:
        fit = np.flatnonzero(node)
        at, node = at[fit], node[fit]
        ends = np.flatnonzero(p.piece[node] >= 0)
        x, piece = at[ends], node[ends]
        runs.append((x, x + depth, p.piece[piece], alpha * p.log[piece]))
        covered[x[size[x - lo] == depth] - lo] = True
        more = np.flatnonzero(at + depth < len(data))
        at, node = at[more], node[more]
        if not len(at):
            break
        nxt = data[at + depth]
        node = p.two[data[at].astype(np.int64) * 256 + nxt] if depth == 1 else p.child(node, nxt)
        depth += 1
    lone = np.flatnonzero(((byte & 0xC0) != 0x80) & ~covered)
    for k in range(4):
        x = lone[size[lone] > k] + lo + k
        runs.append((x, x + 1, p.byte[data[x]].astype(np.int32), np.full(len(x), alpha * _BYTE)))
    start, end, piece, log = (np.concatenate(c) for c in zip(*runs, strict=True))
    order = np.lexsort((start, end))
    return start[order], end[order], piece[order], log[order]


def _long(p: Pieces, data: np.ndarray, seed: np.uint64, alpha: float) -> np.ndarray:
    """Pieces of one long part."""
    n = len(data)
    step, chosen = np.zeros(n + 1, np.int16), np.zeros(n + 1, np.int32)
    before = [1.0]  # sums of the last places before a block; only their ratios count
    for lo in range(0, n, _BLOCK):
        hi = min(n, lo + _BLOCK)
        first = max(0, lo - p.longest)
        while first and data[first] & 0xC0 == 0x80:  # to the first byte of a character
            first -= 1
        start, end, piece, log = _edges(p, data, first, hi, alpha)
        some = (end > lo) & (end <= hi)
        start, piece, log, end = start[some], piece[some], log[some], end[some]
        with np.errstate(over="ignore"):
            draws = (W.mix(seed + np.arange(lo + 1, hi + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(11)) * 2.0**-53
        bounds = np.searchsorted(end, np.arange(lo + 1, hi + 2)).tolist()
        s, w, u = (start - first).tolist(), np.exp(np.maximum(log, -200.0)).tolist(), draws.tolist()
        sums = [0.0] * (lo - first + 1 - len(before)) + before[-(lo - first + 1) :]
        picked = []
        for j in range(hi - lo):
            a, z = bounds[j], bounds[j + 1]
            values = [sums[s[e]] * w[e] for e in range(a, z)]
            total = sum(values)
            rest, e = u[j] * total, a
            for v in values[:-1]:
                rest -= v
                if rest < 0.0:
                    break
                e += 1
            picked.append(e if z > a else -1)
            sums.append(total)
            if 0.0 < total < 1e-30:
                k = len(sums) - 1 - p.longest
                scale = 2.0 ** -math.frexp(total)[1]
                sums[max(0, k) :] = [x * scale for x in sums[max(0, k) :]]
        at = np.array(picked)
        into = np.flatnonzero(at >= 0)
        step[lo + 1 + into] = end[at[into]] - start[at[into]]
        chosen[lo + 1 + into] = piece[at[into]]
        before = sums[-(p.longest + 4) :]
    out, at = [], n
    while at:
        out.append(chosen[at])
        at -= int(step[at])
    return np.array(out[::-1], np.int32)


def _encode(p: Pieces, data: np.ndarray, rows: np.ndarray, key: np.ndarray, alpha: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, offsets of rows in them)."""
    n = len(rows) - 1
    full = np.flatnonzero(np.diff(rows))
    text = np.insert(data, rows[full], 32)
    begins = rows[full] + np.arange(len(full))
    space = text == 32
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[begins] = True
    lo = np.flatnonzero(cut)
    hi = np.append(lo[1:], len(text))
    if not len(lo):
        return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
    part = np.searchsorted(lo, begins)  # first part of each row that has any
    row = np.repeat(np.arange(len(full)), np.diff(np.append(part, len(lo))))
    with np.errstate(over="ignore"):
        of_row = W.mix(key[full] + np.uint64(seed) * np.uint64(0xD6E8FEB86659FD93))
        mine = W.mix(of_row[row] + (np.arange(len(lo)) - part[row]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    # A long row is drawn in groups of parts; parts are independent, so groups change nothing.
    begin = np.unique(np.searchsorted(lo, np.arange(0, len(text), 2 * _CHUNK)))
    drawn = [_draw(p, text[lo[i] : hi[j - 1]], lo[i:j] - lo[i], hi[i:j] - lo[i], mine[i:j], alpha) for i, j in zip(begin, [*begin[1:], len(lo)], strict=True) if i < j]
    ids, count = (np.concatenate(x) for x in zip(*drawn, strict=True))
    of = np.concatenate([[0], np.cumsum(count)])
    per_row = np.zeros(n, np.int64)
    per_row[full] = np.diff(of[np.append(part, len(lo))])
    return ids, np.concatenate([[0], np.cumsum(per_row)])


def _draw(p: Pieces, text: np.ndarray, lo: np.ndarray, hi: np.ndarray, mine: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many for each part) of the parts text[lo:hi]."""
    short = hi - lo <= _LONG
    slo, shi = lo[short], hi[short]
    _, one, which = np.unique(W.runs_hash(text, slo, shi), return_index=True, return_inverse=True) if len(slo) else (None, slo, slo)
    ids, short_count = _Lattice(p, text, slo[one], shi[one], alpha).sample(which, mine[short]) if len(slo) else (np.zeros(0, np.int32), slo)
    count = np.zeros(len(lo), np.int64)
    count[short] = short_count
    alone = {i: _long(p, text[lo[i] : hi[i]], mine[i], alpha) for i in np.flatnonzero(~short).tolist()}
    for i, got in alone.items():
        count[i] = len(got)
    if alone:
        of = np.concatenate([[0], np.cumsum(count)])
        every = np.zeros(int(of[-1]), np.int32)
        every[np.repeat(short, count)] = ids
        for i, got in alone.items():
            every[of[i] : of[i + 1]] = got
        ids = every
    return ids, count


def _decode(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets of rows in them), without each row's first space."""
    lens = p.offset[ids + 1] - p.offset[ids]
    src = np.arange(int(lens.sum())) + np.repeat(p.offset[ids] - (np.cumsum(lens) - lens), lens)
    data = p.flat[src]
    at = np.concatenate([[0], np.cumsum(lens)])[offsets]
    lead = at[:-1][np.diff(at) > 0]
    lead = lead[data[lead] == 32]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], at - np.searchsorted(lead, at)


def _strings(data: np.ndarray, at: np.ndarray, null: np.ndarray) -> pa.Array:
    text = data.tobytes()
    try:
        text.decode()
    except UnicodeDecodeError:  # ids that no text gave
        rows = [text[a:z].decode("utf-8", "replace") for a, z in zip(at, at[1:], strict=False)]
        return pa.array(rows, pa.string(), mask=null)
    out = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
    return pa.compute.if_else(pa.array(null), pa.scalar(None, pa.string()), out) if null.any() else out


def _lists(ids: np.ndarray, at: np.ndarray, null: np.ndarray) -> pa.Array:
    mask = np.append(null, False)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=mask if null.any() else None), pa.array(ids, pa.int32()))


def _nulls(column: pa.Array) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def encode(docs: DataFrame, *, key: Column | str = "doc_id", model: str = MODEL, alpha: float = 1.0, seed: int = 0, verify: bool = False) -> DataFrame:
    """`docs` with token_ids (array<int>) and n_tokens, sampled from the lattice of each text.

    key: what seeds a row's draws; rows of equal keys and texts get equal pieces, null keys
    count as one more value. alpha: the power of the weights, 0 for all paths alike, large
    for the heaviest path. A null text has null ids and 0 tokens; an empty one no ids; an
    empty table gives an empty one. Time and memory grow with a text's bytes, spaces or not.
    verify: adds decoded, the text that the ids give back. Columns of these names are
    replaced, all others pass unchanged.
    """
    ship(docs.sparkSession)
    more = {"token_ids": "array<int>", "n_tokens": "long"} | ({"decoded": "string"} if verify else {})
    docs = docs.drop(*more)
    names, text = docs.columns, docs.columns.index("text")
    schema = widened(docs, **more)
    hidden = free_name("_key", names)
    p = docs.sparkSession.sparkContext.broadcast(Pieces(model))  # bounded by the model's vocabulary

    def run(batches):
        for b in batches:
            k = b.column(len(names)).to_numpy().view(np.uint64)
            for at, end, data, rows in W.chunks(b.column(text), _CHUNK):
                part = b.slice(at, end - at)
                null = _nulls(part.column(text))
                ids, offsets = _encode(p.value, data, rows, k[at:end], alpha, seed)
                columns = [*part.columns[: len(names)], _lists(ids, offsets, null), pa.array(np.diff(offsets))]
                if verify:
                    columns.append(_strings(*_decode(p.value, ids, offsets), null))
                yield pa.RecordBatch.from_arrays(columns, [*names, *more])

    return docs.withColumn(hidden, F.xxhash64(key)).mapInArrow(run, schema)


def decode(tokens: DataFrame, *, model: str = MODEL, out: str = "text") -> DataFrame:
    """`tokens` with the text of its token_ids as column `out`; null for null, empty for none.

    It is the exact inverse of encode(). Ids outside the model raise an error; byte pieces
    that are not UTF-8 become U+FFFD.
    """
    ship(tokens.sparkSession)
    tokens = tokens.drop(out)
    names, at = tokens.columns, tokens.columns.index("token_ids")
    p = tokens.sparkSession.sparkContext.broadcast(Pieces(model))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 1_000):
                part = b.slice(lo, 1_000)
                lists = part.column(at)
                n = lists.value_lengths().fill_null(0).to_numpy()
                ids = lists.flatten().to_numpy(zero_copy_only=False)
                text = _strings(*_decode(p.value, ids, np.concatenate([[0], np.cumsum(n)])), _nulls(lists))
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*names, out])

    return tokens.mapInArrow(run, widened(tokens, **{out: "string"}))
