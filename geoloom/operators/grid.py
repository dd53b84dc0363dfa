"""Point in polygon over Arrow batches, for polygons that fit in a broadcast.

All polygons are arrays: their edges by rows of grid cells, and a state for each cell of a
polygon's bounding box - outside, wholly inside, or met by an edge. A batch of points is
tested at once: each point's cell names its candidates, wholly covered ones are hits, and of
the others only the edges in the cell's row are counted against the ray.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Cell sizes to choose from, and how many cells a polygon may take on average.
SIZES = tuple(50_000 << i for i in range(11))
CELLS_PER_POLYGON = 64
#: Pairs of a point and an edge that are tested at once.
_PAIRS = 2_000_000

OUTSIDE, WHOLE, MET = 0, 1, 2


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, first[i] + 0 .. count[i] - 1) for every i."""
    ends = np.cumsum(count)
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count) + np.repeat(first, count)


class Grid:
    """Polygons in the order of rows of a table with ring (list of lat, lon)."""

    def __init__(self, rings: pa.Array, degrees: bool = False):
        if isinstance(rings, pa.ChunkedArray):
            rings = rings.combine_chunks()
        self.degrees = degrees
        size = rings.value_lengths().to_numpy().astype(np.int64)
        flat = rings.flatten()
        lat, lon = (flat.field(f).to_numpy().astype(np.int64) for f in ("lat", "lon"))
        poly = np.repeat(np.arange(len(size)), size)
        first = np.cumsum(size) - size
        nxt = np.arange(len(lat)) + 1
        nxt[first + size - 1] = first
        self.box = [f.reduceat(x, first) if len(first) else first for x in (lat, lon) for f in (np.minimum, np.maximum)]
        edge = [lat, lon, lat[nxt], lon[nxt]] if len(lat) else [lat, lon, lat, lon]
        most = max(4_096, CELLS_PER_POLYGON * len(size))
        for self.size in SIZES:
            self.y0, y1, self.x0, x1 = (x // self.size for x in self.box)
            self.high, self.wide = y1 - self.y0 + 1, x1 - self.x0 + 1
            if (self.high * self.wide).sum() <= most:
                break
        # Edges by the row of cells that they reach; level ones are only met.
        up, down = np.maximum(edge[0], edge[2]), np.minimum(edge[0], edge[2])
        e, row = spread(down // self.size, up // self.size - down // self.size + 1)
        self.row_first = np.cumsum(self.high) - self.high
        at = self.row_first[poly[e]] + row - self.y0[poly[e]]
        tall = up[e] > down[e]
        order = np.argsort(at[tall], kind="stable")
        self.edges = [x[e[tall][order]] for x in edge]
        rows = int(self.high.sum())
        self.bounds = np.searchsorted(at[tall][order], np.arange(rows + 1))
        self.cell_first = np.cumsum(self.high * self.wide) - self.high * self.wide
        state = np.zeros(int((self.high * self.wide).sum()), np.uint8)
        left, right = np.minimum(edge[1], edge[3])[e] // self.size, np.maximum(edge[1], edge[3])[e] // self.size
        i, x = spread(left, right - left + 1)
        p = poly[e][i]
        state[self.cell_first[p] + (row[i] - self.y0[p]) * self.wide[p] + x - self.x0[p]] = MET
        # A cell that no edge meets is inside or outside as its corner is.
        free = np.flatnonzero(state == OUTSIDE)
        p = np.searchsorted(self.cell_first, free, side="right") - 1
        rel = free - self.cell_first[p]
        y, x = rel // np.maximum(self.wide[p], 1) + self.y0[p], rel % np.maximum(self.wide[p], 1) + self.x0[p]
        state[free[self._odd(p, y * self.size, x * self.size)]] = WHOLE
        some = np.flatnonzero(state)
        p = np.searchsorted(self.cell_first, some, side="right") - 1
        rel = some - self.cell_first[p]
        key = self._key(rel // self.wide[p] + self.y0[p], rel % self.wide[p] + self.x0[p]) if len(some) else some
        order = np.lexsort((p, key))
        self.keys, start = np.unique(key[order], return_index=True)
        self.starts = np.append(start, len(order))
        self.polys, self.met = p[order], state[some][order] == MET

    @staticmethod
    def chains(place: np.ndarray, poly: np.ndarray, parent: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, polygon) of each place's chain from its first root down, by place, then by depth.

        place, poly: hits in their order; parent: each polygon's parent or -1.
        """
        n = len(parent) + 1
        key = place * n + parent[poly] + 1
        order = np.lexsort((poly, key))
        keys, first = np.unique(key[order], return_index=True)
        child = poly[order][first]
        at, now = np.unique(place), -1
        out_place, out_poly, out_depth = [], [], []
        now = np.full(len(at), -1)
        for d in range(depth):
            slot = np.minimum(np.searchsorted(keys, at * n + now + 1), max(0, len(keys) - 1))
            there = keys[slot] == at * n + now + 1 if len(keys) else np.zeros(0, bool)
            at, now = at[there], child[slot[there]]
            if not len(at):
                break
            out_place.append(at)
            out_poly.append(now)
            out_depth.append(np.full(len(at), d))
        if not out_place:
            return place[:0], poly[:0]
        at, now, deep = map(np.concatenate, (out_place, out_poly, out_depth))
        order = np.lexsort((deep, at))
        return at[order], now[order]

    @staticmethod
    def _key(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return (y << 32) + x

    def _odd(self, p: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        """Whether each place is inside its polygon: an odd number of edges crosses the ray from it."""
        row = self.row_first[p] + lat // self.size - self.y0[p]
        lo, many = self.bounds[row], self.bounds[row + 1] - self.bounds[row]
        out, done = np.zeros(len(p), bool), 0
        ends = np.cumsum(many)
        while done < len(p):
            upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + _PAIRS, side="right")))
            i, e = spread(lo[done:upto], many[done:upto])
            y, x = lat[done:upto][i], lon[done:upto][i]
            lat0, lon0, lat1, lon1 = (v[e] for v in self.edges)
            over = (lat0 > y) != (lat1 > y)
            if self.degrees:
                y, x, lat0, lon0, lat1, lon1 = (v[over] / 1e7 for v in (y, x, lat0, lon0, lat1, lon1))
                hit = (lon1 - lon0) * (y - lat0) / (lat1 - lat0) + lon0 > x
            else:
                y, x, lat0, lon0, lat1, lon1 = (v[over] for v in (y, x, lat0, lon0, lat1, lon1))
                left = (lon0 - x) * (lat1 - lat0) + (y - lat0) * (lon1 - lon0)
                hit = np.where(lat1 > lat0, left > 0, left < 0)
            out[done:upto] = np.bincount(i[over][hit], minlength=upto - done) % 2 == 1
            done = upto
        return out

    def hits(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, polygon) of all that contain it, by place, then by polygon."""
        lat, lon = lat.astype(np.int64), lon.astype(np.int64)
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        key = self._key(lat // self.size, lon // self.size)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        many = np.where(self.keys[at] == key, self.starts[at + 1] - self.starts[at], 0)
        i, slot = spread(self.starts[at], many)
        p, sure = self.polys[slot], ~self.met[slot]
        near = (lat[i] >= self.box[0][p]) & (lat[i] <= self.box[1][p]) & (lon[i] >= self.box[2][p]) & (lon[i] <= self.box[3][p])
        ask = np.flatnonzero(near & ~sure)
        sure &= near
        sure[ask] = self._odd(p[ask], lat[i[ask]], lon[i[ask]])
        return i[sure], p[sure]
