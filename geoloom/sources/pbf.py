"""A Spark data source for OpenStreetMap PBF files: spark.read.format("osmpbf").

Options: path, and entity: nodes, ways or relations. The driver walks the length-prefixed
block headers once; every input partition is a run of blocks, which its task inflates and
decodes by itself. Fields are read by a small protocol-buffer reader.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

TAGS = "array<struct<k:string,v:string>>"
SCHEMAS = {
    "nodes": f"id long, lat_e7 int, lon_e7 int, tags {TAGS}",
    "ways": f"id long, refs array<long>, tags {TAGS}",
    "relations": f"id long, members array<struct<type:string,ref:long,role:string>>, tags {TAGS}",
}
#: Bytes of compressed blocks in an input partition.
PARTITION_BYTES = 16 << 20


class PbfError(ValueError):
    """A file that breaks the format."""


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data):
            raise PbfError("a number is cut off")
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message: numbers for varints, bytes for the rest."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            if kind == 2:
                n, at = varint(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise PbfError(f"a field of wire type {kind}")
            if at + n > len(data):
                raise PbfError("a field is cut off")
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(data):
        n, at = varint(data, at)
        out.append(zigzag(n) if signed else n)
    return out


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blocks(path: str) -> list[tuple[int, int, str]]:
    """(offset of the blob, its size, its type) of every block."""
    out = []
    with open(path, "rb") as f:
        while head := f.read(4):
            if len(head) < 4:
                raise PbfError("the file is cut off in a header's length")
            n = struct.unpack(">I", head)[0]
            header = f.read(n)
            if len(header) < n:
                raise PbfError("the file is cut off in a header")
            got = dict(fields(header))
            size = got[3]
            out.append((f.tell(), size, got[1].decode()))
            f.seek(size, 1)
        if out and f.seek(0, 2) < out[-1][0] + out[-1][1]:
            raise PbfError("the file is cut off in a block")
    return out


def inflate(blob: bytes) -> bytes:
    got = dict(fields(blob))
    if 1 in got:
        return got[1]
    if 3 in got:
        return zlib.decompress(got[3])
    raise PbfError("a block that is neither raw nor of zlib")


class _Block:
    def __init__(self, data: bytes):
        self.groups, self.granularity, self.lat0, self.lon0, strings = [], 100, 0, 0, b""
        for n, v in fields(data):
            if n == 1:
                strings = v
            elif n == 2:
                self.groups.append(v)
            elif n == 17:
                self.granularity = v
            elif n == 19:
                self.lat0 = v
            elif n == 20:
                self.lon0 = v
        self.strings = [v.decode("utf-8", "replace") for n, v in fields(strings) if n == 1]

    def e7(self, raw: int, base: int) -> int:
        """By way of degrees in double precision, truncated."""
        return int((base + self.granularity * raw) * 1e-9 * 1e7)

    def tags(self, keys: list[int], values: list[int]) -> list[tuple[str, str]]:
        return [(self.strings[k], self.strings[v]) for k, v in zip(keys, values, strict=True)]

    def rows(self, entity: str) -> Iterator[tuple]:
        for group in self.groups:
            for n, v in fields(group):
                if entity == "nodes" and n == 1:
                    yield self._node(v)
                elif entity == "nodes" and n == 2:
                    yield from self._dense(v)
                elif entity == "ways" and n == 3:
                    yield self._way(v)
                elif entity == "relations" and n == 4:
                    yield self._relation(v)

    def _node(self, data: bytes) -> tuple:
        got = dict(fields(data))
        lat, lon = self.e7(zigzag(got[8]), self.lat0), self.e7(zigzag(got[9]), self.lon0)
        return zigzag(got[1]), lat, lon, self.tags(packed(got.get(2, b"")), packed(got.get(3, b"")))

    def _dense(self, data: bytes) -> Iterator[tuple]:
        got = dict(fields(data))
        ids, lats, lons = (_running(packed(got.get(n, b""), signed=True)) for n in (1, 8, 9))
        flat, at = packed(got.get(10, b"")), 0
        for i, y, x in zip(ids, lats, lons, strict=True):
            tags = []
            while at < len(flat) and flat[at]:
                tags.append((self.strings[flat[at]], self.strings[flat[at + 1]]))
                at += 2
            at += 1
            yield i, self.e7(y, self.lat0), self.e7(x, self.lon0), tags

    def _way(self, data: bytes) -> tuple:
        got = dict(fields(data))
        return got[1], _running(packed(got.get(8, b""), signed=True)), self.tags(packed(got.get(2, b"")), packed(got.get(3, b"")))

    def _relation(self, data: bytes) -> tuple:
        got = dict(fields(data))
        roles, refs, kinds = packed(got.get(8, b"")), _running(packed(got.get(9, b""), signed=True)), packed(got.get(10, b""))
        members = [("nwr"[k], r, self.strings[s]) for s, r, k in zip(roles, refs, kinds, strict=True)]
        return got[1], members, self.tags(packed(got.get(2, b"")), packed(got.get(3, b"")))


class _Run(InputPartition):
    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = spans


class PbfReader(DataSourceReader):
    def __init__(self, path: str, entity: str):
        self.path, self.entity = path, entity

    def partitions(self):
        out, now, size = [], [], 0
        for at, n, kind in blocks(self.path):
            if kind != "OSMData":
                continue
            now.append((at, n))
            size += n
            if size >= PARTITION_BYTES:
                out.append(_Run(now))
                now, size = [], 0
        return [*out, _Run(now)] if now or not out else out

    def read(self, partition):
        with open(self.path, "rb") as f:
            for at, n in partition.spans:
                f.seek(at)
                blob = f.read(n)
                if len(blob) < n:
                    raise PbfError("the file is cut off in a block")
                yield from _Block(inflate(blob)).rows(self.entity)


class PbfSource(DataSource):
    """The path must be one that every executor can open, such as a mounted share."""

    @classmethod
    def name(cls):
        return "osmpbf"

    def schema(self):
        return SCHEMAS[self.options.get("entity", "nodes")]

    def reader(self, schema):
        return PbfReader(self.options["path"], self.options.get("entity", "nodes"))


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(PbfSource)


def read(spark: SparkSession, path: str):
    """(nodes, ways, relations) of a file."""
    register(spark)
    return tuple(spark.read.format("osmpbf").option("path", path).option("entity", e).load() for e in SCHEMAS)
