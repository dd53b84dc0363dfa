"""The packed binary files of points, lines and admin areas, as a source and a sink.

A file is a header, fixed-size records, a payload of coordinates and a pool of strings that
end in NUL. Little endian. The sink is for exchange: it gathers a dataset in one file.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geo
from ..session import ship
from . import tables

# --- Fixed values: the format.
HEADER = struct.Struct("<IIQQQ")
MAGIC = {"points": 0x31544E50, "lines": 0x314E494C, "admins": 0x31314D44}
VERSION = 1
RECORD = {"points": struct.Struct("<qii9I"), "lines": struct.Struct("<q3I4iQI"), "admins": struct.Struct("<qI4iQIB3x")}
NONE = 0xFFFFFFFF
# --- End of fixed values.
_STRINGS = {"points": tables.FIELDS, "lines": ("name", "type", "ref"), "admins": ("name",)}


class BinaryError(ValueError):
    """A file that breaks the format."""


def _text(pool: bytes, at: int) -> str | None:
    if at >= len(pool):
        return None
    return pool[at : pool.index(0, at)].decode() or None


def decode(kind: str, data: bytes) -> list[dict]:
    """The records of one file; BinaryError if it is cut off or of another kind."""
    if len(data) < HEADER.size:
        raise BinaryError("the file is shorter than its header")
    magic, _, n, payload_size, pool_size = HEADER.unpack_from(data)
    if magic != MAGIC[kind]:
        raise BinaryError(f"the file holds no {kind}")
    record = RECORD[kind]
    first = HEADER.size + n * record.size
    if len(data) < first + payload_size + pool_size:
        raise BinaryError("the file is cut off")
    payload, pool = data[first : first + payload_size], data[first + payload_size :][:pool_size]
    coords = lambda at, count: [{"lat": a, "lon": b} for a, b in struct.iter_unpack("<ii", payload[at * 8 : (at + count) * 8])]
    out = []
    for values in record.iter_unpack(data[HEADER.size : first]):
        if kind == "points":
            row = dict(zip(("id", "lat_e7", "lon_e7"), values[:3], strict=True)) | {k: _text(pool, v) for k, v in zip(tables.FIELDS, values[3:], strict=True)}
        elif kind == "lines":
            row = {"id": values[0]} | {k: _text(pool, v) for k, v in zip(_STRINGS[kind], values[1:4], strict=True)} | {"coords": coords(values[8], values[9])}
        else:
            row = {"id": values[0], "name": _text(pool, values[1]), "ring": coords(values[6], values[7]), "admin_level": values[8]}
        out.append(row)
    return out


def encode(kind: str, rows: list[dict]) -> bytes:
    pool, known, payload, records, pairs = bytearray(), {}, bytearray(), bytearray(), 0

    def put(text: str | None) -> int:
        if not text:
            return NONE
        if text not in known:
            known[text] = len(pool)
            pool.extend(text.encode() + b"\0")
        return known[text]

    for r in rows:
        if kind == "points":
            records += RECORD[kind].pack(r["id"], r["lat_e7"], r["lon_e7"], *[put(r[c]) for c in tables.FIELDS])
            continue
        path = r["coords" if kind == "lines" else "ring"]
        box = [r[c] for c in ("min_lat", "max_lat", "min_lon", "max_lon")]
        names = [put(r[c]) for c in _STRINGS[kind]]
        tail = [pairs, len(path)] + ([] if kind == "lines" else [r["admin_level"]])
        records += RECORD[kind].pack(r["id"], *names, *box, *tail)
        for c in path:
            payload += struct.pack("<ii", c["lat"], c["lon"])
        pairs += len(path)
    return HEADER.pack(MAGIC[kind], VERSION, len(rows), len(payload), len(pool)) + bytes(records) + bytes(payload) + bytes(pool)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The rows of all files that match `path`, a file to a task."""
    ship(spark)
    plain = {"points": "id long, lat_e7 int, lon_e7 int, " + ", ".join(f"{c} string" for c in tables.FIELDS), "lines": f"id long, name string, type string, ref string, coords {tables.COORDS}", "admins": f"id long, name string, ring {tables.COORDS}, admin_level short"}[kind]

    schema = to_arrow_schema(StructType.fromDDL(plain))

    def run(batches):
        for b in batches:
            for content in b.column(0):
                rows = decode(kind, content.as_py())
                for i in range(0, max(1, len(rows)), 10_000):
                    yield pa.RecordBatch.from_pylist(rows[i : i + 10_000], schema)

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, plain)
    if kind == "points":
        return rows.select("id", F.lit(None).cast("string").alias("osm_type"), "lat_e7", "lon_e7", *tables.FIELDS, F.array().cast(tables.TAGS).alias("extra_tags"))
    path_column = "coords" if kind == "lines" else "ring"
    return rows.select("*", *geo.bbox(F.col(path_column)))


def load(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """`kind` of a folder that holds <kind>.bin or, without one, <kind>.json."""
    names = {"points": tables.read_points_json, "lines": tables.read_lines_json, "admins": tables.read_admins_json}
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kind}.bin")
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return read(spark, f"{folder}/{kind}.bin", kind)
    return names[kind](spark, f"{folder}/{kind}.json")


def write(df: DataFrame, path: str, kind: str) -> None:
    """One file at a local path. All rows pass the driver: for the exchange of single datasets,
    as the format wants one file; tables go to Parquet by tables.write_dataset()."""
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    with open(path, "wb") as f:
        f.write(encode(kind, rows))
