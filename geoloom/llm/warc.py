"""WARC archives of one Zstandard frame per record, with a dictionary in the leading frame.

Layout: a skippable frame of magic 0x184D2A5D holds the dictionary, then every record is a
frame of its own. The archives are written by Spark's text sink, a row being the bytes of a
frame and the line separator an empty skippable frame, which readers of Zstandard pass over;
so they go to any file system that Spark knows, and a file's writer may be lost and started
again. A row, and so a file, holds a bounded number of bytes, or a single record. Reading
takes whole files, loads each one's dictionary, decodes frame by frame and validates headers
and lengths; archives of other writers may be as large as a value of Spark (2 GB).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words as W
from ._env import cut, ship

DICT_MAGIC, EMPTY = 0x184D2A5D, b"P*M\x18\x00\x00\x00\x00"
#: The sink's line separator: a skippable frame without content.
SEPARATOR = EMPTY.decode("ascii")
_DATE = "2024-01-01T00:00:00Z"
_RESPONSE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


def skippable(content: bytes, magic: int = DICT_MAGIC) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


def _odd(c: str) -> bool:
    """Whether a character of a URL would break or be stripped from a header."""
    return c.isspace() or ord(c) < 33 or ord(c) == 127


def record(kind: str, uri: str, page_id: int | None, digest: str, payload: bytes, size: int, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record of an HTTP response; a revisit has its HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {_DATE}"]
    if uri:
        lines.append("WARC-Target-URI: " + "".join(c if not _odd(c) else "".join(f"%{x:02X}" for x in c.encode()) for c in uri))
        if any(map(_odd, uri)):  # the URI as it was, which a header cannot hold
            lines.append(f"X-Raw-Target-URI: {base64.b64encode(uri.encode()).decode()}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_RESPONSE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_ID = re.compile(r"<urn:page:(-?\d+|None)>")


def _headers(raw: bytes, first: str) -> dict[str, str]:
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith(first):
        raise ArchiveError(f"a record begins with {lines[0][:40]!r}")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"a header without a colon: {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse(raw: bytes) -> dict:
    """The fields of one record; ArchiveError if a header, a length or the digest is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("a record's header does not end")
    h = _headers(head, "WARC/1.")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in h:
            raise ArchiveError(f"a record without {name}")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ArchiveError(f"a block of {len(rest) - 4} bytes where the header says {n}")
    web, gap, payload = rest[:n].partition(b"\r\n\r\n")
    if not gap:
        raise ArchiveError("an HTTP header does not end")
    size = int(_headers(web, "HTTP/1.").get("content-length", "-1"))
    kind, ids = h["warc-type"], [_ID.fullmatch(h[k]) for k in ("warc-record-id", "warc-refers-to") if k in h]
    if not all(ids):
        raise ArchiveError("a record id that is none of this archive's")
    page, *to = [None if m[1] == "None" else int(m[1]) for m in ids]
    digest = h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if size != len(payload) or hashlib.sha1(payload).hexdigest() != digest:
            raise ArchiveError(f"the payload of page {page} is not what its header says")
    elif kind != "revisit" or payload or not to:
        raise ArchiveError(f"a record of type {kind!r} with {len(payload)} bytes")
    raw_uri = h.get("x-raw-target-uri")
    uri = base64.b64decode(raw_uri).decode() if raw_uri else h.get("warc-target-uri")
    return {"page_id": page, "url": uri, "record_type": kind, "payload_bytes": size, "payload_digest": digest, "refers_to": to[0] if to else None, "payload": payload if kind == "response" else None}


def frames(data: bytes):
    """The decoded frames of an archive; the dictionary is that of the leading skippable frame."""
    import zstandard

    at, known, plain = 0, None, zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        n = struct.unpack_from("<I", data, 4)[0]
        if 8 + n > len(data):
            raise ArchiveError("the dictionary's frame is cut off")
        held = bytes(data[8 : 8 + n])
        if held[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
            held = plain.decompress(held)
        known, at = zstandard.ZstdCompressionDict(held), 8 + n
    reader = zstandard.ZstdDecompressor(dict_data=known) if known else plain
    view = memoryview(data)
    while at < len(data):
        if len(data) - at >= 8 and 0x184D2A50 <= (magic := struct.unpack_from("<I", data, at)[0]) <= 0x184D2A5F:
            if magic == DICT_MAGIC:
                raise ArchiveError("a second dictionary")
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        one = reader.decompressobj()
        try:
            parts, step = [], 1 << 16
            while not one.eof:
                if at >= len(data):
                    raise ArchiveError("a frame is cut off")
                chunk = view[at : at + step]
                parts.append(one.decompress(chunk))
                at += len(chunk)
            at -= len(one.unused_data)
        except zstandard.ZstdError as e:
            raise ArchiveError(str(e)) from e
        yield b"".join(parts)


def train(samples: list[bytes], size: int = 32_768) -> bytes:
    """A Zstandard dictionary, empty where there is too little to train on."""
    import zstandard

    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _writer(dictionary: bytes, level: int, archive_bytes: int):
    """Rows (value): an archive each, whose records have `archive_bytes` at most unless a single one is longer."""

    def run(batches):
        import zstandard

        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=known, write_checksum=True)
        head = skippable(dictionary)
        out, held = [head], 0

        def archive():
            return pa.RecordBatch.from_pydict({"value": pa.array([b"".join(out)], pa.binary())})

        for b in batches:
            names, html = b.schema.names, b.schema.names.index("html")
            for at, end, data, rows in W.chunks(b.column(html), 1_000_000):
                part = b.slice(at, end - at)
                page, uri, digest, size, kind, to = (part.column(names.index(c)).to_pylist() for c in ("page_id", "url", "digest", "size", "kind", "refers_to"))
                for i in range(end - at):
                    frame = packer.compress(record(kind[i], uri[i] or "", page[i], digest[i], data[rows[i] : rows[i + 1]].tobytes(), size[i], to[i]))
                    if held + len(frame) > archive_bytes and len(out) > 1:
                        yield archive()
                        out, held = [head], 0
                    out.append(frame)
                    held += len(frame)
        if len(out) > 1:
            yield archive()

    return run


def plan(pages: DataFrame, *, least: int = 1_000) -> DataFrame:
    """`pages` (page_id, url, html) with digest, size, kind and refers_to of the record to write.

    Of rows with equal payloads of `least` bytes or more the one of the largest page_id is a
    response and the others revisit it; where several rows share that page_id one of them,
    the first by url, is. Shorter payloads, and groups whose page_ids are all null, are
    responses. A null html is an empty payload.
    """
    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    long = rows.where(F.col("size") >= least)
    # Groups are reduced to their largest member before anything is joined.
    top = F.max(F.struct("page_id", F.coalesce("url", F.lit("")).alias("url"))).alias("top")
    groups = cut(long.groupBy("digest").agg(top, F.count("*").alias("n")).where("n > 1 and top.page_id is not null").select(F.col("digest").alias("d"), F.col("top.page_id").alias("lead")))
    found = rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("size") >= least), "left")
    revisit = F.col("lead").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("lead"))
    return found.select("page_id", "url", "html", "digest", "size", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("lead")).alias("refers_to"))


def _sample(pages: DataFrame, rows: int) -> list[bytes]:
    """Some payloads of 64 K characters at most, to train a dictionary on.

    Keys come first, as numbers: no task sends the driver a payload that is not in the sample.
    """
    key = F.xxhash64("page_id", "url")
    least = pages.select(key.alias("k")).orderBy("k").limit(rows).agg(F.max("k")).first()[0]
    if least is None:
        return []
    found = pages.where((key <= least) & F.length("html").between(1, 65_536)).select("html").limit(rows)
    return [r["html"].encode() for r in found.collect()]


def write(pages: DataFrame, path: str, *, level: int = 3, sample_rows: int = 200, least: int = 1_000, archive_bytes: int = 32 << 20) -> None:
    """Write a record for every row of `pages` to archives below `path`.

    The records of an archive have `archive_bytes` at most, unless a single one is longer,
    whatever a session says of records in a file. The dictionary is trained on a bounded sample: payloads
    of 64 K characters at most among the `sample_rows` rows of lowest hash. It only shortens
    the archives. Characters of a URL that a header cannot hold (white space, controls) are
    percent-encoded there, and a header of its own keeps the URL as it was; an empty URL is
    read back as null. An empty table gives no archive; columns other than page_id, url and
    html are not written, whatever their names.
    """
    ship(pages.sparkSession)
    dictionary = train(_sample(pages, sample_rows))
    out = plan(pages, least=least).mapInArrow(_writer(dictionary, level, archive_bytes), "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 1).text(path)


_FIELDS = {"page_id": "long", "url": "string", "record_type": "string", "payload_bytes": "long", "payload_digest": "string", "refers_to": "long", "payload": "string"}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below `path`: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to and payload (of responses; bytes that are not UTF-8 become
    U+FFFD). A broken archive raises an error; a folder without archives has no records."""
    ship(spark)

    def run(batches):
        schema = pa.schema([(k, {"long": pa.int64(), "string": pa.string()}[v]) for k, v in _FIELDS.items()])
        for b in batches:
            for i in range(b.num_rows):
                out, held = [], 0
                for raw in frames(memoryview(b.column(0)[i].as_buffer())):
                    r = parse(raw)
                    held += len(raw)
                    r["payload"] = None if r["payload"] is None else r["payload"].decode("utf-8", "replace")
                    out.append(r)
                    if held > 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in _FIELDS.items()))


def dangling(records: DataFrame) -> DataFrame:
    """The revisits whose response is not there, or has another digest."""
    known = records.where("record_type = 'response'").select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"))
    named = (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    return records.where("record_type = 'revisit'").join(known, named, "left_anti")
