"""Token counts by scanning flat token files for their end-of-document identifiers.

A token file is nothing but little-endian 16- or 32-bit token ids, in which a separator ends
each document; it has no header and no index. A scan takes files in blocks of fixed size,
which documents cross at will. Every block is searched by itself, with one vector
comparison: it yields the tokens before its first separator, the lengths of the documents
that lie within it and the tokens after its last one. A prefix scan over the separators of a
file's blocks numbers these pieces, and pieces of one number, however many blocks they
cross, sum up to the document's count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words as W
from ._env import cut, ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary splits texts before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = 50_256
BLOCK_TOKENS = 1 << 18
#: Tokens and documents of a file that write() makes, about.
FILE_TOKENS, FILE_DOCS = 1 << 23, 1 << 20

_KINDS = {2: np.dtype("<u2"), 4: np.dtype("<u4")}
#: What \s means in the pattern.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Characters of white space in a run from which on the pattern, which backtracks, is not asked.
_RUN = 10_000
#: Characters that are encoded at once, about.
_PART = 1_000_000


def _ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(ranks: dict[bytes, int], run: int = _RUN, part: int = _PART):
    """A function from a text to lists of tokens, which together are those of the whole text.

    Texts are cut where the pattern begins a match anyhow: before white space that follows
    something else. Of a long run of white space the pattern would match all but the last
    character, or all of it at the end of the text; that match is merged as it is.
    """
    import tiktoken

    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    long_run, begin = re.compile(f"[{_SPACE}]{{{run},}}"), re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")

    def ordinary(text: str):
        at = 0
        while len(text) - at > part:
            end = begin.search(text, at + part)
            if not end:
                break
            yield plain(text[at : end.start()])
            at = end.start()
        yield plain(text[at:] if at else text)

    def encode(text: str):
        at = 0
        for m in long_run.finditer(text) if len(text) >= run else ():
            end = m.end() - (m.end() < len(text))
            yield from ordinary(text[at : m.start()])
            yield whole(text[m.start() : end])
            at = end
        yield from ordinary(text[at:] if at else text)

    return encode


def _separator(separator: int, width: int) -> bytes:
    return np.array([separator], _KINDS[width]).tobytes()


def _writer(ranks, separator: int, width: int, file_tokens: int):
    """Rows (value, kind, run): a file's bytes without the last separator, and the ids of its documents."""

    def run(batches):
        from pyspark import TaskContext

        encode, me = encoder(ranks.value), TaskContext.get().partitionId()
        end, kind = np.array([separator], _KINDS[width]), _KINDS[width]
        held, ids, size, files = [], [], 0, 0

        def put():
            flat = np.concatenate(held)[:-1].tobytes()
            known = ",".join("" if i is None else str(i) for i in ids).encode()
            name = f"r{me}_{files}"
            return pa.RecordBatch.from_pydict({"value": pa.array([flat, known], pa.binary()), "kind": ["tokens", "manifest"], "run": [name, name]})

        for b in batches:
            of = b.column(0).to_pylist()
            for at, to, data, rows in W.chunks(b.column(1)):
                for i in range(to - at):
                    lo, hi = rows[i], rows[i + 1]
                    for tokens in encode(data[lo:hi].tobytes().decode()) if hi > lo else ():
                        held.append(np.array(tokens, kind))
                        size += len(tokens)
                    held.append(end)
                    size += 1
                    ids.append(of[at + i])
                    if size >= file_tokens or len(ids) >= FILE_DOCS:
                        yield put()
                        held, ids, size, files = [], [], 0, files + 1
        if ids:
            yield put()

    return run


def write(docs: DataFrame, path: str, *, ranks: str = RANKS, separator: int = SEPARATOR, width: int = 2, file_tokens: int = FILE_TOKENS) -> None:
    """Encode `docs` (doc_id, text) to flat token files below `path`/kind=tokens.

    A file has about `file_tokens` tokens and ends with the end of a document. Which
    documents, in their order, stand in a file is told below `path`/kind=manifest. Null texts
    are empty: a separator alone. Rows of null or repeated ids are documents like any other;
    an empty table makes no file; columns of other names are not written.
    """
    ship(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(_ranks(ranks))  # bounded by the vocabulary
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_writer(known, separator, width, file_tokens), "value binary, kind string, run string")
    # The text sink writes the bytes as they are, and the separator as the end of a line.
    sink = rows.withColumn("value", F.col("value").cast("string")).write.partitionBy("kind", "run")
    sink.option("encoding", "ISO-8859-1").option("lineSep", _separator(separator, width).decode("latin-1")).option("maxRecordsPerFile", 0).text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _slices(block_tokens: int, width: int):
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                data, name = b.column(1)[i].as_buffer(), b.column(0).slice(i, 1)
                if len(data) % width:
                    raise ValueError(f"{name[0]}: {len(data)} bytes are no whole number of tokens")
                step = block_tokens * width
                for block, at in enumerate(range(0, len(data), step)):
                    yield pa.RecordBatch.from_arrays([name, pa.array([block]), pa.array([data.slice(at, min(step, len(data) - at)).to_pybytes()], pa.binary())], ["file", "block", "tokens"])

    return run


def blocks(spark: SparkSession, path: str, *, block_tokens: int = BLOCK_TOKENS, width: int = 2) -> DataFrame:
    """(file, block, tokens) of the flat token files below `path`, whoever wrote them.

    file: a file's path. A file may be as large as a value of Spark (2 GB); one whose length
    is no whole number of tokens raises an error.
    """
    ship(spark)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where("length > 0").select("path", "content").mapInArrow(_slices(block_tokens, width), "file string, block long, tokens binary")


_RUN_OF = r"/run=([^/]+)/"


def manifest(spark: SparkSession, path: str, *, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """(run, ordinal, doc_id) of the files that write() made, in the order of writing."""
    if not _exists(spark, f"{path}/kind=manifest"):
        return spark.createDataFrame([], "run string, ordinal long, doc_id long")
    read = spark.read.schema("value string, run string").option("encoding", "ISO-8859-1").option("lineSep", _separator(separator, width).decode("latin-1"))
    rows = read.text(f"{path}/kind=manifest")
    return rows.select("run", F.posexplode(F.split("value", ",")).alias("at", "id")).select("run", F.col("at").cast("long").alias("ordinal"), F.expr("try_cast(id AS BIGINT)").alias("doc_id"))


def _search(separator: int, width: int):
    """Rows (file, block, ends, lengths): separators in the block, and tokens of each of its pieces."""

    def run(batches):
        for b in batches:
            ends, lengths = [], []
            for x in b.column(2):
                flat = np.frombuffer(x.as_py() or b"", _KINDS[width])
                at = np.flatnonzero(flat == separator)
                ends.append(len(at))
                lengths.append(np.diff(np.concatenate([[-1], at, [len(flat)]])) - 1)
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lengths])])
            flat = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.int64()), lists], ["file", "block", "ends", "lengths"])

    return run


def scan(found: DataFrame, *, separator: int = SEPARATOR, width: int = 2) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in blocks (file, block, tokens).

    ordinal counts a file's documents from 0; separators don't count as tokens. Tokens after
    a file's last separator are one more document, not closed; none are no document. A null
    or empty block has no tokens. The prefix scan sorts three numbers a block, for each file.
    """
    ship(found.sparkSession)
    name = found.schema["file"].dataType.simpleString()
    pieces = cut(found.select("file", "block", "tokens").mapInArrow(_search(separator, width), f"file {name}, block long, ends long, lengths array<long>"))
    order = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("ends").over(order), F.lit(0)).alias("before")
    before = cut(pieces.select(F.col("file").alias("f"), F.col("block").alias("b"), "ends").select("f", "b", before))
    numbered = pieces.join(before, F.col("file").eqNullSafe(F.col("f")) & (F.col("block") == F.col("b")))
    each = numbered.select("file", "before", "ends", F.posexplode("lengths").alias("at", "n"))
    docs = each.groupBy("file", (F.col("before") + F.col("at")).alias("ordinal")).agg(F.sum("n").alias("n_tokens"), F.max(F.col("at") < F.col("ends")).alias("closed"))
    return docs.where("closed or n_tokens > 0")


def counts(docs: DataFrame, path: str, *, block_tokens: int = BLOCK_TOKENS, **how) -> DataFrame:
    """(doc_id, n_tokens) of every row of `docs`, by writing token files and scanning them.

    A null or empty text has 0 tokens, repeated rows a row each, and an empty table none.
    Very long texts, unbroken white space included, are encoded in parts.
    """
    write(docs, path, **how)
    spark, kind = docs.sparkSession, {k: v for k, v in how.items() if k in ("separator", "width")}
    known = manifest(spark, path, **kind)
    if not _exists(spark, f"{path}/kind=tokens"):
        return known.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))  # no documents
    found = scan(blocks(spark, f"{path}/kind=tokens", block_tokens=block_tokens, width=kind.get("width", 2)), **kind)
    found = found.withColumn("run", F.regexp_extract("file", _RUN_OF, 1))
    return known.join(found, ["run", "ordinal"]).select("doc_id", "n_tokens")
