"""Session helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import session
from ..session import cut, shared_dir

__all__ = ["cut", "free_name", "remove", "scratch", "shared_dir", "ship", "widened"]

#: Rows go to Python in batches of about so many bytes at most, however long their texts are.
ARROW_BYTES = 8 << 20
_ARROW = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, and bound the batches they get."""
    if spark.conf.get(_ARROW).rstrip("b") == "67108864":  # Spark's default; a value set by the user stays
        spark.conf.set(_ARROW, str(ARROW_BYTES))
    session.ship(spark)


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch(spark: SparkSession, name: str) -> str:
    """A path that does not exist yet, below the shared folder; it is deleted when the driver ends."""
    import uuid

    parent, fs = _folder(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return f"{parent.toString()}/data"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that scratch() gave, when nothing reads it any more."""
    parent, fs = _folder(spark, path.rpartition("/")[0])
    fs.delete(parent, True)


def free_name(wanted: str, taken) -> str:
    """`wanted`, with underscores added until no column of `taken` has it (ignoring case)."""
    low = {c.lower() for c in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def widened(df: DataFrame, **more: str):
    """The schema of `df` with further columns, given as name=type."""
    from pyspark.sql.types import StructType

    return StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in more.items())).fields])
