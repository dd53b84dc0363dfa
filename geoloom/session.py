"""What Python workers need to run this package's UDFs, and where intermediate tables are kept."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Make this package importable in Python workers, once an application.

    Workers that get it by ``PYTHONPATH`` or ``--py-files`` as well load the same code.
    """
    sc = (spark or SparkSession.active()).sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # it came as an archive that the workers have too
        return
    path = os.path.join(tempfile.mkdtemp(), "geoloom_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session that names none (as in tests) gets a local one; on a cluster its
    executors could not read each other's.
    """
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    if not known.isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` now and cut its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
