"""Enrichment of streams of points and of queries against static areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import spatial


def attach_admin(stream: DataFrame, nodes: DataFrame) -> DataFrame:
    """A stream of points with country, state, city and suburb; stateless, by the static index of `nodes`."""
    return spatial.attach_admin(stream, nodes)


def counts_by_area(stream: DataFrame, nodes: DataFrame, *, time: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Points of each window and area; points that are later than `late` are dropped by the watermark."""
    found = spatial.with_hits(stream.withWatermark(time, late), nodes, "name")
    rows = found.select(time, F.explode("hits").alias("h"))
    counted = rows.groupBy(F.window(time, window).alias("w"), F.col("h.node_id").alias("node_id"), F.col("h.level").alias("level")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "node_id", "level", "n")


def start(df: DataFrame, path: str, checkpoint: str, *, mode: str = "append") -> StreamingQuery:
    """Write what there is of a stream to Parquet, then stop."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
