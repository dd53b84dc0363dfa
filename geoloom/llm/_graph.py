"""Connected components of a graph given by its edges, with no collection to the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._env import cut


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each node's component, nodes being 0 to n - 1.

    Vectorised: labels take the least of their neighbours and jump to their labels' labels.
    """
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has an edge; component is its least node.

    edges: two columns of longs, in either order, repeated or not. Large-star and small-star
    steps alternate until nothing moves, so the rounds grow with the logarithm of the
    longest path. Groups are only reduced to their least neighbour (partial aggregates),
    never gathered; the joins read checkpointed sides, so that AQE may split a hub.
    """
    edges = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b").distinct()
    edges = cut(edges.mapInArrow(_contract, "a long, b long").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        # Large star: every larger neighbour v of u goes to the least of u's neighbourhood.
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = cut(large)
        # Small star: u and its smaller neighbours go to the least of them.
        small = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(small, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        n, same = new.count(), new.join(edges, ["a", "b"], "left_semi").count()
        if n == same == edges.count():
            break
        edges = new
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return out.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _contract(batches):
    """Each batch of edges as a star forest with the same components."""
    for t in batches:
        a, b = (t.column(i).to_numpy() for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(at[: len(a)], at[len(a) :], len(nodes))
        some = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_pydict({"a": nodes[some], "b": nodes[root[some]]})
