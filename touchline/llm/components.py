"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.runtime import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge (a, b); a component is its smallest node.

    In turn, every node's larger neighbours are tied to its smallest one, then
    its smaller neighbours are, until all components are stars.  The number of
    edges never grows, and no step gathers the neighbours of a node.
    """
    stars = checkpointed(_tidy(edges.select("a", "b")))
    before = None
    while True:
        ways = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = ways.groupBy("a").agg(F.min("b").alias("m"))
        tied = ways.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        tied = tied.distinct()
        least = tied.groupBy("a").agg(F.min("b").alias("m"))
        stars = tied.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        stars = checkpointed(_tidy(stars))
        state = stars.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    roots = stars.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def local_roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The smallest node (of 0 to n - 1) that each node reaches by the pairs of one task."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        while True:
            shorter = root[root]
            if np.array_equal(shorter, root):
                break
            root = shorter
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root
