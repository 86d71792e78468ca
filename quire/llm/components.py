"""Connected components of a graph given as edges, by alternating large and small stars (Kiveris et al., 2014).

Every round is two aggregations by node with map-side minima; what it holds is one row an edge. Rounds are written to the
shared folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._core import settled


def union_pairs(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins each a with its b in a forest whose roots are the least of their trees; returns it with all paths of length one."""
    while True:
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        ra, rb = parent[a], parent[b]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        apart = low != high
        if not apart.any():
            return parent
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        parent = parent.copy()
        np.minimum.at(parent, high, low)


def stars(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, root) for every node of an edge but the roots; root is the least node of the component."""
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select("a", F.col("m").alias("b")).unionByName(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = settled(small, "stars")
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if state == tuple(seen):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(seen)
