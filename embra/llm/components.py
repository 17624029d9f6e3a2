"""Connected components as alternating star operations on an edge table.

Every round turns each node's neighbourhood into a star around its smallest
member (first the larger neighbours, then the smaller ones), so the number of
rounds grows with the logarithm of the longest chain.  Joins on a hot centre
have one row per node on the other side, which skew-join splitting handles;
the rounds are written to the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges (u, v)`` of one orderable type -> ``(node, root)``, where root is the
    smallest node reachable.  Nodes without an edge do not appear; null ends,
    loops and repeated edges are ignored."""
    e = stage(edges.filter("u is not null and v is not null and u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .distinct(), "cc")
    state = _state(e)
    while True:
        e = stage(_small_star(_large_star(e)), "cc")
        state, before = _state(e), state
        if state == before:
            break
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.withColumn("root", F.col("node")))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct())


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    near = e.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


class Forest:
    """Union-find over 0..n-1 that takes whole arrays of links at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n, dtype=np.int64)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        p = self.parent
        while True:
            a, b = p[u], p[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, a, b = u[open_], v[open_], a[open_], b[open_]
            p[np.maximum(a, b)] = np.minimum(a, b)
            while True:  # roots always have smaller numbers, so this ends
                q = p[p]
                if np.array_equal(q, p):
                    break
                p = q
            self.parent = p
