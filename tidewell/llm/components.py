"""Connected components over an edge table by alternating stars.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond") are joins and minimum aggregates, so no node's
neighbourhood ever meets in one task: minima are pre-aggregated on the map
side and the join back to the edges may be split where a node is hot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import staged


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while not np.array_equal(up := label[label], label):
            label = up


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x"), F.expr("bit_xor(xxhash64(v, u, 1))").alias("y")).first()
    return row["n"], row["x"], row["y"]


def components(edges: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(u, v) longs -> (node, root): root is the smallest node reachable.

    Only nodes with an edge to another node appear. Loops, repeated edges and
    rows with a null end add nothing. An empty table gives an empty table.
    ``docs`` is what the edges came from; written tables get files as for it.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u <> v")
    now = staged(ends.distinct(), docs)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        now = staged(small, docs)
        if (after := _mark(now)) == mark:
            break
        mark = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
