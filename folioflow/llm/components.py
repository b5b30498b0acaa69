"""Connected components by alternating large-star and small-star steps.

Edges are rows; each step is a map-side combined minimum and a join that Spark
can split where a vertex is in very many edges.  Every round is checkpointed to
the shared folder, so a lost executor costs no lineage.

A round costs some ten stages however few the edges are, and every task of a stage leaves
files of its own and a record with the driver.  So where a caller asks for it, edges that
fit a task are connected in one: the same labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: So many edges, of 16 bytes, are connected in one task at most.
FEW = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("v")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` run from the larger end a to the smaller end b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least.withColumnRenamed("a", "v"), F.col("a") == F.col("v"))
    rest = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _at_once(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``node`` and ``label`` of all edges of the one task: roots hook to lesser ones until no edge has two."""
    held = [f[["a", "b"]].to_numpy(np.int64) for f in frames]
    if not held or not sum(map(len, held)):
        return
    nodes, ends = np.unique(np.concatenate(held), return_inverse=True)
    a, b = ends.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    for k in range(0, len(nodes), 10_000):
        yield pd.DataFrame({"node": nodes[k : k + 10_000], "label": nodes[root[k : k + 10_000]]})


def components(edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """``node`` and ``label`` (the smallest node reachable) of every node in an edge.

    ``edges`` has long columns ``a`` and ``b``.  Self-loops and null ends are ignored.
    Up to ``few`` edges are connected in one task.
    """
    edges = edges.where("a is not null and b is not null and a != b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if few:
        edges = checkpointed(edges)
        if edges.count() <= few:
            return checkpointed(edges.coalesce(1).mapInPandas(_at_once, "node long, label long"))
    edges = checkpointed(edges.distinct())
    before = None
    for _ in range(max_rounds):
        row = edges.agg(F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % 1000000007).cast("decimal(38,0)")).alias("h")).first()
        if row.n == 0 or (row.n, row.h) == before:
            break
        before = (row.n, row.h)
        edges = checkpointed(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
