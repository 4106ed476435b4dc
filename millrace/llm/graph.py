"""Connected components of a graph of integer nodes.

Graphs of up to TASK_EDGES edges, a bound that the edge count is checked against, are settled by one union-find task in
16 bytes an edge; larger ones by alternating large-star and small-star rounds until they are settled or small enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


TASK_EDGES = 1_000_000


def settle(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not its own root: the least node that the edges u, v connect it to."""
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(names))
    while True:  # hook every edge's greater root to the lesser one, then shorten all paths
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root[root] != root).any():
            root = root[root]
    on = np.flatnonzero(root != np.arange(len(names)))
    return names[on], names[root[on]]


def _settled(batches):
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        node, root = settle(*(np.concatenate(x) for x in zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["node", "root"])


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", task_edges: int = TASK_EDGES) -> DataFrame:
    """node, root: the least node reachable, for every node that an edge touches and that is not its own root.

    Minima are partial sums and stars are joined by their centre, whose rows Spark may split; a round halves the depth
    of what is left, and each round is checkpointed so that a lost executor costs one round.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    seen = _fingerprint(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        if seen[0] <= task_edges:
            return checkpointed(e.coalesce(1).mapInArrow(_settled, "node long, root long"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = _fingerprint(e)
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
