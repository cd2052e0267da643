"""Connected components over edge tables: up to a bound by union-find in one task, beyond it in rounds of stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Edges that one task unites, in a few dozen MB; a larger table goes through rounds of joins instead.
SMALL = 1 << 20


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()], 1) for b in batches if b.num_rows]
    if not parts:
        return
    edges = np.concatenate(parts)
    nodes, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:  # each node takes the least root over its edges, and then that root's
        low = np.minimum(root[at[:, 0]], root[at[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[at[:, 0]], low)
        np.minimum.at(new, root[at[:, 1]], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def _large(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)


def components(edges: DataFrame) -> DataFrame:
    """node, root: each node that has an edge (u long, v long) to another, and the smallest node it reaches.

    The edges, and each round's, are cut in the shared folder; a node's edges are never gathered beyond ``SMALL`` in all,
    only their least end is.
    """
    now = cut(edges.where("u <> v").distinct(), "edges")
    if now.count() <= SMALL:
        return cut(now.repartition(1).mapInArrow(_unite, "node long, root long"), "components")
    facts = None
    while True:
        now = cut(_small(_large(now).distinct()).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == facts:
            break
        facts = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
