"""Connected components by alternating stars; nothing is gathered on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, release, written

#: Up to so many links, which are counted first, are joined in one task; each is 16 bytes. Beyond, in as many as there are.
FEW_LINKS = 1 << 20


def stars(a: np.ndarray, b: np.ndarray):
    """Links to as few as hold the same components: (node, least node)."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = root[root]
        if (root == before).all():
            break
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def connected_components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """``(a long, b long)`` links to ``(node, root)``; root is the least node that can be reached.

    Alternates large and small stars (Kiveris et al., 2014) until the links no longer
    change. Minima are combined before each shuffle, and the joins that follow them are
    plain equi-joins, so a hub with a third of the links can be split by AQE. At most ``few`` links
    give the same rows by union in memory, without those rounds.
    Loops, repeated and null links are ignored; a node without links isn't returned.
    """
    e = written(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= few:
        return written(e.coalesce(1).mapInArrow(_union, "node long, root long"))
    seen = None
    while True:
        both = e.unionAll(again(e).select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        new = written(small.distinct())
        release(e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionAll(again(e).select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _union(batches):
    """Components of all rows of one task."""
    import pyarrow as pa

    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
        node, root = stars(u, v)
        own = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ((node, own), (root, own))], ["node", "root"])
