"""Embedding near-dedup by a forest of random-projection trees.

Each tree splits vectors by the median of a random projection, again and again, and those
near the median go to both sides (spill). The top levels of each tree are fitted on a bounded
sample of vectors; every vector is routed, down to the depth that its label's size asks for. Leaves that still hold
too many are split level by level, each at quantiles of its own vectors, until none does. A task
splits its leaf on in memory and compares in blocks. Links join into components; then
the links of each vector are counted exactly, among the vectors of its component. A label of at most 4 * LEAF vectors is one
leaf, whose pairs are all compared, once.

A pair whose cosine is within SLACK of the limit is decided by sums without rounding errors, so that no
pair below it links anything, in whatever block it is met.

Equal vectors of a label are one point, so copies yield no pairs. Counting goes by
pairs of blocks of a component, each a task group of bounded size.

Defined cases: a vector that is null, empty or zero, or holds null or non-finite
components, and one with a null label, links with nothing, and is kept with itself as its
component. Vectors of different length never link. Repeated ids are vectors of their own
for n_links; a null id is carried with its class. Only vec_id, embedding, label are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, written
from .components import connected_components, stars

COSINE = 0.98
TREES = 12
#: Share of a node's vectors, on either side of its median, that go both ways.
SPILL = 0.10
#: Vectors that the top levels are fitted on, at most; and vectors of a leaf, about.
SAMPLE = 20_000
LEAF = 256
BLOCK = 1_024
#: Errors of a product of matrices are far below this.
SLACK = 1e-9
#: Bytes of the top levels of all trees, at most.
TOP = 1 << 25
#: Vectors of a leaf that one task group compares, at most about twice as many.
HOT = 8_192
SEED = 7


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, initial=0.0)[:, None]  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def usable(vectors: DataFrame) -> DataFrame:
    """The vectors that can link: ``vec_id, label, v``."""
    good = F.col("embedding").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return vectors.where(good).select("vec_id", "label", F.col("embedding").alias("v"))


def fit_tree(x: np.ndarray, rng, depth: int, spill: float):
    """Node k: (direction, lower cut, upper cut), children 2k + 1 and 2k + 2; levels = depth."""
    dirs, low, high = rng.normal(size=(2**depth - 1, x.shape[1])), np.zeros(2**depth - 1), np.zeros(2**depth - 1)
    at = [np.arange(len(x))]
    for k in range(2**depth - 1):
        rows = at[k]
        y = x[rows] @ dirs[k]
        if len(rows):
            low[k], high[k] = np.quantile(y, [0.5 - spill, 0.5 + spill])
        at += [rows[y <= high[k]], rows[y >= low[k]]]
    return dirs, low, high


def route(x: np.ndarray, tree, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, node) of every row at its own depth, some in several nodes."""
    dirs, low, high = tree
    rows, node, level = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    out = []
    while True:
        stop = depth[rows] <= level
        out.append((rows[stop], node[stop]))
        rows, node = rows[~stop], node[~stop]
        if not len(rows):
            return tuple(np.concatenate(v) for v in zip(*out, strict=True))
        y = np.einsum("ij,ij->i", x[rows], dirs[node])
        left, right = y <= high[node], y >= low[node]
        rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        level += 1


def close(x: np.ndarray, y: np.ndarray, cosine: float, raw_x: np.ndarray, raw_y: np.ndarray) -> np.ndarray:
    """Which pairs of unit vectors have that cosine or more; the raw ones decide what is near the limit."""
    product = x @ y.T
    near = product >= cosine
    for i, j in zip(*np.nonzero(np.abs(product - cosine) <= SLACK), strict=True):
        near[i, j] = exact_cosine(raw_x[i], raw_y[j]) >= cosine
    return near


def exact_cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Of the scaled components, with sums that are rounded once."""
    import math

    a, b = ((v / np.abs(v).max()).tolist() for v in (a, b))
    dot, n, m = (math.fsum(p * q for p, q in zip(v, w, strict=True)) for v, w in ((a, b), (a, a), (b, b)))
    return dot / (math.sqrt(n) * math.sqrt(m))


def leaf_links(x: np.ndarray, raw: np.ndarray, cosine: float, rng, leaf: int, spill: float, depth: int = 0):
    """Pairs of rows of one leaf: split on while it pays, then compare in blocks."""
    if len(x) > 4 * leaf and depth < 24:
        y = x @ rng.normal(size=x.shape[1])
        low, high = np.quantile(y, [0.5 - spill, 0.5 + spill])
        parts = [np.flatnonzero(y <= high), np.flatnonzero(y >= low)]
        if max(map(len, parts)) < 0.75 * len(x):
            for rows in parts:
                for i, j in leaf_links(x[rows], raw[rows], cosine, rng, leaf, spill, depth + 1):
                    yield rows[i], rows[j]
            return
    for a in range(0, len(x), BLOCK):
        for b in range(a, len(x), BLOCK):
            i, j = np.nonzero(close(x[a : a + BLOCK], x[b : b + BLOCK], cosine, raw[a : a + BLOCK], raw[b : b + BLOCK]))
            own = a + i < b + j
            yield a + i[own], b + j[own]


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column, all of one length."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)


def _comparer(dims: int, cosine: float, leaf: int, spill: float):
    """Links inside one group of a leaf's vectors, as stars."""
    import pyarrow as pa

    def compare(key, table):
        raw = _matrix(table.column("v").combine_chunks(), dims)
        p = table.column("point").to_numpy()
        order = np.argsort(p, kind="stable")
        raw, p = raw[order], p[order]
        x = _unit(raw)
        rng = np.random.default_rng([SEED, key[1].as_py(), key[2].as_py()])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in leaf_links(x, raw, cosine, rng, leaf, spill):
            a, b = stars(p[i], p[j])
            left.append(a)
            right.append(b)
        a, b = stars(np.concatenate(left), np.concatenate(right))
        return pa.table({"a": a, "b": b})

    return compare


def split_on(routed: DataFrame, own: DataFrame, dims: int, spill: float, hot: int) -> DataFrame:
    """Split nodes of more than hot vectors, a level at a time, while both sides get smaller.

    A node's direction comes from its name, and its cuts are quantiles of its own vectors, so nothing is broadcast.
    """
    import pyarrow as pa

    keys = ["label", "tree", "node"]

    def project(batches):
        for batch in batches:
            x, y = _unit(_matrix(batch.column(4), dims)), np.empty(batch.num_rows)
            names, of = np.unique(np.stack([batch.column(k).to_numpy().astype(np.int64) for k in (2, 3)]), axis=1, return_inverse=True)
            for k, (tree, node) in enumerate(names.T.tolist()):
                y[of == k] = x[of == k] @ np.random.default_rng([SEED, 1, tree, node]).normal(size=dims)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(y)], ["point", *keys, "y"])

    kinds = ", ".join(f"{c} {routed.schema[c].dataType.simpleString()}" for c in ["point", *keys])
    while True:
        large = written(routed.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > hot))
        if large.isEmpty():
            return routed
        rows = routed.join(large.select(*keys), keys).join(own.select("point", "v"), "point").select("point", *keys, "v")
        rows = written(rows.mapInArrow(project, f"{kinds}, y double"))
        cuts = rows.groupBy(*keys).agg(F.percentile_approx("y", [0.5 - spill, 0.5 + spill], 1_000).alias("q"))
        sides = {"l": F.col("y") <= F.get("q", F.lit(1)), "r": F.col("y") >= F.get("q", F.lit(0))}
        cuts = again(rows).join(cuts, keys).withColumns(sides).groupBy(*keys).agg(F.first("q").alias("q"), F.sum(F.col("l").cast("long")).alias("l"), F.sum(F.col("r").cast("long")).alias("r"), F.count("*").alias("n"))
        cuts = written(cuts.where(F.greatest("l", "r") < 0.75 * F.col("n")).select(*keys, "q"))
        if cuts.isEmpty():
            return routed  # what is left is cut into blocks
        child = F.explode(F.array_compact(F.array(F.when(sides["l"], 2 * F.col("node") + 1), F.when(sides["r"], 2 * F.col("node") + 2))))
        halves = rows.join(cuts, keys).select("point", "label", "tree", child.alias("node"))
        routed = written(routed.join(cuts.select(*keys), keys, "left_anti").select("point", *keys).unionAll(halves))


def forest_links(pts: DataFrame, cosine: float, trees: int, spill: float, sample: int, leaf: int, hot: int) -> DataFrame:
    """Links found in any leaf of any tree, as stars: ``a, b`` (points)."""
    import pyarrow as pa

    spark = pts.sparkSession
    shapes = written(pts.groupBy("label", F.size("v").alias("dims")).agg(F.count("*").alias("n")))
    out = None
    for r in shapes.groupBy("dims").agg(F.max("n").alias("most")).orderBy("dims").collect():  # a row for each length of vectors
        dims, most = r["dims"], r["most"]
        own = pts.where(F.size("v") == dims)
        rows = own.select("v", F.xxhash64("point").alias("h")).orderBy("h").limit(sample).select("v").toArrow()
        x = _unit(_matrix(rows.column("v").combine_chunks(), dims))
        top = 0
        while most / 2**top > 8 * leaf and len(x) / 2**top > 64 and trees * dims * 16 << top < TOP:
            top += 1
        rng = np.random.default_rng(SEED)
        forest = spark.sparkContext.broadcast([fit_tree(x, rng, top, spill) for _ in range(trees)])  # TOP bytes

        def dealt(batches, dims=dims, forest=forest):
            for batch in batches:
                x, depth = _unit(_matrix(batch.column(3), dims)), batch.column(2).to_numpy()
                for k, tree in enumerate(forest.value):
                    some = np.arange(len(x)) if not k else np.flatnonzero(depth >= 0)
                    at, node = route(x[some], tree, depth[some])
                    at = pa.array(some[at])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.full(len(at), k, np.int32)), pa.array(node)], ["point", "label", "tree", "node"])

        # -1: one leaf in one tree
        level = F.when(F.col("n") <= 4 * leaf, -1).otherwise(F.least(F.lit(top), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / (8 * leaf)))))).cast("int")
        levels = shapes.where(F.col("dims") == dims).select("label", level.alias("depth"))
        kind = pts.schema["label"].dataType.simpleString()
        routed = written(own.join(levels, "label").select("point", "label", "depth", "v").mapInArrow(dealt, f"point long, label {kind}, tree int, node long"))
        routed = split_on(routed, own, dims, spill, hot)
        # a leaf that holds too many is cut into blocks, and pairs of its blocks are groups of their own
        keys = ["label", "tree", "node"]
        sizes = again(routed).groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("of")).where("of > 1")
        of = F.coalesce("of", F.lit(1))
        placed = routed.join(sizes, keys, "left").withColumn("k", F.pmod(F.xxhash64("point"), of.cast("long")).cast("int"))
        placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
        placed = placed.select("point", *keys, F.least("k", "other").alias("p"), F.greatest("k", "other").alias("q"))

        groups = [*keys, "p", "q"]
        found = placed.join(own.select("point", "v"), "point").repartition(*groups).groupBy(*groups).applyInArrow(_comparer(dims, cosine, leaf, spill), "a long, b long")
        out = found if out is None else out.unionAll(found)
    if out is None:
        return spark.createDataFrame([], "a long, b long")
    return out.distinct()


def count_links(members: DataFrame, cosine: float) -> DataFrame:
    """``point, found``: links of a point to vectors of other points; members: ``point, root, n, v``, of components of two points or more.

    Each component is dealt into blocks, and each pair of its blocks is a group.
    """
    import pyarrow as pa

    large = members.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("of")).where("of > 1")
    of = F.coalesce("of", F.lit(1))
    df = members.join(large, "root", "left").withColumn("k", F.pmod(F.xxhash64("point"), of.cast("long")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), of - 1)))
    df = df.select("root", F.least("k", "other").alias("p"), F.greatest("k", "other").alias("q"), (F.col("k") <= F.col("other")).alias("first"), "point", "n", "v")

    def run(key, table):
        n, p, first = (table.column(c).to_numpy() for c in ("n", "point", "first"))
        v = table.column("v").combine_chunks()
        raw = _matrix(v, len(v[0]))
        x = _unit(raw)
        i, j = np.flatnonzero(first), np.flatnonzero(~first)
        if key[1] == key[2]:
            near = close(x, x, cosine, raw, raw)
            np.fill_diagonal(near, False)
            return pa.table({"point": p, "found": (near.astype(float) @ n).astype(np.int64)})
        near = close(x[i], x[j], cosine, raw[i], raw[j])
        return pa.table({"point": np.concatenate([p[i], p[j]]), "found": np.concatenate([near.astype(float) @ n[j], near.T.astype(float) @ n[i]]).astype(np.int64)})

    found = df.repartition("root", "p", "q").groupBy("root", "p", "q").applyInArrow(run, "point long, found long")
    return found.groupBy("point").agg(F.sum("found").alias("found"))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, sample: int = SAMPLE, leaf: int = LEAF, hot: int = HOT) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    grouped = usable(vectors).groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    pts = written(grouped.withColumn("point", F.monotonically_increasing_id()))
    roots = connected_components(forest_links(pts, cosine, trees, spill, sample, leaf, hot))
    members = written(pts.join(roots, F.col("point") == F.col("node"), "left").select("point", F.coalesce("root", "point").alias("root"), F.col("root").isNotNull().alias("linked"), "n", "least", "v", "label"))
    counted = count_links(members.where("linked").select("point", "root", "n", "v"), cosine)
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = members.join(least, "root").join(counted, "point", "left")
    facts = facts.withColumn("n_links", F.coalesce("found", F.lit(0)) + F.col("n") - 1)
    facts = facts.select(F.col("label").alias("_l"), F.col("v").alias("_v"), "component_id", "n_links")
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v"))
    out = rows.join(facts, (F.col("label") == F.col("_l")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
