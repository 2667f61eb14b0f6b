"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments; each segment's count of set bits is
a coordinate of a point. The Manhattan distance of two points never exceeds the
Hamming distance of their fingerprints. The grid's cells are the points seen on
groups of coordinates: of BANDS groups, BANDS - RADIUS agree entirely whenever the
Manhattan distance is RADIUS or less, so any two such points share a cell of the grid on
some choice of so many groups. In a cell the lower bound is taken on all coordinates, then
the Hamming distance itself.

Copies of a fingerprint are one point, and a cell passes on its links as stars. A cell with more than HOT points is
cut into blocks, and pairs of blocks go to tasks of their own.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; a
null id is carried with the least other id of its class (null if there is none).
Repeated rows have the same class.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TEXTS, by_name, prefix_for, written
from .components import connected_components, stars

SHINGLE = 4
SEED = 42
RADIUS = 4
BANDS = 7
HOT = 20_000
BLOCK = 4_096
#: A two-bit segment's count takes two bits: these hold all first and all second bits.
LOW = 0x5555555555555555
NIBBLES = 0x3333333333333333
ONES = 0x1111111111111111


def shingle_hashes(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where there are fewer words."""
    import xxhash

    words = text.encode().lower().split() if text else []  # of bytes: only A-Z, and only ASCII white space
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    each = (h(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    return np.fromiter(each, np.uint64, n)


def _majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of h."""
    bits = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = np.ascontiguousarray(h[k : k + (1 << 15)])
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(2 * bits > len(h), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Majority of the bits of all shingles' XXH64."""
    return int(_majority(shingle_hashes(text, shingle, seed)))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, text_hash: bool = False) -> DataFrame:
    """``doc_id, fp`` (signed long), and ``th``, a hash of the text, where asked for."""

    def run(batches):
        for pdf in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in pdf["text"]], np.uint64)
            yield pdf.drop(columns="text").assign(fp=fps.view(np.int64))

    doc_id, back = by_name(docs)
    rows = docs.select(doc_id, "text", *[F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th")] * text_hash)
    return back(rows.mapInPandas(run, T.StructType([f for f in rows.schema if f.name != "text"]).add("fp", "long")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def segment_counts(fp):
    """Column: all 32 counts, two bits each."""
    half = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(half).bitwiseAND(F.lit(LOW)), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(F.lit(LOW)))


def grid_masks(bands: int = BANDS, radius: int = RADIUS) -> list[int]:
    """For each choice of coordinates that must agree, the bits of their counts."""
    cuts = [round(32 * k / bands) for k in range(bands + 1)]
    each = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(each[k] for k in some) for some in combinations(range(bands), bands - radius)]


def _points(fp: np.ndarray) -> np.ndarray:
    x = fp.view(np.uint64)
    return x - ((x >> np.uint64(1)) & np.uint64(LOW))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of packed counts: differences in fields of four bits, from -2 to 2 about 8."""
    total = 0
    for shift in (0, 2):
        x, y = ((v >> np.uint64(shift)) & np.uint64(NIBBLES) for v in (a, b))
        d = (x | np.uint64(0x8888888888888888)) - y
        total = total + np.bitwise_count(d & np.uint64(ONES)).astype(np.int16) + 2 * np.bitwise_count((d >> np.uint64(1)) & ~d & np.uint64(ONES)).astype(np.int16)
    return total


def _close(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    near = manhattan(_points(a), _points(b)) <= radius
    near[near] = np.bitwise_count(a[near].view(np.uint64) ^ b[near].view(np.uint64)) <= radius
    return near


def _block_links(x: np.ndarray, y: np.ndarray, radius: int):
    """Links of two blocks, as row numbers of each."""
    for k in range(0, len(x), 512):
        a = np.broadcast_to(x[k : k + 512, None], (len(x[k : k + 512]), len(y)))
        i, j = np.nonzero(_close(np.ascontiguousarray(a), np.ascontiguousarray(np.broadcast_to(y, a.shape)), radius))
        yield x[k + i], y[j]


def cell_links(keys: list[np.ndarray], fp: np.ndarray, radius: int):
    """Links inside the runs of equal keys of sorted rows."""
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    run = np.cumsum(new) - 1
    size = np.bincount(run)[run] if n else run
    left, right = [], []
    small = np.flatnonzero((size > 1) & (size <= 256))
    f, r = fp[small], run[small]
    at = np.arange(len(f))
    d = 1
    while len(at := at[at + d < len(f)]) and len(at := at[r[at] == r[at + d]]):
        near = _close(f[at], f[at + d], radius)
        left.append(f[at[near]])
        right.append(f[at[near] + d])
        d += 1
    starts = np.flatnonzero(new & (size > 256))
    for s in starts.tolist():
        whole = fp[s : s + size[s]]
        for p in range(0, len(whole), BLOCK):
            for q in range(p, len(whole), BLOCK):
                for a, b in _block_links(whole[p : p + BLOCK], whole[q : q + BLOCK], radius):
                    a, b = stars(a[a != b], b[a != b])
                    left.append(a)
                    right.append(b)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return stars(np.concatenate(left), np.concatenate(right))


def _spread(cells: DataFrame, point: str, hot: int) -> DataFrame:
    """Add ``p, q``: 0, or the pair of blocks of a heavy cell; its points go to every pair that theirs is part of."""
    heavy = written(cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where(F.col("n") > hot))
    plain = cells.withColumns({"p": F.lit(0), "q": F.lit(0)})
    if heavy.isEmpty():
        return plain
    blocks = F.ceil(F.col("n") / hot).cast("int")
    own = F.pmod(F.xxhash64(point), blocks.cast("long")).cast("int")
    both = cells.join(heavy, ["grid", "cell"]).withColumns({"k": own, "of": blocks})
    both = both.select(*cells.columns, "k", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("other"))
    both = both.select(*cells.columns, F.least("k", "other").alias("p"), F.greatest("k", "other").alias("q"))
    return plain.join(heavy, ["grid", "cell"], "left_anti").unionByName(both)


def links(fps: DataFrame, radius: int = RADIUS, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """Distinct ``fp`` to ``a, b`` links with the components of all links at radius or less."""
    spark = fps.sparkSession
    masks = grid_masks(bands, radius)
    v = F.col("_v")
    cells = fps.withColumn("_v", segment_counts(F.col("fp"))).select(
        "fp", F.posexplode(F.array(*[v.bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("grid", "cell")
    )
    cells = _spread(cells, "fp", hot)
    keys = ["grid", "cell", "p", "q"]

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            last = np.all([c == c[-1] for c in cols[:4]], axis=0)  # the last cell may go on
            rest = [c[last] for c in cols]
            a, b = cell_links([c[~last] for c in cols[:4]], cols[4][~last], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        if rest is not None:
            a, b = cell_links(rest[:4], rest[4], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    import pyarrow as pa

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sorted_cells = cells.repartition(n, *keys).sortWithinPartitions(*keys)
    return sorted_cells.select(*keys, "fp").mapInArrow(run, "a long, b long").distinct()


def place():
    """Orders the rows of a class: ids first, then hashes of texts."""
    return F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("d"), F.col("th").alias("t"))


def rooted(points: DataFrame, radius: int = RADIUS, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """Add ``root`` to points, which have each ``fp`` once: the least fingerprint that links lead to."""
    roots = connected_components(links(points.select("fp"), radius, bands, hot))
    member = points.join(roots, F.col("fp") == F.col("node"), "left")
    return written(member.select(*points.columns, F.coalesce("root", "fp").alias("root")))


def _classes(rows: DataFrame, radius: int, bands: int, hot: int) -> DataFrame:
    """``fp, root, component_id`` of the fingerprints of ``doc_id, fp`` rows."""
    member = rooted(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), radius, bands, hot)
    least = member.groupBy("root").agg(F.min("least").alias("component_id"))
    return member.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = written(fingerprints(docs, shingle, seed), rows=TEXTS)
    classes = _classes(rows, radius, bands, hot)
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, bands: int = BANDS, hot: int = HOT) -> DataFrame:
    """The rows of docs that are the first of their class: that of its least doc_id, once.

    Where rows repeat that id, the one with the least hash of its text stays. A class of
    null ids alone keeps one of its rows.
    """
    rows = written(fingerprints(docs, shingle, seed, text_hash=True), rows=TEXTS)
    classes = _classes(rows.select("doc_id", "fp"), radius, bands, hot)
    return kept_rows(docs, rows.join(classes, "fp").groupBy("root").agg(F.min(place()).alias("p")))


def kept_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows of docs at the places ``p``; rows alike in id and text are one."""
    own = prefix_for(docs)
    keys = {f"{own}n": F.col("doc_id").isNull(), f"{own}d": F.coalesce(F.col("doc_id").cast("string"), F.lit(""))}  # never null, so one shuffle serves both steps
    first = first.select(F.col("p.d").alias("doc_id"), F.col("p.t").alias(f"{own}t")).withColumns(keys).drop("doc_id")
    hashed = docs.withColumns(keys | {f"{own}t": F.coalesce(F.xxhash64("text"), F.lit(0))})
    on = [*keys, f"{own}t"]
    return hashed.join(first, on, "left_semi").dropDuplicates(on).select(*[F.col(f"`{c}`") for c in docs.columns])
