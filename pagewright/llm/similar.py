"""Near copies: all links of SimHash fingerprints, and all pairs of similar sets of shingles that these leave apart.

With ``fingerprints``, operator 8 comes first, in full and by its own method: majority fingerprints of 64 bits, segment counts,
grid join under the Manhattan bound, Hamming check. All its links count. They miss most texts that are similar as sets of
shingles, since 64 bits cannot tell these; so the rest is an exact search, in which pairs of one class of fingerprints are not
looked at again. A class is what links of both kinds lead to.

The exact search takes fingerprints that are not folded. A text's unfolded fingerprint has one bit for each possible hash of a shingle. Its segments are ranges of
hashes, and a segment's count of set bits is a coordinate of a point; the Manhattan distance of two points never
exceeds the Hamming distance of their fingerprints, which is the number of shingles that only one text
has. Texts of x and y shingles have similarity s (Jaccard) where that number is at most (1 - s) / (1 + s) * (x + y), so
the range grows with the texts and is exact, which a folded fingerprint's range cannot be.

The grid's cells are single bits: two texts so close share one of the rarest bits of each (a share of 1 - s of its bits, and one
more), whichever order of rarity all texts use. Pairs of a cell are dropped where sizes and places in that
order rule the similarity out, then by the Manhattan distance, and the rest is verified on the sets. No pair is lost.

Hot groups: texts with equal sets are one node. A cell of at most FEW nodes gives all its pairs; a larger one first gives
pairs with HUBS of its nodes, those with the fewest rarer bits, which hold what the group has in common. What these link is one
group, and then the pairs of unlike groups are tried, in blocks where a cell is large. Sets are
compared in groups of bounded size, into which each set is put once for each block that it has a pair with.

Defined cases: texts without a word are alike; fewer words than a shingle are one shingle. Of a group, the row with the least
doc_id stays (null last; then the least hash of the text). Rows with equal id and text are one. An empty table
stays empty. Columns may have any names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, again, release, sliced, summed_slices, tables_of_slices, written
from .components import connected_components
from .simhash import SEED, fingerprint, kept_rows, place, rooted, shingle_hashes
from .tokens import let_go

SHINGLE = 5
SIMILARITY = 0.8
#: Counts of shingles, for the order of rarity alone, are kept for so many buckets of their hashes.
BUCKETS = 1 << 18
FEW = 32
HUBS = 4
#: Nodes of a block of a large cell; shingles of a block of sets that are compared.
BLOCK = 4_096
LOAD = 1 << 20
SEGMENTS = 64
#: Nodes with more copies than this share of all rows are found in the first pass; there are at most 1 / share of them.
COMMON = 1 / 20_000
#: Bits of the filter that tells which texts are in a pair: at most so many, and about 16 for each of these texts.
FILTER = 1 << 26


def node_of(s: np.ndarray, seed: int = SEED) -> int:
    """A name of a sorted set of hashes."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), seed)).view(np.int64))


def shingle_set(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle, seed))


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x.view(np.uint64) % np.uint64(buckets)).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """``d`` (doc_id as a string), ``t`` (a hash of the text), ``text``."""
    return docs.select(F.col("doc_id").cast("string").alias("d"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("t"), "text")


def first_pass(docs: DataFrame, shingle: int, seed: int = SEED, buckets: int = BUCKETS, fingerprints: bool = False) -> tuple[DataFrame, DataFrame]:
    """``d, t, node, fp`` of each row (fp: operator 8's fingerprint where asked for), and how many rows hold the shingles of each bucket, in slices of each task."""

    def run(batches):
        from pyspark import TaskContext

        let_go()
        total, pd = np.zeros(buckets, np.int64), None
        for pdf in sliced(batches):
            pd = pdf.__class__
            sets = [shingle_set(t, shingle, seed) for t in pdf["text"]]
            total += np.bincount(_bucket(np.concatenate(sets), buckets), minlength=buckets)
            fp = np.array([fingerprint(t) for t in pdf["text"]], np.uint64).view(np.int64) if fingerprints else None
            yield pd({"d": pdf["d"], "t": pdf["t"], "node": [node_of(s, seed) for s in sets], "fp": fp, "part": None, "task": None, "v": None})
        if pd:
            yield tables_of_slices(pd, total, TaskContext.get().partitionId(), ["d", "t", "node", "fp"])

    out = written(_rows(docs).mapInPandas(run, "d string, t long, node long, fp long, part int, task long, v array<long>"), rows=TEXTS)
    return out.where("part is null").select("d", "t", "node", "fp"), out.where("part is not null").select("part", "task", "v")


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """Links ``a, b`` of the nodes whose rows are of one class of operator 8, as stars; rows: ``node, fp``."""
    own = rows.select("fp", "node").distinct()
    roots = rooted(own.select("fp").distinct())
    member = written(own.join(roots, "fp").select("root", "node").distinct())
    least = again(member).groupBy("root").agg(F.min("node").alias("a"))
    return member.join(least, "root").where("a != node").select("a", F.col("node").alias("b"))


def apart(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The edges ``a, b`` whose ends are not of one group; groups: ``node, root``, without the nodes that are alone."""
    at = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    return edges.join(at("a"), "a", "left").join(at("b"), "b", "left").where("root_a is null or root_b is null or root_a != root_b").select("a", "b")


def prefix(x: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest shingles of a set, as many as another set of that similarity must share one of.

    Any order that is the same for all sets is right; counts of buckets put common shingles last.
    """
    rare = np.lexsort((x, counts[_bucket(x, len(counts))]))
    return x[rare[: int(len(x) - similarity * len(x) + 1e-9) + 1]]


def entries(docs: DataFrame, counts, common, shingle: int, similarity: float, hot: int, seed: int = SEED) -> DataFrame:
    """``cell, p, info, node``: the prefix of each node, from one of its rows in a task; info: place in the order, then size.

    Cells that stand out as hot are dealt into blocks ``p``; common: node to the one row that speaks for it.
    """

    def run(batches):
        let_go()
        c, speaks, seen = counts.value, common.value, set()
        usual = np.median(c)
        usual += 8 * usual**0.5  # beyond what chance puts into a bucket
        for pdf in sliced(batches):
            nodes, sizes, prefixes = [], [], []
            for d, t, text in zip(pdf["d"], pdf["t"].tolist(), pdf["text"], strict=True):
                s = shingle_set(text, shingle, seed)
                node = node_of(s, seed)
                if len(s) and node not in seen and speaks.get(node, (d, t)) == (d, t):
                    seen.add(node)
                    nodes.append(node)
                    sizes.append(len(s))
                    prefixes.append(prefix(s, c, similarity))
            if not nodes:
                continue
            n = np.array([len(x) for x in prefixes])
            cell = np.concatenate(prefixes)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            node = np.repeat(np.array(nodes, np.int64), n)
            of = np.maximum(np.ceil((c[_bucket(cell, len(c))] - usual) / hot), 1).astype(np.uint64)
            yield pdf.__class__({"cell": cell.view(np.int64), "p": ((node.view(np.uint64) >> np.uint64(7)) % of).astype(np.int32) - (of < 2), "info": (at.astype(np.int64) << 32) | np.repeat(np.array(sizes, np.int64), n), "node": node})

    return _rows(docs).mapInPandas(run, "cell long, p int, info long, node long")


def fits(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether two entries of a cell can be of similar sets, if this is the first cell that they share."""
    n, m = x & 0xFFFFFFFF, y & 0xFFFFFFFF
    most = np.minimum(n - (x >> 32), m - (y >> 32))
    return most >= similarity * (n + m - most) - 1e-6


def _sorted_pairs(a: list, b: list) -> np.ndarray:
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    both = np.stack([np.minimum(x, y), np.maximum(x, y)])[:, x != y]
    return np.unique(both, axis=1)


class CellPairs:
    """Pairs of sorted entries, batch by batch; of a cell that goes on, at most FEW entries are held."""

    def __init__(self, similarity: float, few: int = FEW, hubs: int = HUBS):
        self.similarity, self.few, self.hubs = similarity, few, hubs
        self.rest = [np.zeros(0, np.int64) for _ in range(4)]
        self.heavy = None  # (cell, p), entries of the hubs of a large cell that goes on

    def _run(self, cols, a, b, big):
        """A large cell, or more of one."""
        key = (int(cols[0][0]), int(cols[1][0]))
        if self.heavy is None or self.heavy[0] != key:
            self.heavy = (key, cols[2][: self.hubs], cols[3][: self.hubs])
        big.append([cols[0], cols[2], cols[3]])
        for info, node in zip(*self.heavy[1:], strict=True):
            near = fits(np.broadcast_to(info, len(cols[2])), cols[2], self.similarity)
            a.append(np.full(near.sum(), node))
            b.append(cols[3][near])

    def __call__(self, cols, last: bool = False):
        """(pairs, entries of large cells: cell, info, node)."""
        cols = [np.concatenate(x) for x in zip(self.rest, cols, strict=True)]
        n = len(cols[0])
        if n:
            new = np.ones(n, bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in cols[:2]], axis=0)
            own = new.copy()
            own[1:] |= (cols[2][1:] != cols[2][:-1]) | (cols[3][1:] != cols[3][:-1])
            cols, new = [k[own] for k in cols], new[own]  # of a node's rows in several tasks, one
            n = len(new)
        a, b, big, none = [], [], [], [np.zeros(0, np.int64)] * 3
        if not n:
            return _sorted_pairs(a, b), none
        starts = np.flatnonzero(new)
        size = np.diff(np.append(starts, n))
        of_first = self.heavy is not None and self.heavy[0] == (int(cols[0][0]), int(cols[1][0]))
        large = (size > self.few) | (cols[1][starts] >= 0)  # a dealt cell is large, whatever its blocks hold
        large[0] |= of_first
        for k in np.flatnonzero(large).tolist():
            self._run([c[starts[k] : starts[k] + size[k]] for c in cols], a, b, big)
        if not large[-1]:
            self.heavy = None
        keep = 0 if last or large[-1] else int(size[-1])
        self.rest = [c[n - keep :] for c in cols]
        small = np.repeat(~large, size)
        small[n - keep :] = False
        run = np.repeat(np.arange(len(starts)), size)[small]
        info, node = cols[2][small], cols[3][small]
        i, step = np.arange(len(node)), 1
        while len(i := i[i + step < len(node)]) and len(i := i[run[i] == run[i + step]]):
            near = i[fits(info[i], info[i + step], self.similarity)]
            a.append(node[near])
            b.append(node[near + step])
            step += 1
        return _sorted_pairs(a, b), [np.concatenate(x) for x in zip(*big, strict=True)] if big else none


def cell_pairs(cells: DataFrame, similarity: float, few: int = FEW, hubs: int = HUBS) -> DataFrame:
    """``a, b`` of candidates (cell null), and ``a, cell, info`` of the entries of large cells (b null)."""

    def run(batches):
        let_go()
        found = CellPairs(similarity, few, hubs)

        def rows(got):
            (a, b), (cell, info, node) = got
            for cols in ([a, b, None, None], [node, None, cell, info]):
                if n := len(cols[0]):
                    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()) if c is None else pa.array(c) for c in cols], ["a", "b", "cell", "info"])

        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
            yield from rows(found(cols))
        yield from rows(found([np.zeros(0, np.int64)] * 4, last=True))

    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "cell", "p").sortWithinPartitions("cell", "p", "info", "node")
    return dealt.mapInArrow(run, "a long, b long, cell long, info long")


def unlike_pairs(info: np.ndarray, node: np.ndarray, root: np.ndarray, similarity: float):
    """Yield the candidates of one cell whose groups differ; nodes of the largest group don't meet each other."""
    groups, of, n = np.unique(root, return_inverse=True, return_counts=True)
    others = np.flatnonzero(of != n.argmax())
    for k in range(0, len(others), step := max(1, (1 << 20) // max(len(node), 1))):
        i = others[k : k + step]
        near = fits(info[i][:, None], info[None, :], similarity) & (of[i][:, None] != of[None, :])
        x, y = np.nonzero(near)
        yield _sorted_pairs([node[i[x]]], [node[y]])


def rest_pairs(heavy: DataFrame, groups: DataFrame, similarity: float, hot: int) -> DataFrame:
    """Candidates ``a, b`` of large cells in unlike groups; heavy: ``cell, info, node``, groups: ``node, root``."""
    own = heavy.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    cells = written(own.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / F.lit(hot)).cast("int").alias("of")).where("x < y").select("cell", "of"))
    # blocks of a cell, and pairs of blocks
    k = F.pmod(F.xxhash64("node"), F.col("of").cast("long")).cast("int")
    own = own.join(cells, "cell").withColumn("k", k).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    own = own.select("cell", F.least("k", "other").alias("p"), F.greatest("k", "other").alias("q"), "info", "node", "root")

    def run(batches):
        rest = None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            new = np.ones(len(cols[0]), bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)
            cuts = np.flatnonzero(new)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield from pairs([c[a:b] for c in cols[3:]])
            rest = [c[cuts[-1] :] for c in cols]  # the last cell may go on
        if rest is not None:
            yield from pairs(rest[3:])

    def pairs(cols):
        for a, b in unlike_pairs(*cols, similarity):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    n = int(heavy.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartition(n, "cell", "p", "q").sortWithinPartitions("cell", "p", "q")
    return dealt.mapInArrow(run, "a long, b long")


def _filter_of(nodes: DataFrame) -> tuple[np.ndarray, int]:
    """A bit table of the hashes ``t``; one that is full lets through more rows and loses none."""
    n = nodes.count()
    size = min(FILTER, 1 << max(10, (16 * n).bit_length()))

    def run(batches):
        from pyspark import TaskContext

        bits, pd = np.zeros(size, bool), None
        for pdf in batches:
            pd = pdf.__class__
            bits[_bucket(pdf["t"].to_numpy(np.int64), size)] = True
        if pd:
            yield tables_of_slices(pd, np.packbits(bits).view(np.int64), TaskContext.get().partitionId(), [])

    words = summed_slices(nodes.select("t").coalesce(16).mapInPandas(run, "part int, task long, v array<long>"), size // 64, np.bitwise_or)
    return words.astype(np.int64), size


def sets_of(docs: DataFrame, places: DataFrame, shingle: int, seed: int = SEED) -> DataFrame:
    """``node, s``: the sorted set of each node; places: ``node, d, t``, the row that has it."""
    words, size = _filter_of(places)
    sent = docs.sparkSession.sparkContext.broadcast(words)  # FILTER bits at most

    def run(batches):
        let_go()
        bits = np.unpackbits(sent.value.view(np.uint8)).astype(bool)
        for pdf in sliced(batches):
            pdf = pdf[bits[_bucket(pdf["t"].to_numpy(np.int64), size)]]
            if len(pdf):
                yield pdf[["d", "t"]].assign(s=[shingle_set(t, shingle, seed).view(np.int64) for t in pdf["text"]])

    rows = _rows(docs).mapInPandas(run, "d string, t long, s array<long>")
    key = {"no": F.col("d").isNull(), "d": F.coalesce("d", F.lit(""))}  # never null, so one shuffle serves both steps
    own = rows.withColumns(key).join(places.select("node", "d", "t").withColumns(key), ["no", "d", "t"])
    return own.dropDuplicates(["no", "d", "t"]).select("node", "s")


def similar_pairs(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs i, j are similar: by the Manhattan distance of segment counts, then by the sets themselves."""
    n = np.array([len(s) for s in sets], np.int64)
    counts = np.stack([np.bincount((s.view(np.uint64) >> np.uint64(58)).astype(np.int64), minlength=SEGMENTS) for s in sets])
    most = (1 - similarity) / (1 + similarity)
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 8192):
        x, y = i[k : k + 8192], j[k : k + 8192]
        near = np.abs(counts[x] - counts[y]).sum(axis=1) <= most * (n[x] + n[y]) + 1e-6
        for r in np.flatnonzero(near).tolist():
            a, b = sets[x[r]], sets[y[r]]
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            common = int((b[at] == a).sum()) if len(b) else 0
            out[k + r] = common >= similarity * (len(a) + len(b) - common)
    return out


def verified(edges: DataFrame, sets: DataFrame, similarity: float, load: int = LOAD) -> DataFrame:
    """The candidates ``a, b`` that are similar.

    Small components of candidates are put together by hash, so that their sets meet in one group; a large
    one is dealt into blocks, and pairs of blocks are groups.
    """
    nodes = connected_components(edges)
    sized = written(nodes.join(sets.select("node", F.size("s").cast("long").alias("n")), "node"))
    heavy = sized.groupBy("root").agg(F.ceil(F.sum("n") / load).cast("int").alias("of"), F.sum("n").alias("n"))
    bins = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // load))
    block = F.pmod(F.xxhash64("node"), F.col("of").cast("long")).cast("int")
    home = sized.select("node", "root").join(heavy.select("root", "of"), "root").select("node", F.when(F.col("of") > 1, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(bins))).alias("g"), (F.col("of") > 1).alias("large"), block.alias("k"))
    home = written(home)
    at = lambda c: home.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("g", "large", "k")])
    key = ["g", "large", "p", "q"]
    dealt = written(edges.join(at("a"), "a").join(at("b"), "b").select(F.col("g_a").alias("g"), F.col("large_a").alias("large"), F.least("k_a", "k_b").alias("p"), F.greatest("k_a", "k_b").alias("q"), "a", "b"))
    need = again(dealt).select(*key, F.explode(F.array("a", "b")).alias("node")).distinct()

    def run(left, right):
        col = left.column("s").combine_chunks()
        values, cuts = col.flatten().to_numpy(), col.offsets.to_numpy()
        cuts = cuts - cuts[0]
        each = [values[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]
        each = [np.sort(s.view(np.uint64)) for s in each]
        node = left.column("node").to_numpy()
        order = np.argsort(node)
        a, b = (right.column(c).to_numpy() for c in "ab")
        i, j = (order[np.searchsorted(node[order], x)] for x in (a, b))
        near = similar_pairs(each, i, j, similarity)
        return pa.table({"a": a[near], "b": b[near]})

    return need.join(sets, "node").groupBy(*key).cogroup(dealt.groupBy(*key)).applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, seed: int = SEED, few: int = FEW, hubs: int = HUBS, hot: int = BLOCK, load: int = LOAD, fingerprints: bool = False) -> tuple[DataFrame, DataFrame]:
    """``node, d, t`` of each row of docs, and ``node, root`` of the nodes that are linked to another."""
    sc = docs.sparkSession.sparkContext
    rows, slices = first_pass(docs, shingle, seed, fingerprints=fingerprints)
    near = written(fingerprint_links(rows)) if fingerprints else None
    counts = sc.broadcast(summed_slices(slices, BUCKETS))  # BUCKETS numbers
    points = written(rows.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(F.col("d").isNull().alias("no"), "d", "t")).alias("p")).select("node", "n", "p.d", "p.t"))
    often = points.agg(F.sum("n")).first()[0] or 0
    speaks = {r["node"]: (r["d"], r["t"]) for r in points.where(F.col("n") > max(100, often * COMMON)).collect()}  # 1 / COMMON rows at most
    found = written(cell_pairs(entries(docs, counts, sc.broadcast(speaks), shingle, similarity, hot, seed), similarity, few, hubs), rows=TEXTS)
    tried = found.where("cell is null").select("a", "b").distinct()
    tried = written(apart(tried, written(connected_components(near))) if fingerprints else tried)
    heavy = found.where("cell is not null").select("cell", "info", F.col("a").alias("node"))

    def links(edges):
        nodes = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        sets = written(sets_of(docs, points.join(nodes, "node", "left_semi"), shingle, seed), rows=TEXTS)
        out = written(verified(edges, sets, similarity, load))
        release(nodes, sets)
        return out

    some = links(tried).unionAll(again(near)) if fingerprints else links(tried)
    if heavy.isEmpty():
        return rows, connected_components(some)
    rest = written(rest_pairs(heavy, written(connected_components(some)), similarity, hot).distinct().join(tried, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return rows, connected_components(some)
    return rows, connected_components(some.unionAll(links(rest)))


def keep_similar(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that are the first of their class: that of its least doc_id, once. With ``fingerprints``, operator 8's links count too."""
    rows, roots = classes(docs, **options)
    kind = docs.schema["doc_id"].dataType
    rows = rows.select("node", F.col("d").cast(kind).alias("doc_id"), F.col("t").alias("th"))
    first = rows.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(place()).alias("p"))
    return kept_rows(docs, first)
