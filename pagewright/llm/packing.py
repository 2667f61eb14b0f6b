"""Best-fit packing by a grouping genetic algorithm.

A chromosome is a list of bins. Crossover injects whole well-filled bins of one parent
into the other, removes the bins that hold a document twice, exchanges what this displaces for items of
other bins where that fills them better, and best-fits the rest, largest first. Pieces are dealt by hash into blocks of bounded
size; each block is evolved on several islands, tasks of their own, and the islands pass
their elites on round a ring between epochs. The best elite of a block is its packing.

Defined cases: a null text is empty, and so a piece of the closing id alone. Only documents
longer than a sequence are cut; full pieces are sequences by themselves. Repeated rows and
null ids are documents of their own. Only doc_id and text are read.
"""

from __future__ import annotations

import random
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, by_name, written
from .tokens import encoder, let_go

CAPACITY = 2048
CLOSE = 0
#: Pieces of a block on average, islands, epochs, chromosomes of an island, crossovers in an epoch.
BLOCK = 4_000
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
CROSSOVERS = 16
#: Share of a parent's well-filled bins that a crossover injects, at most.
SHARE = 0.5


class Best:
    """Open bins by free room; the lowest set bit above a length is the best fit."""

    def __init__(self, capacity: int):
        self.room, self.mask = [[] for _ in range(capacity + 1)], 0

    def add(self, free: int, k: int) -> None:
        self.room[free].append(k)
        self.mask |= 1 << free

    def take(self, length: int) -> tuple[int, int] | None:
        over = self.mask >> length
        if not over:
            return None
        free = length + (over & -over).bit_length() - 1
        k = self.room[free].pop()
        if not self.room[free]:
            self.mask &= ~(1 << free)
        return free, k


def best_fit(items, sizes, capacity: int, bins: list[tuple[int, ...]], fill: list[int]):
    """Put items, in order, where they fit best; bins and fill grow in place."""
    best, grown = Best(capacity), {}
    for k, f in enumerate(fill):
        if f < capacity:
            best.add(capacity - f, k)
    for i in items:
        if (hit := best.take(sizes[i])) is None:
            bins.append(())
            fill.append(0)
            free, k = capacity, len(bins) - 1
        else:
            free, k = hit
        grown.setdefault(k, []).append(i)
        fill[k] = capacity - free + sizes[i]
        if fill[k] < capacity:
            best.add(capacity - fill[k], k)
    for k, more in grown.items():
        bins[k] = (*bins[k], *more)
    return bins, fill


def fitness(solution, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then unevenly filled ones."""
    bins, fill = solution
    return -len(bins), sum((f / capacity) ** 2 for f in fill)


def improve(bins, fill, displaced: list[int], sizes, capacity: int) -> list[int]:
    """Exchange items of bins for displaced ones that fill them better: one or two for one. What is displaced then gets smaller."""
    free = sorted((sizes[i], i) for i in displaced)
    for k, b in enumerate(bins):
        room = capacity - fill[k]
        if not room or not free:
            continue
        best, at, out = 0, -1, ()
        spans = [(sizes[i], (i,)) for i in b]
        if len(b) <= 4:
            spans += [(sizes[i] + sizes[j], (i, j)) for x, i in enumerate(b) for j in b[:x]]
        for s, some in spans:
            p = bisect_right(free, (s + room, 1 << 62)) - 1
            if p >= 0 and free[p][0] - s > best:
                best, at, out = free[p][0] - s, p, some
                if best == room:
                    break
        if best:
            _, new = free.pop(at)
            bins[k] = (*[i for i in b if i not in out], new)
            fill[k] += best
            for i in out:
                insort(free, (sizes[i], i))
    return [i for _, i in reversed(free)]


def cross(into, giver, sizes, capacity: int, rng: random.Random):
    """A child: some well-filled bins of giver, set into the other parent; what that displaces fills other bins better, and the rest is best-fitted."""
    (bins, fill), (other, other_fill) = into, giver
    well = sorted(other_fill)[len(other_fill) // 4]
    share = SHARE * rng.random()
    chosen = [k for k, f in enumerate(other_fill) if f >= well and rng.random() < share]
    taken = {i for k in chosen for i in other[k]}
    child = [other[k] for k in chosen]
    child_fill = [other_fill[k] for k in chosen]
    displaced = []
    worst = min(fill)
    for b, f in zip(bins, fill, strict=True):
        if not taken.isdisjoint(b):
            displaced += [i for i in b if i not in taken]
        elif f == worst:  # the emptiest bin is broken up too
            displaced += b
        else:
            child.append(b)
            child_fill.append(f)
    displaced = improve(child, child_fill, displaced, sizes, capacity)
    return best_fit(displaced, sizes, capacity, child, child_fill)


def starts(sizes: list[int], capacity: int, island: int, rng: random.Random, population: int):
    """Packings to begin with: best fit in orders about falling size, each island with a disturbance of its own; undisturbed once, on the first."""
    for k in range(population):
        noise = 0.0 if island == k == 0 else 0.1 * (1 + island) * (k + 1) / population
        order = sorted(range(len(sizes)), key=lambda i: -sizes[i] * (1 + noise * rng.random()))
        yield best_fit(order, sizes, capacity, [], [])


def evolve(sizes: list[int], capacity: int, seed: int, elites=(), population: int = POPULATION, crossovers: int = CROSSOVERS, island: int = 0):
    """The fittest (bins, fill) of one island after an epoch; every crossover is made, however good the start."""
    rng = random.Random(seed)
    pool = [([*b], [*f]) for b, f in elites] or []
    pool += starts(sizes, capacity, island, rng, population - len(pool)) if len(pool) < population else []
    pool = sorted(((fitness(s, capacity), k, s) for k, s in enumerate(pool)), key=lambda x: (x[0], -x[1]))
    born = len(pool)
    for _ in range(crossovers if len(pool) > 1 else 0):
        a, b = rng.sample(pool, 2)
        child = cross(max(a, b, key=lambda x: x[0])[2], min(a, b, key=lambda x: x[0])[2], sizes, capacity, rng)
        new = (fitness(child, capacity), born, child)
        born += 1
        if new[0] > pool[0][0]:
            pool[0] = new
            pool.sort(key=lambda x: (x[0], -x[1]))
    return pool[-1][2]


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, close: int = CLOSE, special: bool = True) -> DataFrame:
    """``uid, doc_id, piece, start, length, ids`` (little-endian unsigned 32-bit, binary)."""

    def run(batches):
        from pyspark import TaskContext

        uid = TaskContext.get().partitionId() << 36
        encode = encoder(tokenizer, special)
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"], encode.many(pdf["text"].tolist()), strict=True):
                ids = np.append(ids, np.uint32(close)).astype("<u4", copy=False)
                for k in range(0, len(ids), capacity):
                    part = ids[k : k + capacity]
                    rows.append((uid, doc_id, k // capacity, k, len(part), part.tobytes()))
                    uid += 1
            yield pdf.__class__(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids"])

    doc_id, back = by_name(docs)
    return back(docs.select(doc_id, "text").mapInPandas(run, "uid long, doc_id string, piece int, start long, length long, ids binary"))


def place(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``uid, length`` to ``uid, sequence_id, offset``."""
    whole = pieces.where(F.col("length") >= capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    items = pieces.where(F.col("length") < capacity).select("uid", "length")
    blocks = max(1, -(-items.count() // block))
    spread = items.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)))
    elite = spread.select("block", "uid", "length", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"), F.lit(-1).alias("sender"), F.lit(0).alias("bin"))
    schema = "block long, island int, uid long, length long, bin int, offset long, bins int"

    def epoch(step: int):
        def run(key, pdf):
            let_go()  # the encoder's words
            pdf = pdf.sort_values(["sender", "uid"])
            senders = pdf["sender"].unique().tolist()
            one = pdf[pdf["sender"] == senders[0]]
            uids, sizes = one["uid"].to_numpy(), one["length"].tolist()
            elites = []
            for s in senders if senders != [-1] else []:
                bins, fill = {}, {}
                for i, k in enumerate(pdf.loc[pdf["sender"] == s, "bin"].tolist()):
                    bins.setdefault(k, []).append(i)
                    fill[k] = fill.get(k, 0) + sizes[i]
                elites.append(([tuple(b) for b in bins.values()], list(fill.values())))
            block, island = key
            bins, fill = evolve(sizes, capacity, (int(block) * 64 + int(island)) * 64 + step, elites, island=int(island))
            order, of, at = [], [], []
            for k, b in enumerate(bins):
                offset = 0
                for i in sorted(b):
                    order.append(i)
                    of.append(k)
                    at.append(offset)
                    offset += sizes[i]
            return pdf.__class__({"block": block, "island": island, "uid": uids[order], "length": np.array(sizes)[order], "bin": of, "offset": at, "bins": len(bins)})

        return run

    for step in range(epochs):
        if step:  # the ring: each island keeps its elite and gets its neighbour's
            to = F.array_distinct(F.array("island", F.pmod(F.col("island") + 1, F.lit(islands))))
            elite = elite.select("block", "uid", "length", F.col("island").alias("sender"), "bin", F.explode(to).alias("island"))
        elite = written(elite.groupBy("block", "island").applyInPandas(epoch(step), schema))
    best = elite.groupBy("block").agg(F.min(F.struct("bins", "island")).alias("best")).select(F.col("block").alias("_b"), F.col("best.island").alias("_i"))
    won = elite.join(best, (F.col("block") == F.col("_b")) & (F.col("island") == F.col("_i")))
    return won.select("uid", (F.col("block") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset").unionAll(whole)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, derive=None, **options) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; derive: columns, by name, kept in place of ``ids``."""
    keep = derive(F.col("ids")) if derive else {"ids": F.col("ids")}
    pieces = written(cut(docs, tokenizer, capacity).select("uid", "doc_id", "piece", "start", "length", *[c.alias(k) for k, c in keep.items()]), rows=TEXTS)
    at = place(pieces.select("uid", "length"), capacity, **options)
    return pieces.join(at, "uid").select("doc_id", "piece", "start", "length", *keep, "sequence_id", "offset")
