"""LM scoring by masked pseudo-likelihood.

A network with a window on both sides, written and trained in numpy, predicts each token
from the tokens before and after it. A document's score is the mean of its words'
conditional log-probabilities (their sum is returned too).

The vocabulary comes from the counts of all words of all documents: the most frequent
words are tokens of their own, and the rest fall by hash into SHARED tokens, each of MEMBERS cells. The network gives a
token's probability from its window; a word that shares its token has that times its cell's share of
the token, from the counts of all documents. So every word is scored, not its token alone, up to
words that share a cell; the network's and the cells' probabilities sum to 1 over all words' cells.

Texts are coded once, into a table of token ids in the shared folder. Texts of equal tokens are one, with a weight, and are
dealt by hash into blocks of about PER_BLOCK tokens. A round trains on one place in STRIDE of every text, other
places each time, so that after STRIDE rounds each place has been trained on (ROUNDS is a multiple of it). Each block starts a round from the
same weights, and the blocks' weights are averaged by tokens, in the order of blocks, in a tree. Neither blocks nor
order depend on how the input is partitioned, so reruns agree. Biases start from the tokens' counts. The
output is a softmax over classes, then over the tokens of a class.

Defined cases: a null or empty text, or one without a word, has no tokens, sum 0 and score
null. Places beyond a text's ends are a token of their own. Equal texts have equal scores (up to the rounding of single
precision). Only doc_id and text are read.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, by_name, sliced, summed_slices, tables_of_slices, written

#: Tokens: frequent words, then shared ones; CLASSES x CLASSES in all. The last pads.
CLASSES = 32
FREQUENT = 768
SHARED = CLASSES * CLASSES - FREQUENT
#: Cells of a shared token, at most 1 << 16; and what each counts beyond its words.
MEMBERS = 1 << 13
ALPHA = 0.1
WIDTH = 24
SIDE = 2
ROUNDS = 3
STRIDE = 3
BATCH = 2_048
PER_BLOCK = 1 << 19
#: Tokens that are scored together.
TOGETHER = 1 << 13
RATE = 0.15
SEED = 11
#: Weights of a slice, and blocks whose weights are averaged at a time.
SLICE = 4_096
FAN = 64


class Net:
    """h = tanh(sum of the context's embeddings + b); class and member logits from h and a constant.

    Weights: the embeddings of all places of the window, one after another; b; those of the classes;
    those of each class's members. The constant's weights, the last row, are the biases.
    """

    def __init__(self, weights=None, tokens: int = CLASSES * CLASSES, width: int = WIDTH, side: int = SIDE):
        self.classes, self.side, self.pad = int(tokens**0.5), side, tokens
        if weights is None:
            rng, c = np.random.default_rng(SEED), self.classes
            weights = [rng.normal(0, 0.1, (2 * side * (tokens + 1), width)), np.zeros(width), rng.normal(0, 0.1, (width + 1, c)), rng.normal(0, 0.1, (c, width + 1, c))]
            weights[2][-1] = weights[3][:, -1] = 0
        self.w = [np.asarray(x, np.float32).copy() for x in weights]
        self.seen = [np.full_like(x, 1e-8) for x in self.w]  # sums of squared gradients

    def start_from(self, counts: np.ndarray) -> None:
        """Let the biases give each token its share of all tokens."""
        share = np.log((counts + 1.0) / (counts + 1.0).sum()).reshape(self.classes, self.classes)
        self.w[2][-1] = np.logaddexp.reduce(share, axis=1)
        self.w[3][:, -1] = share - self.w[2][-1][:, None]

    def hidden(self, rows: np.ndarray) -> np.ndarray:
        """rows: of the embeddings, for each place of each window."""
        h = np.ones((len(rows), len(self.w[1]) + 1), np.float32)
        total = self.w[0][rows[:, 0]]
        for k in range(1, rows.shape[1]):
            total += self.w[0][rows[:, k]]
        total += self.w[1]
        np.tanh(total, out=h[:, :-1])
        return h

    def rows(self, context: np.ndarray) -> np.ndarray:
        return context + np.arange(2 * self.side, dtype=np.int32) * (self.pad + 1)

    def _by_class(self, cls: np.ndarray):
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        cuts = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]

    def log_prob(self, context: np.ndarray, token: np.ndarray) -> np.ndarray:
        h = self.hidden(self.rows(context))
        cls, member = np.divmod(token, self.classes)
        order, runs = self._by_class(cls)
        h, cls, member = h[order], cls[order], member[order]
        z = h @ self.w[2]
        got = z[np.arange(len(z)), cls]
        y = np.empty((len(h), self.classes), np.float32)
        for c, a, b in runs:
            np.matmul(h[a:b], self.w[3][c], out=y[a:b])
        got += y[np.arange(len(y)), member]
        for x in (z, y):
            top = x.max(axis=1)
            x -= top[:, None]
            np.exp(x, out=x)
            got -= top + np.log(x.sum(axis=1))
        out = np.empty(len(token))
        out[order] = got
        return out

    def step(self, context: np.ndarray, token: np.ndarray, rate: float, weight: np.ndarray | None = None) -> None:
        """One Adagrad step down the (weighted) mean loss of a batch; rows that are seldom met move further."""
        cls, member = np.divmod(token, self.classes)
        order, runs = self._by_class(cls)
        rows, cls, member, n = self.rows(context[order]), cls[order], member[order], len(token)
        h, at = self.hidden(rows), np.arange(n)
        share = np.float32(1 / n) if weight is None else (weight[order] / weight.sum()).astype(np.float32)[:, None]
        p, q = h @ self.w[2], np.empty((n, self.classes), np.float32)
        for c, a, b in runs:
            np.matmul(h[a:b], self.w[3][c], out=q[a:b])
        for x, right in ((p, cls), (q, member)):
            x -= x.max(axis=1, keepdims=True)
            np.exp(x, out=x)
            x /= x.sum(axis=1, keepdims=True)
            x[at, right] -= 1
            x *= share
        back = p @ self.w[2].T
        grads = np.empty((len(runs), *self.w[3].shape[1:]), np.float32)
        for k, (c, a, b) in enumerate(runs):
            back[a:b] += q[a:b] @ self.w[3][c].T
            np.matmul(h[a:b].T, q[a:b], out=grads[k])
        self._move(3, np.array([c for c, _, _ in runs]), grads, rate)
        self._move(2, slice(None), h.T @ p, rate)
        h, back = h[:, :-1], back[:, :-1]
        back = back * (1 - h * h)
        self._move(1, slice(None), back.sum(axis=0), rate)
        flat = rows.ravel()
        order = np.argsort(flat.astype(np.uint16) if len(self.w[0]) < 1 << 16 else flat, kind="stable")
        own = flat[order]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        self._move(0, own[starts], np.add.reduceat(back[order // rows.shape[1]], starts, axis=0), rate)

    def _move(self, name: int, at, grad: np.ndarray, rate: float) -> None:
        total = self.seen[name][at] + grad * grad
        self.seen[name][at] = total
        self.w[name][at] -= rate * grad / np.sqrt(total)

    def windows(self, ids: list[np.ndarray]):
        """(wide, places, sizes): texts one after another with pads between, and where their tokens are."""
        s, pad = self.side, self.pad
        sizes = np.array([len(x) for x in ids], np.int64)
        places = np.arange(sizes.sum()) + np.repeat(s * (2 * np.arange(len(ids)) + 1), sizes)
        wide = np.full(int(sizes.sum()) + 2 * s * len(ids), pad, np.int32)
        wide[places] = np.concatenate(ids) if ids else []
        return wide, places, sizes

    def around(self, wide: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The window about each place, without itself."""
        s = self.side
        return wide[places[:, None] + np.array([k for k in range(-s, s + 1) if k])]

    def contexts(self, ids: np.ndarray) -> np.ndarray:
        wide, places, _ = self.windows([ids])
        return self.around(wide, places)


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` over all documents; each task sums its own words first."""

    def run(batches):
        from collections import Counter

        seen = Counter()
        pd = None
        for pdf in sliced(batches):
            pd = pdf.__class__
            for text in pdf["text"]:
                seen.update(words_of(text))
            if len(seen) > 500_000:
                yield pd({"word": list(seen), "n": list(seen.values())})
                seen.clear()
        if seen:
            yield pd({"word": list(seen), "n": list(seen.values())})

    return docs.select("text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, size: int = FREQUENT) -> dict[str, int]:
    """The most frequent words, ties by code point."""
    rows = word_counts(docs).orderBy(F.desc("n"), "word").limit(size).collect()
    return {r["word"]: k for k, r in enumerate(rows)}


class Cells(dict):
    """A word that is no token of its own gets a cell by hash, as a number from FREQUENT."""

    def __missing__(self, word: str) -> int:
        self[word] = cell = FREQUENT + zlib.crc32(word.encode()) % (SHARED * MEMBERS)
        return cell


class Coder:
    """Words to numbers: a frequent word's token, or FREQUENT and a cell; words are kept up to a bound."""

    KEEP = 400_000

    def __init__(self, vocab: dict[str, int]):
        self.vocab, self.seen = vocab, Cells(vocab)

    def __call__(self, text: str | None) -> np.ndarray:
        if len(self.seen) > self.KEEP:
            self.seen = Cells(self.vocab)
        return np.array(list(map(self.seen.__getitem__, words_of(text))), np.int32)


def split(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token of each word, member within its token of each word that shares one)."""
    shared = numbers >= FREQUENT
    member, token = np.divmod(numbers[shared] - FREQUENT, SHARED)
    tokens = numbers.copy()
    tokens[shared] = FREQUENT + token
    return tokens, member


def code(docs: DataFrame, vocab: dict[str, int]) -> DataFrame:
    """``doc_id`` (as a string), ``ids``, ``rest``: split() of each text, as little-endian unsigned 16-bit numbers."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)  # FREQUENT words

    def run(batches):
        coder = Coder(words.value)
        for pdf in batches:
            rows = [[x.astype("<u2").tobytes() for x in split(coder(t))] for t in pdf["text"]]
            yield pdf.__class__({"doc_id": pdf["doc_id"], "ids": [a for a, _ in rows], "rest": [b for _, b in rows]})

    doc_id, _ = by_name(docs)
    return docs.select(doc_id, "text").mapInPandas(run, "doc_id string, ids binary, rest binary")


def counts_of(coded: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How often each token occurs in all texts, and each cell (SHARED, MEMBERS)."""

    def run(batches):
        from pyspark import TaskContext

        total, pd = np.zeros(FREQUENT + SHARED * MEMBERS, np.int64), None
        for pdf in sliced(batches):
            pd = pdf.__class__
            ids = np.frombuffer(b"".join(pdf["ids"]), "<u2")
            total[:FREQUENT] += np.bincount(ids[ids < FREQUENT], minlength=FREQUENT)
            cells = (ids[ids >= FREQUENT].astype(np.int64) - FREQUENT) * MEMBERS + np.frombuffer(b"".join(pdf["rest"]), "<u2")
            at, n = np.unique(cells, return_counts=True)
            total[FREQUENT + at] += n
        if pd:
            out = tables_of_slices(pd, total, TaskContext.get().partitionId(), [])
            yield out[[bool(v.any()) for v in out["v"]]]

    total = summed_slices(coded.select("ids", "rest").mapInPandas(run, "part int, task int, v array<long>"), FREQUENT + SHARED * MEMBERS)
    cells = total[FREQUENT:].reshape(SHARED, MEMBERS)
    return np.concatenate([total[:FREQUENT], cells.sum(axis=1)]), cells


def shares(cells: np.ndarray) -> np.ndarray:
    """Log-probability of each cell given its token."""
    return np.log((cells + ALPHA) / (cells.sum(axis=1, keepdims=True) + ALPHA * MEMBERS)).astype(np.float32)


def blocks_of(coded: DataFrame, tokens: int, per_block: int = PER_BLOCK) -> tuple[DataFrame, int]:
    """``block, ids, sizes, copies`` of the distinct texts, and the number of blocks; a block's texts follow each other in order of a hash."""
    texts = coded.where(F.length("ids") > 0).groupBy("ids").agg(F.count("*").alias("n"))
    n = max(1, -(-tokens // per_block))
    dealt = texts.withColumn("h", F.xxhash64("ids")).withColumn("block", F.pmod("h", F.lit(n)).cast("int"))

    def join(pdf):
        pdf = pdf.sort_values(["h", "ids"])
        sizes = np.array([len(x) // 2 for x in pdf["ids"]], "<i8")
        return pdf.__class__({"block": pdf["block"].iloc[:1], "ids": [b"".join(pdf["ids"])], "sizes": [sizes.tobytes()], "copies": [pdf["n"].to_numpy("<i8").tobytes()]})

    return dealt.groupBy("block").applyInPandas(join, "block int, ids binary, sizes binary, copies binary"), n


def averaged(found: DataFrame, blocks: int) -> list:
    """The rows ``part, block, seen, v`` to one for each part, means weighted by seen, in a tree and in order of blocks."""

    def mean(pdf):
        pdf = pdf.sort_values("block")
        seen = pdf["seen"].to_numpy()
        v = sum(n * np.asarray(x, np.float64) for n, x in zip(seen, pdf["v"], strict=True)) / seen.sum()
        return pdf.__class__({"part": pdf["part"].iloc[:1], "block": pdf["block"].iloc[:1], "seen": [seen.sum()], "v": [v]})

    while True:
        blocks = -(-blocks // FAN)
        found = found.withColumn("block", F.floor(F.col("block") / FAN).cast("int")).groupBy("part", "block").applyInPandas(mean, "part int, block int, seen double, v array<double>")
        if blocks == 1:
            return found.collect()


def train(blocks: DataFrame, n: int, counts: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE) -> Net:
    """Rounds of training in every block and averaging; what comes to the driver is one set of weights."""
    sc = blocks.sparkSession.sparkContext
    net = Net(tokens=len(counts))
    net.start_from(counts)
    for r in range(rounds):
        sent = sc.broadcast(net.w)  # a fixed number of weights

        def run(batches, r=r, sent=sent):
            rate = RATE / (1 + r)
            for pdf in batches:
                for row in pdf.itertuples():
                    own = Net(sent.value, len(counts))
                    sizes, copies = np.frombuffer(row.sizes, "<i8"), np.frombuffer(row.copies, "<i8")
                    wide, places, _ = own.windows(np.split(np.frombuffer(row.ids, "<u2"), np.cumsum(sizes)[:-1]))
                    weight = np.repeat(copies.astype(np.float64), sizes)
                    some = (np.arange(len(places)) + r) % stride == 0
                    places, weight = places[some], weight[some]
                    for k in range(0, len(places), BATCH):
                        part = places[k : k + BATCH]
                        own.step(own.around(wide, part), wide[part], rate, weight[k : k + BATCH])
                    if len(places):
                        flat = np.concatenate([x.ravel() for x in own.w])
                        starts = range(0, len(flat), SLICE)
                        yield pdf.__class__({"part": [k // SLICE for k in starts], "block": row.block, "seen": weight.sum(), "v": [flat[k : k + SLICE] for k in starts]})

        merged = averaged(blocks.mapInPandas(run, "part int, block int, seen double, v array<float>"), n)
        if not merged:
            break
        flat = np.concatenate([np.array(x["v"]) for x in sorted(merged, key=lambda x: x["part"])])
        at, new = 0, []
        for x in net.w:
            new.append(flat[at : at + x.size].reshape(x.shape))
            at += x.size
        net = Net(new, len(counts))
    return net


def score(docs: DataFrame, rounds: int = ROUNDS, stride: int = STRIDE, per_block: int = PER_BLOCK) -> DataFrame:
    """``doc_id, n_tokens, log_prob, score`` of every row."""
    coded = written(code(docs, vocabulary(docs)), rows=TEXTS)
    counts, cells = counts_of(coded)
    blocks, n = blocks_of(coded, int(counts.sum()), per_block)
    net = train(written(blocks), n, counts, rounds, stride)
    sent = docs.sparkSession.sparkContext.broadcast((net.w, shares(cells)))  # a fixed number of weights

    def run(batches):
        own, share = Net(sent.value[0], len(counts)), sent.value[1]
        for pdf in sliced(batches):
            wide, places, n = own.windows([np.frombuffer(x, "<u2") for x in pdf["ids"]])
            of, total = np.repeat(np.arange(len(n)), n), np.zeros(len(n))
            for a in range(0, len(places), TOGETHER):
                part = places[a : a + TOGETHER]
                total += np.bincount(of[a : a + TOGETHER], own.log_prob(own.around(wide, part), wide[part]), len(n))
            token = wide[places]
            shared = token >= FREQUENT
            total += np.bincount(of[shared], share[token[shared] - FREQUENT, np.frombuffer(b"".join(pdf["rest"]), "<u2")], len(n))
            mean = [float(s / k) if k else None for s, k in zip(total, n, strict=True)]
            yield pdf.__class__({"doc_id": pdf["doc_id"], "n_tokens": n, "log_prob": total, "score": np.array(mean, object)})

    _, back = by_name(docs)
    return back(coded.mapInPandas(run, "doc_id string, n_tokens long, log_prob double, score double"))
