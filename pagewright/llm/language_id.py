"""Language ID by segmentation-marginalised unigrams.

Each language holds a probability for every piece of a fixed public byte-level
vocabulary. A word's probability is the sum over all its segmentations into pieces,
by a forward pass over its bytes; a text's is the product over its words.

Defined cases: a null text, or one without a letter, is ``und`` with score 0. A null
language or id is never learned from. Where nothing can be learned, every text is
``und``. Ties go to the first language by code point. Repeated rows are predicted
alike. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, prefix_for, written
from .tokens import Numbered, held

LETTERS = re.compile(r"[^\W\d_]+")
#: Documents learned from, for each language at most.
SAMPLE_DOCS = 300
ROUNDS = 4
SMOOTHING = 0.05
#: Bytes of a word up to which words of one length make a lattice of all spans; longer ones (text without blanks)
#: make a lattice of the pieces that they hold, with others of about their length, of so many bytes together.
LONG = 40
TOGETHER_BYTES = 1 << 17


def load_pieces(path: str) -> dict[bytes, int]:
    """A ``.tiktoken`` file: every single byte is a piece, so any word has a segmentation."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Lattice:
    """Words of one length, with the piece (or none, the last id) of each span."""

    def __init__(self, words: list[bytes], pieces: dict[bytes, int], none: int):
        self.n = len(words[0])
        self.ids = {}
        get = pieces.get
        for j in range(1, self.n + 1):
            for i in range(j):
                ids = np.array([get(w[i:j], none) for w in words], np.int32)
                if j - i == 1 or (ids != none).any():
                    self.ids[i, j] = ids

    def forward(self, p: np.ndarray) -> list[np.ndarray]:
        """p: (pieces + 1, languages), zero in its last row."""
        alpha = [np.ones((len(self.ids[0, 1]), p.shape[1]))] + [0.0] * self.n
        for (i, j), ids in self.ids.items():
            alpha[j] = alpha[j] + alpha[i] * p[ids]
        return alpha

    def expected(self, p: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add each piece's expected count, for one language; into: (pieces + 1,)."""
        alpha = self.forward(p)
        beta = [0.0] * self.n + [np.ones_like(alpha[0])]
        spans = sorted(self.ids, key=lambda s: -s[0])
        for i, j in spans:
            beta[i] = beta[i] + p[self.ids[i, j]] * beta[j]
        scale = weight[:, None] / np.maximum(alpha[self.n], 1e-300)
        for (i, j), ids in self.ids.items():
            share = alpha[i] * p[ids] * beta[j] * scale
            into += np.bincount(ids, share[:, 0], len(into))


class LongLattice:
    """Words of any lengths, with the pieces found in each; sums are kept as logarithms, so no length is too much."""

    def __init__(self, words: list[bytes], pieces: dict[bytes, int], starts: set[bytes]):
        self.n = np.array([len(w) for w in words])
        found, get = [], pieces.get
        for r, w in enumerate(words):
            for i in range(len(w)):
                j = i + 1
                while j <= len(w):
                    part = w[i:j]
                    if (k := get(part)) is not None:
                        found.append((r, i, j, k))
                    if part not in starts:
                        break
                    j += 1
        self.spans = np.array(found, np.int64)
        self.reach = int((self.spans[:, 2] - self.spans[:, 1]).max())

    def _by(self, column: int):
        """Spans in order of their starts or ends, and of words within; bounds of each place."""
        order = np.lexsort((self.spans[:, 0], self.spans[:, column]))
        spans = self.spans[order]
        return spans, np.searchsorted(spans[:, column], np.arange(self.n.max() + 2))

    @staticmethod
    def _sums(r: np.ndarray, x: np.ndarray):
        """(words, sums of their rows); r is sorted."""
        at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        return r[at], np.add.reduceat(x, at, axis=0)

    def forward(self, p: np.ndarray, keep: bool = False):
        """Log of each word's sum, (words, languages); with keep, of the sums up to each place too. Else only as many places as a piece spans are held."""
        spans, cuts = self._by(2)
        held = int(self.n.max()) + 1 if keep else self.reach + 1
        alpha, out = np.full((len(self.n), held, p.shape[1]), -np.inf), np.zeros((len(self.n), p.shape[1]))
        alpha[:, 0] = 0
        for j in range(1, self.n.max() + 1):
            r, i, _, k = spans[cuts[j] : cuts[j + 1]].T
            last = alpha[:, (j - 1) % held]
            words, total = self._sums(r, np.exp(alpha[r, i % held] - last[r]) * p[k])
            alpha[words, j % held] = last[words] + np.log(total)
            done = words[self.n[words] == j]
            out[done] = alpha[done, j % held]
        return (out, alpha) if keep else out

    def expected(self, p: np.ndarray, weight: np.ndarray, into: np.ndarray) -> None:
        """Add each piece's expected count, for one language."""
        total, alpha = self.forward(p, keep=True)
        beta = np.full(alpha.shape, -np.inf)
        beta[np.arange(len(self.n)), self.n] = 0
        spans, cuts = self._by(1)
        for i in range(self.n.max() - 1, -1, -1):
            r, _, j, k = spans[cuts[i] : cuts[i + 1]].T
            after = beta[:, i + 1]
            words, sums = self._sums(r, np.exp(beta[r, j] - after[r]) * p[k])
            beta[words, i] = after[words] + np.log(sums)
        r, i, j, k = self.spans.T
        share = np.exp(alpha[r, i, 0] + beta[r, j, 0] - total[r, 0]) * p[k, 0] * weight[r]
        into += np.bincount(k, share, len(into))


def piece_starts(pieces: dict[bytes, int]) -> set[bytes]:
    """What a longer piece may begin with."""
    return {w[:k] for w in pieces for k in range(1, len(w))}


def _by_length(words: list[bytes]):
    """Numbers of words of equal lengths up to LONG, and of longer ones in groups of alike lengths and bounded size."""
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        groups.setdefault(len(w), []).append(k)
    for n in sorted(n for n in groups if n <= LONG):
        for a in range(0, len(groups[n]), 20_000):
            yield False, groups[n][a : a + 20_000]
    some: list[int] = []
    for n in sorted(n for n in groups if n > LONG):
        for k in groups[n]:
            if some and (len(some) + 1) * n > TOGETHER_BYTES:
                yield True, some
                some = []
            some.append(k)
    if some:
        yield True, some


@dataclass
class Model:
    langs: list[str]
    pieces: dict[bytes, int]
    starts: set[bytes]
    p: np.ndarray  # (pieces + 1, languages)

    def log_words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language."""
        spelt = [b" " + w.encode() for w in words]
        out = np.empty((len(words), len(self.langs)))
        for long, part in _by_length(spelt):
            own = [spelt[k] for k in part]
            out[part] = LongLattice(own, self.pieces, self.starts).forward(self.p) if long else np.log(Lattice(own, self.pieces, len(self.p) - 1).forward(self.p)[-1])
        return out


def fit(counts: dict[str, dict[str, int]], pieces: dict[bytes, int], rounds: int = ROUNDS) -> Model:
    """EM over all words of each language, from equal probabilities."""
    langs, none, starts = sorted(counts), max(pieces.values()) + 1, piece_starts(pieces)
    p = np.zeros((none + 1, len(langs)))
    for c, lang in enumerate(langs):
        spelt = [b" " + w.encode() for w in counts[lang]]
        weight = np.array(list(counts[lang].values()), float)
        lattices = []
        for long, part in _by_length(spelt):
            own = [spelt[k] for k in part]
            lattices.append((LongLattice(own, pieces, starts) if long else Lattice(own, pieces, none), weight[part]))
        q = np.full((none + 1, 1), 1.0 / none)
        q[none] = 0
        for _ in range(rounds):
            found = np.full(none + 1, SMOOTHING)
            for lattice, w in lattices:
                lattice.expected(q, w, found)
            found[none] = 0
            q = (found / found.sum())[:, None]
        p[:, c] = q[:, 0]
    return Model(langs, pieces, starts, p)


def is_held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from at most sample_docs whole documents of each language, chosen by a hash of their id."""
    own = docs.where("doc_id is not null and lang is not null").where(~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("_h"))
    # a share by hash first, of about twice the sample, so that no task reads rows by the number of tasks
    sizes = own.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return fit({}, load_pieces(vocabulary))
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, 2.0 * sample_docs / r["n"]))])
    first = Window.partitionBy("lang").orderBy("_h", "doc_id", "text")
    rows = (
        own.where(F.pmod("_h", F.lit(1 << 30)) <= share[F.col("lang")] * (1 << 30))
        .where("text is not null")
        .withColumn("_k", F.row_number().over(first))
        .where(F.col("_k") <= sample_docs)
    )

    def count(batches):
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
                words = words_of(text)
                if words:
                    u, n = np.unique(np.array(words, object), return_counts=True)
                    yield pdf.__class__({"lang": lang, "word": u, "n": n})

    found: dict[str, dict[str, int]] = {}
    for r in rows.select("lang", "text").mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).orderBy("lang", "word").collect():
        found.setdefault(r["lang"], {})[r["word"]] = r["n"]
    return fit(found, load_pieces(vocabulary))


#: Words, and their characters, whose scores a worker keeps; words that it looks up together.
KEEP = 600_000
KEEP_CHARS = 1 << 25
TOGETHER = 200_000


class Judge:
    """Predicts texts, many at a time; scores of words are kept up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known, self.scores, self.chars = Numbered(), np.zeros((1 << 16, len(self.model.langs))), 0

    def _sums(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Log-probabilities of runs of words, each of one or more."""
        if len(self.known) > KEEP or self.chars > KEEP_CHARS:
            self._clear()
        before = len(self.known)
        ids = np.array(list(map(self.known.__getitem__, words)), np.int64)
        while len(self.known) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        if len(self.known) > before:
            new = list(islice(reversed(self.known), len(self.known) - before))[::-1]
            self.scores[before : len(self.known)] = self.model.log_words(new)
            self.chars += sum(map(len, new))
        return np.add.reduceat(self.scores[ids], np.cumsum(sizes) - sizes, axis=0)

    def __call__(self, texts) -> tuple[list[str], np.ndarray]:
        pred, score = ["und"] * len(texts), np.zeros(len(texts))
        words, rows, sizes = [], [], []
        for k, text in enumerate(texts):
            if text is not None and any(map(str.isalpha, text)):
                own = words_of(text)
                words += own
                rows.append(k)
                sizes.append(len(own))
            if rows and (len(words) >= TOGETHER or k == len(texts) - 1):
                total = self._sums(words, np.array(sizes))
                best = total.argmax(axis=1)
                score[rows] = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                for row, c in zip(rows, best.tolist(), strict=True):
                    pred[row] = self.model.langs[c]
                words, rows, sizes = [], [], []
        return pred, score


def predictor(spark, model: Model, token: str):
    """A function of a text column: ``struct<lang_pred, score>``. token names the model in the workers' caches."""
    kind = "lang_pred string, score double"
    if not model.langs:
        return lambda text: F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = spark.sparkContext.broadcast((model.langs, model.p))  # pieces x languages
    path = token.split("|", 1)[1]

    def run(batches):
        import pandas as pd

        def make():
            pieces = load_pieces(path)
            return Judge(Model(sent.value[0], pieces, piece_starts(pieces), sent.value[1]))

        judge = held(("judge", token), make)
        for texts in batches:
            pred, score = judge(texts.tolist())
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    from collections.abc import Iterator

    import pandas as pd

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind).asNondeterministic()  # else a filter above would run it twice


def _fitted(docs: DataFrame, vocabulary: str, sample_docs: int):
    import uuid

    return predictor(docs.sparkSession, train(docs, vocabulary, sample_docs), f"{uuid.uuid4().hex}|{vocabulary}")


def keep_known(docs: DataFrame, vocabulary: str, least: float, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """The rows whose text is of a learned language with a score of least or more, as a table: the model is not run again, and batches are small."""
    verdict = prefix_for(docs)
    out = docs.withColumn(verdict, _fitted(docs, vocabulary, sample_docs)("text"))
    return written(out.where((F.col(verdict)["lang_pred"] != "und") & (F.col(verdict)["score"] >= least)).drop(verdict), rows=TEXTS)


def identify(docs: DataFrame, vocabulary: str, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Learn from the rows that aren't held out, then predict every row: ``doc_id, held_out, lang_pred, score``."""
    out = written(docs.select("doc_id", _fitted(docs, vocabulary, sample_docs)("text").alias("_verdict")), rows=TEXTS)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "_verdict.lang_pred", "_verdict.score")
