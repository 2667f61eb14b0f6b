"""Whole texts to token ids of a public word-BPE file, with a cache of words.

Its pre-tokenizer never joins characters across a blank or a line break, so a text's
ids are those of its blank-separated words in turn. Each worker keeps the ids of
the words that it has met, up to a bound, and encodes a word once.
"""

from __future__ import annotations

import ctypes
import gc
import re
from contextlib import suppress
from itertools import islice

import numpy as np

_SIMPLE = re.compile(r"[a-zà-öø-ÿ]+\Z")
#: Kinds of Latin-1 characters: letters and digits, marks that may end a word, blanks, all else.
_KINDS = bytes(ord("a" if c.isalnum() else "." if c in ".," else " " if c in " \n" else "!") for c in map(chr, range(256)))
#: The byte-level alphabet: printable bytes stand for themselves, the rest for 256 and up in order.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*_PRINTED}))}


class Numbered(dict):
    """A word that is new gets the next number."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        return k


class WordEncoder:
    """Ids of texts; special=True: a special token's string in a text becomes its id."""

    #: Words kept before the cache starts anew; bounds the memory of a worker.
    KEEP = 600_000

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        # the same model for words that are normal already and spelt in the byte-level alphabet
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        for piece, i in vocab.items():
            self.ends[i] = piece.endswith("</w>")
        self._clear()

    def _clear(self) -> None:
        self.at = Numbered({"": 0})
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.flat = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _put(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Note the ids of numbered words, which follow each other in ids."""
        n = len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + n] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += n

    def _learn(self, words: list[str], first: int) -> None:
        """Encode new words, numbered from first. Those of letters go together: each ends with its only word-end piece."""
        while first + len(words) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        match = _SIMPLE.match
        letters = np.array([match(w) is not None for w in words], bool)
        plain, other = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
        parts = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        spelt = [" ".join([words[k] for k in part.tolist()]) for part in parts]
        spelt = [t if t.isascii() else t.encode().decode("latin-1").translate(_ALPHABET).replace(chr(_ALPHABET[32]), " ") for t in spelt]
        for part, e in zip(parts, self.bare.encode_batch_fast(spelt, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part):
                self._put(first + part, ids, np.diff(stops, prepend=0))
            else:
                other += part.tolist()
        if other:
            each = [e.ids for e in self.tokenizer.encode_batch_fast([words[k] for k in other], add_special_tokens=False)]
            self._put(first + np.array(other), np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each]))

    @staticmethod
    def _split(text: str) -> list[str]:
        """Parts of a text that the file's own rules never join.

        A text of Latin-1 alone is lower-cased first, as the file does to each of its characters, and
        loses the full stops and commas at its words' ends to words of their own.
        """
        if "<|" not in text:
            try:
                kinds = text.encode("latin-1").translate(_KINDS)
            except UnicodeEncodeError:
                kinds = b"!."
            if b"!." not in kinds and b".." not in kinds:  # else a mark may join what stands before it
                text = text.lower()
                for mark in ".,":
                    text = text.replace(mark + " ", f" {mark} ").replace(mark + "\n", f" {mark} ")
                if text[-1:] in (".", ","):
                    text = f"{text[:-1]} {text[-1]}"
        return text.replace("\n", " ").split(" ")

    def many(self, texts) -> list[np.ndarray]:
        """Ids of each text; a null or empty one has none."""
        out, words, ends = [], [], []
        for k, text in enumerate(texts):
            if text:
                words += self._split(text)
            ends.append(len(words))
            if len(words) > 200_000 or k == len(texts) - 1:
                flat, sizes = self._ids(words)
                cuts = np.concatenate([[0], np.cumsum(sizes)])[np.array([0, *ends])].tolist()
                out += [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                words, ends = [], []
        return out

    def _ids(self, words: list[str]):
        if not words:
            return self.flat[:0], np.zeros(0, np.int64)
        if len(self.at) > self.KEEP:
            self._clear()
        before = len(self.at)
        k = np.array(list(map(self.at.__getitem__, words)), np.int64)
        if len(self.at) > before:
            new = list(islice(reversed(self.at), len(self.at) - before))
            self._learn(new[::-1], before)
        sizes = self.sizes[k]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[k] - ends + sizes, sizes) + np.arange(ends[-1])], sizes

    def __call__(self, text: str) -> np.ndarray:
        return self.many([text])[0]


_held: list = [None, None]


def held(key, make):
    """What a worker keeps from task to task under a key: one thing, so that stages do not pile up in its memory."""
    if _held[0] != key:
        let_go()  # the old one goes first
        _held[:] = [key, make()]
    return _held[1]


def let_go() -> None:
    """Give back what an earlier stage left in this worker: what is held, and freed memory that allocators keep for themselves."""
    import pyarrow as pa

    if _held[0] is not None:
        _held[:] = [None, None]
        gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc's alone
        ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str, special: bool = True) -> WordEncoder:
    """The worker's own encoder of a file."""
    return held(("encoder", path, special), lambda: WordEncoder(path, special))
