"""Hashed features of words, shared by the two classifiers: the word itself, its character n-grams and, where asked for, its beginnings."""

from __future__ import annotations

import re
from array import array
from zlib import crc32

import numpy as np


def word_features(word: str, grams: tuple[int, ...], buckets: int) -> list[int]:
    """Buckets of the word and, for each n of grams, of its distinct character n-grams between boundary marks; a negative n stands for the
    word's first -n characters, if it has more."""
    w = f"<{word}>"
    found = dict.fromkeys(w[i : i + n] for n in grams if n > 0 for i in range(len(w) - n + 1))
    first = [word[:-n] for n in grams if n < 0 and len(word) > -n]
    marked = [b"#" + g.encode("utf-8", "surrogatepass") for g in found if g != w] + [b"^" + h.encode("utf-8", "surrogatepass") for h in first]
    return [crc32(w.encode("utf-8", "surrogatepass")) % buckets, *(crc32(m) % buckets for m in marked)]


class Lexicon:
    """Numbers for words in order of appearance, with the flat list of their features."""

    def __init__(self, grams: tuple[int, ...], buckets: int):
        self.grams, self.buckets = grams, buckets
        self.number: dict[str, int] = {}
        self.features, self.counts = array("i"), array("i")

    def add(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.int64)
        for k, w in enumerate(words):
            n = self.number.get(w)
            if n is None:
                n = self.number[w] = len(self.number)
                f = word_features(w, self.grams, self.buckets)
                self.features.extend(f)
                self.counts.append(len(f))
            out[k] = n
        return out

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(features, start of each word's)."""
        return np.asarray(self.features, np.int32), np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)


class Scores(dict):
    """word -> what `make` gives for its features; starts anew when it holds `limit` words. Very long words aren't kept."""

    def __init__(self, make, grams: tuple[int, ...], buckets: int, limit: int = 300_000):
        super().__init__()
        self.make, self.grams, self.buckets, self.limit = make, grams, buckets, limit

    def __missing__(self, word: str):
        v = self.make(np.asarray(word_features(word, self.grams, self.buckets)))
        if len(self) >= self.limit:
            self.clear()
        if len(word) <= 64:
            self[word] = v
        return v


SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+|\n|\Z)")
