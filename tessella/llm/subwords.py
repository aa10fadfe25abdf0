"""Words of documents and their subword features as arrays, for the trained classifiers."""

from __future__ import annotations

import numpy as np

from .common import ALNUM, BYTE_CODE, LOWER, gram_hashes, prefix_hash, span_hash, strong, word_spans

#: Letters only: ASCII letters and all of non-ASCII.
LETTERS = ALNUM.copy()
LETTERS[0x30:0x3A] = False


def distinct_words(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, is_word: np.ndarray = LETTERS):
    """(bytes of the distinct words one after the other, where each begins with the total at the end, index of each word of the documents, first word of each document with the total at the end, hashes of the distinct words)."""
    low = LOWER[buf]
    s, e, first = word_spans(buf, starts, lens, is_word)
    hashes = strong(low, s, e, span_hash(prefix_hash(BYTE_CODE[low]), s, e))
    kinds, at, back = np.unique(hashes, return_index=True, return_inverse=True)
    size = (e - s)[at]
    begin = np.append(0, np.cumsum(size))
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], size) + np.repeat(s[at], size)
    return low[inside], begin, back, first, kinds


def framed(data: np.ndarray, begin: np.ndarray, left: int = 0x3C, right: int = 0x3E) -> tuple[np.ndarray, np.ndarray]:
    """The words between two marks."""
    n = len(begin) - 1
    begin2 = begin + 2 * np.arange(n + 1)
    out = np.empty(begin2[-1], np.uint8)
    out[begin2[:-1]], out[begin2[1:] - 1] = left, right
    out[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(begin))] = data
    return out, begin2


def subwords(data: np.ndarray, begin: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature of each subword and of the whole word, the word that it belongs to); n-grams of bytes, hashed to buckets."""
    codes, first = framed(data, begin)
    codes = BYTE_CODE[codes]
    features, words = [], []
    for n in (*sizes, 1 << 40):
        grams, where = gram_hashes(codes, first, n, whole_if_short=n == 1 << 40)
        features.append((grams % np.uint64(buckets)).astype(np.int64))
        words.append(np.repeat(np.arange(len(begin) - 1), np.diff(where)))
    return np.concatenate(features), np.concatenate(words)


def affixes(data: np.ndarray, begin: np.ndarray, sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed prefixes and suffixes of the framed words, with the words that they belong to."""
    codes, first = framed(data, begin)
    p = prefix_hash(BYTE_CODE[codes])
    features, words = [], []
    for n in sizes:
        long = np.flatnonzero(np.diff(first) > n)
        s, e = first[:-1][long], first[1:][long]
        for a, b, salt in ((s, s + n + 1, 1), (e - n - 1, e, 2)):
            features.append(((span_hash(p, a, b) + np.uint64(salt)) % np.uint64(buckets)).astype(np.int64))
            words.append(long)
    return np.concatenate(features), np.concatenate(words)


class Adam:
    """Steps of the Adam optimiser on arrays in place."""

    def __init__(self, *arrays: np.ndarray, rate: float):
        self.arrays, self.rate, self.t = arrays, rate, 0
        self.m, self.v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]

    def step(self, *gradients: np.ndarray) -> None:
        self.t += 1
        for a, g, m, v in zip(self.arrays, gradients, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
