"""Whole-batch text work in numpy, used inside Spark tasks.

A batch of texts becomes one array of code points; words, shingles and their
64-bit hashes then come from a few array operations instead of a Python loop
over tokens. Callers pass texts through `batches`, so the arrays stay a few
tens of MB however long the documents are (a single text is never split).
"""

from __future__ import annotations

from functools import cache

import numpy as np

#: Code points in one batch of texts; one longer text makes a batch of its own.
BATCH_CHARS = 1_000_000
_B = np.uint64(0x9E3779B97F4A7C15)
_LETTER, _NUMBER, _SPACE, _RARE = 1, 2, 3, 4


@cache
def space_table() -> np.ndarray:
    """Per code point: is it white space (str.isspace)?"""
    out = np.zeros(0x110000, bool)
    out[:0x3001] = [chr(i).isspace() for i in range(0x3001)]  # none lies above
    return out


@cache
def class_table() -> np.ndarray:
    """Per code point: letter, number, white space, rare (class may differ between Unicode versions) or other (0)."""
    import unicodedata

    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], 0) for i in range(0x10000)), np.uint8, 0x10000)
    for i in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[i] = _SPACE
    rare = np.fromiter((unicodedata.category(chr(i)) in ("Cn", "Cs", "Co") for i in range(0x10000)), bool, 0x10000)
    out[rare | (np.arange(0x10000) >= 0xA640) & (np.arange(0x10000) < 0xAC00)] = _RARE
    out[0x1C:0x20] = _RARE
    return np.concatenate([out, np.full(0x100000, _RARE, np.uint8)])


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@cache
def _char_values() -> np.ndarray:
    return mix(np.arange(1, 0x110001, dtype=np.uint64) * _B)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's first n powers modulo 2**64 and their inverses."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        for k, base in enumerate((_B, inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def batches(texts: list[str]):
    """(first, last) index ranges of about BATCH_CHARS code points each."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield first, i
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, len(texts)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and each text's start followed by the end of all."""
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=ends[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def span_hashes(arr: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One 64-bit hash per span of code points; equal strings hash equally wherever they stand."""
    up, down = powers(len(arr) + 1)
    sums = np.zeros(len(arr) + 1, np.uint64)
    np.cumsum(_char_values()[arr] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """White-space separated words of a batch: hash, text index, start and length in code points."""
    return words_of(*code_points(texts))


def words_of(arr: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same from code points."""
    if not len(arr):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    ink = ~space_table()[arr]
    before = np.concatenate([[False], ink[:-1]])
    cuts = ends[:-1][ends[:-1] < len(arr)]
    before[cuts] = False
    start = np.flatnonzero(ink & ~before)
    after = np.concatenate([ink[1:], [False]])
    after[cuts[cuts > 0] - 1] = False
    end = np.flatnonzero(ink & ~after) + 1
    return span_hashes(arr, start, end), np.searchsorted(ends, start, "right") - 1, start, end - start


def shingles(word: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words of the same text, and the text's index. A text of 1 to n - 1 words has one shingle, all its words."""
    if not len(word):
        return word, text
    total = np.zeros(len(word), np.uint64)
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[first, len(text)])
    left = np.repeat(first + count, count) - np.arange(len(text))  # words from here to the text's end
    for i in range(n):
        at = np.minimum(np.arange(len(word)) + i, len(word) - 1)
        total = mix(total * _B + np.where(left > i, word[at], np.uint64(i + 1)) + np.uint64(1))
    keep = (left >= n) | (np.repeat(count, count) < n) & (left == np.repeat(count, count))
    return total[keep], text[keep]


def pretokens(arr: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of the byte-level BPE's splitting pattern starts, and which texts hold a character of uncertain class."""
    cls = class_table()[arr]
    n = len(arr)
    first = np.zeros(n, bool)
    first[ends[:-1][ends[:-1] < n]] = True
    same = np.concatenate([[False], cls[1:] == cls[:-1]]) & ~first
    start = ~same
    # the last white space of a run belongs to what follows if it is a blank, and stands alone otherwise
    at = np.flatnonzero(start & ~first & (cls != _SPACE))
    at = at[cls[at - 1] == _SPACE]
    start[at - 1] = True
    start[at[arr[at - 1] == 32]] = False
    # contractions: a lone apostrophe takes s, t, m, d, re, ve or ll from the letters that follow
    q = np.flatnonzero((arr == 39) & start)
    q = q[q + 1 < n]
    q = q[(cls[q + 1] == _LETTER) & ~first[q + 1]]
    a, b = arr[q + 1], arr[np.minimum(q + 2, n - 1)]
    two = (q + 2 < n) & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
    two &= ~first[np.minimum(q + 2, n - 1)]
    one = np.isin(a, [ord(c) for c in "stmd"])
    for hit, k in ((one, 2), (two, 3)):
        start[q[hit] + 1] = False
        to = q[hit] + k
        start[to[to < n]] = True
    rare = np.flatnonzero(cls == _RARE)
    return np.flatnonzero(start), np.unique(np.searchsorted(ends, rare, "right") - 1)
