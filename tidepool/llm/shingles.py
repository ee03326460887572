"""Vectorised hashing of lower-cased words and five-word shingles over whole Arrow batches."""
from __future__ import annotations

import numpy as np

U = np.uint64
#: Fixed values of the 64-bit finaliser of MurmurHash3.
_MIX1, _MIX2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_BASE = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> U(33))
    x = x * _MIX1
    x = x ^ (x >> U(33))
    x = x * _MIX2
    return x ^ (x >> U(33))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    b = np.arange(256, dtype=np.uint64)
    b = np.where((b >= U(65)) & (b <= U(90)), b + U(32), b)
    space = np.zeros(256, bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return mix(b + _BASE), space


_VALUE, _SPACE = _tables()


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the concatenated UTF-8 texts, and how many words each text has.

    data: bytes of all texts one after the other; ends: the end of each text in data. Words are
    maximal runs of bytes other than the ASCII white space 20, 09-0D; A-Z count as a-z. A word
    never spans two texts.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    starts_of_text = np.concatenate([[0], ends[:-1]])
    at = starts_of_text[starts_of_text < n]
    first[at] |= inside[at]
    begin = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & ~first[1:])
    stop = np.flatnonzero(last) + 1
    # A word's hash is a sum of byte value * odd power of the position in the word, from prefix sums.
    power = np.full(n + 1, U(0xD6E8FEB86659FD93), np.uint64)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=total[1:])
    inverse = np.full(n + 1, U(pow(0xD6E8FEB86659FD93, -1, 1 << 64)), np.uint64)
    inverse[0] = 1
    np.multiply.accumulate(inverse, out=inverse)
    h = (total[stop] - total[begin]) * inverse[begin]
    h = mix(h ^ (stop - begin).astype(np.uint64) * _BASE)
    words = np.searchsorted(begin, ends) - np.searchsorted(begin, starts_of_text)
    return h, words


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and the size of each set.

    A text of fewer than `size` words (at least one) has its whole sequence as its one shingle; a text
    without words has the empty set.
    """
    words, count = word_hashes(data, ends)
    n_sh = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    total = int(n_sh.sum())
    if not total:
        return np.zeros(0, np.uint64), n_sh
    first_word = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(ends)), n_sh)
    at = np.arange(total) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + first_word[doc]
    length = np.minimum(count, size)[doc]
    h = np.zeros(total, np.uint64)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    for k in range(size):
        w = padded[at + k] * U((2 * k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) | 1)
        h = np.where(k < length, mix(h + w), h)
    h = mix(h + length.astype(np.uint64))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(total, bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.bincount(doc[keep], minlength=len(ends)).astype(np.int64)
