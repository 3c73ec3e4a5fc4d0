"""Whole-batch text arithmetic in numpy: split, fold and hash every word of a batch of texts without a Python loop over
words.

A batch is one byte buffer; the texts in it are separated by one byte that the caller's word class never contains. The
hash of a word is a polynomial in random 64-bit byte values, taken from a running sum, then mixed; it depends on the word's
bytes alone, so it agrees between tasks, runs and machines.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_pow = {"b": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}


def _powers(kind: str, n: int) -> np.ndarray:
    """Powers 0 .. n-1 of the base (or of its inverse) modulo 2^64; kept and doubled on demand."""
    have = _pow[kind]
    base = _BASE if kind == "b" else _INV
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    _pow[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Texts are handled in pieces of about this many bytes, so that the power tables and the work arrays stay small.
CHUNK = 1 << 21

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: word class of the shingle operators: everything but space and \t \n \v \f \r
SPACE6 = np.zeros(256, bool)
SPACE6[[9, 10, 11, 12, 13, 32]] = True


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of every byte span [start, end) of buf."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(buf)
    run = np.empty(n + 1, np.uint64)
    run[0] = 0
    with np.errstate(over="ignore"):
        np.cumsum(_values()[buf] * _powers("b", n), out=run[1:])
        return mix((run[ends] - run[starts]) * _powers("i", n)[starts])


def split_words(buf: np.ndarray, is_space: np.ndarray = SPACE6) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that aren't spaces."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~is_space[buf]
    edge = np.flatnonzero(np.diff(inside))
    return edge[::2], edge[1::2]


def chunks(texts: list[bytes], size: int = CHUNK):
    """Cuts a list of byte strings in runs (first, last + 1) of about size bytes; a longer text stands alone."""
    first, have = 0, 0
    for k, t in enumerate(texts):
        if have and have + len(t) > size:
            yield first, k
            first, have = k, 0
        have += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def word_hashes(texts: list[bytes], lower: bool = True, is_space: np.ndarray = SPACE6):
    """Yields, for runs of the texts, (first text, word hashes, words before each text of the run and their total)."""
    for a, b in chunks(texts):
        joined = b"\n".join(texts[a:b])
        if lower:
            joined = joined.translate(ASCII_LOWER)
        buf = np.frombuffer(joined, np.uint8)
        starts, ends = split_words(buf, is_space)
        begin = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        yield a, span_hashes(buf, starts, ends), np.searchsorted(starts, begin)


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the 2-word shingles of one text, sorted and distinct; fewer than two words: the sequence as one; none: empty."""
    if len(words) == 0:
        return words
    with np.errstate(over="ignore"):
        if len(words) == 1:
            return mix(words * np.uint64(0xD6E8FEB86659FD93))
        s = mix(words[:-1] * np.uint64(0xA0761D6478BD642F) + words[1:])
    s.sort()
    keep = np.empty(len(s), bool)
    keep[0] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]
