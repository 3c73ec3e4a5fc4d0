"""Encodes each distinct piece of text once: a table from the hash of a span to its ids, filled on demand.

A worker keeps the table between batches; it starts anew once it holds LIMIT spans. Spans are known by a 64-bit hash.
"""

from __future__ import annotations

import numpy as np

from .textnum import _powers, mix

LIMIT = 600_000


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hash_spans(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of code points."""
    run = np.empty(len(units) + 1, np.uint64)
    run[0] = 0
    with np.errstate(over="ignore"):
        u = units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        u ^= u >> np.uint64(29)
        np.cumsum(u * np.uint64(0xBF58476D1CE4E5B9) * _powers("b", len(u)), out=run[1:])
        return mix((run[ends] - run[starts]) * _powers("i", len(u) + 1)[starts])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of the runs [start, start + length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - first, lengths)


class SpanTable:
    def __init__(self, encode_new, dtype=np.uint16):
        """encode_new(list of str) -> (flat ids, ids of each)."""
        self.encode_new, self.dtype = encode_new, dtype
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, self.dtype)

    def unknown(self, h: np.ndarray, pending: set[int]) -> np.ndarray:
        """Indices of the first span of each hash that is neither in the table nor pending; pending gets them."""
        kinds, first = np.unique(h, return_index=True)
        at = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        new = first[self.keys[at] != kinds] if len(self.keys) else first
        if pending:
            new = np.array([i for i in new.tolist() if int(h[i]) not in pending], np.int64)
        pending.update(h[new].tolist())
        return new

    def add(self, hashes: np.ndarray, words: list[str]) -> None:
        if not len(words):
            return
        flat, size = self.encode_new(words)
        begin = len(self.flat) + np.cumsum(size) - size
        self.flat = np.concatenate([self.flat, flat.astype(self.dtype)])
        order = np.argsort(np.concatenate([self.keys, hashes]), kind="stable")
        self.keys = np.concatenate([self.keys, hashes])[order]
        self.at = np.concatenate([self.at, begin])[order]
        self.size = np.concatenate([self.size, size])[order]

    def lookup(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after another, ids of each span); every hash is in the table."""
        if not len(h):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        kinds, inverse = np.unique(h, return_inverse=True)
        at = np.searchsorted(self.keys, kinds)
        size = self.size[at][inverse]
        return self.flat[ragged(self.at[at][inverse], size)], size

    def encode(self, text: str, units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans one after another, ids of each span); text: what units were taken from."""
        if len(self.keys) > LIMIT:
            self.clear()
        h = hash_spans(units, starts, ends)
        new = self.unknown(h, set())
        self.add(h[new], [text[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
        return self.lookup(h)
