"""Word-end BPE encoding of whole batches in numpy, equal to the tokenizers library id by id.

Texts are normalised (NFC, lower case), cut into letter runs, single digits, runs of other signs and English contractions, and
each distinct span is merged once: words of equal length advance together, one merge of the lowest rank a step. Texts that hold
a special token's string, or characters whose lower case is more than one, and spans of over MAX_BYTES bytes, go to the library
itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .spans import SpanTable, code_points

MAX_BYTES = 48
SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every code point: its class, its lower case, and whether that is more than one code point."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kind = np.full(0x110000, OTHER, np.uint8)
    for value, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"[\p{White_Space}]")):
        kind[code_points("".join(regex.findall(pattern, every)))] = value
    lower, long = np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, bool)
    for c in every:
        if (low := c.lower()) != c:
            if len(low) == 1:
                lower[ord(c)] = ord(low)
            else:
                long[ord(c)] = True
    return kind, lower, long


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.specials = [t["content"] for t in spec["added_tokens"]]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + "</w>"] for c in letters], np.int64)
        keys, to = [], []
        for pair in spec["model"]["merges"]:
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            keys.append(vocab[a] << 20 | vocab[b])
            to.append(vocab[a + b])
        keys, ranks, to = np.array(keys), np.arange(len(keys)), np.array(to)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.to = keys[order], ranks[order], to[order]
        self.table = SpanTable(self._encode_new, np.uint16 if self.size <= 1 << 16 else np.uint32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Index of the merge in the sorted table, or -1."""
        k = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, at, -1)

    def _merge(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: words x letters of equal length; returns the merged ids and how many of each row stand."""
        n, width = ids.shape
        left = np.full(n, width)
        far = len(self.ranks)
        if width > 1:
            rule = self._rank(ids[:, :-1], ids[:, 1:])
            live = np.arange(n)
            while len(live):
                r = np.where(rule[live] >= 0, self.ranks[rule[live]], far)
                j = r.argmin(1)
                some = r[np.arange(len(live)), j] < far
                live, j = live[some], j[some]
                if not len(live):
                    break
                ids[live, j] = self.to[rule[live, j]]
                # close the gap behind j + 1
                cols = np.arange(width - 1)
                source = cols[None, :] + (cols[None, :] > j[:, None])
                ids[live, :-1] = ids[live[:, None], source]
                left[live] -= 1
                if width > 2:
                    inner = np.arange(width - 2)
                    source = inner[None, :] + (inner[None, :] > j[:, None])
                    rule[live, :-1] = rule[live[:, None], source]
                rule[live, left[live] - 1] = -1
                for shift in (-1, 0):  # the pairs that hold the new piece
                    k = j + shift
                    ok = (k >= 0) & (k < left[live] - 1)
                    rule[live[ok], k[ok]] = self._rank(ids[live[ok], k[ok]], ids[live[ok], k[ok] + 1])
        return ids, left

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode() for w in words]
        length = np.array([len(b) for b in raw])
        size = np.zeros(len(raw), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for width in np.unique(length):
            which = np.flatnonzero(length == width)
            if width > MAX_BYTES:
                for i in which:
                    ids = np.array(self.library.encode(words[i], add_special_tokens=False).ids, np.int64)
                    size[i] = len(ids)
                    parts.append((which[which == i], ids[None, :], np.array([len(ids)])))
                continue
            for k in range(0, len(which), 20_000):
                some = which[k : k + 20_000]
                b = np.frombuffer(b"".join(raw[i] for i in some), np.uint8).reshape(len(some), width)
                ids = self.inner[b]
                ids[:, -1] = self.last[b[:, -1]]
                ids, left = self._merge(ids)
                size[some] = left
                parts.append((some, ids, left))
        begin = np.cumsum(size) - size
        flat = np.zeros(int(size.sum()), np.int64)
        for some, ids, left in parts:
            stand = np.arange(ids.shape[1])[None, :] < left[:, None]
            row, col = np.nonzero(stand)
            flat[begin[some][row] + col] = ids[stand]
        return flat, size

    def _plain(self, text: str) -> bool:
        return not any(s in text for s in self.specials)

    def encode(self, texts: list[str], slice_chars: int = 1_000_000):
        """Yields (ids of a run of texts one after another, ids of each text)."""
        kind, lower, long = _classes()
        k = 0
        while k < len(texts):
            run, have = [], 0
            while k < len(texts) and (not run or have + len(texts[k]) <= slice_chars):
                t = texts[k]
                run.append(t if t.isascii() or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t))
                have += len(run[-1]) + 1
                k += 1
            first = k - len(run)
            joined = "\n".join(run)
            units = lower[code_points(joined)]
            odd = [i for i, t in enumerate(run) if ("<|" in t and not self._plain(t))]
            if long[units].any():
                odd = sorted({*odd, *(i for i, t in enumerate(run) if long[code_points(t)].any())})
            kinds = kind[units]
            begin = np.cumsum([0] + [len(t) + 1 for t in run])
            if odd:
                kinds = kinds.copy()
                for i in odd:
                    kinds[begin[i] : begin[i + 1] - 1] = SPACE
            cut = np.empty(len(kinds) + 1, bool)
            cut[0] = cut[-1] = True
            cut[1:-1] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == NUMBER)
            edge = np.flatnonzero(cut)
            starts, ends = edge[:-1], edge[1:]
            full = kinds[starts] != SPACE if len(kinds) else np.zeros(0, bool)
            starts, ends = starts[full].copy(), ends[full].copy()
            quote = np.flatnonzero((units[starts] == 39) & (ends - starts == 1)) if len(starts) else starts
            quote = quote[quote + 1 < len(starts)]
            quote = quote[(starts[quote + 1] == ends[quote]) & (kinds[starts[quote + 1]] == LETTER)]
            lowered = joined.lower() if len(quote) and len(joined.lower()) == len(joined) else None
            gone = []
            for q in quote.tolist():
                s, e = int(starts[q + 1]), int(ends[q + 1])
                word = "".join(map(chr, units[s : min(e, s + 2)]))
                for x in SUFFIXES:
                    if word.startswith(x):
                        ends[q] = starts[q + 1] = s + len(x)
                        if s + len(x) == e:
                            gone.append(q + 1)
                        break
            del lowered
            if gone:
                starts, ends = np.delete(starts, gone), np.delete(ends, gone)
            small = units.tobytes().decode("utf-32-le", "surrogatepass")
            ids, size = self.table.encode(small, units, starts, ends)
            of = np.searchsorted(starts, begin)
            upto = np.concatenate([[0], np.cumsum(size)])[of]
            if not odd:
                yield ids, np.diff(upto)
            else:
                parts = [ids[upto[i] : upto[i + 1]] for i in range(len(run))]
                for i in odd:
                    parts[i] = np.array(self.library.encode(texts[first + i], add_special_tokens=False).ids, ids.dtype)
                yield np.concatenate(parts), np.array([len(p) for p in parts])


@lru_cache(maxsize=2)
def coder(path: str) -> WordBpe:
    return WordBpe(path)
