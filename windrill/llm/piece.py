"""SentencePiece encoding and decoding in batched numpy (operator 6), equal to the library id by id.

The model's pieces, scores and byte fallback are read through the library; the encoding isn't done by it. A text gets its leading
mark and marks for spaces and is cut before each run of marks; every distinct unit is encoded once. Units of equal length
advance together: at each place, hashes of the substrings that end there probe the sorted piece keys, a predecessor is
admissible for a piece if merging the two alone leaves them apart, and a vectorised maximum over the admissible pieces stores the
backpointer. For merge-ranked (BPE) models, like the public one here, a plain sum of scores doesn't give the library's ids; with
this admissibility the last piece of every prefix is unique, so the recursion gives exactly the merge result. For unigram models
the same recursion maximises the sum of scores. Verdicts on pairs of pieces are kept in a sorted table.

Characters outside the vocabulary become their UTF-8 bytes' pieces. Units that begin with two marks or more (tied scores), or are
longer than LONG code points, are merged one by one with a heap.

Cases: null and empty texts have no pieces and decode to the empty text. A text that holds the mark itself decodes with a space
in its place, as in the library. Texts of any length are encoded whole. A null doc_id is kept as it is. Ties can't arise: a
prefix's last piece is unique (unigram: of equal sums the one with the shortest last piece). Repeated rows are encoded each for themselves; an
empty table gives no row; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, small
from .spans import LIMIT, SpanTable, code_points, hash_spans, ragged
from .textnum import _powers, mix

MARK = "▁"
LONG = 96
_START = -2


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.names = [sp.id_to_piece(i) for i in range(self.size)]
        byte = [i for i in range(self.size) if sp.is_byte(i)]
        special = {i for i in range(self.size) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_id = np.zeros(256, np.int64)
        for i in byte:
            self.byte_id[int(self.names[i][3:-1], 16)] = i
        plain = [i for i in range(self.size) if i not in special and not sp.is_byte(i)]
        self.id_of = {self.names[i]: i for i in plain}
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.unigram = max(self.score.values()) < 0 and len({round(-s) == -s for s in self.score.values()}) > 1
        self.weight = np.array([sp.get_score(i) for i in range(self.size)])
        self.longest = max(map(len, self.id_of))
        joined = code_points("".join(self.names[i] for i in plain))
        ends = np.cumsum([len(self.names[i]) for i in plain])
        keys = hash_spans(joined, ends - [len(self.names[i]) for i in plain], ends)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain)[order]
        self.alone = np.array([self.unigram or (self.names[i] in self.id_of and self.merge(self.names[i]) == [i]) for i in range(self.size)])
        self.pair_keys, self.pair_ok = np.zeros(0, np.int64), np.zeros(0, bool)
        raw = [bytes([int(self.names[i][3:-1], 16)]) if sp.is_byte(i) else b"" if i in special else self.names[i].replace(MARK, " ").encode() for i in range(self.size)]
        self.byte_size = np.array([len(r) for r in raw])
        self.byte_at = np.cumsum(self.byte_size) - self.byte_size
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.table = SpanTable(self._encode_new, np.uint16 if self.size <= 1 << 16 else np.uint32)

    # -- one at a time ---------------------------------------------------------------------------------------------------

    def merge(self, unit: str) -> list[int]:
        """The merge result of one unit by a heap; characters outside the vocabulary are numbered from self.size on."""
        part: list[str | None] = list(unit)
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(part):
                both = part[a] + part[b]
                s = self.score.get(both)
                if s is not None:
                    heapq.heappush(heap, (-s, a, both))

        for k in range(len(part) - 1):
            offer(k, k + 1)
        while heap:
            _, a, both = heapq.heappop(heap)
            b = after[a] if part[a] is not None else len(part)
            if b >= len(part) or part[a] + part[b] != both:
                continue
            part[a], part[b] = both, None
            after[a] = after[b]
            if after[a] < len(part):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [self.id_of.get(p, self.size + ord(p[0])) for p in part if p is not None]

    def _name(self, i: int) -> str:
        return self.names[i] if i < self.size else chr(i - self.size)

    # -- in batches ------------------------------------------------------------------------------------------------------

    def _admissible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if self.unigram:
            return np.ones(len(left), bool)
        key = left << 22 | right
        kinds, inverse = np.unique(key, return_inverse=True)
        at = np.searchsorted(self.pair_keys, kinds)
        known = np.zeros(len(kinds), bool)
        inside = at < len(self.pair_keys)
        known[inside] = self.pair_keys[at[inside]] == kinds[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ok = np.array([self.merge(self._name(a) + self._name(b)) == [a, b] for a, b in zip((kinds[new] >> 22).tolist(), (kinds[new] & 0x3FFFFF).tolist())], bool)
            self.pair_keys = np.insert(self.pair_keys, at[new], kinds[new])
            self.pair_ok = np.insert(self.pair_ok, at[new], ok)
            at = np.searchsorted(self.pair_keys, kinds)
        return self.pair_ok[at][inverse]

    def viterbi(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """units: words x code points of equal length. Returns (pieces, right-aligned; pieces of each word, 0 where none fits)."""
        n, width = units.shape
        run = np.zeros((n, width + 1), np.uint64)
        inverse = _powers("i", width + 1)
        with np.errstate(over="ignore"):
            u = units.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
            u ^= u >> np.uint64(29)
            np.cumsum(u * np.uint64(0xBF58476D1CE4E5B9) * _powers("b", width)[None, :], axis=1, out=run[:, 1:])
        last = np.full((n, width + 1), -1, np.int64)
        last[:, 0] = _START
        back = np.zeros((n, width + 1), np.int16)
        total = np.full((n, width + 1), -np.inf)
        total[:, 0] = 0
        for i in range(1, width + 1):
            far = max(0, i - self.longest)
            with np.errstate(over="ignore"):
                h = mix((run[:, i : i + 1] - run[:, far:i]) * inverse[None, far:i])
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            single = np.where(hit[:, -1], self.ids[at[:, -1]], self.size + units[:, i - 1].astype(np.int64))
            hit[:, -1] = True
            rows, cols = np.nonzero(hit & (last[:, far:i] != -1))
            p = last[rows, far + cols]
            q = np.where(cols == i - 1 - far, single[rows], self.ids[at[rows, cols]])
            ok = np.ones(len(rows), bool)
            inner = p != _START
            ok[~inner] = (q[~inner] >= self.size) | self.alone[np.minimum(q[~inner], self.size - 1)]
            ok[inner] = self._admissible(p[inner], q[inner])
            rows, cols, q = rows[ok], cols[ok], q[ok]
            # the last piece is unique where pieces are merged; where scores add up, the largest sum is written last
            if self.unigram:
                gain = total[rows, far + cols] + np.where(q < self.size, self.weight[np.minimum(q, self.size - 1)], -1e4)
                order = np.argsort(gain, kind="stable")
                rows, cols, q = rows[order], cols[order], q[order]
                total[rows, i] = gain[order]
            last[rows, i], back[rows, i] = q, i - far - cols
        out = np.full((n, width), -1, np.int64)
        count = np.zeros(n, np.int64)
        where = np.full(n, width)
        live = np.flatnonzero(last[:, width] != -1)
        while len(live):
            count[live] += 1
            out[live, width - count[live]] = last[live, where[live]]
            where[live] -= back[live, where[live]]
            live = live[where[live] > 0]
        return out, count

    def _encode_new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[np.ndarray | None] = [None] * len(words)
        size = np.array([len(w) for w in words])
        by_hand = [i for i, w in enumerate(words) if len(w) > LONG or (w.startswith(MARK * 2) and not self.unigram)]
        size[by_hand] = 0
        for width in np.unique(size[size > 0]):
            which = np.flatnonzero(size == width)
            for k in range(0, len(which), 20_000):
                some = which[k : k + 20_000]
                ids, count = self.viterbi(code_points("".join(words[i] for i in some)).reshape(len(some), width))
                for row, i in enumerate(some.tolist()):
                    if count[row]:
                        found[i] = ids[row, width - count[row] :]
                    else:
                        by_hand.append(i)
        for i in by_hand:
            found[i] = np.array(self.merge(words[i]), np.int64)
        n = np.array([len(f) for f in found], np.int64)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        odd = np.flatnonzero(flat >= self.size)
        if len(odd):  # characters outside the vocabulary: their bytes
            owner = np.repeat(np.arange(len(n)), n)
            raw = [self.byte_id[np.frombuffer(chr(int(c) - self.size).encode("utf-8", "surrogatepass"), np.uint8)] for c in flat[odd]]
            extra = np.array([len(r) for r in raw])
            np.add.at(n, owner[odd], extra - 1)
            pieces, begin = [], 0
            for k, r in zip(odd, raw):
                pieces += [flat[begin:k], r]
                begin = k + 1
            flat = np.concatenate([*pieces, flat[begin:]])
        return flat, n

    def encode(self, texts: list[str], slice_chars: int = 1_000_000):
        """Yields (ids of a run of texts one after another, ids of each text). New units of all texts are encoded together."""
        if len(self.table.keys) > LIMIT:
            self.table.clear()
        k, runs = 0, []
        pending: set[int] = set()
        words: list[str] = []
        hashes: list[np.ndarray] = []
        while k < len(texts):
            run, have = [], 0
            while k < len(texts) and (not run or have + len(texts[k]) <= slice_chars):
                t = texts[k]
                run.append(MARK + t.replace(" ", MARK) if t else "")
                have += len(run[-1])
                k += 1
            joined = "".join(run)
            units = code_points(joined)
            begin = np.cumsum([0] + [len(t) for t in run])
            mark = units == ord(MARK)
            cut = mark.copy()
            cut[1:] &= ~mark[:-1]
            cut[begin[:-1][np.diff(begin) > 0]] = True
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], len(units)) if len(starts) else starts
            h = hash_spans(units, starts, ends)
            new = self.table.unknown(h, pending)
            words += [joined[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            hashes.append(h[new])
            runs.append((h, np.searchsorted(starts, begin)))
        if words:
            self.table.add(np.concatenate(hashes), words)
        for h, at in runs:
            ids, size = self.table.lookup(h)
            yield ids, np.diff(np.concatenate([[0], np.cumsum(size)])[at])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of runs of ids."""
        ids = ids.astype(np.int64)
        n = self.byte_size[ids]
        raw = self.bytes[ragged(self.byte_at[ids], n)].tobytes()
        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
        out = []
        for a, b in zip(upto[:-1], upto[1:]):
            t = raw[a:b].decode("utf-8", "replace")
            out.append(t[1:] if t.startswith(" ") else t)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


OUT = "doc_id long, n_pieces long, ids binary"


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, n_pieces, ids (little-endian 32-bit)."""

    def run(batches):
        p = pieces(path)
        for b in small(batches):
            sizes, blobs = [], []
            for ids, n in p.encode([t or "" for t in b.column("text").to_pylist()]):
                wide = ids.astype("<u4")
                upto = np.concatenate([[0], np.cumsum(n)])
                sizes += n.tolist()
                blobs += [wide[upto[k] : upto[k + 1]].tobytes() for k in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n_pieces", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, OUT)


def decode_table(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids -> doc_id, text."""

    def run(batches):
        p = pieces(path)
        for b in small(batches):
            ids = [np.frombuffer(x, "<u4") for x in b.column("ids").to_pylist()]
            texts = p.decode(np.concatenate(ids), np.array([len(x) for x in ids])) if ids else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text -> doc_id, n_pieces, ids_crc32, n_chars of the decoded text, round_trip: whether it equals the text."""

    def run(batches):
        p = pieces(path)
        for b in small(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            sizes, crcs, chars, same = [], [], [], []
            at = 0
            for ids, n in p.encode(texts):
                wide = ids.astype("<u4")
                upto = np.concatenate([[0], np.cumsum(n)])
                sizes += n.tolist()
                crcs += [zlib.crc32(wide[upto[k] : upto[k + 1]].tobytes()) for k in range(len(n))]
                for t in p.decode(ids, n):
                    chars.append(len(t))
                    same.append(t == texts[at].replace(MARK, " "))
                    at += 1
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.array(chars, pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids_crc32", "n_chars", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, n_chars long, round_trip boolean")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
