"""Benchmark decontamination by latent semantic retrieval (operator 5).

1. Document frequencies and counts of hashed words (VOCABULARY buckets) over all documents.
2. A distributed randomised SVD of the TF-IDF passages (PASSAGE words each, unit rows A): every task forms its rows of Y = A W for a
   sparse random W with SKETCH columns and adds Y'Y and the row sum; Spark sums SKETCH x SKETCH numbers whatever the input. The
   eigenvectors of the centred Y'Y give the leading singular directions; a word's latent vector is its row of W on the first RANK
   of them, less the mean word of the corpus.
3. Search: documents are cut in blocks of BLOCK words. For an item of n words, every run of blocks long enough to hold a stretch of
   STRETCH * n words at any offset is a passage; passages whose latent cosine with the item reaches the item's threshold are the
   candidates, all others are left. An item's threshold comes from DRAWS made-up passages that keep SHARE of its words and have
   words drawn by the corpus's counts in all other places: the QUANTILE of their cosines if any word is alike likely to be
   kept, or the least cosine if the 2 * ANSWERS rarest words are kept and the next rarest replaced, whichever is lower.
   Cosines are taken without projecting a block: an item turned back to the sketch has the same products, and the length in the
   space is the sketch's less that along the directions left out.
4. Candidates are checked word by word: the longest common subsequence, bit-parallel, must reach SHARE of the item, within a
   stretch of STRETCH times its length (an eighth more may pass), and at least ANSWERS of the item's RAREST rarest words must be
   in it. Order, inflection of punctuation and case, and inserted or replaced words are thus tolerated up to 1 - SHARE.
   Passages with fewer than SHARE * n words of the item can't pass and are left out before.

A paraphrase that replaces an item's very rarest words too and keeps only what all texts have in common is beyond the cosine; tests
and README give the shares of paraphrases found.

The items are the stated query set and reach the tasks in blocks of ITEM_BLOCK; each block of items is one pass over all
documents. Whole texts are searched. Result: one row for each document and item found.

Cases: null or empty texts hold nothing; items without a word are left out; repeated items are reported each under their own id;
repeated rows of a document give the same (doc_id, item_id) row once, rows without a doc_id are reported together under null; of
several places of one item in a document the one with most common words counts, then the larger cosine, then the first. Texts and
items of any length are searched whole, in runs of blocks. No item or no document: no row. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, small
from .textnum import word_hashes

VOCABULARY, SKETCH, RANK, PASSAGE, BLOCK = 1 << 15, 512, 384, 64, 16
ITEM_BLOCK = 4096
SHARE, STRETCH, ANSWERS, RAREST = 0.6, 1.6, 3, 8
DRAWS, QUANTILE = 256, 0.02
#: bytes of text a task handles at once; blocks and items that are multiplied at once, blocks whose lengths are summed at once
PIECE, RUN, SIDE, TILE = 1 << 20, 8192, 256, 512

_BREAK = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])


def sequences(texts: list):
    """Yields (first text, word hashes of a run of texts, where each text begins among them)."""
    raw = [(t or "").lower().encode() for t in texts]
    a = 0
    while a < len(raw):
        z, have = a, 0
        while z < len(raw) and (z == a or have + len(raw[z]) <= PIECE):
            have += len(raw[z])
            z += 1
        for first, h, at in word_hashes(raw[a:z], False, _BREAK):
            yield a + first, h, at
        a = z


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - VOCABULARY.bit_length() + 1)).astype(np.int64)


def _sum(df: DataFrame, dtype: str) -> np.ndarray | None:
    """(v) byte arrays summed; None without a row."""

    def adder(kind: str):
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(len(pdf.v.iloc[0]) // np.dtype(kind).itemsize)
            for v in pdf.v:
                total += np.frombuffer(v, kind)
            return pd.DataFrame({"v": [total.tobytes()], "p": [int(pdf.p.iloc[0]) // 64]})

        return add

    # 64 tasks' sums at a time, then 64 of those; the driver adds one row for each 4,096 tasks
    once = df.withColumn("p", F.floor(F.spark_partition_id() / 64)).groupBy("p").applyInPandas(adder(dtype), "v binary, p long")
    total = None
    for r in once.groupBy("p").applyInPandas(adder("<f8"), "v binary, p long").toLocalIterator():
        v = np.frombuffer(r.v)
        total = v.copy() if total is None else total + v
    return total


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    """(documents that hold each bucket, documents, occurrences of each bucket)."""

    def run(batches):
        df, cf, n = np.zeros(VOCABULARY, np.int64), np.zeros(VOCABULARY, np.int64), 0
        for b in small(batches):
            for _, h, at in sequences(b.column("text").to_pylist()):
                own = np.repeat(np.arange(len(at) - 1), np.diff(at))
                word = bucket(h)
                cf += np.bincount(word, minlength=VOCABULARY)
                pair = np.sort(own * VOCABULARY + word)
                pair = pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair
                df += np.bincount(pair % VOCABULARY, minlength=VOCABULARY)
                n += len(at) - 1
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.concatenate([df, cf, [n]]).astype(np.int64).tobytes()], pa.binary())})

    all_three = _sum(docs.select("text").mapInArrow(run, "v binary"), "<i8")
    if all_three is None:
        all_three = np.zeros(2 * VOCABULARY + 1)
    return all_three[:VOCABULARY], int(all_three[-1]), all_three[VOCABULARY:-1]


def _starts(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the blocks of size words of each text begin, and the text of each."""
    n = np.diff(at)
    many = -(-n // size)
    own = np.repeat(np.arange(len(n)), many)
    first = np.cumsum(many) - many
    return at[:-1][own] + (np.arange(len(own)) - first[own]) * size, own


def _places() -> tuple[np.ndarray, np.ndarray]:
    """The rows of W: two columns of the sketch for each bucket, with signs."""
    r = np.random.Generator(np.random.PCG64(11))
    return r.integers(0, SKETCH, (VOCABULARY, 2)), r.integers(0, 2, (VOCABULARY, 2)) * 2.0 - 1


def sketched(word: np.ndarray, own: np.ndarray, weight: np.ndarray, rows: int, places) -> np.ndarray:
    """rows x SKETCH: the sums of the weighted words of each row, times W."""
    column, sign = places
    y = np.bincount((own[:, None] * SKETCH + column[word]).ravel(), (weight[:, None] * sign[word]).ravel(), rows * SKETCH)
    return y.reshape(rows, SKETCH).astype(np.float32)


class Space:
    """Latent coordinates: weight of each bucket, SKETCH x RANK orthonormal map, and the corpus's mean word."""

    def __init__(self, idf: np.ndarray, turn: np.ndarray, counts: np.ndarray):
        self.idf, self.turn = idf, turn.astype(np.float32)
        column, sign = _places()
        share = counts / max(1.0, counts.sum()) * idf
        self.middle = (np.bincount(column[:, 0], share * sign[:, 0], SKETCH) + np.bincount(column[:, 1], share * sign[:, 1], SKETCH)).astype(np.float32)
        self.mean = self.middle @ self.turn
        # lengths in the space are taken in it, or as what the directions left out leave of the sketch's, whichever are fewer
        rank = turn.shape[1]
        self.left_out = 2 * rank > SKETCH
        self.narrow = np.linalg.qr(turn, mode="complete")[0][:, rank:].astype(np.float32) if self.left_out else self.turn

    def words(self, word: np.ndarray) -> np.ndarray:
        column, sign = _places()
        w = (self.turn[column[word, 0]] * sign[word, 0, None] + self.turn[column[word, 1]] * sign[word, 1, None]) * self.idf[word, None]
        return (w - self.mean).astype(np.float32)

    def lengths(self, y: np.ndarray, many: int, wides: list[int]) -> dict[int, np.ndarray]:
        """The squared latent length of the sum of `wide` centred sketch rows from each of the first many on; rows past the end are 0."""
        out = {wide: np.zeros(many) for wide in wides}
        kinds = [(y @ self.narrow, -1.0), (y, 1.0)] if self.left_out else [(y @ self.narrow, 1.0)]
        for rows, sign in kinds:
            for a in range(0, many, TILE):
                z = min(many, a + TILE)
                total, held = rows[a:z].copy(), 1
                for wide in wides:
                    for k in range(held, wide):
                        more = rows[a + k : z + k]
                        total[: len(more)] += more
                    held = wide
                    out[wide][a:z] += sign * np.einsum("ij,ij->i", total, total)
        return out


def latent_space(docs: DataFrame, idf: np.ndarray, counts: np.ndarray) -> Space:
    """The leading singular directions of the passages' centred, sketched TF-IDF."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        weight, places = shared.value, _places()
        gram, total, n = np.zeros((SKETCH, SKETCH)), np.zeros(SKETCH), 0
        for b in small(batches):
            for _, h, at in sequences(b.column("text").to_pylist()):
                if not len(h):
                    continue
                word = bucket(h)
                start, _ = _starts(at, PASSAGE)
                size = np.diff(np.append(start, len(word)))
                w = weight[word]
                length = np.sqrt(np.maximum(np.add.reduceat(w * w, start), 1e-12))
                for a in range(0, len(start), RUN):
                    z = min(len(start), a + RUN)
                    mine = slice(start[a], start[z] if z < len(start) else len(word))
                    own = np.repeat(np.arange(z - a), size[a:z])
                    y = sketched(word[mine], own, w[mine] / length[a:z][own], z - a, places)
                    gram += y.T @ y
                    total += y.sum(0, dtype=np.float64)
                    n += z - a
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.concatenate([gram.ravel(), total, [n]]).astype(np.float32).tobytes()], pa.binary())})

    both = _sum(docs.select("text").mapInArrow(run, "v binary"), "<f4")
    if both is None or not both[-1]:
        return Space(idf, np.zeros((SKETCH, 0)), counts)
    gram, total = both[: SKETCH * SKETCH].reshape(SKETCH, SKETCH), both[SKETCH * SKETCH : -1]
    value, vector = np.linalg.eigh(gram - np.outer(total, total) / both[-1])
    value, vector = value[::-1][:RANK], vector[:, ::-1][:, :RANK]
    some = value > 1e-5 * max(value[0], 1e-9)
    return Space(idf, vector[:, some], counts)


def lcs_within(item: list[int], words: list[int], stretch: int) -> tuple[int, int, int]:
    """(length, start, end) of the longest common subsequence of item with a stretch of words no longer than stretch.

    Bit-parallel over the item; windows of an eighth more slide by that eighth, so that each such stretch lies in one whole."""
    where: dict[int, int] = {}
    for k, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    best = (0, 0, 0)
    step = max(1, stretch // 8)
    wide = stretch + step - 1
    for a in range(0, max(1, len(words) - wide + step), step):
        v = full
        for w in words[a : a + wide]:
            m = where.get(w)
            if m:
                u = v & m
                v = (v + u) | (v - u)
        n = len(item) - (v & full).bit_count()
        if n > best[0]:
            best = (n, a, min(len(words), a + wide))
    return best


class Items:
    """One block of benchmark items, ready for the search; small: RANK numbers and a few words for each."""

    def __init__(self, ids: list[int], words: list[np.ndarray], space: Space, counts: np.ndarray):
        self.ids, self.words, self.space = ids, words, space
        n = np.array([len(w) for w in words])
        self.blocks = -(-((STRETCH * n).astype(np.int64) + 1 + BLOCK - 1) // BLOCK)
        self.need = np.ceil(SHARE * n - 1e-9).astype(np.int64)
        vectors = [space.words(bucket(w)) for w in words]
        raw = np.stack([v.sum(0) for v in vectors])
        self.vector = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
        self.turned = self.vector @ space.turn.T
        self.threshold = self._thresholds(vectors, counts)
        weight = [space.idf[bucket(w)] for w in words]
        self.answers = [set(list(dict.fromkeys(w[np.argsort(-g, kind="stable")].tolist()))[:RAREST]) for w, g in zip(words, weight)]
        self.lists = [w.tolist() for w in words]
        self.kinds = [np.unique(w) for w in words]
        self.buckets = [bucket(w) for w in self.kinds]

    def _thresholds(self, vectors: list[np.ndarray], counts: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), -1.0, np.float32)
        if not self.vector.shape[1] or not counts.sum():
            return out
        r = np.random.Generator(np.random.PCG64(17))
        upto = np.cumsum(counts / counts.sum())
        around, drawn = np.zeros((DRAWS, self.vector.shape[1]), np.float32), 0
        other = self.blocks * BLOCK - self.need
        for k in np.argsort(other, kind="stable").tolist():
            while drawn < other[k]:  # the words in all other places, one more of each made-up passage at a time
                around += self.space.words(np.minimum(np.searchsorted(upto, r.random(DRAWS)), len(upto) - 1))
                drawn += 1
            n = len(vectors[k])
            keep = (np.argsort(r.random((DRAWS, n)), axis=1) < self.need[k]).astype(np.float32)
            v = keep @ vectors[k] + around
            rare = np.argsort(-self.space.idf[bucket(self.words[k])], kind="stable")
            first = min(2 * ANSWERS, self.need[k])
            worst = np.r_[rare[:first], rare[n - (self.need[k] - first) :]]
            cosine, least = (x @ self.vector[k] / np.maximum(np.linalg.norm(x, axis=1), 1e-9) for x in (v, vectors[k][worst].sum(0) + around))
            out[k] = min(np.quantile(cosine, QUANTILE), least.min())
        return out

    def candidates(self, h: np.ndarray, at: np.ndarray, places):
        """Yields (item, first block, cosine, first word, end) arrays of the passages whose cosine reaches the item's threshold."""
        start, own = _starts(at, BLOCK)
        edge = np.append(start, len(h))
        last_block = np.cumsum(np.bincount(own, minlength=len(at) - 1))[own]  # where each block's text ends
        first_block = np.r_[True, own[1:] != own[:-1]]
        word = bucket(h)
        weight = self.space.idf[word]
        size = np.diff(edge)
        most = int(self.blocks.max())
        for a in range(0, len(start), RUN):
            z, far = min(len(start), a + RUN), min(len(start), a + RUN + most)
            mine = slice(edge[a], edge[far])
            block = np.repeat(np.arange(far - a), size[a:far])
            sketch = sketched(word[mine], block, weight[mine], far - a, places) - size[a:far, None].astype(np.float32) * self.space.middle
            wides = np.unique(self.blocks).tolist()
            squares = self.space.lengths(sketch, z - a, wides)
            for wide in wides:
                # a passage that its text's end cuts is part of one before, but for the text's first
                whole = np.arange(a, z) + wide <= last_block[a:z]
                cut = np.flatnonzero(~whole & first_block[a:z])
                square = squares[wide]
                for x in cut.tolist():
                    v = sketch[x : last_block[a + x] - a].sum(0) @ self.space.turn
                    square[x] = v @ v
                length = np.sqrt(np.maximum(square, 1e-18))
                whole[cut] = True
                end = np.minimum(np.arange(a, z) + wide, last_block[a:z])
                which = np.flatnonzero(self.blocks == wide)
                for k in range(0, len(which), SIDE):
                    items = which[k : k + SIDE]
                    # a passage's product with an item is the sum of its blocks' products
                    upto = np.zeros((len(items), z - a + most + 1))
                    np.cumsum(self.turned[items] @ sketch.T, axis=1, dtype=np.float64, out=upto[:, 1 : far - a + 1])
                    product = upto[:, wide : wide + z - a] - upto[:, : z - a]
                    product[:, cut] = upto[:, end[cut] - a] - upto[:, cut]
                    item, row = np.nonzero((product >= self.threshold[items, None] * length) & whole)
                    for part in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
                        if len(part):
                            some = row[part]
                            yield items[item[part[0]]], a + some, product[item[part[0]], some] / length[some], edge[a + some], edge[end[some]]

    def search(self, h: np.ndarray, at: np.ndarray, places):
        """Yields (text, item, common words, cosine, start, end) of what a run of texts holds."""
        if not len(h):
            return
        _, own = _starts(at, BLOCK)
        word, marked = bucket(h).astype(np.uint16), np.zeros(VOCABULARY, bool)
        for k, block, cosine, first, end in self.candidates(h, at, places):
            kinds, item = self.kinds[k], self.lists[k]
            index = first[:, None] + np.arange(int((end - first).max()))
            # words are looked up by bucket first; one bucket's words can only count too many
            marked[self.buckets[k]] = True
            held = marked[word[np.minimum(index, len(h) - 1)]] & (index < end[:, None])
            marked[self.buckets[k]] = False
            for x in np.flatnonzero(held.sum(1) >= self.need[k]).tolist():
                passage = h[first[x] : end[x]]
                if (kinds[np.minimum(np.searchsorted(kinds, passage), len(kinds) - 1)] == passage).sum() < self.need[k]:
                    continue
                text, begin = own[block[x]], first[x] - at[own[block[x]]]
                words = passage.tolist()
                enough = min(ANSWERS, -(-len(self.answers[k]) // 2))
                if len(self.answers[k].intersection(words)) < enough:
                    continue
                common, a, z = lcs_within(item, words, int(STRETCH * len(item)) + 1)
                if common >= self.need[k]:
                    if len(self.answers[k].intersection(words[a:z])) >= enough:
                        yield int(text), int(k), common, float(cosine[x]), int(begin) + a, int(begin) + z


SCHEMA = "doc_id long, item_id long, common_words long, item_words long, cosine double, start_word long, end_word long"


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, text; item_id, text -> one row for each document and item that it holds."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df, n, counts = document_frequencies(docs)
    space = latent_space(docs, np.log((n + 1) / (df + 1)) + 1e-3, counts)
    found = None
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")

    def block_of(rows) -> DataFrame:
        ids, words = [], []
        texts = [r.text for r in rows]
        for a, h, at in sequences(texts):
            for k in range(len(at) - 1):
                if at[k + 1] > at[k]:
                    ids.append(rows[a + k].item_id)
                    words.append(h[at[k] : at[k + 1]])
        if not ids:
            return None
        these = spark.sparkContext.broadcast(Items(ids, words, space, counts))

        def run(batches):
            own, places = these.value, _places()
            for b in small(batches):
                doc = b.column("doc_id").to_pylist()
                best: dict[tuple, tuple] = {}
                for a, h, at in sequences(b.column("text").to_pylist()):
                    for text, k, common, c, s, e in own.search(h, at, places):
                        key = (doc[a + text], own.ids[k])
                        value = (common, round(c, 4), -s, e, len(own.lists[k]))
                        if value > best.get(key, (0,)):
                            best[key] = value
                rows = [(d, i, n, m, c, -s, e) for (d, i), (n, c, s, e, m) in best.items()]
                kinds = [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows)) or [()] * 7, kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

        return docs.mapInArrow(run, SCHEMA)

    def blocks():
        rows = []
        for r in items.orderBy("item_id").toLocalIterator():
            rows.append(r)
            if len(rows) == ITEM_BLOCK:
                yield rows
                rows = []
        if rows:
            yield rows

    for rows in blocks():
        one = block_of(rows)
        if one is not None:
            found = one if found is None else found.union(one)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("common_words", "cosine", "item_words", "start_word", "end_word")).alias("m")).select("doc_id", "item_id", "m.common_words", "m.item_words", "m.cosine", "m.start_word", "m.end_word")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))
