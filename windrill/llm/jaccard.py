"""Exact n-gram Jaccard join in the metric space of shingle sets (operator 3).

Two sets link when 100 * intersection >= 60 * union: their Jaccard distance is at most EPS = 0.4, and |x & y| >= 3(|x|+|y|)/8.

Level 0, Voronoi regions of the whole corpus. Random documents lie at distances above 0.9 from one another, so a window of
2 * EPS around cells of sampled documents holds every document and separates nothing. The pivots of level 0 are therefore the
one-shingle sets {s}, under the weighted Jaccard distance whose weights fall steeply from rare to common shingles: a document's
nearest pivot is its rarest shingle, the next its second rarest, and so on. The window comes from the triangle inequality: with
x_r for x without its r rarest shingles, d(x, x_r) = r / |x|; a partner that holds none of those r shingles has no more in
common with x than x_r, so it lies at least r / |x| away. x is thus replicated to its pivots only while r / |x| <= EPS (plus
times(|x|) - 1 more, so that a linked pair meets in times() of the smaller set's size regions, or in all its common shingles if they
are fewer). times() grows with the size: long texts that aren't linked share a few rare shingles by chance, the more of them the
larger the corpus, and a fixed number would merge them in one region. A pair counts in a region only if both positions still leave
room for the intersection that their sizes ask for. Pairs that meet often enough are edges; components of edges are merged regions,
and no link leaves one.

Level 1 and deeper, region_join(): sets of a merged region go to the Voronoi cells of document pivots by their exact distances, as
far as RHO; sets farther from every pivot go on with other pivots. y joins the cell of p if d(y,p) <= d(y,own pivot) + 2 EPS and
d(y,p) <= radius(p) + EPS; cells are joined recursively down to LEAF sets, or where cells no longer get smaller. Triangle bounds
through the pivot accept or reject pairs without a comparison; what is left is compared exactly. Regions of over REGION sets are
cut in blocks, and each pair of blocks is a task of its own.

Hot groups: equal sets are one class throughout, collapsed inside a task and again in each region. Near copies share a word of
their sketch and are put in one region for that (sketches only add to a region, so the result stays exact); pairs within such a
cluster aren't counted at level 0, so a shingle that a third of all sets hold as copies costs its members times the sets outside
the cluster. Nothing is capped or sampled. What moves are packed arrays: keys as 32 bits within one of the partitions, and 1-byte
positions. The rarity order comes from a table of 2^22 counters over all documents, a broadcast of fixed size; any order gives
the same result.

Cases: null or empty texts and texts without a word have an empty set, no link, and are their own component; a null doc_id can't
be named as a component, so such rows count as documents but give way to others' ids (null if a component has none). Rows that
repeat a doc_id are documents of their own. Very long texts are read whole. Ties: links, components and counts don't depend on an
order. An empty table gives no row; other columns are dropped, whatever their names. Sets are known by 63-bit hashes of their
shingles' 64-bit hashes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read_table, small
from .textnum import shingles, word_hashes

EPS = 0.4
#: the largest radius of a cell of level 1 and deeper; sets farther from every pivot go on with other pivots
RHO = 0.5
#: a linked pair shares this many of the regions it is replicated to, one more for each STEP shingles of the smaller set, MOST at most
NEED, STEP, MOST = 3, 32, 255
BUCKETS = 1 << 22
SLICES = 64
KEYS_PER_PART = 4_000_000
LEAF, REGION = 8, 3000
#: so many edges at most come to the driver, 16 bytes each
COLLECT = 500_000
#: sets of this many shingles in total make one task's block
REGION_SHINGLES = 4_000_000
#: shingles of the small regions that one group takes; members of regions that are sent to every task, 40 bytes each
GROUP_SHINGLES, BROADCAST_MEMBERS = 500_000, 1_000_000


#: words of a set's sketch, and the largest near-copy clusters whose members are known to every task: so many members at most
WORDS, LABELLED = 3, 1_000_000
_ORDERS = np.random.Generator(np.random.PCG64(77)).integers(1, 1 << 62, 3 * WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def need(nx, ny):
    """The least intersection of a linked pair of sizes nx and ny."""
    return (3 * (nx + ny) + 7) // 8


def times(n):
    """In how many regions a linked pair whose smaller set has n shingles meets, if it has as many shingles in common."""
    return np.minimum(NEED + n // STEP, MOST)


def window(n):
    """How many of its nearest pivots a set of n shingles is replicated to."""
    return np.minimum(n, n - (3 * n + 4) // 5 + times(n))


def set_hash(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1 or 1


def sketch(s: np.ndarray) -> list[int]:
    """WORDS hashes of a set, each of three of its minima under random orders: near copies share one, unrelated sets hardly ever."""
    with np.errstate(over="ignore"):
        least = [int((s * m).min()) for m in _ORDERS]
    return [xxhash.xxh3_64_intdigest(np.array(least[k : k + 3], np.uint64).tobytes(), k) >> 1 for k in range(0, 3 * WORDS, 3)]


def document_sets(texts: list):
    """Yields (index, sorted shingle hashes) of each text; null counts as empty."""
    raw = [(t or "").encode() for t in texts]
    for a, h, at in word_hashes(raw):
        for k in range(len(at) - 1):
            yield a + k, shingles(h[at[k] : at[k + 1]])


# ---- pass 1: classes of equal sets, and counters for the order -------------------------------------------------------


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(42)).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, sig (0: empty), n, words (the sketch)."""

    def run(batches):
        for b in small(batches):
            sig, n = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            words: list = [None] * b.num_rows
            for k, s in document_sets(b.column("text").to_pylist()):
                if len(s):
                    sig[k], n[k], words[k] = set_hash(s), len(s), sketch(s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sig), pa.array(n), pa.array(words, pa.list_(pa.int64()))], ["doc_id", "sig", "n", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sig long, n long, words array<long>")


def near_copies(classes: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, from each class to the smallest one with which it shares a word of the sketch.

    They only say which classes belong in one region; whether they link is compared there. A word that a third of all classes
    hold costs one aggregate row a task and as many edges as classes."""
    rows = classes.select("sig", F.explode("words").alias("word"))
    least = rows.groupBy("word").agg(F.min("sig").alias("b"), F.max("sig").alias("z")).where("b < z").select("word", "b")
    return rows.join(least, "word").where("sig > b").select(F.col("sig").alias("a"), "b").distinct()


def labels(clusters: DataFrame, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, sorted; the cluster of each) of the largest clusters of near copies, most members in all.

    Pairs within a labelled cluster needn't be counted; members of clusters beyond the bound are counted pair by pair."""
    size = clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size")).where("size >= 8")
    rows = clusters.join(size, "root").orderBy(F.desc("size"), "root", "node").select("node", "root").limit(LABELLED if most is None else most).toPandas()
    node, root = rows.node.to_numpy(np.int64), rows.root.to_numpy(np.int64)
    order = np.argsort(node)
    return node[order], root[order]


def shingle_counters(docs: DataFrame) -> np.ndarray:
    """In how many documents each of BUCKETS groups of shingles occurs; tasks count equal sets once. 16 MB, whatever the input."""

    def run(batches):
        total = np.zeros(BUCKETS, np.uint32)
        seen: set[int] = set()
        for b in small(batches):
            for _, s in document_sets(b.column("text").to_pylist()):
                if len(s) and (h := set_hash(s)) not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(h)
                    np.add.at(total, _bucket(s), np.uint32(1))
        for k, part in enumerate(total.reshape(SLICES, -1)):
            # nearly all of a task's counts are 0 to 3: one byte each, the few larger ones apart, deflated
            large = np.flatnonzero(part > 254)
            apart = np.stack([large.astype(np.uint32), part[large]]).tobytes()
            small_ones = np.minimum(part, 255).astype(np.uint8)
            small_ones[large] = 0
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "v": pa.array([zlib.compress(small_ones.tobytes() + apart, 1)], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        size = BUCKETS // SLICES
        out = np.zeros(size, np.uint64)
        for v in pdf.v:
            raw = zlib.decompress(v)
            out += np.frombuffer(raw[:size], np.uint8)
            where, many = np.frombuffer(raw[size:], np.uint32).reshape(2, -1)
            out[where] += many
        return pd.DataFrame({"k": pdf.k[:1], "v": [np.minimum(out, 0xFFFFFFFF).astype(np.uint32).tobytes()]})

    rows = docs.select("text").mapInArrow(run, "k int, v binary").groupBy("k").applyInPandas(add, "k int, v binary").collect()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.uint32)
    for r in rows:
        out[r.k] = np.frombuffer(r.v, np.uint32)
    return out.reshape(-1)


# ---- level 0: replicate to one-shingle pivots, meet, count ------------------------------------------------------------


def pack_sets(sig: np.ndarray, size: np.ndarray, many: np.ndarray) -> bytes:
    """Signatures, sizes and numbers of replicas of sets; 11 bytes a set, and 4 more for each number that its 2 bytes or 1 can't hold."""
    wide = np.concatenate([size[size >= 0xFFFF], many[many >= 0xFF]]).astype("<u4")
    columns = sig.astype("<i8"), np.minimum(size, 0xFFFF).astype("<u2"), np.minimum(many, 0xFF).astype(np.uint8), wide
    return b"".join(c.tobytes() for c in (np.array([len(sig)], "<u4"), *columns))


def unpack_sets(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    sig = np.frombuffer(blob, "<i8", n, 4)
    size, many = (np.frombuffer(blob, kind, n, 4 + at * n).astype(np.uint32) for kind, at in (("<u2", 8), (np.uint8, 10)))
    wide = np.frombuffer(blob, "<u4", -1, 4 + 11 * n) if len(blob) > 4 + 11 * n else np.zeros(0, "<u4")
    large = size == 0xFFFF
    size[large], many[many == 0xFF] = np.split(wide, [large.sum()])
    return sig, size, many


def replicas(docs: DataFrame, counters, parts: int) -> DataFrame:
    """Packed replicas: (part, sets, keys, place). A blob lists sets (pack_sets: signature, size, replicas in this part), then the
    replicas' keys and places set by set. counters: a broadcast of the table."""

    def pack(sigs, sizes, keys, owner, place):
        part = ((keys & np.uint64(0xFFFFF)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")  # within a part: set by set, places rising
        code = part[order] * len(sigs) + owner[order]
        first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        many = np.diff(np.append(first, len(code)))
        run_part, run_set = np.divmod(code[first], len(sigs))
        key, near = (keys[order] >> np.uint64(32)).astype("<u4"), place[order].astype(np.uint8)
        edge = np.searchsorted(run_part, np.arange(parts + 1))
        upto = np.append(first, len(code))
        out = []
        for p in np.unique(run_part).tolist():
            a, z = edge[p], edge[p + 1]
            own = run_set[a:z]
            out.append((p, pack_sets(sigs[own], sizes[own], many[a:z]), key[upto[a] : upto[z]].tobytes(), near[upto[a] : upto[z]].tobytes()))
        cols = list(zip(*out)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), *[pa.binary()] * 3])], ["part", "sets", "keys", "place"])

    def run(batches):
        table = counters.value
        seen: set[int] = set()
        sigs, sizes, keys, owner, place, have = [], [], [], [], [], 0
        for b in small(batches):
            for _, s in document_sets(b.column("text").to_pylist()):
                if not len(s) or (h := set_hash(s)) in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(h)
                n, w = len(s), int(window(len(s)))
                rank = np.minimum(table[_bucket(s)], 0xFFFFF).astype(np.uint64) << np.uint64(44) | s >> np.uint64(20)
                near = np.argpartition(rank, w - 1)[:w] if w < n else np.arange(n)
                near = near[np.argsort(rank[near], kind="stable")]
                keys.append(s[near])
                owner.append(np.full(w, len(sigs)))
                # positions in 255ths of the set's size, rounded down, so that they never exclude a pair
                place.append(np.arange(w) * 255 // n)
                sigs.append(h)
                sizes.append(n)
                have += w
                if have > 2_000_000:
                    yield pack(np.array(sigs), np.array(sizes), *map(np.concatenate, (keys, owner, place)))
                    sigs, sizes, keys, owner, place, have = [], [], [], [], [], 0
        if sigs:
            yield pack(np.array(sigs), np.array(sizes), *map(np.concatenate, (keys, owner, place)))

    return docs.select("text").mapInArrow(run, "part int, sets binary, keys binary, place binary")


def meet(blobs: list[tuple[bytes, bytes, bytes]], clusters: tuple[np.ndarray, np.ndarray] | None = None, batch: int = 500_000):
    """Yields (kinds, size, codes, times): pairs of sets that meet in the regions of one partition, as indices x << 32 | y with
    x < y of the sorted signatures kinds; each pair once a yield. Pairs within one of the labelled clusters are left out, and a
    region's largest cluster isn't paired with itself: a region costs its members times those outside that cluster."""
    sig, size, many, key, place = [], [], [], [], []
    for sets, k, p in blobs:
        for column, values in zip((sig, size, many), unpack_sets(sets)):
            column.append(values)
        key.append(np.frombuffer(k, "<u4"))
        place.append(np.frombuffer(p, np.uint8))
    sig, size, many, key, place = map(np.concatenate, (sig, size, many, key, place))
    # copies collapse: one run of replicas for each set
    kinds, first = np.unique(sig, return_index=True)
    run = np.full(len(sig), -1, np.int32)
    run[first] = np.arange(len(kinds), dtype=np.int32)
    own = np.repeat(run, many)
    size = size[first].astype(np.int64)
    label = np.arange(len(kinds))
    if clusters is not None and len(clusters[0]):
        at = np.minimum(np.searchsorted(clusters[0], kinds), len(clusters[0]) - 1)
        known = clusters[0][at] == kinds
        label[known] = len(kinds) + np.unique(clusters[1][at[known]], return_inverse=True)[1]
    if (own < 0).any():
        keep = own >= 0
        key, own, place = key[keep], own[keep], place[keep]
    order = np.argsort(key, kind="stable")
    key, own, place = key[order], own[order], place[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    del order, key
    held: list[tuple[np.ndarray, np.ndarray]] = []
    weight = 0

    def counted():
        code = np.concatenate([c for c, _ in held])
        times = np.concatenate([t for _, t in held])
        u, inv = np.unique(code, return_inverse=True)
        return u, np.bincount(inv, times).astype(np.int64)

    a = 0
    while a < len(edge) - 1:  # some regions at a time
        z = max(a + 1, int(np.searchsorted(edge, edge[a] + batch, side="right")) - 1)
        long = np.diff(edge[a : z + 1])
        some = np.repeat(long, long) > 1
        region = np.repeat(np.arange(z - a), long)[some]
        o = own[edge[a] : edge[z]][some].astype(np.int64)
        n = size[o]
        room = n - place[edge[a] : edge[z]][some].astype(np.int64) * n // 255  # shingles from here on, not less than they are
        a = z
        # within a region cluster by cluster, the largest last; partners of x are the sets of the clusters that follow
        kind = label[o]
        order = np.lexsort((kind, region))
        same = np.r_[True, (region[order][1:] != region[order][:-1]) | (kind[order][1:] != kind[order][:-1])] if len(o) else np.zeros(0, bool)
        block = np.cumsum(same) - 1
        members = np.bincount(block)
        order = order[np.lexsort((block, members[block], region[order]))] if len(o) else order
        o, n, room, region, kind = o[order], n[order], room[order], region[order], kind[order]
        after = np.r_[np.flatnonzero(np.r_[True, (region[1:] != region[:-1]) | (kind[1:] != kind[:-1])])[1:], len(o)] if len(o) else order
        after = np.repeat(after, np.diff(np.r_[0, after]))
        partners = np.searchsorted(region, region, side="right") - after
        total = np.concatenate([[0], np.cumsum(partners)])
        begin = 0
        while begin < len(o):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + batch, side="right")) - 1)
            m = partners[begin:end]
            i = np.repeat(np.arange(begin, end), m)
            j = np.repeat(after[begin:end], m) + np.arange(len(i)) - np.repeat(total[begin:end] - total[begin], m)
            least = need(n[i], n[j]) - times(np.minimum(n[i], n[j])) + 1
            ok = (room[i] >= least) & (room[j] >= least) & (5 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j]))
            x, y = o[i[ok]], o[j[ok]]
            u, c = np.unique(np.minimum(x, y) << 32 | np.maximum(x, y), return_counts=True)
            held.append((u, c))
            weight += len(u)
            if weight > 2 * batch:
                held = [counted()]
                weight = len(held[0][0])
                if weight > batch:
                    yield kinds, size, *held[0]
                    held, weight = [], 0
            begin = end
    if held:
        yield kinds, size, *counted()


def meetings(packed: DataFrame, pair_parts: int, clusters=None) -> DataFrame:
    """Packed pairs (part, pairs): signatures, times of meeting and times needed; a pair always goes to the same part. clusters: a
    broadcast of labels()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kinds, size, u, c in meet(list(zip(pdf.sets, pdf["keys"], pdf.place)), clusters.value if clusters else None):
            x, y = u >> 32, u & 0xFFFFFFFF  # kinds are sorted, so the smaller index is the smaller signature
            least = np.minimum(times(np.minimum(size[x], size[y])), need(size[x], size[y]))
            # pairs that meet often enough right here are edges: their spanning forest stands for them, and pairs within one
            # of its components add nothing to the regions
            strong = c >= least
            node, root = forest(x[strong], y[strong])
            label = np.arange(len(kinds))
            label[node] = root
            apart = label[x] != label[y]
            x, y = np.concatenate([root, x[apart]]), np.concatenate([node, y[apart]])
            c, least = np.concatenate([np.full(len(node), MOST), np.minimum(c[apart], MOST)]), np.concatenate([np.ones(len(node), np.int64), least[apart]])
            a, b = kinds[x], kinds[y]
            part = (a ^ b * 31) % pair_parts
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(pair_parts + 1))
            for p in range(pair_parts):
                some = order[edge[p] : edge[p + 1]]
                if len(some):
                    out.append((p, a[some].astype("<i8").tobytes() + b[some].astype("<i8").tobytes() + c[some].astype(np.uint8).tobytes() + least[some].astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["part", "pairs"])

    return packed.groupBy("part").applyInPandas(run, "part int, pairs binary")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of a list of edges; nodes that are their own smallest are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        lo = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], lo)
        np.minimum.at(new, root[y], lo)
        while True:
            deeper = new[new]
            if (deeper == new).all():
                break
            new = deeper
        if (new == root).all():
            break
        root = new
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def edges(met: DataFrame) -> DataFrame:
    """Spanning edges (a, b) with a > b of the pairs that meet in enough regions."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = [len(v) // 18 for v in pdf.pairs]
        a, b = (np.concatenate([np.frombuffer(v, "<i8", k, at * k) for v, k in zip(pdf.pairs, n)]) for at in (0, 8))
        c, least = (np.concatenate([np.frombuffer(v, np.uint8, k, at * k) for v, k in zip(pdf.pairs, n)]).astype(np.int64) for at in (16, 17))
        order = np.lexsort((b, a))
        a, b, c, least = a[order], b[order], c[order], least[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        first = np.flatnonzero(new)
        enough = np.add.reduceat(c, first) >= np.minimum.reduceat(least, first)
        node, root = forest(a[first][enough], b[first][enough])
        return pd.DataFrame({"a": node, "b": root})

    return met.groupBy("part").applyInPandas(run, "a long, b long")


def components(edge: DataFrame, name: str) -> DataFrame:
    """node, root (the smallest node of its component) of edges a > b; nodes that are roots themselves are included.

    Alternating star contraction: each round points the larger, then the smaller neighbours of a node at its smallest one, and
    writes the edges anew; edges never grow in number, and the rounds end when no edge changes. A node of any degree is handled
    by aggregation and join alone."""
    edge = cut(edge.distinct(), name)
    some = edge.limit(COLLECT + 1).toPandas()  # at most COLLECT rows stay here; more go the distributed way
    if len(some) <= COLLECT:
        node, root = forest(some.a.to_numpy(np.int64), some.b.to_numpy(np.int64))
        roots = np.unique(root)
        return edge.sparkSession.createDataFrame(pd.DataFrame({"node": np.concatenate([node, roots]), "root": np.concatenate([root, roots])}, dtype="int64"), "node long, root long")
    while True:
        both = edge.union(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = edge.select("a", "b").join(least.withColumnRenamed("a", "b"), "b").where("a <> m").select("a", F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = cut(large.join(low, "a").select("a", F.col("m").alias("b")).union(small).distinct(), name)
        inner = new.select("b").distinct().join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        twice = new.groupBy("a").count().where("count > 1")
        edge = new
        if inner.limit(1).count() == 0 and twice.limit(1).count() == 0:
            break
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edge.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# ---- level 1 and deeper: exact joins inside a region ------------------------------------------------------------------


class Region:
    """Sets of one region over a numbering of their shingles."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        kinds, small = np.unique(flat, return_inverse=True)
        self.flat = small.astype(np.int64)
        self.mark = np.zeros(len(kinds), np.int32)

    def common(self, x: int, others: np.ndarray) -> np.ndarray:
        """Intersection sizes of set x with each of others."""
        if not len(others):
            return np.zeros(0, np.int64)
        own = self.flat[self.at[x] : self.at[x + 1]]
        self.mark[own] = 1
        size = self.size[others]
        first = np.cumsum(size) - size
        index = np.arange(int(size.sum())) + np.repeat(self.at[others] - first, size)
        out = np.add.reduceat(self.mark[self.flat[index]], first).astype(np.int64)
        self.mark[own] = 0
        return out

    def distance(self, x: int, others: np.ndarray) -> np.ndarray:
        c = self.common(x, others)
        return 1 - c / (self.size[x] + self.size[others] - c)


def region_join(sets: list[np.ndarray], side: np.ndarray | None = None, leaf: int = LEAF, done: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All linked pairs (i, j), i < j, of non-empty sets; with side, only pairs whose sides differ. Exact. done counts the sets of
    divided regions (divided), pairs decided by a pivot's distances (bounds) and pairs compared (compared)."""
    r = Region(sets)
    found: list[np.ndarray] = []
    tiny = 1e-9

    def compare(members: np.ndarray, home: np.ndarray) -> None:
        """Pairs of a home member and any member; a pair of two home members once."""
        members, home = members[np.argsort(r.size[members], kind="stable")], home
        is_home = np.zeros(len(r.size), bool)
        is_home[home] = True
        pivot = members[len(members) // 2]
        far = r.distance(pivot, members)
        n = r.size[members]
        for k in range(len(members)):
            x = members[k]
            hi = np.searchsorted(n, n[k] / 0.6 + tiny, side="right")
            near = np.arange(k + 1, hi)
            if not is_home[x]:
                near = near[is_home[members[near]]]
            if side is not None:
                near = near[side[members[near]] != side[x]]
            among = len(near)
            near = near[np.abs(far[near] - far[k]) <= EPS + tiny]
            sure = far[near] + far[k] <= EPS - tiny
            rest = near[~sure]
            if done is not None:
                done["bounds"] += among - len(rest)
                done["compared"] += len(rest)
            c = r.common(x, members[rest])
            linked = np.concatenate([near[sure], rest[c >= need(n[k], n[rest])]])
            if len(linked):
                y = members[linked]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)]))

    def join(home: np.ndarray, window_only: np.ndarray, depth: int) -> None:
        members = np.concatenate([home, window_only])
        if len(members) <= leaf or depth > 6:
            compare(members, home)
            return
        k = min(16, max(2, len(members) // leaf + 1))
        pivots = home[np.linspace(0, len(home) - 1, min(k, len(home))).astype(int)] if len(home) else members[:1]
        pivots = np.unique(pivots)
        d = np.stack([r.distance(p, members) for p in pivots])
        own = d.argmin(0)
        nearest = d.min(0)
        many = len(home)
        rest = nearest[:many] > RHO
        cells = [(home[rest], window_only)] if rest.any() else []  # their pairs with sets of a cell are found in that cell
        for c in range(len(pivots)):
            inside = (own[:many] == c) & ~rest
            if not inside.any():
                continue
            radius = nearest[:many][inside].max()
            close = (d[c] <= nearest + 2 * EPS + tiny) & (d[c] <= radius + EPS + tiny)
            close[:many] &= ~inside
            cells.append((home[inside], members[close]))
        if max(len(h) + len(w) for h, w in cells) > 0.8 * len(members):
            compare(members, home)  # the windows no longer separate these sets
            return
        if done is not None and depth == 0:
            done["divided"] += len(members)
        for h, w in cells:
            join(h, w, depth + 1)

    everyone = np.flatnonzero(r.size > 0)
    if len(everyone) > 1:
        join(everyone, np.zeros(0, np.int64), 0)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)  # pairs of two homes meet in both cells
    return pairs[0], pairs[1]


def _wanted(member: DataFrame, limit: int):
    """The members (sig, root, blocks, docs, grp) as sorted arrays if they are limit at most, else None."""
    some = member.limit(limit + 1).toPandas()
    if len(some) > limit:
        return None
    some = some.sort_values("sig")
    return tuple(some[c].to_numpy(np.int64) for c in ("sig", "root", "blocks", "docs", "grp"))


def class_links(docs: DataFrame, classes: DataFrame, regions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sig, similar: documents in linked classes), and spanning link edges (a, b), of the classes in regions.

    classes: sig, n, docs, first; regions: node, root. Sets move once, from the task that reads the text to their region, if the
    members fit BROADCAST_MEMBERS; otherwise they move to their member's row first, and then to the region."""
    spark = docs.sparkSession
    member = classes.join(regions, classes.sig == regions.node).select("sig", "root", "docs", "first", "n")
    load = member.groupBy("root").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("shingles"))
    load = load.withColumn("blocks", F.ceil(F.greatest(F.col("sets") / REGION, F.col("shingles") / REGION_SHINGLES)).cast("long"))
    # small regions share a task's group, of about GROUP_SHINGLES shingles; a region of more blocks has a group for each pair of them
    groups = max(1, int((load.agg(F.sum("shingles")).first()[0] or 0) // GROUP_SHINGLES) + 1)
    member = cut(member.join(load.select("root", "blocks"), "root").withColumn("grp", F.pmod(F.xxhash64("root"), F.lit(groups)).cast("long")).select("sig", "root", "blocks", "docs", "grp"), "op3-members")
    schema = "grp long, root long, i long, j long, own long, sig long, docs long, shingles binary"

    def placed(sig: np.ndarray, root, blocks, docs_of, grp, shingles: list):
        """A row for each pair of blocks that a set takes part in."""
        own = (sig ^ sig >> 17) % blocks
        at = np.repeat(np.arange(len(sig)), blocks)
        other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        i, j = np.minimum(own[at], other), np.maximum(own[at], other)
        where = np.where(blocks[at] > 1, -1 - ((root[at] * 31 + i) * 31 + j & 0x3FFFFFFF), grp[at])
        return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (where, root[at], i, j, own[at], sig[at], docs_of[at])), pa.array(shingles, pa.binary()).take(pa.array(at))], [x.split()[0] for x in schema.split(", ")])

    known = _wanted(member, BROADCAST_MEMBERS)
    if known is not None:
        shared = spark.sparkContext.broadcast(known)

        def sets_placed(batches):
            every = shared.value
            seen: set[int] = set()
            for b in small(batches, 200):
                out: list[tuple[int, bytes]] = []
                for _, s in document_sets(b.column("text").to_pylist()):
                    if not len(s):
                        continue
                    h = set_hash(s)
                    at = int(np.searchsorted(every[0], h))
                    if at < len(every[0]) and every[0][at] == h and h not in seen:
                        seen.add(h)  # at most as many as members
                        out.append((at, s.tobytes()))
                at = np.array([x for x, _ in out], np.int64)
                yield placed(*(c[at] for c in every), [x for _, x in out])

        paired = docs.select("text").mapInArrow(sets_placed, schema)
    else:

        def sets_of(batches):
            for b in small(batches, 200):
                out = [(set_hash(s), s.tobytes()) for _, s in document_sets(b.column("text").to_pylist()) if len(s)]
                yield pa.RecordBatch.from_pydict({"sig": pa.array([x for x, _ in out], pa.int64()), "shingles": pa.array([x for _, x in out], pa.binary())})

        def place(batches):
            for b in small(batches, 200):
                yield placed(*(b.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "root", "blocks", "docs", "grp")), b.column("shingles").to_pylist())

        paired = docs.select("text").mapInArrow(sets_of, "sig long, shingles binary").join(member, "sig").select("sig", "root", "blocks", "docs", "grp", "shingles").mapInArrow(place, schema)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs, similar, a, b = [], [], [], []
        done = {"divided": 0, "bounds": 0, "compared": 0}
        for (_, i, j), g in pdf.groupby(["root", "i", "j"], sort=False):
            g = g.drop_duplicates("sig")
            if len(g) < 2:
                continue
            s = g.sig.to_numpy(np.int64)
            docs_of = g.docs.to_numpy(np.int64)
            x, y = region_join([np.frombuffer(v, np.uint64) for v in g.shingles], None if i == j else g.own.to_numpy(), done=done)
            count = np.bincount(x, docs_of[y], len(s)) + np.bincount(y, docs_of[x], len(s))
            some = np.flatnonzero(count)
            node, root = forest(s[x], s[y]) if len(x) else (s[:0], s[:0])
            sigs += s[some].tolist() + [0] * len(node)
            similar += count[some].astype(np.int64).tolist() + [0] * len(node)
            a += [0] * len(some) + node.tolist()
            b += [0] * len(some) + root.tolist()
        out = pd.DataFrame({"sig": [*sigs, -1], "similar": [*similar, 0], "a": [*a, 0], "b": [*b, 0]}, dtype="int64")
        return out.assign(**{k: np.where(out.sig < 0, n, 0) for k, n in done.items()})

    # rows of sig -1 say how the pairs were decided
    solved = cut(paired.groupBy("grp").applyInPandas(solve, "sig long, similar long, a long, b long, divided long, bounds long, compared long"), "op3-links")
    return solved.where("sig > 0").groupBy("sig").agg(F.sum("similar").alias("similar")), solved.where("sig = 0").select("a", "b")


def jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, text -> doc_id, n_shingles, n_similar, component_id, class_id (the smallest doc_id of an equal set)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    own = cut(signatures(docs), "op3-signatures")
    classes = cut(own.where("sig <> 0").groupBy("sig").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.first("words").alias("words")), "op3-classes")
    total = own.agg(F.sum(F.col("n") - F.ceil(F.col("n") * 0.6) + F.least(F.floor(F.col("n") / STEP) + NEED, F.lit(MOST)))).first()[0] or 0
    parts = max(1, -(-int(total) // KEYS_PER_PART))
    copies = cut(near_copies(classes), "op3-copies")
    clusters = spark.sparkContext.broadcast(labels(components(copies, "op3-clusters")))
    counters = spark.sparkContext.broadcast(shingle_counters(docs))
    packed = replicas(docs, counters, parts)
    met = meetings(packed, max(1, parts), clusters)
    regions = components(edges(met).union(copies), "op3-regions")
    similar, links = class_links(docs, classes, regions)
    linked = components(links, "op3-components")
    of = classes.join(similar, "sig", "left").join(linked.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", "docs", F.coalesce("similar", F.lit(0)).alias("similar"), F.coalesce("root", "sig").alias("root"))
    least = of.groupBy("root").agg(F.min("first").alias("component"))
    of = cut(of.join(least, "root").select("sig", "first", "docs", "similar", "component"), "op3-answers")
    out = own.drop("words").join(of, "sig", "left")
    has = F.col("sig") != 0
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(has, F.col("similar") + F.col("docs") - 1).otherwise(0).cast("long").alias("n_similar"), F.when(has, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), F.when(has, F.col("first")).otherwise(F.col("doc_id")).alias("class_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("class_id")


#: Texts without a word have no shingle and no row in s; intersections come from a join on shingles.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, list_sort(CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS sh FROM d),
c AS (SELECT sh, min(doc_id) AS cls, count(*) AS docs FROM t WHERE len(sh) > 0 GROUP BY sh),
m AS (SELECT t.doc_id, c.cls, c.docs FROM t JOIN c ON t.sh = c.sh),
s AS (SELECT cls, len(sh) AS n, unnest(sh) AS g FROM c),
p AS (SELECT a.cls AS x, b.cls AS y, a.n AS nx, b.n AS ny, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.cls < b.cls AND 10 * a.n >= 6 * b.n AND 10 * b.n >= 6 * a.n GROUP BY 1, 2, 3, 4),
l AS (SELECT x, y FROM p WHERE 100 * k >= 60 * (nx + ny - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
q AS (SELECT e.x AS cls, sum(c.docs) AS k FROM e JOIN c ON e.y = c.cls GROUP BY 1),
r AS (SELECT cls, cls AS root FROM c UNION SELECT e.y, r.root FROM r JOIN e ON r.cls = e.x),
o AS (SELECT cls, min(root) AS root FROM r GROUP BY cls)
SELECT t.doc_id, CAST(len(t.sh) AS BIGINT) AS n_shingles, CAST(CASE WHEN m.cls IS NULL THEN 0 ELSE m.docs - 1 + coalesce(q.k, 0) END AS BIGINT) AS n_similar, coalesce(o.root, t.doc_id) AS component_id
FROM t LEFT JOIN m USING (doc_id) LEFT JOIN q ON m.cls = q.cls LEFT JOIN o ON m.cls = o.cls
"""
