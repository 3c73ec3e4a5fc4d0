"""Token ids in binary files: frequency ranks in byte-aligned variable length, control bytes apart (operator 2).

Every id becomes its rank by frequency over all documents (most frequent first, ties by id). A rank takes 1 to 4 bytes; two
bits of a control byte hold the length, so one control byte serves four ranks. All control bytes of a file come
before its data bytes, and the decoder looks control bytes up in a table of 256 x 4 lengths.

A file holds a run of documents in ascending doc_id order: the magic, counts, doc ids, ids of each document, control bytes,
data bytes. The rank table is a file of its own. Files follow one another by their number; each says how many ids stand before.

Documents are encoded where they lie; their ids move once, to the range partition of (doc_id, length, hash), so that rows without a
doc_id and rows that repeat one are spread like all others. A partition writes one file after another of about IDS_PER_FILE ids,
whatever its number of documents. A document of any length stays whole. The ids before a file are sums over the manifest.

Encoding is done by this package's batched merges (wordbpe), which equal the tokenizers library id by id; the library itself
encodes what they leave: special tokens, odd lower cases and long spans.

Cases: null text is empty and gets the end id alone; null doc_ids come first; repeated rows each get a place (ties by length, then
content); texts of any length are encoded whole; an empty table gives no file but the rank table. Further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut, read_file, read_table, small, work_folder, write_file
from .spans import ragged

MAGIC = b"VBRANK01"
IDS_PER_FILE = 4_000_000
#: ids of a range partition, in one file or more
PARTITION_IDS = 4_000_000
END = 1

_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of non-negative integers below 2^32."""
    r = ranks.astype(np.uint32)
    length = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    four = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    four[: len(r)] = length - 1
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    raw = r.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), raw[np.arange(4)[None, :] < length[:, None]].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(the n integers, where each begins in data and, last, their end)."""
    return values(_LENGTHS[control].reshape(-1)[:n], data)


def values(length: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the integers of these lengths, where each begins in data and, last, their end)."""
    length = length.astype(np.int64)
    at = np.concatenate([[0], np.cumsum(length)])
    begin = at[:-1]
    value = data[begin].astype(np.uint32)
    for k in range(1, int(length.max(initial=1))):
        some = np.flatnonzero(length > k)
        value[some] |= data[begin[some] + k].astype(np.uint32) << np.uint32(8 * k)
    return value, at


def tokenise(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """doc_id, text -> doc_id, n, ids (little-endian; 16 bits where the vocabulary fits)."""

    def run(batches):
        from .wordbpe import coder

        c = coder(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            sizes, blobs = [], []
            for ids, n in c.encode(texts):
                upto = np.concatenate([[0], np.cumsum(n)])
                sizes += (n + 1).tolist()
                last = np.array([end], c.table.dtype).tobytes()
                blobs += [ids[upto[k] : upto[k + 1]].tobytes() + last for k in range(len(n))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, ids binary")


def frequencies(tokens: DataFrame, width: int) -> dict[int, int]:
    """Count of every id; the driver gets at most one row for each id of the vocabulary."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            ids = np.frombuffer(b"".join(b.column("ids").to_pylist()), f"<u{width}")
            c = np.bincount(ids, minlength=len(total))
            c[: len(total)] += total
            total = c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(some, pa.int64()), "n": pa.array(total[some], pa.int64())})

    return {r.id: r.n for r in tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}


def write_files(docs: DataFrame, path: str, folder: str, end: int = END, ids_per_file: int = IDS_PER_FILE) -> tuple[DataFrame, str]:
    """Writes all documents; returns the manifest (part, file, base, docs, n) and the rank table's file."""
    from .wordbpe import coder

    width = coder(path).table.dtype().itemsize
    tokens = cut(tokenise(docs, path, end), "op2-tokens")
    counts = frequencies(tokens, width)
    ranked = np.array(sorted(counts, key=lambda i: (-counts[i], i)), np.uint32)
    table = write_file(folder, "ranks", ranked.astype("<u4").tobytes())
    to_rank = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    to_rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    parts = max(1, -(-sum(counts.values()) // max(ids_per_file, PARTITION_IDS)))
    shared = docs.sparkSession.sparkContext.broadcast(to_rank)  # a row for each id of the vocabulary

    def save(batches):
        number = TaskContext.get().partitionId()
        own: list[tuple] = []
        have = files = 0

        def flush():
            nonlocal own, have, files
            doc, n, control, data = zip(*own)
            present = np.array([d is not None for d in doc], np.uint8)
            head = MAGIC + struct.pack("<QQ", len(own), have)
            body = [head, present.tobytes(), np.array([d or 0 for d in doc], "<i8").tobytes(), np.array(n, "<i8").tobytes(), *control, *data]
            name = write_file(folder, f"part-{number:06d}-{files:06d}", b"".join(body))
            row = pa.RecordBatch.from_pydict({"part": pa.array([number], pa.int64()), "place": pa.array([files], pa.int64()), "file": [name], "docs": pa.array([len(own)], pa.int64()), "n": pa.array([have], pa.int64())})
            own, have, files = [], 0, files + 1
            return row

        for b in small(batches):
            for doc, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "n", "ids"))):
                if own and have + n > ids_per_file:
                    yield flush()
                own.append((doc, n, *pack(shared.value[np.frombuffer(ids, f"<u{width}")])))
                have += n
        if own:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), F.col("n"), F.col("h")]
    moved = tokens.withColumn("h", F.xxhash64("ids")).repartitionByRange(parts, *order).sortWithinPartitions(*order, "ids")
    written = cut(moved.select("doc_id", "n", "ids").mapInArrow(save, "part long, place long, file string, docs long, n long"), "op2-manifest")
    # the ids before each file: within blocks of partitions, and before each block
    block = F.floor(F.col("part") / 1024)
    within = W.partitionBy("block").orderBy("part", "place").rowsBetween(W.unboundedPreceding, -1)
    placed = written.withColumn("block", block).withColumn("inner", F.coalesce(F.sum("n").over(within), F.lit(0)))
    totals = written.groupBy(block.alias("block")).agg(F.sum("n").alias("t"))
    before = totals.withColumn("outer", F.coalesce(F.sum("t").over(W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("block", "outer")
    return placed.join(before, "block").select("part", "file", (F.col("inner") + F.col("outer")).alias("base"), "docs", "n"), table


def read_documents(manifest: DataFrame, table: str, files: int, with_ids: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start, n_tokens, ids_crc32, and the ids as little-endian 32-bit integers if asked for."""

    def run(batches):
        ranked = np.frombuffer(read_file(table), "<u4")
        for b in batches:
            for name, base in zip(b.column("file").to_pylist(), b.column("base").to_pylist()):
                raw = np.frombuffer(read_file(name), np.uint8)
                if raw[:8].tobytes() != MAGIC:
                    raise ValueError(f"{name} is no token file")
                docs, total = struct.unpack("<QQ", raw[8:24].tobytes())
                at = 24
                present = raw[at : at + docs].astype(bool)
                at += docs
                doc, n = (np.frombuffer(raw[at + k * 8 * docs : at + (k + 1) * 8 * docs].tobytes(), "<i8") for k in (0, 1))
                at += 16 * docs
                blocks = -(-n // 4)
                control = raw[at : at + int(blocks.sum())]
                # each document has its own control bytes; the last may hold fewer than four lengths
                first = np.cumsum(blocks) - blocks
                length = _LENGTHS[control].reshape(-1)[ragged(first * 4, n)]
                value, _ = values(length, raw[at + len(control) :])
                ids = np.ascontiguousarray(ranked[value].astype("<u4"))
                upto = np.concatenate([[0], np.cumsum(n)])
                view = memoryview(ids).cast("B")
                out = {
                    "doc_id": pa.array(doc, pa.int64(), mask=~present),
                    "start": pa.array(base + upto[:-1], pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(view[4 * upto[k] : 4 * upto[k + 1]]) for k in range(docs)], pa.int64()),
                }
                if with_ids:
                    out["ids"] = pa.array([bytes(view[4 * upto[k] : 4 * upto[k + 1]]) for k in range(docs)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return manifest.repartition(max(1, min(files, 10_000)), "file").mapInArrow(run, schema)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_folder(spark, "op2-files")
    manifest, table = write_files(read_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), folder)
    return read_documents(manifest, table, manifest.count())
