"""Language identification with hyperdimensional profiles (operator 10).

Every letter has a random +-1 vector of DIM places, drawn from a generator seeded by its code point. A trigram's vector binds
(multiplies place by place) its letters' vectors, the first cyclically shifted by two places, the second by one. A text's
vector bundles (sums) its trigrams' vectors. A language's prototype bundles the vectors of its training texts, each divided by
its number of trigrams; the mean prototype is then taken from every prototype. A text gets the language with the largest
cosine.

Bundling is linear, so training first sums trigram weights by language inside a task and multiplies once; tasks send
languages x DIM numbers each, and the driver holds as many. All training texts count; nothing is sampled.

Cases: null or empty text, or one without a letter: ``und`` with score 0. Null lang: not a training row. A language is whatever
string ``lang`` holds; ties go to the alphabetically first. No training row at all: every text is ``und``. A null
doc_id is neither held out nor, as its fold is unknown, a training row. Texts of any length count whole. An empty table gives no row. Repeated rows are
scored each for themselves. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, small

DIM = 1024
#: Texts are counted in slices of about this many code points.
SLICE = 1_000_000
#: and of at most so many texts, so that the dense counts stay small
MOST = 256


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1 << 14)
def _letter(code: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7_000_003 + code)).integers(0, 2, DIM, dtype=np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """One row for each (a, b, c) row of code points; 0 stands for the gap between words."""
    alphabet, at = np.unique(codes, return_inverse=True)
    at = at.reshape(codes.shape)
    base = np.stack([_letter(int(c)) for c in alphabet])
    return np.roll(base, 2, 1)[at[:, 0]] * np.roll(base, 1, 1)[at[:, 1]] * base[at[:, 2]]


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(counts, texts x distinct trigrams; the code points of the distinct trigrams) of a slice of texts.

    Text is lower-cased; runs of characters that aren't letters are one gap, also at both ends; trigrams hold a letter in the
    middle."""
    units = np.frombuffer("\0".join(["", *texts, ""]).lower().encode("utf-32-le", "replace"), np.uint32)
    gap = units == 0
    if np.count_nonzero(gap) != len(texts) + 1:  # a text holds U+0000
        return trigram_counts([t.replace("\0", " ") for t in texts])
    is_letter = _letters()[units]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the gap after a letter
    keep |= gap
    u = np.where(is_letter, units, 0)[keep]
    own = (np.cumsum(gap, dtype=np.int32) - 1)[keep]
    if len(u) < 3:
        return np.zeros((len(texts), 0), np.float32), np.zeros((0, 3), np.uint32)
    alphabet = np.flatnonzero(np.bincount(u))
    n = len(alphabet)
    number = np.zeros(alphabet[-1] + 1, np.int64)
    number[alphabet] = np.arange(n)
    small = number[u]
    ok = np.flatnonzero(u[1:-1])  # a letter in the middle: its neighbours are of the same text, or the gap before or after it
    code = (small[ok] * n + small[ok + 1]) * n + small[ok + 2]
    if n**3 <= 1 << 24:
        kinds = np.flatnonzero(np.bincount(code))
        number = np.zeros(n**3, np.int32)
        number[kinds] = np.arange(len(kinds))
        row = number[code]
    else:
        kinds, row = np.unique(code, return_inverse=True)
    counts = np.bincount(own[ok + 1].astype(np.int64) * len(kinds) + row, minlength=len(texts) * len(kinds)).reshape(len(texts), len(kinds))
    return counts.astype(np.float32), np.stack([alphabet[kinds // (n * n)], alphabet[kinds // n % n], alphabet[kinds % n]], 1)


def slices(texts: list[str], size: int = SLICE):
    a = have = 0
    for k, t in enumerate(texts):
        if have and (have + len(t) > size or k - a == MOST):
            yield a, k
            a, have = k, 0
        have += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def bundle_by_language(batches):
    """Partial prototypes of a task: (lang, sums as little-endian float64)."""
    total: dict[str, np.ndarray] = {}
    for b in small(batches):
        texts = [t or "" for t in b.column("text").to_pylist()]
        langs = b.column("lang").to_pylist()
        for a, z in slices(texts):
            counts, points = trigram_counts(texts[a:z])
            if not len(points):
                continue
            names = sorted(set(langs[a:z]))
            at = np.zeros((len(names), z - a), np.float32)
            at[[names.index(x) for x in langs[a:z]], np.arange(z - a)] = 1 / np.maximum(counts.sum(1), 1)
            weights = at @ counts
            for name, v in zip(names, weights @ trigram_vectors(points).astype(np.float32)):
                total[name] = total.get(name, 0) + v.astype(np.float64)
    yield pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "v": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def fit(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) of a table with text and non-null lang."""
    parts = train.select("lang", "text").mapInArrow(bundle_by_language, "lang string, v binary")

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": pdf.lang[:1], "v": [np.sum([np.frombuffer(v) for v in pdf.v], axis=0).tobytes()]})

    found = sorted(parts.groupBy("lang").applyInPandas(add, "lang string, v binary").collect())  # one row a language
    if not found:
        return [], np.zeros((0, DIM))
    p = np.stack([np.frombuffer(r.v) for r in found])
    p = p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    if len(p) > 1:
        p = p - p.mean(0)
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-12)
    return [r.lang for r in found], p


def predict_texts(texts: list[str], langs: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score (the cosine, not below 0) of each text."""
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    if not langs:
        return out, score
    proto = prototypes.T.astype(np.float32)
    for a, z in slices(texts):
        counts, points = trigram_counts(texts[a:z])
        if not len(points):
            continue
        v = counts @ trigram_vectors(points).astype(np.float32)
        cos = (v @ proto) / np.maximum(np.linalg.norm(v, axis=1), 1e-9)[:, None]
        best, some = cos.argmax(1), counts.any(1)
        for i in np.flatnonzero(some):
            out[a + i] = langs[best[i]]
        score[a:z] = np.where(some, np.clip(cos.max(1), 0, 1), 0)
    return out, score


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray) -> DataFrame:
    """doc_id, text -> doc_id, lang_pred, score."""

    def run(batches):
        for b in small(batches):
            names, score = predict_texts([t or "" for t in b.column("text").to_pylist()], langs, prototypes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(np.round(score, 6))], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    langs, prototypes = fit(docs.where((fold != 2) & F.col("lang").isNotNull()))
    found = identify(docs, langs, prototypes)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
