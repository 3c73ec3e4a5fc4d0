"""Toxicity by a weighted lexicon (operator 9).

Texts are lower-cased and folded: look-alike letters of other scripts and digit or sign substitutions become the Latin letters
they imitate. One Aho-Corasick automaton then finds every lexicon entry and exception phrase in one pass. An entry counts where
it begins a word; an entry marked whole must also end it. Matches inside an exception phrase are dropped. The summed weights,
raw and divided by the square root of the number of words, feed a logistic curve that gives the score.

The lexicon is learned: of a bounded sample of labelled training texts (SAMPLE rows, those with the smallest hash of their id; of
copies with one label one, the smallest doc_id)
document frequencies of whole words and word beginnings are counted by label. Entries are those with at least MIN_DF toxic
texts, a share MIN_SHARE of them, and a smoothed log-odds of at least MIN_WEIGHT; a beginning is kept only if no shorter kept beginning says as much.
Exception phrases are pairs of neighbouring words that hold an entry, in clean texts alone and at least MIN_EXCEPTION times.
Everything is scored over whole texts.

Cases: null or empty texts have no match and get the curve's value at 0. A null doc_id is scored like any other, is never a
training row and not held out. Very long texts are folded and matched whole, in one pass. Ties: of entries that begin at one
place the heaviest counts, whichever of equal ones; terms of equal weight are taken alphabetically. Empty documents: no row. Null labels and labels without a text are no training
rows. Without training rows of both kinds every score is 0. Repeated rows are scored each for themselves. Further columns of
either table are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import read_table, small

SAMPLE = 20_000
MIN_DF, MIN_SHARE, MIN_WEIGHT, MIN_EXCEPTION, MAX_ENTRIES = 8, 0.008, 3.0, 3, 4000
PREFIXES = (4, 5, 6)

_LOOKALIKE = {
    "аạàáâãäåα": "a", "еёεèéêë": "e", "оοòóôõöө": "o", "рρ": "p", "сϲ": "c", "уγý": "y", "хχ": "x", "іıìíîï": "i", "јϳ": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g",
    "һ": "h", "кκ": "k", "ӏ": "l", "мμ": "m", "пη": "n", "тτ": "t", "υùúûü": "u", "ν": "v", "ԝω": "w", "вβ": "b", "ñ": "n", "ç": "c",
}
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: letters of the four written languages stay; only other scripts and signs inside words fold
FOLD = {ord(c): to for chars, to in _LOOKALIKE.items() for c in chars if not ("À" <= c <= "ÿ")}
_WORD = re.compile(r"[^\W_]+")
_ANY_FOLD = re.compile("[" + "".join(map(chr, FOLD)) + "]")
_SIGN = re.compile("[" + re.escape("".join(_SIGNS).replace("!", "")) + "]")
_TOKEN_PART = re.compile(r"[\w@$!|]")
_SIGN_MAP = {ord(k): v for k, v in _SIGNS.items()}


def fold(text: str) -> str:
    """Lower case; look-alikes folded everywhere, digits and signs only inside tokens that also hold a letter."""
    t = text.lower()
    if not t.isascii() and _ANY_FOLD.search(t):
        t = t.translate(FOLD)
    out, done = [], 0
    for m in _SIGN.finditer(t):
        s = e = m.start()
        if s < done:
            continue
        while s > done and _TOKEN_PART.match(t, s - 1):
            s -= 1
        while e < len(t) and _TOKEN_PART.match(t, e):
            e += 1
        while e > m.end() and t[e - 1] in "!|":
            e -= 1
        if any(c.isalpha() for c in t[s:e]):
            out += [t[done:s], t[s:e].translate(_SIGN_MAP)]
        else:
            out.append(t[done:e])
        done = e
    return "".join([*out, t[done:]]) if out else t


def sample_labels(labels: DataFrame, training, size: int = SAMPLE) -> DataFrame:
    """At most size labelled training rows: those with the smallest hash of their id. One row for an id."""
    rows = labels.where(training & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Of each label, one row of those whose least hash of three neighbouring words is the same: copies and most near copies of a
    text, which would make their whole vocabulary look typical of their label. The smallest doc_id stays. Rows of different
    labels never displace each other: a clean text with insults added is what the lexicon has to learn from."""
    words = F.split(F.lower("text"), r"\s+")
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice("_w", i, 3), " ")))
    rows = rows.withColumn("_w", words).withColumn("_s", F.array_min(triples))
    place = F.row_number().over(W.partitionBy("_s", F.col("toxic") > 0).orderBy("doc_id", "text"))  # at most SAMPLE rows in all
    return rows.withColumn("_p", place).where("_p = 1").drop("_w", "_s", "_p")


def _features(batches):
    """Document frequencies of a task: (kind, term, toxic, clean); kind w: word, p: beginning, b: pair of words, n: texts."""
    count: Counter = Counter()
    for b in small(batches):
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
            words = _WORD.findall(fold(text or ""))
            y = int(toxic > 0)
            own = set(words)
            count.update(("w", w, y) for w in own)
            count.update(("p", p, y) for p in {w[:n] for w in own for n in PREFIXES if len(w) > n})
            count[("n", "", y)] += 1
        if len(count) > 100_000:
            yield _rows(count)
            count = Counter()
    yield _rows(count)


def _rows(count: Counter) -> pa.RecordBatch:
    k = list(count)
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([x[0] for x in k], pa.string()), "term": pa.array([x[1] for x in k], pa.string()), "y": pa.array([x[2] for x in k], pa.int32()), "n": pa.array(list(count.values()), pa.int64())})


class Lexicon:
    """Entries {(term, whole): weight}, exception phrases, and the curve (intercept, raw, by length)."""

    def __init__(self, entries: dict[tuple[str, bool], float], exceptions: list[str] = (), curve: tuple[float, float, float] = (-4.0, 1.0, 1.0)):
        self.entries, self.exceptions, self.curve = entries, sorted(exceptions), curve
        self._automaton = None

    def __getstate__(self):
        return self.entries, self.exceptions, self.curve

    def __setstate__(self, s):
        self.entries, self.exceptions, self.curve = s
        self._automaton = None

    def automaton(self):
        if self._automaton is None:
            own: dict[str, list] = {}
            for (term, whole), w in self.entries.items():
                own.setdefault(term, []).append((whole, w))
            for phrase in self.exceptions:
                own.setdefault(phrase, []).append((None, 0.0))
            a = ahocorasick.Automaton()
            for term, what in own.items():
                a.add_word(term, (len(term), what))
            if own:
                a.make_automaton()
            self._automaton = a if own else False
        return self._automaton

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries that count in a folded text; of those that begin a word, the heaviest."""
        a = self.automaton()
        if not a:
            return []
        at: dict[int, tuple[int, float]] = {}
        spared = []
        n = len(folded)
        for last, (size, what) in a.iter(folded):
            start, end = last - size + 1, last + 1
            if start and folded[start - 1].isalnum():
                continue
            for whole, w in what:
                if whole is not False and end < n and folded[end].isalnum():
                    continue
                if whole is None:
                    spared.append((start, end))
                elif w > at.get(start, (0, 0.0))[1]:
                    at[start] = (end, w)
        return [(s, e, w) for s, (e, w) in sorted(at.items()) if not any(p <= s and e <= q for p, q in spared)]

    def raw(self, text: str) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, _, w in self.matches(folded))
        return (total, total / max(1.0, len(folded) / 6) ** 0.5) if total else (0.0, 0.0)

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.entries:
            return np.zeros(len(texts))
        b, u, v = self.curve
        x = np.array([self.raw(t) for t in texts]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(b + u * x[:, 0] + v * x[:, 1], -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton steps with a small ridge; slopes are not below 0."""
    a = np.c_[np.ones(len(x)), np.minimum(x, 50)]
    w = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([1e-3, 0.05, 0.05]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 0.05, 0.05])
        step = np.linalg.solve(h, g)
        w -= step
        if abs(step).max() < 1e-6:
            break
    if (w[1:] < 0).any():  # one feature then does the work
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, training, size: int = SAMPLE) -> Lexicon:
    """Learns from the sample of labelled rows; docs: doc_id, text; labels: doc_id, toxic; training: a condition on doc_id."""
    chosen = sample_labels(labels, training, size)  # at most size rows, so the broadcast is bounded
    rows = distinct_texts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")).persist()
    try:
        counts = rows.mapInArrow(_features, "kind string, term string, y int, n long").groupBy("kind", "term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("neg"))
        counts = counts.persist()
        total = counts.where("kind = 'n'").collect()
        pos, neg = (total[0].pos, total[0].neg) if total else (0, 0)
        if not pos or not neg:
            counts.unpersist()
            return Lexicon({})
        weight = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
        best = counts.where((F.col("kind") != "n") & (F.col("pos") >= max(MIN_DF, MIN_SHARE * pos))).withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT)
        found = best.orderBy(F.desc(F.col("w") * F.col("pos")), "kind", "term").limit(MAX_ENTRIES).collect()
        counts.unpersist()
        begin = {r.term: r for r in found if r.kind == "p"}
        entries: dict[tuple[str, bool], float] = {}
        for r in sorted(found, key=lambda r: (r.kind != "p", len(r.term), r.term)):
            shorter = [begin[r.term[:n]] for n in PREFIXES if n < len(r.term) + (r.kind == "w") and r.term[:n] in begin]
            if not any(s.w >= r.w - 0.7 for s in shorter):
                entries[(r.term, r.kind == "w")] = float(r.w)
        first = Lexicon(entries)

        def seen(batches):
            for b in small(batches):
                phrases: Counter = Counter()
                for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                    f = fold(text or "")
                    for s, e, _ in first.matches(f):
                        before, after = _WORD.findall(f[max(0, s - 40) : s]), _WORD.findall(f[s : e + 80])
                        if len(after) > 1:
                            phrases[(f"{after[0]} {after[1]}", int(toxic > 0))] += 1
                        if before and after:
                            phrases[(f"{before[-1]} {after[0]}", int(toxic > 0))] += 1
                yield _rows(Counter({("b", t, y): n for (t, y), n in phrases.items()}))

        pairs = rows.mapInArrow(seen, "kind string, term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum("n").alias("n"))
        spared = [r.term for r in pairs.where((F.col("pos") == 0) & (F.col("n") >= MIN_EXCEPTION)).orderBy(F.desc("n"), "term").limit(MAX_ENTRIES).collect()]
        lexicon = Lexicon(entries, spared)

        def features(batches):
            for b in small(batches):
                x = [lexicon.raw(t or "") for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"a": pa.array([v[0] for v in x], pa.float64()), "b": pa.array([v[1] for v in x], pa.float64()), "y": b.column("toxic").cast(pa.int32())})

        xy = rows.mapInArrow(features, "a double, b double, y int").toPandas()  # at most size rows
        lexicon.curve = fit_curve(xy[["a", "b"]].to_numpy(), (xy.y > 0).to_numpy(float))
        return lexicon
    finally:
        rows.unpersist()


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, text -> doc_id, score."""

    def run(batches):
        for b in small(batches):
            s = lexicon.scores([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.round(s, 6), pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """docs without the rows whose text scores at or above the threshold; all columns stay, and no row moves."""
    at = docs.columns.index("text")

    def run(batches):
        for b in small(batches):
            keep = lexicon.scores([t or "" for t in b.column(at).to_pylist()]) < threshold
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def not_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 != 0


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    lexicon = fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"), not_held_out())
    return score(docs, lexicon).select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
