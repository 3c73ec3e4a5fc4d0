"""Window assignment: df -> df with __w_id, __w_start, __w_end and __w_reason. Aggregation then is one code path.

Only sequences need an order: row batches are numbered by range partitions and their counts; sessions and gaps use SQL windows over
their keys, or, without keys, over range partitions that start with the state that those before them leave. Nothing but one row
per partition, or per distinct bucket, comes to one place; only a growing window without keys and an expiring session without
keys are one sequence in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError

#: windows are aligned to 0001-01-01T00:00:00Z; Spark aligns to 1970
ZERO_MS = -62_135_596_800_000


def offset_ms(size_ms: int) -> int:
    return ZERO_MS % size_ms


def _with(df: DataFrame, ident: Column, start: Column, end: Column, reason: str) -> DataFrame:
    return df.withColumns({"__w_id": ident, "__w_start": start, "__w_end": end, "__w_reason": F.lit(reason)})


def slice_time(df: DataFrame, time: str, size_ms: int, boundary: str = "left") -> DataFrame:
    """Tumbling windows. left: [lo, hi); right: (lo, hi]; sticky: a row at hi joins the window before if that is open."""
    if size_ms <= 0:
        raise AnalysisError("a window needs a positive length")
    if boundary == "sticky":
        return _sticky_time(df, time, size_ms)
    if boundary not in ("left", "right"):
        raise AnalysisError(f"unknown boundary {boundary}")
    t = F.col(time) if boundary == "left" else F.col(time) - F.expr("INTERVAL 0.000001 SECOND")
    # the window itself is the key: on a stream it carries the watermark
    df = df.withColumn("__w_id", F.window(t, f"{size_ms} milliseconds", None, f"{offset_ms(size_ms)} milliseconds"))
    return df.withColumns({"__w_start": F.col("__w_id.start"), "__w_end": F.col("__w_id.end"), "__w_reason": F.lit("interval")})


def _absorbing(buckets: DataFrame) -> DataFrame:
    """k, interior -> k of the buckets that take in a row at their upper end.

    A(k) holds if the bucket has a row inside or follows a gap; else it is the opposite of A(k - 1). One row per distinct
    bucket takes part, never the rows themselves."""
    w = W.orderBy("k")
    anchor = F.col("interior") | (F.coalesce(F.lag("k").over(w), F.col("k") - 2) != F.col("k") - 1)
    marked = buckets.withColumn("at", F.when(anchor, F.col("k"))).withColumn("at", F.max("at").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return marked.where(F.pmod(F.col("k") - F.col("at"), F.lit(2)) == 0).select((F.col("k") + 1).alias("__k"), F.lit(True).alias("__absorbed"))


def _sticky(df: DataFrame, position: Column, size: Column, least: Column) -> DataFrame:
    """Adds __b, the bucket of a whole-number position under the sticky rule; rows that are not least are bucket -1."""
    df = df.withColumn("__p", position).withColumn("__k", F.floor((F.col("__p") - F.pmod("__p", size)) / size).cast("long"))
    df = df.withColumn("__edge", (F.pmod("__p", size) == 0) & least)
    buckets = df.where(least).groupBy(F.col("__k").alias("k")).agg(F.max(~F.col("__edge")).alias("interior"))
    df = df.join(_absorbing(buckets), "__k", "left")
    return df.withColumn("__b", F.when(F.col("__edge") & F.coalesce("__absorbed", F.lit(False)), F.col("__k") - 1).otherwise(F.col("__k"))).drop("__absorbed", "__edge", "__p", "__k")


def _sticky_time(df: DataFrame, time: str, size_ms: int) -> DataFrame:
    micros = F.unix_micros(F.col(time).cast("timestamp")) - F.lit(ZERO_MS * 1000)
    df = _sticky(df.where(F.col(time).isNotNull()), micros, F.lit(size_ms * 1000).cast("long"), F.lit(True))
    start = F.timestamp_micros(F.col("__b") * (size_ms * 1000) + F.lit(ZERO_MS * 1000))
    end = F.timestamp_micros((F.col("__b") + 1) * (size_ms * 1000) + F.lit(ZERO_MS * 1000))
    return _with(df, F.col("__b"), start, end, "interval").drop("__b")


def slice_range(df: DataFrame, field: str, size: int, boundary: str = "right") -> DataFrame:
    """Ranges of a whole-number field. right: (lo, hi], so that ids from 1 fall in batches of size; left: [lo, hi); sticky: all
    values up to 0 are one window, and a value at hi joins the window before if that is open."""
    if size <= 0:
        raise AnalysisError("a window needs a positive length")
    n = F.lit(size).cast("long")
    x = F.col(field).cast("long")
    if boundary == "sticky":
        df = _sticky(df.where(x.isNotNull()), x, n, x > 0).withColumn("__b", F.when(F.col(field) <= 0, F.lit(-1)).otherwise(F.col("__b")))
    elif boundary in ("left", "right"):
        y = x - 1 if boundary == "right" else x
        df = df.where(x.isNotNull()).withColumn("__b", F.call_function("div", y - F.pmod(y, n), n))
    else:
        raise AnalysisError(f"unknown boundary {boundary}")
    return _with(df, F.col("__b"), F.col("__b") * n, (F.col("__b") + 1) * n, "interval").drop("__b")


def _spread(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows in range partitions of the order, each sorted, with __part, their number, and __place, the place in it from 0.

    Kept on disk so that all readers see the same partitions; a lost part is computed again from the same shuffle."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()).persist()
    return spread.withColumns({"__part": F.shiftright("__id", 33).cast("int"), "__place": F.col("__id").bitwiseAND((1 << 33) - 1)}).drop("__id")


def _carried(df: DataFrame, value: Column, start: int, step) -> tuple[Column, int]:
    """(what each partition starts with, what the last one ends with): value aggregates a partition, step folds it into the state.

    The driver sees one row a partition."""
    found = {r.p: r.v for r in df.groupBy(F.col("__part").alias("p")).agg(value.alias("v")).collect()}
    before, state = [], start
    for p in range(max(found, default=-1) + 1):
        before.append(state)
        if found.get(p) is not None:
            state = step(state, found[p])
    return F.get(F.array(*[F.lit(v).cast("long") for v in before or [start]]), F.col("__part")), state


def numbered(df: DataFrame, order: list[str], name: str = "__n") -> DataFrame:
    """Adds the row's place, from 0, in the total order. Range partitions are sorted on their own; the driver sees one count
    for each of them."""
    spread = _spread(df, order)
    base, _ = _carried(spread, F.count(F.lit(1)), 0, int.__add__)
    return spread.withColumn(name, F.col("__place") + base).drop("__part", "__place")


def slice_rows(df: DataFrame, size: int, order: list[str], groups: tuple[str, ...] = (), per_group: bool = False, emit_incomplete: bool = False) -> DataFrame:
    """Batches of size rows in arrival order. Without per_group a batch runs across groups. Partial batches only on demand."""
    if size <= 0:
        raise AnalysisError("a window needs a positive length")
    if per_group and groups:
        df = df.withColumn("__n", F.row_number().over(W.partitionBy(*groups).orderBy(*order)).cast("long") - 1)
        full = F.count(F.lit(1)).over(W.partitionBy(*groups, F.floor(F.col("__n") / size)))
    else:
        df = numbered(df, order)
        full = F.count(F.lit(1)).over(W.partitionBy(F.floor(F.col("__n") / size)))
    df = df.withColumn("__full", full).withColumn("__b", F.call_function("div", F.col("__n"), F.lit(size).cast("long")))
    if not emit_incomplete:
        df = df.where(F.col("__full") == size)
    reason = F.when(F.col("__full") == size, "rows").otherwise("end")
    return df.withColumns({"__w_id": F.col("__b"), "__w_start": F.col("__b") * size, "__w_end": (F.col("__b") + 1) * size, "__w_reason": reason}).drop("__n", "__b", "__full")


def slide(df: DataFrame, time: str, size_ms: int, advance_ms: int) -> DataFrame:
    """Overlapping windows of size, one begun every advance."""
    if advance_ms <= 0 or size_ms < advance_ms:
        raise AnalysisError("a sliding window needs 0 < advance <= length")
    df = df.withColumn("__w_id", F.window(time, f"{size_ms} milliseconds", f"{advance_ms} milliseconds", f"{offset_ms(advance_ms)} milliseconds"))
    return df.withColumns({"__w_start": F.col("__w_id.start"), "__w_end": F.col("__w_id.end"), "__w_reason": F.lit("interval")})


def session(df: DataFrame, opened: Column, closed: Column, inclusive: bool, order: list[str], groups: tuple[str, ...], emit_incomplete: bool = False) -> DataFrame:
    """Sessions between an opening and a closing condition, per group, in closed form.

    Each row's effect on the state is constant (open, close) or none, so the state after a row is the last effect before it. A
    closing row is tested anew and may open the next session: such a row can belong to two."""
    df = df.withColumns({"__o": F.coalesce(opened, F.lit(False)), "__c": F.coalesce(closed, F.lit(False))})
    effect = F.when(F.col("__o"), 1).when(F.col("__c"), 0)
    was_open = first_sid = F.lit(0)
    if not groups:  # one sequence: range partitions, each with the state that the ones before it leave
        df = _spread(df, order)
        was_open, _ = _carried(df, F.max_by(effect, F.when(effect.isNotNull(), F.col("__place"))), 0, lambda _, last: last)
        w = W.partitionBy("__part").orderBy("__place")
    else:
        w = W.partitionBy(*groups).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("__after", F.last(effect, ignorenulls=True).over(upto))
    df = df.withColumn("__open", F.coalesce(F.lag("__after").over(w), was_open) == 1)
    df = df.withColumn("__starts", F.col("__o") & (~F.col("__open") | F.col("__c")))
    if not groups:
        first_sid, _ = _carried(df, F.sum(F.col("__starts").cast("long")), 0, int.__add__)
    df = df.withColumn("__sid", F.sum(F.col("__starts").cast("long")).over(upto) + first_sid)
    earlier = F.col("__sid") - F.col("__starts").cast("long")
    ended = F.max(F.when(F.col("__open") & F.col("__c"), earlier))
    if groups:
        df = df.withColumn("__done", ended.over(W.partitionBy(*groups).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    else:
        df = df.withColumn("__done", F.lit(df.agg(ended.alias("d")).first().d).cast("long"))
    member = F.col("__open") & (~F.col("__c") | F.lit(inclusive))
    ids = F.array_compact(F.array(F.when(member, earlier), F.when(F.col("__starts"), F.col("__sid"))))
    df = df.withColumn("__w_id", F.explode(ids))
    complete = F.coalesce(F.col("__w_id") <= F.col("__done"), F.lit(False))
    df = df.withColumn("__w_reason", F.when(complete, "close").otherwise("end"))
    if not emit_incomplete:
        df = df.where(complete)
    return df.withColumns({"__w_start": F.col("__w_id"), "__w_end": F.col("__w_id")}).drop("__o", "__c", "__after", "__open", "__starts", "__sid", "__done", "__part", "__place")


def session_expire(df: DataFrame, opened: Column, closed: Column, inclusive: bool, time: str, expire_ms: int, order: list[str], groups: tuple[str, ...], mode: str = "life", emit_incomplete: bool = False) -> DataFrame:
    """Sessions that also end when a row comes later than expire after the opening (life) or after the last row (idle).

    The row that finds the session expired isn't in it; it is tested anew. Rows without a time are left out. Rows are sorted by group
    and order and pass through a small automaton once, so memory doesn't depend on the size of a group; how a session ended
    comes to its rows by a window over (group, session)."""
    if mode not in ("life", "idle"):
        raise AnalysisError(f"unknown expiry {mode}")
    key = F.xxhash64(*groups) if groups else F.lit(0).cast("long")
    df = df.where(F.col(time).isNotNull())
    df = df.withColumns({"__o": F.coalesce(opened, F.lit(False)), "__c": F.coalesce(closed, F.lit(False)), "__t": F.unix_micros(F.col(time).cast("timestamp")), "__g": key, "__gk": F.to_json(F.struct(*groups)) if groups else F.lit("")})
    schema = T.StructType([*df.schema.fields, T.StructField("__w_id", T.LongType()), T.StructField("__why", T.StringType())])
    limit = expire_ms * 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, sid, is_open, since = None, 0, False, 0
        for pdf in batches:
            rows, ids, why = [], [], []  # a row of a session, or, with a reason, the news that the session ended
            for k, (g, o, c, t) in enumerate(zip(pdf["__gk"], pdf["__o"], pdf["__c"], pdf["__t"])):
                if g != group:
                    group, sid, is_open = g, 0, False
                if is_open and t - since > limit:
                    is_open = False
                    rows.append(k), ids.append(sid), why.append("expire")
                if is_open:
                    if not c or inclusive:
                        rows.append(k), ids.append(sid), why.append(None)
                    if mode == "idle":
                        since = t
                    if c:
                        is_open = False
                        rows.append(k), ids.append(sid), why.append("close")
                if not is_open and o:
                    sid, is_open, since = sid + 1, True, t
                    rows.append(k), ids.append(sid), why.append(None)
            out = pdf.iloc[rows].copy()
            out["__w_id"], out["__why"] = pd.array(ids, "int64"), why
            yield out

    done = df.repartition("__g").sortWithinPartitions("__g", "__gk", *order).mapInPandas(run, schema)
    done = done.withColumn("__w_reason", F.max("__why").over(W.partitionBy("__g", "__gk", "__w_id")))
    rows = done.where(F.col("__why").isNull())
    rows = rows.withColumn("__w_reason", F.coalesce("__w_reason", F.lit("end"))) if emit_incomplete else rows.where(F.col("__w_reason").isNotNull())
    return rows.withColumns({"__w_start": F.col("__w_id"), "__w_end": F.col("__w_id")}).drop("__o", "__c", "__t", "__g", "__gk", "__why")


def session_gap(df: DataFrame, time: str, gap_ms: int, groups: tuple[str, ...]) -> DataFrame:
    """Sessions that a pause of at least gap ends, per group."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    before = base = F.lit(None).cast("long")
    if groups:
        w = W.partitionBy(*groups).orderBy(time)
    else:  # rows of one time are in one partition
        df = _spread(df, [time])
        before, _ = _carried(df, F.max(micros), None, lambda state, last: last)
        w = W.partitionBy("__part").orderBy(time)
    new = F.coalesce(micros - F.coalesce(F.lag(micros).over(w), before) >= gap_ms * 1000, F.lit(True)).cast("long")
    df = df.withColumn("__new", new)
    if not groups:
        base, _ = _carried(df, F.sum("__new"), 0, int.__add__)
    ident = F.sum("__new").over(w.rangeBetween(W.unboundedPreceding, 0)) + F.coalesce(base, F.lit(0))
    return _with(df, ident, ident, ident, "expire").drop("__new", "__part", "__place")


def growing(df: DataFrame, aggregates: dict[str, Column], order: list[str], groups: tuple[str, ...]) -> DataFrame:
    """A window that starts at a group's first row and ends at each row in turn: running aggregates."""
    w = (W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({name: c.over(w) for name, c in aggregates.items()})
