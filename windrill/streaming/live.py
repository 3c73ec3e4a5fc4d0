"""The same queries on live input, by Structured Streaming.

Event-time slices and slides are watermarked aggregations; a slice without "based on" is a micro-batch per interval; row batches
and sessions (with expiry by event-time or never) keep their state in the state store, per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..errors import AnalysisError
from ..functions.expressions import Scope, condition
from ..plans.compiler import compile_plan, time_columns
from ..plans.language import Plan, WindowSpec


def event_time(plan: Plan, stream: DataFrame, lateness: str = "0 seconds", order_by: list[str] | None = None) -> DataFrame:
    """slice and slide based on a time: rows later than lateness are dropped; a window is emitted once the watermark passes it."""
    if plan.window.kind not in ("slice_time", "slide") or not plan.window.based_on:
        raise AnalysisError("event_time needs a slice or slide based on a time")
    if plan.window.boundary == "sticky":
        raise AnalysisError("a sticky boundary needs bounded input")
    t = time_columns(stream).get(plan.window.based_on, plan.window.based_on)
    return compile_plan(plan, stream.withWatermark(t, lateness), order_by, keep_window=True)


def processing_time(plan: Plan, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, order_by: list[str] | None = None, available_now: bool = False) -> StreamingQuery:
    """slice without "based on": each interval's arrivals are one window. An empty interval gives no row and doesn't end anything."""
    if plan.window.kind != "slice_time" or plan.window.based_on:
        raise AnalysisError("processing_time needs a slice without 'based on'")

    def batch(df: DataFrame, number: int) -> None:
        if df.isEmpty():
            return
        order = order_by or ["__arrival"]
        df = df.withColumn("__arrival", F.monotonically_increasing_id()).withColumn("arrival_window", F.lit(number).cast("long"))
        own = Plan(plan.source, plan.groups, plan.where, WindowSpec("slice_range", 1, based_on="arrival_window"), plan.aggregates, plan.having, plan.projections, plan.project_where, plan.sink)
        sink(compile_plan(own, df, order), number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=f"{plan.window.size} milliseconds")
    return writer.start()


class _Sessions(StatefulProcessor):
    """One key's session automaton; rows of complete sessions come out with their session's number and reason."""

    def __init__(self, schema: T.StructType, inclusive: bool, expire_us: int | None, mode: str, order: list[str]):
        self.schema, self.inclusive, self.expire_us, self.mode, self.order = schema, inclusive, expire_us, mode, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mark = handle.getValueState("mark", "sid long, open boolean, since long")
        self.rows = handle.getListState("rows", self.schema)

    def _emit(self, sid: int, reason: str) -> pd.DataFrame:
        held = [tuple(r) for r in self.rows.get()]
        self.rows.clear()
        out = pd.DataFrame(held, columns=self.schema.names)
        return out.assign(__w_id=sid, __w_reason=reason)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        sid, is_open, since = tuple(self.mark.get()) if self.mark.exists() else (0, False, 0)
        every = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for r in every[self.schema.names].itertuples(index=False, name=None):
            o, c, t = (r[self.schema.names.index(n)] for n in ("window_opens", "window_closes", "window_micros"))
            t = int(t)
            if is_open and self.expire_us is not None and t - since > self.expire_us:
                is_open = False
                yield self._emit(sid, "expire")
            if is_open:
                if not c or self.inclusive:
                    self.rows.appendValue(r)
                if self.mode == "idle":
                    since = t
                if c:
                    is_open = False
                    yield self._emit(sid, "close")
            if not is_open and o:
                sid, is_open, since = sid + 1, True, t
                self.rows.appendValue(r)
        self.mark.update((int(sid), bool(is_open), int(since)))
        if self.expire_us is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if is_open:
                self.handle.registerTimer((since + self.expire_us) // 1000 + 1)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        sid, is_open, since = tuple(self.mark.get()) if self.mark.exists() else (0, False, 0)
        if is_open:
            self.mark.update((int(sid), False, int(since)))
            yield self._emit(sid, "expire")

    def close(self) -> None:
        pass


class _Batches(StatefulProcessor):
    """One key's row batches: every size rows come out together."""

    def __init__(self, schema: T.StructType, size: int, order: list[str]):
        self.schema, self.size, self.order = schema, size, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "batch long, held long")
        self.rows = handle.getListState("rows", self.schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch, held = tuple(self.count.get()) if self.count.exists() else (0, 0)
        every = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        for r in every[self.schema.names].itertuples(index=False, name=None):
            self.rows.appendValue(r)
            held += 1
            if held == self.size:
                full = pd.DataFrame([tuple(x) for x in self.rows.get()], columns=self.schema.names)
                self.rows.clear()
                yield full.assign(__w_id=batch, __w_reason="rows")
                batch, held = batch + 1, 0
        self.count.update((int(batch), int(held)))

    def close(self) -> None:
        pass


def stateful_rows(plan: Plan, stream: DataFrame, order_by: list[str], lateness: str = "0 seconds") -> DataFrame:
    """session and slice-rows windows: the member rows of complete windows, with __w_id and __w_reason.

    Aggregating them is a second step (aggregate_rows), in a foreachBatch: a window's rows come out in one batch. Needs the
    RocksDB state store. Order holds within a micro-batch and between micro-batches."""
    spec = plan.window
    scope = Scope(stream.schema, time_columns(stream))
    if plan.where is not None:
        stream = stream.where(condition(plan.where, scope))
    if spec.kind == "session":
        t = time_columns(stream).get(spec.based_on, spec.based_on)
        if spec.expire is not None:
            stream = stream.withWatermark(t, lateness)
        stream = stream.withColumns({"window_opens": F.coalesce(condition(spec.open, scope), F.lit(False)), "window_closes": F.coalesce(condition(spec.close, scope), F.lit(False)), "window_micros": F.unix_micros(F.col(t).cast("timestamp")) if t else F.lit(0).cast("long")})
    elif spec.kind != "slice_rows":
        raise AnalysisError("stateful_rows needs a session or a slice of rows")
    groups = list(plan.groups) if spec.kind == "session" or spec.per_group else []
    stream = stream.withColumn("__key", F.to_json(F.struct(*groups)) if groups else F.lit(""))
    schema = T.StructType([f for f in stream.schema.fields if f.name != "__key"])
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema.fields], T.StructField("__w_id", T.LongType()), T.StructField("__w_reason", T.StringType())])
    timed = spec.kind == "session" and spec.expire is not None
    processor = _Sessions(schema, spec.inclusive, spec.expire * 1000 if timed else None, spec.expire_mode, order_by) if spec.kind == "session" else _Batches(schema, spec.size, order_by)
    return stream.groupBy("__key").transformWithStateInPandas(processor, out, "Append", "EventTime" if timed else "None")


def aggregate_rows(plan: Plan, rows: DataFrame, order_by: list[str]) -> DataFrame:
    """The aggregates, filters and projections of a plan over the rows that stateful_rows gave, in a batch. Windows keep their
    reasons, and row batches across groups take the first row's group fields, as on bounded input."""
    rows = rows.drop("window_opens", "window_closes", "window_micros", "__key").withColumns({"__w_start": F.col("__w_id"), "__w_end": F.col("__w_id")})
    return compile_plan(plan, rows, order_by, assigned=True)


__all__ = ["aggregate_rows", "event_time", "processing_time", "stateful_rows"]
