"""Plan -> DataFrame, and the fluent form of the same plan."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AnalysisError
from ..functions import aggregates as A
from ..functions.expressions import Scope, condition, kind_of, translate
from ..operators import windows
from .language import Aggregate, Name, Plan, Projection, WindowSpec, parse, parse_expression

WINDOW_COLUMNS = ("__w_id", "__w_start", "__w_end", "__w_reason")


def time_columns(df: DataFrame) -> dict[str, str]:
    """Text fields marked as times -> the columns that hold their timestamps."""
    return {f.name: f.metadata["time_column"] for f in df.schema.fields if "time_column" in (f.metadata or {})}


def _usage(df: DataFrame, usage: str) -> list[str]:
    return [f.name for f in df.schema.fields if (f.metadata or {}).get("usage") == usage]


def compile_plan(plan: Plan, df: DataFrame, order_by: list[str] | None = None, keep_window: bool = False, assigned: bool = False) -> DataFrame:
    """Builds the DataFrame of a plan over its input.

    assigned: the rows have passed the first filter and bear their window's columns already, as from a stateful stream.

    order_by: the arrival order; without it, the field the window is based on and the fields marked as sequence. keep_window adds
    window_start and window_end. Output: projections, then the group fields in clause order."""
    spec = plan.window
    if spec is None or not plan.aggregates or not plan.projections:
        raise AnalysisError("a query needs a window, aggregates and projections")
    streaming = df.isStreaming
    derived = time_columns(df)
    scope = Scope(df.schema, derived)
    for g in plan.groups:
        scope.get(g)
    clash = {a.alias for a in plan.aggregates} | {p.alias for p in plan.projections}
    clash &= set(plan.groups)
    if clash:
        raise AnalysisError(f"{', '.join(sorted(clash))}: both a result and a group field")
    if plan.where is not None and not assigned:
        df = df.where(condition(plan.where, scope))
    time = spec.based_on
    if time is None and (spec.kind in ("slide", "gap") or spec.expire is not None):
        times = _usage(df, "time") or [n for n, (k, _) in scope.names.items() if k == "timestamp"]
        if len(times) != 1:
            raise AnalysisError("say which field the window is based on")
        time = times[0]
    if time is not None:
        scope.get(time)
    order = list(order_by or []) or [*([time] if time and scope.get(time)[0] in ("timestamp", "long") else []), *_usage(df, "sequence")]
    order = [derived.get(o, o) for o in order]
    if not assigned:
        df = _assign(df, plan, derived.get(time, time) if time else None, order, scope)
    out = _aggregate(df, plan, order, scope, streaming)
    names = Scope(out.select(*[f"`{a.alias}`" for a in plan.aggregates]).schema)
    if plan.having is not None:
        out = out.where(condition(plan.having, names))
    chosen, seen = [], set()
    for p in plan.projections:
        kind, c = translate(p.expression, names)
        if p.alias in seen:
            continue  # a name repeated in the clause is written once
        seen.add(p.alias)
        chosen.append(c.alias(p.alias))
    extra = [F.col("__w_start").alias("window_start"), F.col("__w_end").alias("window_end")] if keep_window else []
    out = out.select(*chosen, *[F.col(f"`{g}`") for g in plan.groups], *extra)
    if plan.project_where is not None:
        fields = [f for f in out.schema.fields if f.name in seen]
        out = out.where(condition(plan.project_where, Scope(type(out.schema)(fields))))
    return out


def _assign(df: DataFrame, plan: Plan, time: str | None, order: list[str], scope: Scope) -> DataFrame:
    spec = plan.window

    def ordered() -> list[str]:
        if not order:
            raise AnalysisError("this window needs an arrival order: pass order_by")
        return order

    match spec.kind:
        case "slice_time":
            if time is None:
                raise AnalysisError("a time slice without 'based on' is by processing time: run it on a stream")
            return windows.slice_time(df, time, spec.size, spec.boundary or "left")
        case "slice_range":
            if scope.get(spec.based_on)[0] != "long":
                raise AnalysisError(f"rows based on {spec.based_on}: not a whole number")
            return windows.slice_range(df, spec.based_on, spec.size, spec.boundary or "right")
        case "slice_rows":
            return windows.slice_rows(df, spec.size, ordered(), plan.groups, spec.per_group, spec.emit_incomplete)
        case "slide":
            return windows.slide(df, time, spec.size, spec.advance)
        case "gap":
            return windows.session_gap(df, time, spec.size, plan.groups)
        case "session":
            opened, closed = condition(spec.open, scope), condition(spec.close, scope)
            if spec.expire is not None:
                return windows.session_expire(df, opened, closed, spec.inclusive, time, spec.expire, ordered(), plan.groups, spec.expire_mode, spec.emit_incomplete)
            return windows.session(df, opened, closed, spec.inclusive, ordered(), plan.groups, spec.emit_incomplete)
    raise AnalysisError(f"unknown window {spec.kind}")


def _aggregate(df: DataFrame, plan: Plan, order: list[str], scope: Scope, streaming: bool) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    arrival = F.struct(*order) if order else None
    built: dict[str, tuple[str, Column]] = {}
    for a in plan.aggregates:
        if a.alias in built:
            raise AnalysisError(f"two aggregates are called {a.alias}")
        if a.function == "count" and a.argument and a.argument not in types:
            raise AnalysisError(f"unknown name {a.argument}")
        kind = x = None
        if a.argument and a.function not in ("count", "reason"):
            scope.get(a.argument)
            kind, x = kind_of(types[a.argument]), F.col(f"`{a.argument}`")
        built[a.alias] = (a.function, A.column(a.function, a.argument, kind, x, arrival, plan.groups, streaming).alias(a.alias))
    across = plan.window.kind == "slice_rows" and not plan.window.per_group
    keys = [c for c in WINDOW_COLUMNS if c != "__w_reason"]
    if across:  # batches run across groups; their group fields are those of the first row
        for g in plan.groups:
            built[g] = ("first", F.min_by(F.col(f"`{g}`"), arrival).alias(g))
    else:
        keys += [f"`{g}`" for g in plan.groups]
    apart = [c for f, c in built.values() if f in A.APART and not streaming]
    rest = [c for f, c in built.values() if not (f in A.APART and not streaming)]
    if not apart or not rest:
        return df.groupBy(*keys).agg(*(rest or apart))
    # exact distinct counts expand rows by value; kept apart so that sketches aren't held once for each value
    right = df.groupBy(*keys).agg(*apart)
    left = df.groupBy(*keys).agg(*rest)
    plain = [k.strip("`") for k in keys]
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in plain})
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__r_{k}`")) for k in plain]
    return left.join(renamed, on).drop(*[f"__r_{k}" for k in plain])


class Query:
    """The fluent form: Query.from_("events").group_by("k").where("v > 0").slice("1 minutes", on="ts").aggregate(n="count()")
    .having("n > 1").append("n").to("out")."""

    def __init__(self, plan: Plan):
        self.plan = plan

    @classmethod
    def from_(cls, table: str) -> "Query":
        return cls(Plan(table))

    @classmethod
    def parse(cls, text: str, **window) -> "Query":
        """From text; window: options that the language has no words for, such as boundary or emit_incomplete."""
        plan = parse(text)
        return cls(dataclasses.replace(plan, window=dataclasses.replace(plan.window, **window)) if window else plan)

    def _with(self, **changes) -> "Query":
        return Query(dataclasses.replace(self.plan, **changes))

    def group_by(self, *names: str) -> "Query":
        return self._with(groups=tuple(names))

    def where(self, text: str) -> "Query":
        """Before the window; after append(), on the projected names."""
        return self._with(project_where=parse_expression(text)) if self.plan.projections else self._with(where=parse_expression(text))

    def _window(self, text: str, **options) -> "Query":
        from .language import Parser

        return self._with(window=dataclasses.replace(Parser(text).window(), **options))

    def slice(self, size: str, on: str | None = None, **options) -> "Query":
        return self._window(f"slice {size}" + (f" based on {on}" if on else ""), **options)

    def slide(self, size: str, every: str, on: str | None = None) -> "Query":
        return self._window(f"slide {size} advance every {every}" + (f" based on {on}" if on else ""))

    def session(self, begin: str, end: str, inclusive: bool = True, expire: str | None = None, on: str | None = None, **options) -> "Query":
        return self._window(f"session begin when {begin} end when {end} {'inclusive' if inclusive else 'exclusive'}" + (f" expire after {expire}" if expire else "") + (f" based on {on}" if on else ""), **options)

    def gap(self, pause: str, on: str | None = None) -> "Query":
        from .language import Parser

        return self._with(window=WindowSpec("gap", Parser(pause).duration(), based_on=on))

    def aggregate(self, **calls: str) -> "Query":
        """alias="function(argument)"."""
        from .language import Parser

        made = [Parser(f"{call} as {alias}").aggregate() for alias, call in calls.items()]
        return self._with(aggregates=(*self.plan.aggregates, *made))

    def having(self, text: str) -> "Query":
        return self._with(having=parse_expression(text))

    def append(self, *names: str, **expressions: str) -> "Query":
        made = [Projection(Name(n), n) for n in names] + [Projection(parse_expression(t), n) for n, t in expressions.items()]
        return self._with(projections=(*self.plan.projections, *made))

    def to(self, table: str) -> "Query":
        return self._with(sink=table)

    def run(self, df: DataFrame | None = None, spark: SparkSession | None = None, order_by: list[str] | None = None, keep_window: bool = False) -> DataFrame:
        """The result; df: the input, else the view that bears the source's name. The result is registered under the sink's name."""
        if df is None:
            spark = spark or SparkSession.active()
            df = spark.table(self.plan.source.replace(".", "_"))
        out = compile_plan(self.plan, df, order_by, keep_window)
        if self.plan.sink and not out.isStreaming:
            out.createOrReplaceTempView(self.plan.sink.replace(".", "_"))
        return out


__all__ = ["Aggregate", "Query", "compile_plan"]
