"""Typed translation of expressions to Columns; everything stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AnalysisError
from ..plans.language import Binary, Call, Literal, Name, Not

_COMPARE = {"<": "__lt__", "<=": "__le__", "==": "__eq__", "!=": "__ne__", ">=": "__ge__", ">": "__gt__"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return "text"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(t, T.DayTimeIntervalType):
        return "duration"
    return t.simpleString()


def duration(ms: int) -> Column:
    return F.expr(f"make_dt_interval(0, 0, 0, {ms // 1000}.{ms % 1000:03d})")


class Scope:
    """The names that an expression may use: name -> (kind, Column)."""

    def __init__(self, schema: T.StructType, derived: dict[str, str] | None = None):
        self.names = {f.name: (kind_of(f.dataType), F.col(f"`{f.name}`")) for f in schema.fields if not f.name.startswith("__")}
        for name, column in (derived or {}).items():  # text fields whose time is in another column
            self.names[name] = ("timestamp", F.col(f"`{column}`"))

    def get(self, name: str) -> tuple[str, Column]:
        if name not in self.names:
            raise AnalysisError(f"unknown name {name}; there are {', '.join(sorted(self.names))}")
        return self.names[name]


def translate(e, scope: Scope) -> tuple[str, Column]:
    """(kind, Column)."""
    match e:
        case Literal(value, "timestamp"):
            return "timestamp", F.to_timestamp(F.lit(value))
        case Literal(value, "duration"):
            return "duration", duration(value)
        case Literal(value, "long"):
            return "long", F.lit(value).cast("long")
        case Literal(value, kind):
            return kind, F.lit(value)
        case Name(name):
            return scope.get(name)
        case Not(inner):
            kind, c = translate(inner, scope)
            if kind != "boolean":
                raise AnalysisError("not needs a condition")
            return "boolean", ~c
        case Call("seconds", (inner,)):
            return seconds(inner, scope)
        case Call(name, _):
            raise AnalysisError(f"unknown function {name}")
        case Binary(op, left, right):
            return binary(op, translate(left, scope), translate(right, scope))
    raise AnalysisError(f"not an expression: {e!r}")


def seconds(inner, scope: Scope) -> tuple[str, Column]:
    """Whole seconds of a duration, or of the difference of two times (also where they are text)."""
    if isinstance(inner, Binary) and inner.op == "-":
        (a, x), (b, y) = translate(inner.left, scope), translate(inner.right, scope)
        if {a, b} <= {"timestamp", "text"}:
            micros = F.unix_micros(x.cast("timestamp")) - F.unix_micros(y.cast("timestamp"))
            return "long", F.call_function("div", micros, F.lit(1_000_000))
    kind, c = translate(inner, scope)
    if kind != "duration":
        raise AnalysisError("seconds() needs a duration")
    return "long", F.extract(F.lit("DAY"), c) * 86400 + F.extract(F.lit("HOUR"), c) * 3600 + F.extract(F.lit("MINUTE"), c) * 60 + F.floor(F.extract(F.lit("SECOND"), c))


def binary(op: str, left: tuple[str, Column], right: tuple[str, Column]) -> tuple[str, Column]:
    (a, x), (b, y) = left, right
    numeric = {"long", "double"}
    if op in ("and", "or"):
        if a != "boolean" or b != "boolean":
            raise AnalysisError(f"{op} needs two conditions")
        return "boolean", x & y if op == "and" else x | y
    if op in _COMPARE:
        if a == "text" and b == "timestamp":
            x = x.cast("timestamp")
        elif a == "timestamp" and b == "text":
            y = y.cast("timestamp")
        elif a != b and not {a, b} <= numeric:
            raise AnalysisError(f"{a} {op} {b}: the types differ")
        return "boolean", getattr(x, _COMPARE[op])(y)
    if {a, b} <= numeric:
        kind = "long" if a == b == "long" else "double"
        if op == "/":
            # whole numbers divide to whole numbers, toward zero
            return kind, F.call_function("div", x.cast("long"), y.cast("long")) if kind == "long" else x / y
        if op == "%" and kind != "long":
            raise AnalysisError("% needs whole numbers")
        return kind, {"+": x + y, "-": x - y, "*": x * y, "%": x % y}[op] if op != "%" else x % y
    if op in "+-":
        if a == "timestamp" and b == "duration":
            return "timestamp", x + y if op == "+" else x - y
        if a == "duration" and b == "timestamp" and op == "+":
            return "timestamp", y + x
        if a == b == "duration":
            return "duration", x + y if op == "+" else x - y
        if a == b == "timestamp" and op == "-":
            return "duration", x - y
    raise AnalysisError(f"{a} {op} {b} has no meaning")


def condition(e, scope: Scope) -> Column:
    kind, c = translate(e, scope)
    if kind != "boolean":
        raise AnalysisError("where needs a condition")
    return c
