"""Aggregate functions by name. Each becomes a Column aggregate, so Spark combines partial results before the shuffle.

User functions are registered by name: a callable from a Column to an aggregate Column, also a grouped Pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AnalysisError

#: registers of a distinct-count sketch are 2^LG_K: relative error 1.04 / sqrt(2^LG_K)
LG_K = 17
CMS = (0.001, 0.99, 42)

USER: dict[str, Callable[[Column], Column]] = {}
NUMERIC = ("long", "double")
KNOWN = ("avg", "mean", "count", "sum", "first", "last", "min", "max", "distinctcount", "uniq", "hll", "group", "reason", "cms")
#: exact distinct counts expand the input by value; kept apart from all others
APART = ("distinctcount",)


def register(name: str, function: Callable[[Column], Column]) -> None:
    if name in KNOWN:
        raise AnalysisError(f"{name} is built in")
    USER[name] = function


def column(function: str, argument: str | None, kind: str | None, x: Column | None, order: Column | None, groups: tuple[str, ...], streaming: bool = False) -> Column:
    """The aggregate Column. order: a struct that rises in arrival order; kind: the argument's type."""

    def numeric() -> Column:
        if kind not in NUMERIC:
            raise AnalysisError(f"{function}({argument}) needs a number, not {kind}")
        return x

    if function not in ("count", "reason") and x is None:
        raise AnalysisError(f"{function}() needs an argument")
    match function:
        case "avg" | "mean":
            return F.avg(numeric().cast("double"))
        case "count":
            return F.count(F.lit(1))
        case "sum":
            return F.sum(numeric())
        case "min":
            return F.min(x)
        case "max":
            return F.max(x)
        case "first" | "last":
            if order is None:
                raise AnalysisError(f"{function}() needs an arrival order")
            return F.min_by(x, order) if function == "first" else F.max_by(x, order)
        case "distinctcount":
            # a stream can't expand by value; NULL doesn't count in either
            return F.size(F.collect_set(x)).cast("long") if streaming else F.count_distinct(x)
        case "uniq" | "hll":
            return F.hll_sketch_estimate(F.hll_sketch_agg(x if kind in ("long", "text") else x.cast("string"), F.lit(LG_K)))
        case "group":
            if argument not in groups:
                raise AnalysisError(f"group({argument}): {argument} is no group field")
            return F.min(x)
        case "reason":
            return F.min(F.col("__w_reason"))
        case "cms":
            eps, confidence, seed = CMS
            return F.count_min_sketch(x if kind in ("long", "text") else x.cast("string"), F.lit(eps), F.lit(confidence), F.lit(seed))
    if function in USER:
        return USER[function](x)
    raise AnalysisError(f"unknown aggregate {function}")
