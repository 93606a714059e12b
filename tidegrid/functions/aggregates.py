"""Aggregates: of grid cells (blank cells and text that is no number are left out), and of expressions (null counts as 0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions import values as V
from tidegrid.functions.values import Typed

ALIASES = {"mean": "avg", "stddev": "stdev", "distinctCount": "distinct_count"}
GRID = ("sum", "avg", "min", "max", "count", "distinct_count", "median", "stdev", "variance", "first", "last", "weightedAvg")


class AggregateError(ValueError):
    """An aggregate that is not known, or lacks a weight."""


def canonical(fn: str) -> str:
    fn = ALIASES.get(fn, fn)
    if fn not in GRID:
        raise AggregateError(f"unknown aggregate {fn!r}")
    return fn


def grid(fn: str, t: Typed, weight: Typed | None = None, order: Column | None = None) -> Column:
    """A grid aggregate. `count` counts rows; `first` and `last` go by `order`."""
    x = V.numeric_cell(t)
    match canonical(fn):
        case "sum":
            return F.coalesce(F.sum(x), F.lit(0.0))
        case "avg":
            return F.avg(x)
        case "min":
            return F.min(x)
        case "max":
            return F.max(x)
        case "count":
            return F.count(F.lit(1))
        case "distinct_count":
            return F.count_distinct(F.nullif(t.column, F.lit("")) if t.kind == "str" else t.column)
        case "median":
            return F.median(x)
        case "stdev":
            return F.stddev_samp(x)
        case "variance":
            return F.var_samp(x)
        case "first":
            return F.min_by(t.column, order) if order is not None else F.first(t.column)
        case "last":
            return F.max_by(t.column, order) if order is not None else F.last(t.column)
        case _:
            if weight is None:
                raise AggregateError("weightedAvg without a weight")
            w = V.numeric_cell(weight)
            finite = x.isNotNull() & w.isNotNull() & (F.abs(x) != V.INFINITY) & (F.abs(w) != V.INFINITY)
            total = F.sum(F.when(finite, w))
            return F.when(total != 0, F.sum(F.when(finite, x * w)) / F.when(total != 0, total))


def expression(fn: str, t: Typed) -> Column:
    """An aggregate inside an expression: every value as a number, null and other text as 0; of no rows 0."""
    x = V.number(t, 0.0, 0.0)
    zero = F.lit(0.0)
    odd = F.coalesce(F.bool_or(F.isnan(x)), F.lit(False))
    match ALIASES.get(fn, fn):
        case "sum":
            return F.coalesce(F.sum(x), zero)
        case "avg":
            return F.coalesce(F.avg(x), zero)
        case "count":
            return F.count(t.column).cast("double")
        case "distinct_count":
            return F.count_distinct(t.column).cast("double")
        case "min" | "max":
            return F.when(odd, V.NAN).otherwise(F.coalesce((F.min if fn == "min" else F.max)(x), zero))
        case "median":
            return F.coalesce(F.median(x), zero)
        case "stdev":
            return F.coalesce(F.stddev_samp(x), zero)
        case "variance":
            return F.coalesce(F.var_samp(x), zero)
        case _:
            raise AggregateError(f"unknown aggregate {fn!r}")
