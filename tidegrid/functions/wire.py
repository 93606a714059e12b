"""Computed columns: expressions in wire form, {"k": "bin", "op": "add", "l": ..., "r": ...}, compiled to Columns.

Kinds are known when a plan is built, so each node compiles to the one Spark expression that its operands' kinds call for.
Null is 0 as a number, "null" when added to text and empty in CONCAT; equality is strict; `and` and `or` give an operand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions import values as V
from tidegrid.functions.dsl import joined
from tidegrid.functions.values import Typed

BINARY = ("add", "sub", "mul", "div", "mod", "eq", "ne", "lt", "le", "gt", "ge", "and", "or")
AGGREGATES = ("sum", "avg", "mean", "count", "min", "max", "median", "stdev", "stddev", "variance", "distinct_count", "distinctCount")
#: Scalar functions and their least number of arguments.
FUNCTIONS = {
    "ABS": 1, "FLOOR": 1, "CEIL": 1, "ROUND": 1, "SQRT": 1, "POW": 2, "LOG": 1, "EXP": 1, "MOD": 2, "MIN": 0, "MAX": 0, "CONCAT": 0, "UPPER": 1, "LOWER": 1,
    "TRIM": 1, "LEN": 1, "SUBSTRING": 2, "REPLACE": 3, "CONTAINS": 2, "STARTS_WITH": 2, "ENDS_WITH": 2, "IF": 2, "IFS": 2, "SWITCH": 2, "CASE": 2, "ISNULL": 2,
    "ISNOTNULL": 1, "ISEMPTY": 1, "YEAR": 1, "MONTH": 1, "DAY": 1, "IS_WEEKDAY": 1,
}
Aggregate = Callable[[str, str], Column]


class ExpressionError(ValueError):
    """An expression of an unknown kind, operator or function, or over unknown columns."""


def walk(e: object) -> Iterator[Mapping]:
    """Every node, outermost first."""
    if isinstance(e, Mapping):
        if "k" in e:
            yield e
        for key, value in e.items():
            if key != "v":
                yield from walk(value)
    elif isinstance(e, list | tuple):
        for value in e:
            yield from walk(value)


def check(e: object) -> None:
    """Raise unless all nodes are of known kinds with what they need."""
    if not isinstance(e, Mapping) or "k" not in e:
        raise ExpressionError("a node without k")
    needs = {"lit": (), "col": ("name",), "bin": ("op", "l", "r"), "un": ("op", "a"), "fn": ("name",), "in": ("a",), "between": ("a", "lo", "hi"), "cond": ("branches",), "agg": ("fn", "col")}
    for n in walk(e):
        k = n["k"]
        if k not in needs:
            raise ExpressionError(f"unknown node kind {k!r}")
        if missing := [x for x in needs[k] if x not in n]:
            raise ExpressionError(f"{k} without {', '.join(missing)}")
        if k == "bin" and n["op"] not in BINARY or k == "un" and n["op"] not in ("neg", "not"):
            raise ExpressionError(f"unknown operator {n['op']!r}")
        if k == "fn" and n["name"] not in FUNCTIONS:
            raise ExpressionError(f"unknown function {n['name']!r}")
        if k == "fn" and len(n.get("args") or []) < FUNCTIONS[n["name"]]:
            raise ExpressionError(f"too few arguments for {n['name']}")
        if k == "agg" and n["fn"] not in AGGREGATES:
            raise ExpressionError(f"unknown aggregate {n['fn']!r}")
        if k == "lit" and isinstance(n.get("v"), list | dict):
            raise ExpressionError("a literal that is no scalar")


def columns(e: object) -> list[str]:
    """Columns read cell by cell; those of aggregates are told by `aggregates`."""
    return list(dict.fromkeys(n["name"] for n in walk(e) if n["k"] == "col"))


def aggregates(e: object) -> list[tuple[str, str]]:
    return list(dict.fromkeys((n["fn"], n["col"]) for n in walk(e) if n["k"] == "agg"))


def num(t: Typed) -> Column:
    return V.number(t, 0.0)


def arg(t: Typed) -> Column:
    """As a function's argument: text that is no number counts as 0."""
    return V.number(t, 0.0, 0.0)


def shown(t: Typed, null: str = "") -> Column:
    return F.lit(null) if t.kind == "null" else F.coalesce(V.text(t), F.lit(null))


def truthy(t: Typed) -> Column:
    if t.kind == "null":
        return F.lit(False)
    if t.kind == "bool":
        return F.coalesce(t.column, F.lit(False))
    if t.kind == "str":
        return F.coalesce(t.column != "", F.lit(False))
    return t.column.isNotNull() if t.kind == "time" else F.coalesce(t.column != 0, F.lit(False))


def strict_equal(a: Typed, b: Typed) -> Column:
    none = a.column.isNull() & b.column.isNull()
    if a.numeric and b.numeric:
        return none | F.coalesce(V.same_number(a.column.cast("double"), b.column.cast("double")), F.lit(False))
    return a.column.eqNullSafe(b.column) if a.kind == b.kind else none


def compare(a: Typed, b: Typed, op: str) -> Column:
    def test(x: Column, y: Column) -> Column:
        return {"lt": V.below(x, y), "gt": V.below(y, x), "le": V.at_most(x, y), "ge": V.at_most(y, x)}[op]

    plain = test(num(a), num(b))
    if a.kind != "str" or b.kind != "str":
        return plain
    x, y = a.column, b.column
    words = {"lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[op]
    return F.when(x.isNotNull() & y.isNotNull(), words).otherwise(plain)


def add(a: Typed, b: Typed) -> Typed:
    total = num(a) + num(b)
    if "str" not in (a.kind, b.kind):
        return Typed(total, "float")
    both = F.concat(shown(a, "null"), shown(b, "null"))
    # a null is no text, even where its column holds text
    some = reduce(lambda p, q: p | q, [t.column.isNotNull() for t in (a, b) if t.kind == "str"])
    return Typed(F.when(some, both).otherwise(V.number_text(total)), "str")


def modulo(a: Column, b: Column) -> Column:
    return F.when((b != 0) & ~F.isnan(b), a % F.when(b != 0, b)).otherwise(V.NAN)


def instant(t: Typed) -> Column:
    """An ISO date or time, or epoch milliseconds of 11 digits or more, as a timestamp; null if it is neither."""
    if t.kind == "time":
        return t.column.cast("timestamp")
    c = V.trimmed(V.text(t))
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?$"
    return F.when(c.rlike(iso), F.try_to_timestamp(F.when(c.rlike(iso), F.regexp_replace(c, " ", "T")))).when(c.rlike("^-?[0-9]{11,15}$"), F.timestamp_millis(F.when(c.rlike("^-?[0-9]{11,15}$"), c).cast("long")))


def substring(s: Column, start: Column, length: Column | None) -> Column:
    """From a place counted from 0; both ends clamped, swapped if the wrong way round."""
    n = F.length(s).cast("double")
    clamp = lambda x: F.greatest(F.least(F.when(F.isnan(x), 0.0).otherwise(x), n), F.lit(0.0))
    a = clamp(start)
    b = clamp(start + length) if length is not None else n
    lo, hi = F.least(a, b).cast("int"), F.greatest(a, b).cast("int")
    return F.substring(s, lo + 1, hi - lo)


def compile_expression(e: Mapping, kinds: Mapping[str, str], aggregate: Aggregate | None = None, columns_of: Mapping[str, Column] | None = None) -> Typed:
    """The expression as a typed Column; `aggregate` gives the Column of an aggregate node."""
    check(e)

    def build(n: Mapping) -> Typed:
        match n["k"]:
            case "lit":
                return V.literal(n.get("v"))
            case "col":
                if n["name"] not in kinds:
                    raise ExpressionError(f"unknown column {n['name']!r}")
                return V.cell(n["name"], kinds[n["name"]])
            case "agg":
                if aggregate is None:
                    raise ExpressionError("an aggregate where there is nothing to aggregate")
                return Typed(aggregate(n["fn"], n["col"]), "float")
            case "un":
                a = build(n["a"])
                return Typed(~truthy(a), "bool") if n["op"] == "not" else Typed(-num(a), "float")
            case "bin":
                return binary(n["op"], build(n["l"]), build(n["r"]))
            case "in":
                a = build(n["a"])
                return Typed(reduce(lambda p, q: p | q, [strict_equal(a, build(x)) for x in n.get("list") or []], F.lit(False)), "bool")
            case "between":
                a = build(n["a"])
                return Typed(compare(a, build(n["lo"]), "ge") & compare(a, build(n["hi"]), "le"), "bool")
            case "cond":
                return chain([(truthy(build(b["when"])), build(b["then"])) for b in n["branches"]], build(n["else"]) if n.get("else") is not None else None)
            case _:
                return call(n["name"], [build(x) for x in n.get("args") or []])

    return build(e)


def chain(branches: list[tuple[Column, Typed]], other: Typed | None) -> Typed:
    return joined(branches, other or V.literal(None))


def binary(op: str, a: Typed, b: Typed) -> Typed:
    match op:
        case "add":
            return add(a, b)
        case "sub":
            return Typed(num(a) - num(b), "float")
        case "mul":
            return Typed(num(a) * num(b), "float")
        case "div":
            d = num(b)
            return Typed(F.when(d != 0, num(a) / F.when(d != 0, d)), "float")
        case "mod":
            return Typed(modulo(num(a), num(b)), "float")
        case "eq" | "ne":
            same = strict_equal(a, b)
            return Typed(same if op == "eq" else ~same, "bool")
        case "and":
            return chain([(truthy(a), b)], a)
        case "or":
            return chain([(truthy(a), a)], b)
        case _:
            return Typed(compare(a, b, op), "bool")


def call(name: str, a: list[Typed]) -> Typed:
    real, yes, words = (lambda c: Typed(c, "float")), (lambda c: Typed(c, "bool")), (lambda c: Typed(c, "str"))
    match name:
        case "ABS":
            return real(F.abs(arg(a[0])))
        case "FLOOR" | "CEIL":
            return real(V.whole(arg(a[0]), F.floor if name == "FLOOR" else F.ceil))
        case "ROUND":
            return real(V.half_up(arg(a[0]), arg(a[1]) if len(a) > 1 else None))
        case "SQRT":
            return real(F.sqrt(arg(a[0])))
        case "POW":
            return real(F.pow(arg(a[0]), arg(a[1])))
        case "LOG":
            x = arg(a[0])
            return real(F.when(x > 0, F.log(x)).when(x == 0, -V.INFINITY).otherwise(V.NAN))
        case "EXP":
            return real(F.exp(arg(a[0])))
        case "MOD":
            return real(modulo(arg(a[0]), arg(a[1])))
        case "MIN" | "MAX":
            return real(V.extreme([arg(t) for t in a], name == "MIN"))
        case "CONCAT":
            return words(F.concat(*map(shown, a)) if a else F.lit(""))
        case "UPPER" | "LOWER":
            return words((F.upper if name == "UPPER" else F.lower)(shown(a[0])))
        case "TRIM":
            return words(V.trimmed(shown(a[0])))
        case "LEN":
            # in UTF-16 units: characters beyond the basic plane count twice
            s = shown(a[0])
            return Typed((F.length(s) + F.regexp_count(s, F.lit("[\\x{10000}-\\x{10FFFF}]"))).cast("long"), "int")
        case "SUBSTRING":
            return words(substring(shown(a[0]), arg(a[1]), arg(a[2]) if len(a) > 2 else None))
        case "REPLACE":
            return words(F.replace(shown(a[0]), shown(a[1]), shown(a[2])))
        case "CONTAINS":
            return yes(F.contains(shown(a[0]), shown(a[1])))
        case "STARTS_WITH":
            return yes(F.startswith(shown(a[0]), shown(a[1])))
        case "ENDS_WITH":
            return yes(F.endswith(shown(a[0]), shown(a[1])))
        case "IF":
            return chain([(truthy(a[0]), a[1])], a[2] if len(a) > 2 else None)
        case "IFS" | "CASE":
            return chain([(truthy(a[i]), a[i + 1]) for i in range(0, len(a) - 1, 2)], a[-1] if len(a) % 2 else None)
        case "SWITCH":
            return chain([(strict_equal(a[0], a[i]), a[i + 1]) for i in range(1, len(a) - 1, 2)], a[-1] if len(a) % 2 == 0 else None)
        case "ISNULL":
            return chain([(a[0].column.isNotNull(), a[0])], a[1])
        case "ISNOTNULL":
            return yes(a[0].column.isNotNull())
        case "ISEMPTY":
            return yes(a[0].column.isNull() | (V.text(a[0]) == "") if a[0].kind == "str" else a[0].column.isNull())
        case "YEAR" | "MONTH" | "DAY":
            part = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth}[name](instant(a[0]))
            return real(F.coalesce(part.cast("double"), F.lit(V.NAN)))
        case _:
            return yes(F.coalesce(F.weekday(instant(a[0])) < 5, F.lit(False)))
