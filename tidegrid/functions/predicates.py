"""Filter predicates: {column, op, value, valueTo} leaves, and nodes of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions import dsl
from tidegrid.functions.values import Typed, at_most, below, blank, cell, filter_number, fold, literal, number_text, same_number, trimmed

OPS = (
    "equals equalsIgnoreCase notEqual notEqualIgnoreCase contains notContains startsWith endsWith greaterThan greaterThanOrEqual "
    "lessThan lessThanOrEqual inRange blank notBlank in notIn"
).split()
ANY = ("or", "anyOf")


class FilterError(ValueError):
    """A filter that names unknown columns or operators, or whose expression does not parse."""


def needle(value: object) -> str | None:
    """A literal's folded text; None for a blank one."""
    if value is None or value == "":
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
        return str(int(value))
    return str(value).lower()


def bound(value: object) -> float:
    """A literal as a number in a comparison: null is 0, text other than a number NaN."""
    if value is None:
        return 0.0
    try:
        return float(value)
    except (TypeError, ValueError):
        return float("nan")


def _equal(t: Typed, value: object) -> Column:
    want = needle(value)
    if want is None:
        return F.lit(False)
    if t.numeric and isinstance(value, int | float) and not isinstance(value, bool):
        return F.coalesce(same_number(t.column.cast("double"), F.lit(float(value))), F.lit(False))
    return F.coalesce(fold(t) == want, F.lit(False))


def _differs(t: Typed, value: object) -> Column:
    if needle(value) is None:
        return ~blank(t)
    return ~_equal(t, value)


def _compare(test: Callable[[Column], Column]) -> Callable[[Typed], Column]:
    return lambda t: ~blank(t) & F.coalesce(test(filter_number(t)), F.lit(False))


def leaf(t: Typed, op: str, value: object = None, to: object = None) -> Column:
    """A boolean Column, never null."""
    low, high = F.lit(bound(value)), F.lit(bound(to))
    want = needle(value) or ""
    if op in ("equals", "equalsIgnoreCase"):
        return _equal(t, value)
    if op in ("notEqual", "notEqualIgnoreCase"):
        return _differs(t, value)
    if op == "contains":
        return F.coalesce(F.contains(fold(t), F.lit(want)), F.lit(False))
    if op == "notContains":
        return ~F.coalesce(F.contains(fold(t), F.lit(want)), F.lit(False))
    if op == "startsWith":
        return F.coalesce(fold(t).startswith(want), F.lit(False))
    if op == "endsWith":
        return F.coalesce(fold(t).endswith(want), F.lit(False))
    if op == "greaterThan":
        return _compare(lambda x: below(low, x))(t)
    if op == "greaterThanOrEqual":
        return _compare(lambda x: at_most(low, x))(t)
    if op == "lessThan":
        return _compare(lambda x: below(x, low))(t)
    if op == "lessThanOrEqual":
        return _compare(lambda x: at_most(x, low))(t)
    if op == "inRange":
        return _compare(lambda x: at_most(low, x) & at_most(x, high))(t)
    if op == "blank":
        return blank(t)
    if op == "notBlank":
        return ~blank(t)
    if op in ("in", "notIn"):
        hit = member(t, value if isinstance(value, list | tuple) else [])
        return ~hit if op == "notIn" else hit
    raise FilterError(f"unknown operator {op!r}")


def member(t: Typed, values: Sequence[object]) -> Column:
    """In a set of folded values; a null among them stands for blank cells, empty text for none."""
    wanted = sorted({w for w in map(needle, values) if w is not None})
    hit = F.coalesce(fold(t).isin(wanted), F.lit(False)) if wanted else F.lit(False)
    return hit | blank(t) if any(v is None for v in values) else hit


def node(item: Mapping, kinds: Mapping[str, str]) -> Column:
    """One node of a filter: a leaf, an or of nodes (nested as deep as need be), or an expression."""
    if "expr" in item:
        return dsl.predicate(str(item["expr"]), kinds)
    op = item.get("op")
    if op in ANY:
        parts = [node(c, kinds) for c in item.get("conditions") or []]
        return reduce(lambda a, b: a | b, parts) if parts else F.lit(False)
    name = item.get("column")
    if name not in kinds:
        raise FilterError(f"unknown column {name!r}")
    return leaf(cell(name, kinds[name]), op, item.get("value"), item.get("valueTo"))


def condition(nodes: Sequence[Mapping], kinds: Mapping[str, str]) -> Column:
    """All nodes together; true for an empty filter."""
    return reduce(lambda a, b: a & b, [node(n, kinds) for n in nodes], F.lit(True))


def problems(nodes: Sequence[Mapping], kinds: Mapping[str, str]) -> list[str]:
    """What keeps a filter from being applied; empty if nothing does."""
    out = []
    for item in nodes:
        if "expr" in item:
            out += [f"expression: {p}" for p in dsl.problems(str(item["expr"]), kinds)]
        elif item.get("op") in ANY:
            out += problems(item.get("conditions") or [], kinds)
        else:
            if item.get("column") not in kinds:
                out.append(f"unknown column {item.get('column')!r}")
            if item.get("op") not in OPS:
                out.append(f"unknown operator {item.get('op')!r}")
    return out


def quick(words: str, columns: Sequence[str], kinds: Mapping[str, str], every_word: bool = True) -> Column:
    """Quick search: every word (or the text as a whole) is in some column."""
    parts = words.split() if every_word else [words]
    any_of = lambda w: reduce(lambda a, b: a | b, [leaf(cell(c, kinds[c]), "contains", w) for c in columns], F.lit(False))
    return reduce(lambda a, b: a & b, [any_of(w) for w in parts], F.lit(True))


# client-side semantics: another reading of the same models, on demand


def grid_leaf(t: Typed, kind: str, op: str, value: object = None, to: object = None) -> Column:
    """The client row model's reading: numbers compare as numbers, sets by exact text, dates by calendar day (UTC)."""
    no = F.lit(False)
    if op in ("blank", "notBlank"):
        return leaf(t, op)
    if kind == "number":
        x = filter_number(t)
        want = F.lit(bound(value))
        if op == "equals":
            return ~blank(t) & F.coalesce(same_number(x, want), no)
        if op == "notEqual":
            return blank(t) | ~F.coalesce(same_number(x, want), no)
        return leaf(t, op, value, to)
    if kind == "set":
        shown = F.coalesce(text_or_blank(t), F.lit(""))
        wanted = ["" if v is None else str(v) for v in (value or [])]
        return shown.isin(wanted) if wanted else no
    if kind == "date":
        day = F.to_date(t.column) if t.kind == "time" else F.to_date(F.substring(t.column, 1, 10))
        first, last = (F.to_date(F.lit(str(v)[:10])) if v else None for v in (value, to))
        tests = {
            "equals": lambda: day == first, "notEqual": lambda: day != first, "greaterThan": lambda: day > first, "greaterThanOrEqual": lambda: day >= first,
            "lessThan": lambda: day < first, "lessThanOrEqual": lambda: day <= first, "inRange": lambda: day.between(first, last if last is not None else first),
        }
        if op not in tests:
            raise FilterError(f"unknown date operator {op!r}")
        return F.coalesce(tests[op](), F.lit(op == "notEqual"))
    return leaf(t, op, value, to)


def text_or_blank(t: Typed) -> Column:
    return number_text(t.column.cast("double")) if t.kind == "float" else t.column.cast("string")


__all__ = ["ANY", "OPS", "FilterError", "condition", "grid_leaf", "leaf", "literal", "member", "node", "problems", "quick", "trimmed"]
