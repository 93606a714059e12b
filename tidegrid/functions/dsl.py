"""The rule language: text such as `desk == 'govies' and abs(pnl) > 1000`, compiled to a Column.

Numbers have no exponent; a quote in a string is doubled. `==` folds case; `<` and the like are numeric only; `+` joins
text; null is NaN as a number and empty as text; division by zero gives infinities and NaN.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions import values as V
from tidegrid.functions.values import Typed

#: Functions and how many arguments each takes.
FUNCTIONS = {
    "abs": (1, 1), "sqrt": (1, 1), "floor": (1, 1), "ceil": (1, 1), "round": (1, 1), "min": (1, 99), "max": (1, 99), "length": (1, 1), "lower": (1, 1),
    "upper": (1, 1), "contains": (2, 2), "startsWith": (2, 2), "endsWith": (2, 2), "if": (2, 3),
}
#: Binary operators by how tight they bind.
BINDING = {"or": 1, "and": 2, "==": 3, "!=": 3, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6}
TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d*)?|\.\d+)|(?P<str>'(?:[^']|'')*')|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>&&|\|\||==|!=|<=|>=|[-+*/<>!(),]))")
WORDS = {"&&": "and", "||": "or", "!": "not"}


class RuleError(ValueError):
    """A rule that does not parse, with the place."""


@dataclass(frozen=True)
class Node:
    kind: str
    value: object = None
    args: tuple[Node, ...] = ()


def tokens(source: str) -> list[tuple[str, str, int]]:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise RuleError(f"unexpected character at {at + len(source[at:]) - len(source[at:].lstrip())}")
        kind = m.lastgroup or ""
        word = m[kind]
        if kind == "name" and word in ("and", "or", "not"):
            kind = "op"
        out.append((kind, WORDS.get(word, word) if kind == "op" else word, m.start(kind)))
        at = m.end()
    return out


class Parser:
    def __init__(self, source: str) -> None:
        self.items, self.at = tokens(source), 0
        self.end = len(source)

    def peek(self) -> tuple[str, str, int]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "", self.end)

    def next(self) -> tuple[str, str, int]:
        item = self.peek()
        self.at += 1
        return item

    def expect(self, word: str) -> None:
        kind, got, place = self.next()
        if kind != "op" or got != word:
            raise RuleError(f"expected {word!r} at {place}")

    def whole(self) -> Node:
        out = self.expression(0)
        kind, got, place = self.peek()
        if kind != "end":
            raise RuleError(f"unexpected {got!r} at {place}")
        return out

    def expression(self, least: int) -> Node:
        left = self.unary()
        while True:
            kind, op, _ = self.peek()
            level = BINDING.get(op, 0) if kind == "op" else 0
            if level <= least:
                return left
            self.next()
            left = Node("binary", op, (left, self.expression(level)))

    def unary(self) -> Node:
        kind, word, _ = self.peek()
        if kind == "op" and word in ("-", "not"):
            self.next()
            return Node("unary", word, (self.unary(),))
        return self.primary()

    def primary(self) -> Node:
        kind, word, place = self.next()
        if kind == "num":
            return Node("literal", float(word) if "." in word else int(word))
        if kind == "str":
            return Node("literal", word[1:-1].replace("''", "'"))
        if kind == "op" and word == "(":
            inner = self.expression(0)
            self.expect(")")
            return inner
        if kind == "name":
            if self.peek()[:2] == ("op", "("):
                return self.call(word, place)
            constants = {"true": True, "false": False, "null": None}
            return Node("literal", constants[word]) if word in constants else Node("field", word)
        raise RuleError(f"unexpected {word or 'end'!r} at {place}")

    def call(self, name: str, place: int) -> Node:
        if name not in FUNCTIONS:
            raise RuleError(f"unknown function {name!r} at {place}")
        self.expect("(")
        args = []
        if self.peek()[:2] != ("op", ")"):
            args.append(self.expression(0))
            while self.peek()[:2] == ("op", ","):
                self.next()
                args.append(self.expression(0))
        self.expect(")")
        least, most = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise RuleError(f"{name} takes {least} to {most} arguments, got {len(args)}, at {place}")
        return Node("call", name, tuple(args))


def parse(source: str) -> Node:
    return Parser(source).whole()


def fields(n: Node) -> list[str]:
    """The columns a rule reads, each once, in order."""
    own = [n.value] if n.kind == "field" else []
    return list(dict.fromkeys(own + [f for a in n.args for f in fields(a)]))


def problems(source: str, kinds: Mapping[str, str] | None = None) -> list[str]:
    try:
        n = parse(source)
    except RuleError as e:
        return [f"syntax: {e}"]
    return [f"unknown-field: {f}" for f in fields(n) if kinds is not None and f not in kinds]


def num(t: Typed) -> Column:
    return V.number(t, V.NAN)


def shown(t: Typed) -> Column:
    return F.coalesce(V.text(t), F.lit(""))


def truthy(t: Typed) -> Column:
    if t.kind == "null":
        return F.lit(False)
    if t.kind == "bool":
        return F.coalesce(t.column, F.lit(False))
    if t.kind == "str":
        return F.coalesce(t.column != "", F.lit(False))
    return F.coalesce(num(t) != 0, F.lit(False)) if t.kind != "time" else t.column.isNotNull()


def equal(a: Typed, b: Typed) -> Column:
    both_null = a.column.isNull() & b.column.isNull()
    if a.kind == "null" or b.kind == "null":
        return both_null
    if a.kind == "str" and b.kind == "str":
        return both_null | F.coalesce(F.lower(a.column) == F.lower(b.column), F.lit(False))
    if a.numeric and b.numeric:
        return both_null | F.coalesce(V.same_number(a.column.cast("double"), b.column.cast("double")), F.lit(False))
    if a.kind == b.kind == "bool":
        return a.column.eqNullSafe(b.column)
    if "bool" in (a.kind, b.kind):
        return both_null
    some = a.column.isNotNull() & b.column.isNotNull()
    return both_null | (some & F.coalesce(V.same_number(num(a), num(b)), F.lit(False)))


def joined(branches: list[tuple[Column, Typed]], other: Typed | None) -> Typed:
    """when-otherwise over values of one kind, or as text where they differ."""
    every = [t for _, t in branches] + ([other] if other else [])
    seen = {t.kind for t in every} - {"null"}
    kind = seen.pop() if len(seen) == 1 else "null" if not seen else "float" if seen <= {"int", "float"} else "float" if seen <= {"int", "float", "bool"} else "str"
    kind_type = {"bool": "boolean", "int": "long", "float": "double", "str": "string", "null": "string", "time": "timestamp"}[kind]
    as_kind = lambda t: F.lit(None).cast(kind_type) if t.kind == "null" else V.text(t) if kind == "str" and t.kind != "str" else t.column.cast(kind_type)
    out = None
    for when, t in branches:
        out = F.when(when, as_kind(t)) if out is None else out.when(when, as_kind(t))
    return Typed(out.otherwise(as_kind(other)) if other else out, kind)


def build(n: Node, kinds: Mapping[str, str]) -> Typed:
    if n.kind == "literal":
        return V.literal(n.value)
    if n.kind == "field":
        if n.value not in kinds:
            raise RuleError(f"unknown-field: {n.value}")
        return V.cell(str(n.value), kinds[str(n.value)])
    a = [build(x, kinds) for x in n.args]
    yes = lambda c: Typed(c, "bool")
    real = lambda c: Typed(c, "float")
    if n.kind == "unary":
        return yes(~truthy(a[0])) if n.value == "not" else real(-num(a[0]))
    if n.kind == "binary":
        l, r = a
        match n.value:
            case "and":
                return yes(truthy(l) & truthy(r))
            case "or":
                return yes(truthy(l) | truthy(r))
            case "==":
                return yes(equal(l, r))
            case "!=":
                return yes(~equal(l, r))
            case "<" | ">" | "<=" | ">=":
                x, y = num(l), num(r)
                return yes({"<": V.below(x, y), ">": V.below(y, x), "<=": V.at_most(x, y), ">=": V.at_most(y, x)}[str(n.value)])
            case "+" if "str" in (l.kind, r.kind):
                return Typed(F.concat(shown(l), shown(r)), "str")
            case "/":
                return real(V.divide(num(l), num(r)))
            case _:
                x, y = num(l), num(r)
                return real({"+": x + y, "-": x - y, "*": x * y}[str(n.value)])
    match n.value:
        case "abs":
            return real(F.abs(num(a[0])))
        case "sqrt":
            return real(F.sqrt(num(a[0])))
        case "floor" | "ceil":
            return real(V.whole(num(a[0]), F.floor if n.value == "floor" else F.ceil))
        case "round":
            return real(V.half_up(num(a[0])))
        case "min" | "max":
            return real(V.extreme([num(t) for t in a], n.value == "min"))
        case "length":
            return Typed(F.coalesce(F.length(V.text(a[0])), F.lit(0)).cast("long"), "int")
        case "lower" | "upper":
            return Typed((F.lower if n.value == "lower" else F.upper)(V.text(a[0])), "str")
        case "contains":
            return yes(F.contains(shown(a[0]), shown(a[1])))
        case "startsWith":
            return yes(F.startswith(shown(a[0]), shown(a[1])))
        case "endsWith":
            return yes(F.endswith(shown(a[0]), shown(a[1])))
        case _:
            return joined([(truthy(a[0]), a[1])], a[2] if len(a) > 2 else V.literal(None))


def compile_rule(source: str, kinds: Mapping[str, str]) -> Typed:
    return build(parse(source), kinds)


def predicate(source: str, kinds: Mapping[str, str]) -> Column:
    """Where the rule's value is truthy; never null."""
    return truthy(compile_rule(source, kinds))
