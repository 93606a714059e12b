"""View specifications: filter, sort, groups, aggregates, pivot and computed columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from tidegrid.functions import aggregates, predicates, wire
from tidegrid.functions.aggregates import AggregateError


class SpecError(ValueError):
    """A request that cannot be answered; says everything that is wrong with it."""

    def __init__(self, problems: Sequence[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = list(problems)


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Aggregate:
    column: str
    fn: str
    name: str
    weight: str | None = None


@dataclass(frozen=True)
class Computed:
    name: str
    expression: Mapping


@dataclass(frozen=True)
class ViewSpec:
    filter: tuple[Mapping, ...] = ()
    sort: tuple[SortKey, ...] = ()
    groups: tuple[str, ...] = ()
    aggregates: tuple[Aggregate, ...] = ()
    splits: tuple[str, ...] = ()
    computed: tuple[Computed, ...] = ()
    columns: tuple[str, ...] = ()
    watch: bool = False
    problems: tuple[str, ...] = field(default=())

    @staticmethod
    def parse(spec: Mapping) -> ViewSpec:
        """From JSON; aggregates as {column: fn} or [{column, fn, as}], sort keys with `sort` or `dir`."""
        wrong: list[str] = []
        given = spec.get("aggregates") or []
        listed = [{"column": c, "fn": f} for c, f in given.items()] if isinstance(given, Mapping) else list(given)
        aggs = []
        for a in listed:
            try:
                aggs.append(Aggregate(a["column"], aggregates.canonical(a.get("fn") or "sum"), a.get("as") or a["column"], a.get("weight")))
            except (AggregateError, KeyError) as e:
                wrong.append(str(e))
        computed = []
        for c in spec.get("computed") or []:
            try:
                wire.check(c.get("expr"))
                computed.append(Computed(c["as"], c["expr"]))
            except (wire.ExpressionError, KeyError) as e:
                wrong.append(f"computed {c.get('as')!r}: {e}")
        sort = tuple(SortKey(s["column"], (s.get("sort") or s.get("dir")) == "desc") for s in spec.get("sort") or [])
        return ViewSpec(
            tuple(spec.get("filter") or []), sort, tuple(spec.get("groupBy") or []), tuple(aggs), tuple(spec.get("splitBy") or []),
            tuple(computed), tuple(spec.get("columns") or []), bool(spec.get("watch")), tuple(wrong),
        )

    def validated(self, kinds: Mapping[str, str]) -> ViewSpec:
        """This spec, or a SpecError that names every unknown column, operator and function and every circle."""
        wrong = list(self.problems)
        known = dict(kinds)
        made: list[str] = []
        over_aggregates: set[str] = set()
        for c in self.computed:
            wrong += [f"computed {c.name!r} reads unknown column {x!r}" for x in wire.columns(c.expression) if x not in known]
            for _, x in wire.aggregates(c.expression):
                if x in over_aggregates:
                    wrong.append(f"computed {c.name!r} aggregates {x!r}, which itself follows from aggregates")
                elif x not in known:
                    wrong.append(f"computed {c.name!r} aggregates unknown column {x!r}")
            if wire.aggregates(c.expression) or any(x in over_aggregates for x in wire.columns(c.expression)):
                over_aggregates.add(c.name)
            known[c.name] = "float"
            made.append(c.name)
        wrong += predicates.problems(self.filter, known)
        named = [("sort", k.column) for k in self.sort] + [("group", g) for g in self.groups] + [("aggregate", a.column) for a in self.aggregates if a.fn != "count"]
        named += [("split", s) for s in self.splits] + [("column", c) for c in self.columns] + [("weight", a.weight) for a in self.aggregates if a.weight]
        wrong += [f"{what} by unknown column {c!r}" for what, c in named if c not in known]
        if wrong:
            raise SpecError(wrong)
        return self
