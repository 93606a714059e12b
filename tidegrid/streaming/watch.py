"""Watches over a live table's versions: row deltas, group deltas, members of views, alerts."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidegrid.functions import dsl
from tidegrid.functions import values as V
from tidegrid.operators import diff
from tidegrid.operators.view import View
from tidegrid.streaming.live import LiveTable

PAYLOAD = 200


@dataclass
class Delta:
    """What a subscriber gets: rows written, keys removed, and whether to start anew."""

    rev: int
    rows: DataFrame
    removed: DataFrame
    reset: bool


class RowDeltas:
    """Changes since the last poll; a subscriber that joins begins at the current version (or an older one, to rewind)."""

    def __init__(self, table: LiveTable, rev: int | None = None) -> None:
        self.table, self.rev = table, table.rev if rev is None else rev

    def poll(self) -> Delta | None:
        now = self.table.rev
        if now == self.rev:
            return None
        rows, removed, reset = self.table.changed_since(self.rev)
        self.rev = now
        return Delta(now, rows, removed, reset)


    def notify(self) -> dict[str, int] | None:
        """As poll, but only how many rows there are to fetch."""
        delta = self.poll()
        return None if delta is None else {"rev": delta.rev, "changed": delta.rows.count(), "removed": delta.removed.count()}


@dataclass
class GroupWatch:
    """Group rows that changed since the last poll, over every level of the spec's groups."""

    table: LiveTable
    spec: Mapping
    tolerance: float = 0.0
    rev: int = -1
    stats: dict[str, int] = field(default_factory=lambda: {"polls": 0, "unchanged": 0, "full": 0})

    def poll(self) -> DataFrame | None:
        self.stats["polls"] += 1
        now = self.table.rev
        if now == self.rev:
            self.stats["unchanged"] += 1
            return None
        current = View(self.table.read(now), dict(self.spec))
        levels = current.levels()
        before = View(self.table.read(self.rev), dict(self.spec)).levels() if self.rev in self.table.versions() else levels.limit(0)
        self.stats["full"] += 1
        self.rev = now
        return diff.group_diff(before, levels, current.spec.groups, self.tolerance)


@dataclass
class MemberWatch:
    """Keys that entered or left a view; the first poll only takes note. A payload of at most `PAYLOAD` rows goes with it."""

    table: LiveTable
    spec: Mapping
    rev: int = -1

    def poll(self) -> tuple[DataFrame, DataFrame] | None:
        now = self.table.rev
        if now == self.rev:
            return None
        primed, self_rev = self.rev >= 0, self.rev
        self.rev = now
        if not primed:
            return None
        current = View(self.table.read(now), dict(self.spec)).filtered()
        events = diff.membership(View(self.table.read(self_rev), dict(self.spec)).filtered(), current).orderBy("event", "__key")
        entered = current.join(events.where("event = 'entered'").select("__key"), "__key", "left_semi").orderBy("__key").limit(PAYLOAD)
        return events, entered


@dataclass
class Alert:
    """A rule over the whole table; fires when a row comes to match. Rows that match at the start fire at once."""

    table: LiveTable
    rule_id: str
    rule: str
    rev: int = -1

    def __post_init__(self) -> None:
        found = dsl.problems(self.rule, V.kinds(self.table.read()))
        if found:
            raise dsl.RuleError("; ".join(found))

    def poll(self) -> DataFrame | None:
        now = self.table.rev
        if now == self.rev:
            return None
        current = self.table.read(now)
        before = self.table.read(self.rev) if self.rev in self.table.versions() else current.limit(0)
        self.rev = now
        return diff.alert_transitions(before, current, dsl.predicate(self.rule, V.kinds(current)))


class Alerts:
    """Rules by id; a rule under an id that is there takes its place."""

    def __init__(self, table: LiveTable) -> None:
        self.table, self.rules = table, {}

    def subscribe(self, rule_id: str, rule: str) -> Alert:
        if not rule_id:
            raise ValueError("a rule without an id")
        self.rules[rule_id] = Alert(self.table, rule_id, rule)
        return self.rules[rule_id]

    def unsubscribe(self, rule_id: str) -> bool:
        return self.rules.pop(rule_id, None) is not None

    def poll(self) -> dict[str, DataFrame]:
        return {k: events for k, a in self.rules.items() if (events := a.poll()) is not None}


def on_each(watches: Sequence, sink: Callable[[object, object], None]) -> Callable[[int], None]:
    """For LiveTable.follow: polls the watches after each version and hands what they say to a sink."""

    def after(rev: int) -> None:
        for w in watches:
            said = w.poll()
            if said is not None:
                sink(w, said)

    return after
