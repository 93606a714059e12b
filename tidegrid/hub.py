"""The hub: datasources, their shared live tables, and the requests that clients make of them.

`handle` takes a request as the protocol has it, {"id": ..., "type": "openView", ...}, and answers with a dict; the methods
are there for use from Python. Tables are shared by datasource and parameters, and go when nobody holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from itertools import count
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tidegrid.operators.view import View
from tidegrid.plans import config as cfg
from tidegrid.plans.gridmodel import view_request
from tidegrid.plans.viewspec import SpecError, ViewSpec
from tidegrid.streaming.live import LiveTable
from tidegrid.streaming.watch import Alerts, GroupWatch, MemberWatch, RowDeltas

PROTOCOL = 1
CELL_BYTES, CEILING = 32, 2_500_000_000
CAPABILITIES = {
    "protocol": PROTOCOL,
    "views": ["filter", "sort", "groupBy", "splitBy", "computed", "aggregates", "window"],
    "streams": ["rowDelta", "groupDelta", "viewDelta", "alert"],
    "verbs": [
        "hello", "bootstrap", "subscribe", "unsubscribe", "pin", "unpin", "openView", "readWindow", "expandRow", "disposeView", "command", "rowCount", "aggregates", "distinctValues",
        "searchValues", "rank", "watchGroups", "unwatchGroups", "alertSubscribe", "alertUnsubscribe", "pushConfig", "getRows", "scan", "stats", "ack", "capabilities",
    ],
}


class HubError(RuntimeError):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


@dataclass
class Entry:
    """A shared table and who holds it."""

    table: LiveTable
    holders: set[str] = field(default_factory=set)
    pins: int = 0


@dataclass
class OpenView:
    entry: Entry
    spec: dict
    owner: str
    expanded: list[tuple] = field(default_factory=list)
    cached: tuple | None = None


class Hub:
    def __init__(self, spark: SparkSession, root: str, ceiling: int = CEILING) -> None:
        self.spark, self.root, self.ceiling = spark, root.rstrip("/"), ceiling
        self.sources: dict[str, dict] = {}
        self.entries: dict[str, Entry] = {}
        self.views: dict[str, OpenView] = {}
        self.group_watches: dict[tuple[str, str], GroupWatch] = {}
        self.alerts: dict[str, Alerts] = {}
        self.ledger: set[str] = set()
        self.config: dict = {"bundleVersion": 0}
        self.numbers = count(1)
        self.figures = {"requests": 0, "errors": 0}

    # datasources and tables

    def register(self, source: Mapping) -> str:
        """registered, shared (the same is there), or conflict (another is)."""
        if not source.get("id") or not source.get("keyColumns") or not source.get("columns"):
            return "invalid"
        known = self.sources.get(source["id"])
        if known is None:
            self.sources[source["id"]] = dict(source)
            return "registered"
        return "shared" if cfg.canonical(known) == cfg.canonical(source) else "conflict"

    @staticmethod
    def key(source: str, params: Mapping | None) -> str:
        return f"{source}?{cfg.canonical(dict(params or {}))}"

    def subscribe(self, source: str, params: Mapping | None, session: str) -> Entry:
        if source not in self.sources:
            raise HubError("unknown-datasource", f"no datasource {source!r}")
        key = self.key(source, params)
        if key not in self.entries:
            config = self.sources[source]
            rows = config.get("estimatedRows") or 0
            width = len(config["columns"].split(","))
            if rows * width * CELL_BYTES > self.ceiling:
                raise HubError("too-large", f"{source}: {rows} rows of {width} columns pass the ceiling")
            self.entries[key] = Entry(LiveTable(self.spark, f"{self.root}/{cfg.checksum(key)[:16]}", config["columns"], int(config.get("buckets", 16))))
        self.entries[key].holders.add(session)
        return self.entries[key]

    def entry(self, source: str, params: Mapping | None) -> Entry:
        found = self.entries.get(self.key(source, params))
        if found is None:
            raise HubError("not-subscribed", f"{source} is not open with these parameters")
        return found

    def unsubscribe(self, source: str, params: Mapping | None, session: str) -> None:
        key = self.key(source, params)
        if key in self.entries:
            self.entries[key].holders.discard(session)
            self._tidy(key)

    def pin(self, source: str, params: Mapping | None, by: int = 1) -> int:
        entry = self.entry(source, params)
        entry.pins = max(0, entry.pins + by)
        self._tidy(self.key(source, params))
        return entry.pins

    def _tidy(self, key: str) -> None:
        entry = self.entries[key]
        if not entry.holders and not entry.pins:
            del self.entries[key]

    def superset(self, source: str, params: Mapping) -> tuple[Entry, list[dict]] | None:
        """An open table whose parameters hold these as a special case (`*`), with the filter that cuts it down."""
        import json

        for key, entry in self.entries.items():
            name, _, text = key.partition("?")
            have = json.loads(text)
            if name == source and have.keys() == dict(params).keys() and all(v in ("*", params[k]) for k, v in have.items()):
                return entry, [{"column": k, "op": "equals", "value": params[k]} for k, v in have.items() if v == "*"]
        return None

    # views

    def open_view(self, source: str, params: Mapping | None, spec: Mapping, session: str) -> str:
        entry = self.entry(source, params)
        View(entry.table.read(), dict(spec))  # raises for what is wrong with it
        name = f"v{next(self.numbers)}"
        self.views[name] = OpenView(entry, dict(spec), session)
        return name

    def view(self, name: str) -> OpenView:
        if name not in self.views:
            raise HubError("unknown-view", f"no view {name!r}")
        return self.views[name]

    def plan(self, v: OpenView) -> DataFrame:
        """The view's rows in order; built once for each version and shape."""
        at = (v.entry.table.rev, tuple(v.expanded))
        if v.cached is None or v.cached[0] != at:
            view = View(v.entry.table.read(), v.spec)
            groups, splits = view.spec.groups, view.spec.splits
            v.cached = (at, view.pivot() if splits else view.tree(v.expanded) if groups else view.rows())
        return v.cached[1]

    def read_window(self, name: str, start: int = 0, end: int | None = None) -> tuple[DataFrame, int]:
        plan = self.plan(self.view(name))
        rows = plan.offset(max(start, 0)) if start > 0 else plan
        return (rows if end is None else rows.limit(max(end - max(start, 0), 0))), plan.count()

    def expand(self, name: str, row: int, collapse: bool = False) -> list[tuple]:
        """Open or close the group in a visible row; closing drops what is open below it."""
        v = self.view(name)
        groups = ViewSpec.parse(v.spec).groups
        got = self.plan(v).offset(row).limit(1).collect()
        if not got or not got[0]["__group"]:
            raise HubError("not-a-group", f"row {row} is no group")
        path = tuple(got[0][g] for g in groups[: got[0]["__level"] + 1])
        if collapse:
            v.expanded = [p for p in v.expanded if p[: len(path)] != path]
        elif path not in v.expanded:
            v.expanded.append(path)
        return v.expanded

    def get_rows(self, source: str, params: Mapping | None, request: Mapping, search: tuple = (), dates: tuple = ()) -> tuple[DataFrame, list[str]]:
        """A grid's block of rows, and what of its request has no translation."""
        spec, unsupported = view_request(request, search, dates)
        view = View(self.entry(source, params).table.read(), spec)
        start, end = int(request.get("startRow") or 0), request.get("endRow")
        df = view.pivot() if view.spec.splits else view.groups() if view.spec.groups else view.rows()
        df = df.offset(start) if start else df
        return (df.limit(int(end) - start) if end is not None else df), unsupported

    def one(self, source: str, params: Mapping | None, spec: Mapping) -> View:
        return View(self.entry(source, params).table.read(), dict(spec))

    def command(self, source: str, params: Mapping | None, key: str, column: str, value: object, idempotency: str) -> str:
        """Write one field of one row (which is made if need be): applied, duplicate or rejected."""
        entry = self.entry(source, params)
        fields = {f.name: f.dataType for f in entry.table.fields.fields}
        if not key or column not in fields or not idempotency:
            return "rejected"
        if idempotency in self.ledger:
            return "duplicate"
        seq = entry.table.version().rev + 1 << 40
        row = self.spark.createDataFrame([(key, seq, "update", [column], *[value if f == column else None for f in fields])], self._message_schema(entry))
        entry.table.apply(row)
        self.ledger.add(idempotency)
        return "applied"

    def _message_schema(self, entry: Entry):  # noqa: ANN202
        from pyspark.sql import types as T

        meta = [T.StructField("__key", T.StringType()), T.StructField("__seq", T.LongType()), T.StructField("__op", T.StringType()), T.StructField("__present", T.ArrayType(T.StringType()))]
        return T.StructType([*meta, *entry.table.fields.fields])

    def push_config(self, incoming: Mapping) -> dict[str, str]:
        """What each datasource of a new configuration asks for: none, added, or the class of its reload. Applied at once."""
        out = {}
        for d in incoming.get("datasources") or []:
            old = self.sources.get(d["id"])
            out[d["id"]] = "added" if old is None else cfg.reload_class(old, d)[0]
            self.sources[d["id"]] = dict(d)
            if out[d["id"]] in ("rebuild", "restart"):
                for key in [k for k in self.entries if k.partition("?")[0] == d["id"]]:
                    holders, pins = self.entries[key].holders, self.entries[key].pins
                    table = LiveTable(self.spark, f"{self.root}/{cfg.checksum([key, cfg.checksum(d)])[:16]}", d["columns"], int(d.get("buckets", 16)))
                    self.entries[key] = Entry(table, holders, pins)
        return out

    # the protocol

    def handle(self, message: Mapping, session: str = "local") -> dict:
        """Answer a request; errors are answers too."""
        self.figures["requests"] += 1
        verbs: dict[str, Callable[[Mapping, str], dict]] = {
            "hello": self._hello, "bootstrap": self._bootstrap, "subscribe": self._subscribe, "unsubscribe": self._unsubscribe, "pin": self._pin, "unpin": self._pin,
            "openView": self._open_view, "readWindow": self._read_window, "expandRow": self._expand_row, "disposeView": self._dispose, "command": self._command, "rowCount": self._row_count,
            "aggregates": self._aggregates, "distinctValues": self._distinct, "searchValues": self._search, "rank": self._rank, "watchGroups": self._watch_groups, "unwatchGroups": self._unwatch,
            "alertSubscribe": self._alert, "alertUnsubscribe": self._alert_off, "pushConfig": self._push, "getRows": self._get_rows, "scan": self._scan, "stats": self._stats, "ack": lambda m, s: {},
            "capabilities": lambda m, s: dict(CAPABILITIES),
        }
        verb = message.get("type")
        try:
            if verb not in verbs:
                raise HubError("unknown-verb", f"no verb {verb!r}")
            return {"id": message.get("id"), "type": "result", **verbs[verb](message, session)}
        except (SpecError, ValueError, KeyError, HubError) as e:
            self.figures["errors"] += 1
            return {"id": message.get("id"), "type": "error", "code": getattr(e, "code", "invalid-params"), "message": str(e)}

    @staticmethod
    def _ref(m: Mapping) -> tuple[str, Mapping]:
        ref = m.get("ref") or {}
        if "datasourceId" not in ref:
            raise HubError("invalid-params", "no ref.datasourceId")
        return ref["datasourceId"], ref.get("params") or {}

    @staticmethod
    def _rows(df: DataFrame) -> list[dict[str, Any]]:
        return [r.asDict(recursive=True) for r in df.collect()]

    def _hello(self, m: Mapping, session: str) -> dict:
        if m.get("protocolVersion") != PROTOCOL:
            raise HubError("protocol-version-mismatch", f"protocol {m.get('protocolVersion')}; this hub speaks {PROTOCOL}")
        own = cfg.checksum({k: v for k, v in self.config.items() if k != "bundleVersion"})
        return {"type": "configAck", "status": cfg.reconcile(m.get("bundleVersion") or 0, m.get("bundleChecksum"), self.config["bundleVersion"], own), "bundleVersion": self.config["bundleVersion"], "bundleChecksum": own}

    def _bootstrap(self, m: Mapping, session: str) -> dict:
        given = m.get("datasources") or []
        if not given:
            raise HubError("invalid-params", "no datasources")
        return {"datasources": [{"id": d.get("id"), "status": self.register(d)} for d in given]}

    def _subscribe(self, m: Mapping, session: str) -> dict:
        entry = self.subscribe(*self._ref(m), session)
        deltas = {"deltas": RowDeltas(entry.table)} if m.get("delivery") == "rows" else {}
        return {"type": "subscribed", "revision": entry.table.rev, "mode": "shared", **deltas}

    def _unsubscribe(self, m: Mapping, session: str) -> dict:
        self.unsubscribe(*self._ref(m), session)
        return {}

    def _pin(self, m: Mapping, session: str) -> dict:
        return {"pins": self.pin(*self._ref(m), 1 if m["type"] == "pin" else -1)}

    def _open_view(self, m: Mapping, session: str) -> dict:
        name = self.open_view(*self._ref(m), m.get("view") or {}, session)
        v = self.view(name)
        watch = {"watch": MemberWatch(v.entry.table, v.spec)} if v.spec.get("watch") else {}
        return {"viewId": name, "revision": v.entry.table.rev, **watch}

    def _read_window(self, m: Mapping, session: str) -> dict:
        rows, total = self.read_window(m["viewId"], int(m.get("start") or 0), m.get("end"))
        return {"rows": self._rows(rows), "total": total}

    def _expand_row(self, m: Mapping, session: str) -> dict:
        return {"expanded": [list(p) for p in self.expand(m["viewId"], int(m["row"]), bool(m.get("collapse")))]}

    def _dispose(self, m: Mapping, session: str) -> dict:
        return {"disposed": self.views.pop(m["viewId"], None) is not None}

    def _command(self, m: Mapping, session: str) -> dict:
        return {"status": self.command(*self._ref(m), m.get("key") or "", m.get("column") or "", m.get("value"), m.get("idempotencyKey") or "")}

    def _row_count(self, m: Mapping, session: str) -> dict:
        return {"count": self.one(*self._ref(m), {"filter": m.get("filter") or []}).count().head()[0]}

    def _aggregates(self, m: Mapping, session: str) -> dict:
        specs = [{**a, "as": a.get("as") or f"{a['fn']}({a['column']})"} for a in m.get("aggregates") or []]
        return {"values": self._rows(self.one(*self._ref(m), {"filter": m.get("filter") or [], "aggregates": specs}).totals())[0]}

    def _distinct(self, m: Mapping, session: str) -> dict:
        limit = int(m.get("limit") or 10_000)
        got = [r[0] for r in self.one(*self._ref(m), {"filter": m.get("filter") or []}).distinct(m["column"], limit + 1).collect()]
        return {"values": got[:limit], "truncated": len(got) > limit}

    def _search(self, m: Mapping, session: str) -> dict:
        return {"values": [r[0] for r in self.one(*self._ref(m), {"filter": m.get("filter") or []}).starting_with(m["column"], m.get("prefix") or "", int(m.get("limit") or 100)).collect()]}

    def _rank(self, m: Mapping, session: str) -> dict:
        got = self.one(*self._ref(m), {"filter": m.get("filter") or [], "sort": m.get("sort") or []}).rank("__key", m["key"]).head()
        return {"rank": got[0] if got else None}

    def _watch_groups(self, m: Mapping, session: str) -> dict:
        source, params = self._ref(m)
        entry = self.entry(source, params)
        View(entry.table.read(), dict(m["view"]))
        watch = GroupWatch(entry.table, m["view"], float(m.get("tolerance") or 0))
        self.group_watches[session, self.key(source, params)] = watch  # one a session and table: a new one takes its place
        first = watch.poll()
        return {"watch": watch, "rows": self._rows(first) if first is not None else []}

    def _unwatch(self, m: Mapping, session: str) -> dict:
        return {"stopped": self.group_watches.pop((session, self.key(*self._ref(m))), None) is not None}

    def _alert(self, m: Mapping, session: str) -> dict:
        source, params = self._ref(m)
        alerts = self.alerts.setdefault(self.key(source, params), Alerts(self.entry(source, params).table))
        first = alerts.subscribe(m.get("ruleId") or "", m["predicate"]).poll()
        return {"ruleId": m["ruleId"], "fired": [r["__key"] for r in first.collect()] if first is not None else []}

    def _alert_off(self, m: Mapping, session: str) -> dict:
        alerts = self.alerts.get(self.key(*self._ref(m)))
        return {"stopped": bool(alerts and alerts.unsubscribe(m["ruleId"]))}

    def _push(self, m: Mapping, session: str) -> dict:
        return {"reload": self.push_config(m.get("config") or {})}

    def _get_rows(self, m: Mapping, session: str) -> dict:
        rows, unsupported = self.get_rows(*self._ref(m), m["request"], tuple(m.get("searchColumns") or ()), tuple(m.get("dateColumns") or ()))
        return {"rows": self._rows(rows), "unsupportedFilters": unsupported}

    def _scan(self, m: Mapping, session: str) -> dict:
        """All rows of a view, block by block, without holding them all."""
        size = int(m.get("batch") or 2_000)

        def batches():  # noqa: ANN202
            held = []
            for r in self.one(*self._ref(m), m.get("view") or {}).ordered().toLocalIterator():
                held.append(r.asDict(recursive=True))
                if len(held) == size:
                    yield held
                    held = []
            if held:
                yield held

        return {"batches": batches()}

    def _stats(self, m: Mapping, session: str) -> dict:
        return {"figures": dict(self.figures), "tables": {k: {"revision": e.table.rev, "holders": len(e.holders), "pins": e.pins} for k, e in self.entries.items()}, "views": len(self.views)}
