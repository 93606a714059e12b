"""Configuration of datasources: validation, what a change asks for, and bundles of it."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping
from copy import deepcopy

#: Weakest to strongest.
RELOAD = ("none", "live", "resubscribe", "rebuild", "restart")
#: What a change of each part of a datasource or connection asks for; the nearest named ancestor holds.
DATASOURCE_RELOAD = {
    "id": "rebuild", "connectionRef": "resubscribe", "schemaRef": "rebuild", "keyColumns": "rebuild", "opField": "rebuild", "softDelete": "rebuild", "softDelete.reapAfterMs": "live",
    "coercions": "rebuild", "batch": "live", "conflation": "live", "params": "resubscribe", "sharing": "rebuild", "lifecycle": "live", "updates": "resubscribe", "snapshot": "resubscribe", "flatten": "rebuild",
}
CONNECTION_RELOAD = {
    "id": "restart", "kind": "restart", "url": "resubscribe", "vhost": "resubscribe", "heartbeat": "resubscribe", "auth": "restart", "credentialRef": "resubscribe", "reconnect": "live",
    "failover": "resubscribe", "tls": "restart", "updatesUrl": "resubscribe", "updatesKind": "restart",
}
COLLECTIONS = ("connections", "datasources", "artifacts", "rules")
SECRET = re.compile(r"(?i)(password|passwd|secret|token|api_?key)$")
KINDS = {"stomp", "ws", "socketio", "rest", "file", "amps", "solace"}
SNAPSHOTS = ("trigger-reply", "rest-then-subscribe", "subscribe-with-replay", "subscribe-only", "file-seed")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def checksum(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def changed_paths(old: object, new: object, at: str = "") -> list[str]:
    """Paths at which two configurations differ."""
    if isinstance(old, Mapping) and isinstance(new, Mapping):
        return [p for k in sorted({*old, *new}) for p in changed_paths(old.get(k), new.get(k), f"{at}.{k}".lstrip("."))]
    return [] if canonical(old) == canonical(new) else [at]


def reload_class(old: Mapping, new: Mapping, classes: Mapping[str, str] = DATASOURCE_RELOAD) -> tuple[str, dict[str, str]]:
    """The strongest class among the changes, and each change's own. What no ancestor names asks for a rebuild."""
    each = {}
    for path in changed_paths(old, new):
        parts = path.split(".")
        names = [".".join(parts[:i]) for i in range(len(parts), 0, -1)]
        each[path] = next((classes[n] for n in names if n in classes), "rebuild")
    return max(each.values(), key=RELOAD.index, default="none"), each


def problems(config: Mapping) -> list[str]:
    """What is wrong with a configuration of connections and datasources."""
    out = []
    connections = {c.get("id"): c for c in config.get("connections") or []}
    artifacts = {a.get("id") for a in config.get("artifacts") or []}
    for c in config.get("connections") or []:
        if c.get("kind") not in KINDS:
            out.append(f"connection {c.get('id')!r}: kind {c.get('kind')!r}")
        out += [f"connection {c.get('id')!r}: {p} holds a secret; use credentialRef" for p in secrets(c)]
    seen = set()
    for d in config.get("datasources") or []:
        name = d.get("id")
        if not name or name in seen:
            out.append(f"datasource {name!r}: no id, or one that is taken")
        seen.add(name)
        if d.get("connectionRef") not in connections:
            out.append(f"datasource {name!r}: connection {d.get('connectionRef')!r} is not there")
        if artifacts and d.get("schemaRef") not in artifacts:
            out.append(f"datasource {name!r}: schema {d.get('schemaRef')!r} is not there")
        if not d.get("keyColumns"):
            out.append(f"datasource {name!r}: no key columns")
        mode = (d.get("snapshot") or {}).get("mode")
        if mode is not None and mode not in SNAPSHOTS:
            out.append(f"datasource {name!r}: snapshot mode {mode!r}")
        if (sep := (d.get("flatten") or {}).get("separator", "_")) not in "_/-:":
            out.append(f"datasource {name!r}: separator {sep!r}")
    return out


def secrets(value: object, at: str = "") -> list[str]:
    if isinstance(value, Mapping):
        own = [f"{at}.{k}".lstrip(".") for k, v in value.items() if SECRET.search(str(k)) and isinstance(v, str) and v]
        return own + [p for k, v in value.items() for p in secrets(v, f"{at}.{k}".lstrip("."))]
    if isinstance(value, list):
        return [p for i, v in enumerate(value) for p in secrets(v, f"{at}.{i}".lstrip("."))]
    return []


def reconcile(app_version: int, app_sum: str | None, own_version: int, own_sum: str | None) -> str:
    """Whose configuration is newer; of one version with two contents: a conflict."""
    if app_version != own_version:
        return "app-newer" if app_version > own_version else "hub-newer"
    return "conflict" if app_sum is not None and own_sum is not None and app_sum != own_sum else "current"


def _id(collection: str, item: Mapping) -> str:
    return f"{item['id']}@v{item.get('version', 1)}" if collection == "artifacts" else item["id"]


def bundle(config: Mapping, version: int) -> dict:
    """An export: all collections, with a checksum over them."""
    content = {k: list(config.get(k) or []) for k in COLLECTIONS}
    return {**content, "bundleVersion": version, "checksum": checksum(content)}


def bundle_diff(incoming: Mapping, current: Mapping) -> dict[str, dict[str, list[str]]]:
    out = {}
    for k in COLLECTIONS:
        a, b = ({_id(k, x): canonical(x) for x in side.get(k) or []} for side in (current, incoming))
        both = a.keys() & b.keys()
        same = {i for i in both if a[i] == b[i]}
        out[k] = {"added": sorted(b.keys() - a.keys()), "changed": sorted(both - same), "removed": sorted(a.keys() - b.keys()), "unchanged": sorted(same)}
    return out


def import_bundle(current: Mapping, incoming: Mapping, mode: str = "dry-run") -> tuple[dict, dict, list[str]]:
    """(configuration after, difference, errors). Only a bundle without errors is applied, and then as a whole."""
    if mode not in ("dry-run", "merge-incoming", "merge-local", "replace-all"):
        raise ValueError(f"import mode {mode!r}")
    diff, errors = bundle_diff(incoming, current), problems(incoming)
    if incoming.get("checksum") != checksum({k: list(incoming.get(k) or []) for k in COLLECTIONS}):
        errors.append("the checksum does not fit the content")
    if errors or mode == "dry-run":
        return dict(current), diff, errors
    after = {}
    for k in COLLECTIONS:
        items = {} if mode == "replace-all" else {_id(k, x): x for x in current.get(k) or []}
        for x in incoming.get(k) or []:
            if mode != "merge-local" or _id(k, x) not in items:
                items[_id(k, x)] = deepcopy(x)
        after[k] = list(items.values())
    after["bundleVersion"] = max(current.get("bundleVersion") or 0, incoming.get("bundleVersion") or 0) + 1
    return after, diff, []
