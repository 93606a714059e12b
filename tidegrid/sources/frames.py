"""Frames of the feeds' transports: STOMP 1.2, Engine.IO / socket.io packets, and the messages of a plain WebSocket."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

#: STOMP's escapes in headers.
ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", ":": "\\c"}
UNESCAPES = {v: k for k, v in ESCAPES.items()}


class FrameError(ValueError):
    """Bytes that are no frame."""


@dataclass(frozen=True)
class Stomp:
    command: str
    headers: dict[str, str] = field(default_factory=dict)
    body: str = ""

    def encode(self) -> str:
        plain = self.command in ("CONNECT", "CONNECTED")
        head = [f"{k if plain else escape(k)}:{v if plain else escape(v)}" for k, v in self.headers.items()]
        return "\n".join([self.command, *head, "", self.body]) + "\0"


def escape(text: str) -> str:
    return "".join(ESCAPES.get(c, c) for c in text)


def unescape(text: str) -> str:
    out, i = [], 0
    while i < len(text):
        pair = text[i : i + 2]
        if text[i] == "\\":
            if pair not in UNESCAPES:
                raise FrameError(f"escape {pair!r}")
            out.append(UNESCAPES[pair])
            i += 2
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


class StompReader:
    """Frames from chunks of text, wherever these are cut; line ends between frames are heartbeats."""

    def __init__(self) -> None:
        self.held = ""
        self.heartbeats = 0

    def feed(self, chunk: str) -> list[Stomp]:
        self.held += chunk
        out = []
        while True:
            before = len(self.held)
            self.held = self.held.lstrip("\r\n")
            self.heartbeats += before - len(self.held)
            head, blank, rest = self.held.partition("\n\n")
            if "\r\n\r\n" in self.held and (not blank or self.held.index("\r\n\r\n") < len(head)):
                head, blank, rest = self.held.partition("\r\n\r\n")
            if not blank:
                return out
            lines = [line.rstrip("\r") for line in head.split("\n")]
            headers: dict[str, str] = {}
            plain = lines[0] in ("CONNECT", "CONNECTED")
            for line in lines[1:]:
                k, colon, v = line.partition(":")
                if not colon:
                    raise FrameError(f"header {line!r}")
                headers.setdefault(k if plain else unescape(k), v if plain else unescape(v))  # the first of a name holds
            size = headers.get("content-length")
            if size is not None:
                raw = rest.encode()
                if len(raw) <= int(size):
                    return out
                body, left = raw[: int(size)].decode(), raw[int(size) :].decode()
                if not left.startswith("\0"):
                    raise FrameError("no end after content-length")
                self.held = left[1:]
            else:
                if "\0" not in rest:
                    return out
                body, _, self.held = rest.partition("\0")
            out.append(Stomp(lines[0], headers, body))


def heartbeat(ours: tuple[int, int], theirs: str) -> tuple[int, int]:
    """(we send every, we expect every) milliseconds, 0 for never, from both sides' offers."""
    can, want = (int(x) for x in theirs.split(","))
    return (max(ours[0], want) if ours[0] and want else 0), (max(ours[1], can) if ours[1] and can else 0)


def socketio_decode(packet: str) -> tuple[str, str, object]:
    """(kind, namespace, data) of an Engine.IO text packet."""
    kinds = {"0": "open", "1": "close", "2": "ping", "3": "pong", "6": "noop"}
    if not packet:
        raise FrameError("an empty packet")
    if packet[0] != "4":
        if packet[0] not in kinds:
            raise FrameError(f"packet {packet[0]!r}")
        return kinds[packet[0]], "/", json.loads(packet[1:]) if packet[0] == "0" else packet[1:]
    inner = {"0": "connect", "1": "disconnect", "2": "event", "3": "ack", "4": "error"}
    if packet[1:2] not in inner:
        raise FrameError(f"message {packet[1:2]!r}")
    rest, namespace = packet[2:], "/"
    if rest.startswith("/"):
        namespace, _, rest = rest.partition(",")
    rest = rest.lstrip("0123456789")
    return inner[packet[1]], namespace, json.loads(rest) if rest else None


def socketio_event(name: str, *data: object, namespace: str = "/") -> str:
    at = "" if namespace == "/" else f"{namespace},"
    return f"42{at}{json.dumps([name, *data], separators=(',', ':'))}"


@dataclass
class SnapshotEnd:
    """When a snapshot is whole: a sentinel header, body or text, a count, or the stream's end."""

    mode: str = "stream-end"
    header: str | None = None
    value: str | None = None
    count: int | None = None
    seen: int = 0

    def __call__(self, body: str, headers: dict[str, str] | None = None, rows: int = 0) -> bool:
        """Whether this message ends the snapshot; counts rows on the way."""
        self.seen += rows
        match self.mode:
            case "sentinel-header":
                return (headers or {}).get(self.header or "") == self.value
            case "sentinel-body":
                return body.strip() == self.value
            case "substring":
                return (self.value or "\0") in body
            case "count-reached":
                return self.count is not None and self.seen >= self.count
            case "stream-end":
                return False
        raise FrameError(f"end of snapshot by {self.mode!r}")

    def whole(self) -> bool:
        """Whether the declared count (if any) was met; a snapshot that falls short must not go live."""
        return self.count is None or self.seen == self.count


def backoff(attempt: int, initial: float = 1.0, factor: float = 2.0, most: float = 30.0) -> float:
    """Seconds to wait before an attempt to reconnect."""
    return min(most, initial * factor**attempt)


def next_url(urls: list[str], failures: int, each: int = 3) -> str:
    """Fail over to the next address once one has failed `each` times."""
    return urls[(failures // each) % len(urls)]
