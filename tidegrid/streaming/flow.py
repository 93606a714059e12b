"""Flow control of subscribers, the life of a feed, and its figures."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

#: Shares of the limit of unacknowledged messages at which each step begins.
LADDER = ((1.0, "disconnect"), (0.75, "refresh"), (0.4, "conflate"))
STUCK_S = 30.0
#: While conflating, merged rows go out so often.
CONFLATE_S = 0.25


@dataclass
class Subscriber:
    """What to do with a delta by how far the acknowledgements lag: send, hold (and merge), refresh, or drop."""

    limit: int = 500
    sent: int = 0
    acked: int = 0
    held: dict[str, object] = field(default_factory=dict)
    state: str = "none"
    stuck_since: float | None = None
    flushed: float | None = None

    def ack(self, seq: int) -> None:
        self.acked = max(self.acked, min(seq, self.sent))

    def offer(self, rows: dict[str, object], now: float) -> tuple[str, dict[str, object]]:
        """(action, rows to send). Rows by key: held ones give way to newer ones."""
        lag = (self.sent - self.acked) / self.limit
        self.state = next((s for share, s in LADDER if lag >= share), "none")
        if self.state in ("refresh", "disconnect"):
            return self._lost(now), {}
        self.stuck_since = None
        self.held |= rows
        if self.state == "none":
            self.flushed = None
        elif self.flushed is None or now - self.flushed < CONFLATE_S:
            self.flushed = now if self.flushed is None else self.flushed
            return "hold", {}
        else:
            self.flushed = now
        out, self.held = self.held, {}
        self.sent += 1
        return "send", out

    def _lost(self, now: float) -> str:
        """Rows are of no use to who is so far behind: one refresh, then nothing, and an end if that lasts."""
        self.held = {}
        entered = self.stuck_since is None
        self.stuck_since = now if entered else self.stuck_since
        if now - self.stuck_since >= STUCK_S:
            self.state = "disconnect"
        return "drop" if self.state == "disconnect" else "refresh" if entered else "hold"


#: The states of a feed and where each can go.
LIFE = {
    "idle": {"connecting"}, "connecting": {"snapshotting", "live", "recovering", "failed"}, "snapshotting": {"live", "failed", "recovering"}, "live": {"stale", "recovering", "idle", "failed"},
    "stale": {"live", "recovering", "failed", "idle"}, "recovering": {"connecting", "snapshotting", "failed"}, "failed": {"connecting", "idle"},
}


@dataclass
class Feed:
    """A feed's state; goes live only when its snapshot is whole, and keeps updates that come before."""

    state: str = "idle"
    buffered: list = field(default_factory=list)

    def go(self, state: str) -> None:
        if state not in LIFE[self.state]:
            raise ValueError(f"from {self.state} to {state}")
        self.state = state

    def update(self, batch: object) -> list:
        """Updates that may be applied now."""
        if self.state in ("connecting", "snapshotting"):
            self.buffered.append(batch)
            return []
        return [batch]

    def end_snapshot(self, whole: bool) -> list:
        """Go live with the updates that were kept, or fail."""
        self.go("live" if whole else "failed")
        out, self.buffered = (self.buffered if whole else []), []
        return out


class Meter:
    """Messages a second over the last seconds, and percentiles of the last values."""

    def __init__(self, seconds: float = 5.0, most: int = 2_000) -> None:
        self.seconds, self.events, self.values = seconds, deque(), deque(maxlen=most)

    def mark(self, now: float, n: int = 1) -> None:
        self.events.append((now, n))
        while self.events and self.events[0][0] <= now - self.seconds:
            self.events.popleft()

    def rate(self, now: float) -> float:
        return sum(n for t, n in self.events if t > now - self.seconds) / self.seconds

    def record(self, value: float) -> None:
        self.values.append(value)

    def percentiles(self) -> dict[str, float]:
        if not self.values:
            return {}
        s = sorted(self.values)
        at = lambda p: s[min(len(s) - 1, int(p * len(s)))]
        return {"p50": at(0.5), "p95": at(0.95), "p99": at(0.99), "max": s[-1]}


@dataclass
class MicroBatch:
    """Rows by key until it is time to flush; refuses what a bounded queue cannot hold."""

    most_ms: float = 100
    most_rows: int = 1_000
    queue: int = 10_000
    rows: dict[str, dict] = field(default_factory=dict)
    since: float | None = None
    came: int = 0
    went: int = 0

    def add(self, key: str, fields: dict, now_ms: float) -> bool:
        if key not in self.rows and len(self.rows) >= self.queue:
            return False
        self.rows[key] = self.rows.get(key, {}) | fields
        self.came += 1
        self.since = now_ms if self.since is None else self.since
        return True

    def due(self, now_ms: float) -> bool:
        return bool(self.rows) and (len(self.rows) >= self.most_rows or now_ms - (self.since or now_ms) >= self.most_ms)

    def flush(self) -> dict[str, dict]:
        out, self.rows, self.since = self.rows, {}, None
        self.went += len(out)
        return out

    @property
    def ratio(self) -> float:
        """Rows out for each row in: what conflation saved."""
        return self.went / self.came if self.came else 1.0
