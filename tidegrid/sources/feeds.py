"""Spark data sources for feeds: paginated REST snapshots (batch) and message feeds (streaming)."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator, Mapping
from pathlib import Path
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from tidegrid.sources.frames import SnapshotEnd, Stomp, StompReader, backoff, socketio_decode, socketio_event

#: Kinds of feeds that configurations may name but no transport exists for.
UNAVAILABLE = ("amps", "solace")


class TransportUnavailable(RuntimeError):
    """transport-unavailable: a kind of feed that is known but not served."""


def fetch(url: str, headers: Mapping[str, str], tries: int = 4, timeout: float = 30) -> object:
    """A JSON document, with waits between tries."""
    for attempt in range(tries):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=dict(headers)), timeout=timeout) as answer:  # noqa: S310
                return json.loads(answer.read())
        except (OSError, ValueError):
            if attempt == tries - 1:
                raise
            time.sleep(backoff(attempt))
    raise RuntimeError("no tries")


def rows_of(document: object, path: str | None) -> list:
    """The array of records: the document, the array at a path, or the only array in its envelope."""
    if isinstance(document, list):
        return document
    if path:
        for part in path.split("."):
            document = document[part]  # type: ignore[index]
        return list(document)  # type: ignore[call-overload]
    arrays = [v for v in document.values() if isinstance(v, list)] if isinstance(document, dict) else []
    if len(arrays) != 1:
        raise ValueError("no array, or several, in the answer: name the path of the records")
    return arrays[0]


class Page(InputPartition):
    def __init__(self, url: str) -> None:
        self.url = url


class RestReader(DataSourceReader):
    """`pagination`: none, offset (pages are independent, one task each) or cursor (one task follows them)."""

    def __init__(self, schema, options: Mapping[str, str]) -> None:  # noqa: ANN001
        self.fields = schema.fieldNames()
        self.options = dict(options)

    def _url(self, **more: object) -> str:
        base = self.options["url"]
        return f"{base}{'&' if '?' in base else '?'}{urlencode(more)}" if more else base

    def _headers(self) -> dict[str, str]:
        return {k.removeprefix("header."): v for k, v in self.options.items() if k.startswith("header.")}

    def partitions(self) -> list[InputPartition]:
        if self.options.get("pagination", "none") != "offset":
            return [Page(self._url())]
        size, total = int(self.options["pageSize"]), int(self.options["total"])
        offset, limit = self.options.get("offsetParam", "offset"), self.options.get("limitParam", "limit")
        return [Page(self._url(**{offset: at, limit: size})) for at in range(0, max(total, 1), size)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        url: str | None = partition.url  # type: ignore[attr-defined]
        while url:
            document = fetch(url, self._headers())
            for record in rows_of(document, self.options.get("rowsPath")):
                yield tuple(record.get(f) for f in self.fields)
            cursor = document.get(self.options.get("cursorField", "next")) if isinstance(document, dict) and self.options.get("pagination") == "cursor" else None
            url = None if not cursor else cursor if str(cursor).startswith("http") else self._url(**{self.options.get("cursorParam", "cursor"): cursor})


class RestSource(DataSource):
    """spark.read.format("tidegrid-rest").schema(...).option("url", ...)."""

    @classmethod
    def name(cls) -> str:
        return "tidegrid-rest"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return RestReader(schema, self.options)


#: Opens a feed: options -> a function that gives the next text, or None when nothing came in a while.
Opener = Callable[[Mapping[str, str]], Callable[[], str | None]]
OPENERS: dict[str, Opener] = {}


def messages(kind: str, texts: list[str], reader: StompReader | None = None) -> list[tuple[str, str]]:
    """(body, headers as JSON) of a feed's texts."""
    if kind == "stomp":
        frames = (reader or StompReader()).feed("".join(texts))
        return [(f.body, json.dumps(f.headers)) for f in frames if f.command == "MESSAGE"]
    if kind == "socketio":
        decoded = [socketio_decode(t) for t in texts]
        return [(json.dumps(d[1]), json.dumps({"event": d[0]})) for k, _, d in decoded if k == "event" and isinstance(d, list) and len(d) > 1]
    return [(t, "{}") for t in texts]


def greeting(kind: str, options: Mapping[str, str]) -> list[str]:
    """What a subscriber says first: subscribe before the snapshot is asked for, so that no update is missed."""
    where = options.get("destination", "")
    if kind == "stomp":
        heads = {"id": "0", "destination": where} | ({"selector": options["selector"]} if "selector" in options else {})
        trigger = [Stomp("SEND", {"destination": options["trigger"]}, options.get("triggerBody", "")).encode()] if "trigger" in options else []
        return [Stomp("CONNECT", {"accept-version": "1.2", "host": options.get("host", "/"), "heart-beat": "10000,10000"}).encode(), Stomp("SUBSCRIBE", heads).encode(), *trigger]
    if kind == "socketio":
        return ["40", socketio_event("subscribe", {"destination": where})]
    first = {"type": "subscribe", "destination": where} | ({"selector": options["selector"]} if "selector" in options else {})
    return [json.dumps(first), *([options["triggerBody"]] if "triggerBody" in options else [])]


class FeedReader(SimpleDataSourceStreamReader):
    """Messages by number. What was handed out stays until it is committed, so that a batch can be read again; with the option
    `log` (a folder that outlives the driver, a stream's own) it stays there, so that this holds after a restart too.
    Without it, messages handed out and not committed before a restart can only be had from the feed's own snapshot."""

    def __init__(self, options: Mapping[str, str]) -> None:
        self.options = dict(options)
        self.kind = self.options.get("kind", "ws")
        if self.kind in UNAVAILABLE or self.kind not in OPENERS:
            raise TransportUnavailable(f"transport-unavailable: {self.kind}")
        self.next_text = OPENERS[self.kind](self.options)
        self.frames = StompReader()
        self.kept: dict[int, tuple] = {}
        self.count = 0
        self.log = Path(self.options["log"]) if "log" in self.options else None
        if self.log:
            self.log.mkdir(parents=True, exist_ok=True)
            for file in sorted(self.log.glob("*.json")):
                self.kept |= {row[0]: tuple(row) for row in json.loads(file.read_text(encoding="utf-8"))}
            self.count = max(self.kept, default=-1) + 1
        self.end = SnapshotEnd(self.options.get("endMode", "stream-end"), self.options.get("endHeader"), self.options.get("endValue"))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"n": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        texts, most = [], int(self.options.get("maxMessages", "1000"))
        first = self.count = max(self.count, start["n"])
        while len(texts) < most and (t := self.next_text()) is not None:
            texts.append(t)
        for body, headers in messages(self.kind, texts, self.frames):
            self.kept[self.count] = (self.count, body, headers, self.end(body, json.loads(headers)))
            self.count += 1
        if self.log and first < self.count:
            part = self.log / f"{first:020d}.part"
            part.write_text(json.dumps([self.kept[i] for i in range(first, self.count)]), encoding="utf-8")
            part.rename(part.with_suffix(".json"))
        return self._between(start["n"], self.count), {"n": self.count}

    def _between(self, start: int, end: int) -> Iterator[tuple]:
        missing = [i for i in range(start, end) if i not in self.kept]
        if missing:
            raise LookupError(f"messages {missing[0]} to {missing[-1]} were not kept over a restart: set the option log, or start from a new snapshot")
        return iter([self.kept[i] for i in range(start, end)])

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return self._between(start["n"], end["n"])

    def commit(self, end: dict) -> None:
        for i in [i for i in self.kept if i < end["n"]]:
            del self.kept[i]
        if self.log:
            # a file goes when all its messages are committed: when the next one begins at or before the end
            files = sorted(self.log.glob("*.json"))
            nexts = [*(int(f.stem) for f in files[1:]), self.count]
            for file, until in zip(files, nexts, strict=True):
                if until <= end["n"]:
                    file.unlink()


class FeedSource(DataSource):
    """spark.readStream.format("tidegrid-feed").option("kind", "stomp"): __seq, body, headers, snapshot_end."""

    @classmethod
    def name(cls) -> str:
        return "tidegrid-feed"

    def schema(self) -> str:
        return "__seq long, body string, headers string, snapshot_end boolean"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: ANN001, N802
        return FeedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RestSource)
    spark.dataSource.register(FeedSource)


def seed(spark: SparkSession, path: str, schema: str, streaming: bool = False) -> DataFrame:
    """JSON files as a snapshot, or as a stream of messages; the schema is always given, never guessed."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(schema).json(path)
