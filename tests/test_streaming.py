"""Live tables, watches, feeds, flow and the hub."""

import json

import pytest
from pyspark.sql import functions as F

from tidegrid.hub import Hub
from tidegrid.plans import config as cfg
from tidegrid.sources import feeds, flatten, frames, infer
from tidegrid.streaming.flow import Feed, Meter, MicroBatch, Subscriber
from tidegrid.streaming.live import LiveTable, as_messages
from tidegrid.streaming.watch import Alerts, GroupWatch, MemberWatch, RowDeltas

SCHEMA = "__key string, __seq long, __op string, __present array<string>, desk string, pnl double"


def batch(spark, *rows):
    return spark.createDataFrame([(k, s, op, None, d, p) for k, s, op, d, p in rows], SCHEMA)


@pytest.fixture
def live(spark, tmp_path):
    return LiveTable(spark, f"file://{tmp_path}/t", "desk string, pnl double", buckets=3)


def state(table):
    return {r["__key"]: (r["desk"], r["pnl"]) for r in table.read().collect()}


def test_versions_and_changes(spark, live):
    assert live.apply(batch(spark, ("a", 1, "insert", "X", 1.0), ("b", 2, "insert", "Y", 2.0))) == 1
    assert live.apply(batch(spark)) == 1
    assert live.apply(batch(spark, ("a", 3, "delete", None, None), ("c", 4, "update", "X", 3.0), (None, 5, "update", "X", 9.0))) == 2
    assert state(live) == {"b": ("Y", 2.0), "c": ("X", 3.0)}
    rows, gone, reset = live.changed_since(1)
    assert [r["__key"] for r in rows.collect()] == ["c"] and [r["__key"] for r in gone.collect()] == ["a"] and not reset
    live.apply(batch(spark, ("a", 6, "insert", "Z", 1.0)))
    assert live.changed_since(1)[1].count() == 0
    assert {r["__key"] for r in live.read(1).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        live.replace(live.read(), expected=7)
    rev = live.replace(live.read().where("__key <> 'b'"), expected=2)
    assert [r["__key"] for r in live.changed_since(rev - 1)[1].collect()] == ["b"]
    live.truncate()
    assert state(live) == {}


def test_a_batch_that_comes_twice_counts_once(spark, live):
    assert live.apply(batch(spark, ("a", 1, "insert", "X", 1.0)), batch=0) == 1
    assert live.apply(batch(spark, ("a", 1, "insert", "X", 1.0)), batch=0) == 1


def test_old_versions_go(spark, tmp_path):
    table = LiveTable(spark, f"file://{tmp_path}/t", "desk string, pnl double", buckets=2, keep=2)
    for i in range(4):
        table.apply(batch(spark, ("a", i, "update", "X", float(i))))
    assert table.versions() == [3, 4] and table.changed_since(1)[2]


def test_follow_a_stream(spark, live, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps({"id": f"k{j}", "n": 10 * i + j, "desk": "D", "pnl": float(i)}) for j in range(3)))
    source = feeds.seed(spark, f"file://{tmp_path}/in", "id string, n long, desk string, pnl double", streaming=True)
    messages, _ = as_messages(source, ["id"], F.col("n"))
    seen = []
    live.follow(messages.drop("id", "n"), f"file://{tmp_path}/cp", seen.append).awaitTermination()
    assert seen and state(live) == {f"k{j}": ("D", 1.0) for j in range(3)}


def test_watches(spark, live):
    live.apply(batch(spark, ("a", 1, "insert", "X", 1.0), ("b", 2, "insert", "Y", -5.0)))
    deltas, groups = RowDeltas(live), GroupWatch(live, {"groupBy": ["desk"], "aggregates": {"pnl": "sum"}})
    members = MemberWatch(live, {"filter": [{"column": "pnl", "op": "greaterThan", "value": 0}]})
    alerts = Alerts(live)
    first = alerts.subscribe("r", "pnl < 0").poll()
    assert [tuple(r) for r in first.collect()] == [("fired", "b")]
    assert groups.poll().count() == 2 and groups.poll() is None and members.poll() is None and deltas.poll() is None
    live.apply(batch(spark, ("b", 3, "update", "Y", 5.0), ("c", 4, "insert", "X", -1.0)))
    assert {r["__key"] for r in deltas.poll().rows.collect()} == {"b", "c"}
    assert RowDeltas(live, 1).notify() == {"rev": 2, "changed": 2, "removed": 0}
    assert {(r["desk"], r["change"], r["pnl"]) for r in groups.poll().collect()} == {("X", "update", 0.0), ("Y", "update", 5.0)}
    events, payload = members.poll()
    assert [tuple(r) for r in events.collect()] == [("entered", "b")] and payload.count() == 1
    assert {tuple(r) for r in alerts.poll()["r"].collect()} == {("fired", "c"), ("cleared", "b")}
    with pytest.raises(ValueError):
        alerts.subscribe("s", "nothing > 1")


def test_hub(spark, tmp_path):
    hub = Hub(spark, f"file://{tmp_path}/hub")
    ref = {"datasourceId": "pos", "params": {"client": "1"}}
    say = lambda kind, **more: hub.handle({"id": "1", "type": kind, "ref": ref, **more})
    assert say("hello", protocolVersion=9)["code"] == "protocol-version-mismatch" and say("hello", protocolVersion=1)["status"] == "current"
    source = {"id": "pos", "keyColumns": ["id"], "columns": "desk string, pnl double", "buckets": 2}
    assert [d["status"] for d in say("bootstrap", datasources=[source, {**source, "buckets": 3}, {"id": "x"}])["datasources"]] == ["registered", "conflict", "invalid"]
    assert say("rowCount")["code"] == "not-subscribed" and say("nothing")["code"] == "unknown-verb"
    assert say("subscribe")["mode"] == "shared"
    for i, (k, d, p) in enumerate([("a", "X", "1.5"), ("b", "Y", "2")]):
        assert say("command", key=k, column="desk", value=d, idempotencyKey=f"{i}")["status"] == "applied"
        assert say("command", key=k, column="pnl", value=float(p), idempotencyKey=f"{i}p")["status"] == "applied"
    assert say("command", key="a", column="pnl", value=1.0, idempotencyKey="0")["status"] == "duplicate"
    assert say("rowCount")["count"] == 2 and say("distinctValues", column="desk")["values"] == ["X", "Y"] and say("searchValues", column="desk", prefix="x")["values"] == ["X"]
    assert say("aggregates", aggregates=[{"column": "pnl", "fn": "sum"}])["values"] == {"sum(pnl)": 3.5}
    assert say("rank", key="b", sort=[{"column": "pnl", "sort": "desc"}])["rank"] == 0
    view = say("openView", view={"groupBy": ["desk"], "aggregates": {"pnl": "sum"}})["viewId"]
    assert say("readWindow", viewId=view, start=0, end=1)["total"] == 2
    assert say("expandRow", viewId=view, row=0)["expanded"] == [["X"]]
    rows = say("readWindow", viewId=view)["rows"]
    assert [r["__level"] for r in rows] == [0, 1, 0]
    assert say("expandRow", viewId=view, row=0, collapse=True)["expanded"] == [] and say("disposeView", viewId=view)["disposed"]
    assert say("openView", view={"sort": [{"column": "zzz"}]})["type"] == "error"
    assert say("alertSubscribe", ruleId="r", predicate="pnl > 1.8")["fired"] == ["b"] and len(say("watchGroups", view={"groupBy": ["desk"]})["rows"]) == 2
    assert [len(b) for b in say("scan", batch=1)["batches"]] == [1, 1]
    assert say("getRows", request={"startRow": 0, "endRow": 1, "sortModel": [{"colId": "pnl", "sort": "desc"}]})["rows"][0]["__key"] == "b"
    assert say("pushConfig", config={"datasources": [{**source, "lifecycle": {"prewarm": True}}]})["reload"] == {"pos": "live"}
    assert say("pin")["pins"] == 1 and say("unsubscribe")["type"] == "result" and say("rowCount")["count"] == 2
    assert say("unpin")["pins"] == 0 and say("rowCount")["code"] == "not-subscribed"


def test_flow():
    s = Subscriber(limit=10)
    assert [s.offer({"k": i}, 0.0)[0] for i in range(5)] == ["send"] * 4 + ["hold"]
    s.ack(4)
    assert s.offer({"j": 1}, 1.0) == ("send", {"k": 4, "j": 1})
    # who never acknowledges climbs every rung: merged rows now and then, one refresh, silence, the end
    s, said = Subscriber(limit=10), []
    for i in range(600):
        action, out = s.offer({f"k{i % 7}": i}, i * 0.1)
        said.append(action)
        assert len(s.held) <= 7 and (action == "send") == bool(out)
    once = [a for a, b in zip(said, [None, *said], strict=False) if a != b]
    assert said[:4] == ["send"] * 4 and said.count("send") == 8 and said.count("refresh") == 1 and once[-1] == "drop"
    began, ended = said.index("refresh"), said.index("drop")
    assert set(said[began + 1 : ended]) == {"hold"} and (ended - began) * 0.1 == pytest.approx(30, abs=0.11)
    s.ack(8)
    assert s.offer({"z": 1}, 61.0)[0] == "send" and s.state == "none"
    feed = Feed()
    feed.go("connecting")
    feed.go("snapshotting")
    assert feed.update("u") == [] and feed.end_snapshot(True) == ["u"] and feed.update("v") == ["v"]
    with pytest.raises(ValueError):
        feed.go("connecting")
    m = MicroBatch(most_rows=2, queue=2)
    assert m.add("a", {"x": 1}, 0) and m.add("a", {"y": 2}, 1) and m.add("b", {}, 2) and not m.add("c", {}, 3)
    assert m.due(3) and m.flush() == {"a": {"x": 1, "y": 2}, "b": {}} and m.ratio == pytest.approx(2 / 3)
    meter = Meter()
    meter.mark(0.0, 10)
    assert meter.rate(1.0) == 2.0 and meter.rate(6.0) == 0.0


def test_frames():
    reader = frames.StompReader()
    wire = frames.Stomp("MESSAGE", {"a:b": "x\ny"}, "body").encode() + "\n" + frames.Stomp("MESSAGE", {"content-length": "3"}, "a\0b").encode()
    got = [f for i in range(0, len(wire), 3) for f in reader.feed(wire[i : i + 3])]
    assert [(f.headers.get("a:b"), f.body) for f in got] == [("x\ny", "body"), (None, "a\0b")]
    assert frames.socketio_decode(frames.socketio_event("upd", {"a": 1}, namespace="/n")) == ("event", "/n", ["upd", {"a": 1}])
    assert frames.socketio_decode("2")[0] == "ping" and frames.heartbeat((1000, 500), "0,2000") == (2000, 0) and frames.backoff(10) == 30.0
    end = frames.SnapshotEnd("count-reached", count=3)
    assert not end("", rows=2) and end("", rows=1) and end.whole()


def test_feed_source(spark):
    texts = iter([json.dumps({"n": 1}), json.dumps({"n": 2}), None])
    feeds.OPENERS["ws"] = lambda options: lambda: next(texts, None)
    reader = feeds.FeedReader({"kind": "ws", "endMode": "substring", "endValue": "2"})
    rows, at = reader.read(reader.initialOffset())
    assert [(r[0], r[3]) for r in rows] == [(0, False), (1, True)] and at == {"n": 2}
    assert len(list(reader.readBetweenOffsets({"n": 0}, {"n": 2}))) == 2
    with pytest.raises(feeds.TransportUnavailable):
        feeds.FeedReader({"kind": "solace"})
    assert feeds.rows_of({"data": [1], "n": 1}, None) == [1] and feeds.rows_of({"a": {"b": [2]}}, "a.b") == [2]


def test_feed_source_after_a_restart(tmp_path):
    coming = [json.dumps({"n": i}) for i in range(6)]
    queue = iter([*coming[:3], None, *coming[3:], None])
    feeds.OPENERS["ws"] = lambda options: lambda: next(queue, None)
    options = {"kind": "ws", "log": str(tmp_path / "log")}
    first = feeds.FeedReader(options)
    rows, at = first.read({"n": 0})
    assert [r[0] for r in rows] == [0, 1, 2] and at == {"n": 3}
    # a batch that was planned and not committed comes again from the log; numbers go on
    second = feeds.FeedReader(options)
    assert [r[0] for r in second.readBetweenOffsets({"n": 0}, {"n": 3})] == [0, 1, 2]
    second.commit({"n": 3})
    rows, at = second.read({"n": 3})
    assert [(r[0], json.loads(r[1])["n"]) for r in rows] == [(3, 3), (4, 4), (5, 5)] and at == {"n": 6}
    second.commit({"n": 6})
    assert list((tmp_path / "log").iterdir()) == []
    # without a log numbers go on from the offset, and what is lost is told
    queue = iter([coming[0], None])
    third = feeds.FeedReader({"kind": "ws"})
    rows, at = third.read({"n": 6})
    assert [r[0] for r in rows] == [6] and at == {"n": 7}
    with pytest.raises(LookupError):
        third.readBetweenOffsets({"n": 4}, {"n": 6})


def test_flatten_and_coerce(spark):
    body = json.dumps([{"id": "1", "risk": {"dv01": 2.5}, "legs": [{"r": "a"}, {"r": "b"}], "price": "99-16+", "q": "n/a"}, {"id": "2", "risk": None, "legs": [], "price": "-1-08", "q": "7.9"}])
    df = flatten.body_rows(spark.createDataFrame([(body,), ("nope",)], "b string"), "b", "id string, risk struct<dv01: double>, legs array<struct<r: string>>, price string, q string")
    rules = flatten.Flatten(arrays={"legs": flatten.ArrayRule("pin", 2)})
    flat = flatten.coerce(flatten.flatten(df, rules), "price", "ticks-to-decimal", "px")
    got = {r["id"]: r.asDict() for r in flatten.typed(flat, {"id": "string", "risk_dv01": "f64", "legs_1_r": "string", "px": "float", "q": "integer", "gone": "string"}).collect()}
    assert got["1"] == {"id": "1", "risk_dv01": 2.5, "legs_1_r": "b", "px": 99.515625, "q": None, "gone": None}
    assert got["2"]["px"] == -1.25 and got["2"]["q"] == 7 and got["2"]["risk_dv01"] is None
    child = flatten.children(df, F.col("id"), "legs").orderBy("__key").collect()
    assert [(r["__parentKey"], r["__index"], r["r"]) for r in child] == [("1", 0, "a"), ("1", 1, "b")]
    assert flatten.template("/t/{a}", {"a": 1}) == "/t/1"
    with pytest.raises(KeyError):
        flatten.template("{b}", {})


def test_infer(spark):
    df = spark.createDataFrame([(f"{i}", f"2026-01-{i % 28 + 1:02d}", "Y" if i % 2 else "N", float(i)) for i in range(50)], "a string, b string, c string, d double")
    assert {c: d.type for c, d in infer.infer(df).items()} == {"a": "string", "b": "date", "c": "boolean", "d": "float"}


def test_config():
    old = {"id": "d", "batch": {"maxMs": 1}, "keyColumns": ["a"]}
    assert cfg.reload_class(old, {**old, "batch": {"maxMs": 2}})[0] == "live" and cfg.reload_class(old, {**old, "batch": {"maxMs": 2}, "keyColumns": ["b"]})[0] == "rebuild" and cfg.reload_class(old, old)[0] == "none"
    good = {"connections": [{"id": "c", "kind": "stomp"}], "datasources": [{"id": "d", "connectionRef": "c", "keyColumns": ["a"]}]}
    assert cfg.problems(good) == [] and len(cfg.problems({"connections": [{"id": "c", "kind": "fax", "password": "x"}], "datasources": [{"id": "d"}]})) == 4
    exported = cfg.bundle(good, 3)
    assert cfg.import_bundle({}, exported)[1]["datasources"]["added"] == ["d"] and cfg.import_bundle({}, exported, "replace-all")[0]["bundleVersion"] == 4
    assert cfg.import_bundle({}, {**exported, "checksum": "0"}, "replace-all")[2]
