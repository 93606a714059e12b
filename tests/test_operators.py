"""Views, diffs and merges on small tables."""

import pytest
from pyspark.sql import functions as F

from tidegrid.operators import diff, merge
from tidegrid.operators.view import View
from tidegrid.plans.gridmodel import mode, refresh_routes, view_request
from tidegrid.plans.viewspec import SpecError, ViewSpec


def col(name):
    return {"k": "col", "name": name}


@pytest.fixture(scope="module")
def desks(spark):
    rows = [("a", "Govies", "US", 10, 100.0, 0), ("b", "Govies", "EU", 20, 50.0, 1), ("c", "EM", "US", 5, 200.0, 2), ("d", "EM", None, 5, 300.0, 3), ("e", None, "", None, None, 4)]
    return spark.createDataFrame(rows, "__key string, desk string, ccy string, qty int, px double, __seq long")


def keys(df):
    return [r["__key"] for r in df.collect()]


def test_sort_and_window(desks):
    view = View(desks, {"sort": [{"column": "qty", "sort": "asc"}, {"column": "px", "dir": "desc"}]})
    assert keys(view.rows()) == ["d", "c", "a", "b", "e"]
    assert keys(view.rows(1, 3)) == ["c", "a"] and keys(view.rows(-5, 1)) == ["d"] and keys(view.rows(9, 12)) == [] and keys(view.rows(3, 2)) == []
    assert keys(View(desks, {"sort": [{"column": "qty", "sort": "desc"}]}).rows()) == ["e", "b", "a", "c", "d"]
    assert [view.rank("__key", k).head()[0] for k in "dcabe"] == [0, 1, 2, 3, 4] and view.rank("__key", "zz").head() is None


def test_tree(desks):
    view = View(desks, {"groupBy": ["desk", "ccy"], "aggregates": [{"column": "px", "fn": "sum", "as": "px"}], "sort": [{"column": "desk", "sort": "desc"}]})
    shown = [(r["__level"], r["desk"], r["ccy"], r["__count"], r["px"]) for r in view.tree([("EM",), ("EM", None), ("Govies", "US")]).collect()]
    assert shown == [(0, None, None, 1, 0.0), (0, "Govies", None, 2, 150.0), (0, "EM", None, 2, 500.0), (1, "EM", "US", 1, 200.0), (1, "EM", None, 1, 300.0), (2, "EM", None, None, 300.0)]
    assert [r["__expanded"] for r in view.tree([("EM",)]).collect()] == [False, False, True, False, False]


def test_levels_tell_null_groups_from_totals(desks):
    got = {(r["__level"], r["desk"], r["ccy"]): r["__count"] for r in View(desks, {"groupBy": ["desk", "ccy"]}).levels().collect()}
    assert got[0, "EM", None] == 2 and got[1, "EM", None] == 1 and got[1, None, ""] == 1 and len(got) == 8


def test_pivot(desks):
    spec = {"groupBy": ["desk"], "splitBy": ["ccy"], "aggregates": {"px": "sum"}}
    view = View(desks, spec)
    assert view.pivot_values() == ["", "EU", "US", "null"]
    got = {r["desk"]: r.asDict() for r in view.pivot().collect()}
    assert got["Govies"]["US|px"] == 100.0 and got["Govies"]["null|px"] is None and got["EM"]["null|px"] == 300.0
    bars = View(desks.withColumn("ccy", F.lit("a|b")), spec)
    assert bars.pivot_values() == ["a¦b"]


def test_computed_over_computed_and_nodes(desks):
    mv = {"k": "bin", "op": "mul", "l": col("qty"), "r": col("px")}
    ratio = {"k": "bin", "op": "div", "l": {"k": "agg", "fn": "sum", "col": "mv"}, "r": {"k": "agg", "fn": "sum", "col": "qty"}}
    spec = {"computed": [{"as": "mv", "expr": mv}, {"as": "wpx", "expr": ratio}], "groupBy": ["desk"]}
    got = {r["desk"]: r["wpx"] for r in View(desks, spec).levels().collect()}
    assert got["Govies"] == pytest.approx(2000 / 30) and got["EM"] == 250.0 and got[None] is None
    flat = View(desks, {"computed": spec["computed"], "filter": [{"column": "wpx", "op": "greaterThan", "value": 1}]})
    assert flat.filtered().count() == 5


def test_spec_says_all_that_is_wrong(desks):
    bad = {"sort": [{"column": "x"}], "groupBy": ["y"], "aggregates": {"px": "mode"}, "filter": [{"column": "z", "op": "equals"}], "computed": [{"as": "c", "expr": {"k": "no"}}]}
    with pytest.raises(SpecError) as e:
        View(desks, bad)
    assert len(e.value.problems) == 5
    circle = {"computed": [{"as": "a", "expr": {"k": "agg", "fn": "sum", "col": "px"}}, {"as": "b", "expr": {"k": "agg", "fn": "sum", "col": "a"}}]}
    with pytest.raises(SpecError):
        View(desks, circle)
    assert ViewSpec.parse({"aggregates": [{"column": "px", "fn": "mean"}]}).aggregates[0].fn == "avg"


def test_grid_request():
    spec, unsupported = view_request(
        {"rowGroupCols": [{"id": "desk"}, {"id": "ccy"}], "groupKeys": ["EM"], "valueCols": [{"id": "px", "aggFunc": "avg"}], "filterModel": {"qty": {"filterType": "number", "operator": "OR", "conditions": [{"filterType": "number", "type": "equals", "filter": 5}, {"filterType": "number", "type": "blank"}]}, "px": {"filterType": "number", "type": "contains"}}, "quickFilterText": "a b"},
        ["desk"],
    )
    assert spec["groupBy"] == ["ccy"] and spec["filter"][0] == {"column": "desk", "op": "equals", "value": "EM"} and spec["filter"][1]["op"] == "or" and len(spec["filter"]) == 4
    assert unsupported == ["px: contains (number)"]
    date = lambda entry, low, high=None: {"filterType": "date", "type": entry, "dateFrom": low, "dateTo": high}
    ms = 86_400_000
    made = lambda model: view_request({"filterModel": {"d": model}}, (), ["d"])
    assert made(date("equals", "1970-01-02 10:00:00"))[0]["filter"] == [{"column": "d", "op": "greaterThanOrEqual", "value": ms}, {"column": "d", "op": "lessThan", "value": 2 * ms}]
    assert made(date("greaterThan", "1970-01-02"))[0]["filter"] == [{"column": "d", "op": "greaterThanOrEqual", "value": 2 * ms}]
    either = made({"operator": "OR", "conditions": [date("equals", "1970-01-01"), date("blank", None)]})
    assert either == ({"filter": [{"op": "or", "conditions": [{"column": "d", "op": "inRange", "value": 0, "valueTo": ms - 1}, {"column": "d", "op": "blank"}]}], "sort": []}, [])
    assert made(date("lessThan", "soon"))[1] == ["d: lessThan needs a day"] and made(date("inRange", "1970-01-01", "1970-01-02"))[0]["filter"][1]["value"] == 2 * ms
    both = made({"filterModels": [None, {"filterType": "set", "values": [None, "A", 1]}]})[0]["filter"]
    assert both == [{"op": "or", "conditions": [{"column": "d", "op": "blank"}, {"column": "d", "op": "equalsIgnoreCase", "value": "A"}, {"column": "d", "op": "equals", "value": 1}]}]
    assert made({"filterType": "set", "values": []})[0]["filter"] == [{"column": "d", "op": "in", "value": []}]
    assert refresh_routes([("a", "b"), ("a", "c"), ("d",)]) == [["a"], []] and mode(10) == ("client",)


def test_fold_is_a_naive_fold(spark):
    import random

    random.seed(3)
    messages, state = [], {}
    for seq in range(300):
        k, op = random.choice("abcde"), random.choices(["insert", "update", "delete"], [2, 6, 1])[0]
        fields = {f: random.choice([None, seq]) for f in ("p", "q") if random.random() < 0.6}
        messages.append((k, seq, op, list(fields), fields.get("p"), fields.get("q")))
        if op == "delete":
            state.pop(k, None)
        else:
            state[k] = {"p": None, "q": None} | state.get(k, {}) | fields
    df = spark.createDataFrame(messages, "__key string, __seq long, __op string, __present array<string>, p long, q long")
    whole = merge.fold_messages(df, ["p", "q"]).where("__op <> 'delete'")
    assert {r["__key"]: {"p": r["p"], "q": r["q"]} for r in whole.collect()} == state
    table = spark.createDataFrame([], "__key string, __seq long, p long, q long")
    for cut in range(0, 300, 75):
        patch = merge.fold_messages(df.where(f"__seq >= {cut} AND __seq < {cut + 75}"), ["p", "q"])
        table = spark.createDataFrame(merge.apply_patch(table, patch, ["p", "q"]).collect(), table.schema)
    assert {r["__key"]: {"p": r["p"], "q": r["q"]} for r in table.collect()} == state


def test_diffs(spark):
    a = spark.createDataFrame([("1", 1, None), ("2", 2, False), ("3", 3, None)], "__key string, x int, gone boolean")
    b = spark.createDataFrame([("1", 1, None), ("2", 5, None), ("4", 4, None), ("3", 3, True)], "__key string, x int, gone boolean")
    got = {r["__key"]: r["change"] for r in diff.snapshot_diff(a, b, soft_delete="gone").collect()}
    assert got == {"1": "same", "2": "update", "3": "remove", "4": "insert"}
    assert sorted((r["event"], r["__key"]) for r in diff.membership(a, b).collect()) == [("entered", "4")]


def test_overlay_and_outcomes(spark):
    incoming = spark.createDataFrame([("1", "old"), ("2", "new"), ("3", "mine")], "__key string, v string")
    edits = spark.createDataFrame([(k, "v", "mine", "old") for k in "1234"], "__key string, column string, value string, baseline string")
    assert {r["__key"]: r["v"] for r in merge.overlay(incoming, edits, ["v"]).collect()} == {"1": "mine", "2": "new", "3": "mine"}
    assert {r["__key"]: r["outcome"] for r in merge.edit_outcomes(incoming, edits, ["v"]).collect()} == {"1": "pending", "2": "diverged", "3": "confirmed", "4": "gone"}


def test_commands(spark):
    ledger = spark.createDataFrame([("x",)], "idempotency string")
    incoming = spark.createDataFrame([("x", "1", "v", "a", 1), ("y", "1", "v", "a", 2), ("y", "1", "v", "b", 3), ("z", None, "v", "a", 4)], "idempotency string, __key string, column string, value string, __seq long")
    assert [r["status"] for r in merge.commands(ledger, incoming).orderBy("__seq").collect()] == ["duplicate", "applied", "duplicate", "rejected"]


def test_csv(spark):
    df = spark.createDataFrame([('a"b', None, 1.0), ("c,d", "x\ny", 2.5)], "p string, q string, r double")
    assert [r[0] for r in View(df, {}).as_csv().collect()] == ['"a""b",,1', '"c,d","x\ny",2.5']
