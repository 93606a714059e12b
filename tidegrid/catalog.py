"""The registered queries: each operator over the driver's tables, with DuckDB SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions import aggregates, dsl, predicates, wire
from tidegrid.functions import values as V
from tidegrid.operators import diff, merge
from tidegrid.operators.view import View, selection
from tidegrid.plans.gridmodel import view_request
from tidegrid.shared import shared_dir
from tidegrid.sources import flatten, infer
from tidegrid.streaming.live import LiveTable, as_messages

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a keyed table of positions."""
    df = read(spark, sf_dir, "lineitem")
    key = F.concat_ws("\u0001", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return df.withColumns({"__key": key, "__seq": (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")})


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumns({"__key": F.col("o_orderkey").cast("string"), "__seq": F.col("o_orderkey")})


def rounded(df: DataFrame, digits: int = 2) -> DataFrame:
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])


# filters: name -> (table, nodes, SQL condition)

_TS = "epoch_ms(CAST(o_orderdate AS TIMESTAMP))"
FILTERS: Mapping[str, tuple[str, list, str]] = {
    "filter_equals": ("lineitem", [{"column": "l_returnflag", "op": "equals", "value": "a"}], "lower(l_returnflag) = 'a'"),
    "filter_equals_number": ("lineitem", [{"column": "l_quantity", "op": "equals", "value": 17}], "l_quantity = 17"),
    "filter_not_equal": ("orders", [{"column": "o_orderpriority", "op": "notEqual", "value": "1-urgent"}], "coalesce(lower(o_orderpriority), '') <> '1-urgent'"),
    "filter_contains": ("part", [{"column": "p_name", "op": "contains", "value": "RE"}], "contains(lower(p_name), 're')"),
    "filter_not_contains": ("part", [{"column": "p_name", "op": "notContains", "value": "a"}], "NOT coalesce(contains(lower(p_name), 'a'), false)"),
    "filter_starts_with": ("customer", [{"column": "c_mktsegment", "op": "startsWith", "value": "B"}], "starts_with(lower(c_mktsegment), 'b')"),
    "filter_ends_with": ("customer", [{"column": "c_name", "op": "endsWith", "value": "7"}], "ends_with(lower(c_name), '7')"),
    "filter_greater_than": ("lineitem", [{"column": "l_quantity", "op": "greaterThan", "value": 45}], "l_quantity > 45"),
    "filter_greater_or_equal": ("lineitem", [{"column": "l_quantity", "op": "greaterThanOrEqual", "value": "45"}], "l_quantity >= 45"),
    "filter_less_than": ("customer", [{"column": "c_acctbal", "op": "lessThan", "value": 0}], "c_acctbal < 0"),
    "filter_less_or_equal": ("part", [{"column": "p_size", "op": "lessThanOrEqual", "value": 10}], "p_size <= 10"),
    "filter_in_range": ("lineitem", [{"column": "l_discount", "op": "inRange", "value": 0.02, "valueTo": 0.05}], "l_discount BETWEEN 0.02 AND 0.05"),
    "filter_blank": ("events", [{"column": "props", "op": "blank"}], "props IS NULL OR props = ''"),
    "filter_not_blank": ("events", [{"column": "props", "op": "notBlank"}], "props IS NOT NULL AND props <> ''"),
    "filter_in": ("orders", [{"column": "o_orderstatus", "op": "in", "value": ["f", "P", None]}], "lower(o_orderstatus) IN ('f', 'p') OR o_orderstatus IS NULL"),
    "filter_in_empty": ("orders", [{"column": "o_orderstatus", "op": "in", "value": []}], "false"),
    "filter_not_in": ("orders", [{"column": "o_orderstatus", "op": "notIn", "value": ["F"]}], "coalesce(lower(o_orderstatus), '') <> 'f'"),
    "filter_or": (
        "lineitem",
        [{"op": "or", "conditions": [{"column": "l_returnflag", "op": "equals", "value": "R"}, {"column": "l_quantity", "op": "lessThan", "value": 5}]}],
        "lower(l_returnflag) = 'r' OR l_quantity < 5",
    ),
    "filter_or_nested": (
        "orders",
        [{"op": "or", "conditions": [{"column": "o_orderstatus", "op": "equals", "value": "P"}, {"op": "anyOf", "conditions": [{"column": "o_totalprice", "op": "greaterThan", "value": 300000}, {"expr": "o_totalprice < 2000"}]}]}],
        "lower(o_orderstatus) = 'p' OR o_totalprice > 300000 OR o_totalprice < 2000",
    ),
    "filter_expression": ("lineitem", [{"expr": "l_returnflag == 'r' and (l_quantity * 2 > 60 or l_discount == 0.05)"}], "lower(l_returnflag) = 'r' AND (l_quantity * 2 > 60 OR l_discount = 0.05)"),
    "filter_date": ("orders", [{"column": "o_orderdate", "op": "lessThan", "value": 820454400000}], f"{_TS} < 820454400000"),
    "filter_all_of": ("lineitem", [{"column": "l_linestatus", "op": "equals", "value": "O"}, {"column": "l_tax", "op": "greaterThan", "value": 0.04}], "lower(l_linestatus) = 'o' AND l_tax > 0.04"),
}
_NUMBER = {"lineitem": "l_extendedprice", "orders": "o_totalprice", "part": "p_retailprice", "customer": "c_acctbal", "events": "value"}


def _filter_query(table: str, nodes: list) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = {"filter": nodes, "aggregates": [{"column": "*", "fn": "count", "as": "rows"}, {"column": _NUMBER[table], "fn": "sum", "as": "total"}]}
        return rounded(View(read(spark, sf_dir, table), spec).totals())

    return run


for _name, (_table, _nodes, _where) in FILTERS.items():
    query(f"SELECT count(*) AS rows, round(coalesce(sum({_NUMBER[_table]}), 0), 2) AS total FROM {_table} WHERE {_where}", _name)(_filter_query(_table, _nodes))


@query(
    "SELECT count(*) AS rows FROM part WHERE (contains(lower(p_name), 'b') OR contains(lower(p_brand), 'b') OR contains(lower(p_type), 'b')) "
    "AND (contains(lower(p_name), '3') OR contains(lower(p_brand), '3') OR contains(lower(p_type), '3'))"
)
def quick_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.where(predicates.quick("B 3", ["p_name", "p_brand", "p_type"], V.kinds(df))).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT count(*) AS rows FROM part WHERE contains(lower(p_name), '1') OR contains(lower(p_brand), '1')")
def quick_filter_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part")
    return df.where(predicates.quick("1", ["p_name", "p_brand"], V.kinds(df), every_word=False)).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE lower(o_orderstatus) = 'f' AND epoch_ms(CAST(o_orderdate AS TIMESTAMP)) >= 788918400000 "
    "AND epoch_ms(CAST(o_orderdate AS TIMESTAMP)) <= 820454399999 AND contains(lower(o_orderpriority), 'high') ORDER BY o_totalprice DESC, o_orderkey LIMIT 50"
)
def grid_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = {
        "startRow": 0, "endRow": 50, "sortModel": [{"colId": "o_totalprice", "sort": "desc"}], "quickFilterText": "high",
        "filterModel": {"o_orderstatus": {"filterType": "set", "values": ["F"]}, "o_orderdate": {"filterType": "date", "type": "inRange", "dateFrom": "1995-01-01", "dateTo": "1995-12-31"}},
    }
    spec, _ = view_request(request, ["o_orderpriority"], ["o_orderdate"])
    return rounded(View(orders(spark, sf_dir), spec).rows(0, 50).select("o_orderkey", "o_totalprice"))


@query("SELECT count(*) AS rows FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1996-06-30' AND o_totalprice <> 0")
def grid_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    k = V.kinds(df)
    late = predicates.grid_leaf(V.cell("o_orderdate", k["o_orderdate"]), "date", "greaterThan", "1996-06-30")
    return df.where(late & predicates.grid_leaf(V.cell("o_totalprice", "float"), "number", "notEqual", 0)).agg(F.count(F.lit(1)).alias("rows"))


# sorts and windows


@query("SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 20 OFFSET 10")
def sort_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View(orders(spark, sf_dir), {"sort": [{"column": "o_totalprice", "sort": "desc"}]})
    return rounded(view.rows(10, 30).select("o_orderkey", "o_custkey", "o_totalprice"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem ORDER BY l_returnflag, l_shipdate DESC, l_orderkey, l_linenumber LIMIT 100")
def sort_multi_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View(book(spark, sf_dir), {"sort": [{"column": "l_returnflag", "dir": "asc"}, {"column": "l_shipdate", "dir": "desc"}]})
    return view.rows(0, 100).select("l_orderkey", "l_linenumber", "l_shipdate")


@query("SELECT p_partkey, lower(p_brand) AS brand FROM part ORDER BY lower(p_brand) DESC NULLS LAST, p_partkey LIMIT 30")
def sort_grid_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").withColumn("__seq", F.col("p_partkey"))
    return View(df, {"sort": [{"column": "p_brand", "sort": "desc"}]}, collation="grid").rows(0, 30).select("p_partkey", F.lower("p_brand").alias("brand"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(View(orders(spark, sf_dir), {"sort": [{"column": "o_totalprice", "sort": "desc"}]}).rows(0, 10).select("o_orderkey", "o_totalprice"))


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders WHERE o_orderstatus = 'O') SELECT rank FROM r WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'O')")
def rank_of_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = orders(spark, sf_dir)
    key = df.where("o_orderstatus = 'O'").agg(F.min("o_orderkey")).head()[0]
    return View(df, {"filter": [{"column": "o_orderstatus", "op": "equals", "value": "O"}], "sort": [{"column": "o_totalprice", "sort": "desc"}]}).rank("__key", str(key))


@query("SELECT count(*) AS rows FROM lineitem WHERE l_quantity < 24")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(read(spark, sf_dir, "lineitem"), {"filter": [{"column": "l_quantity", "op": "lessThan", "value": 24}]}).count()


# aggregates

_AGGS = ("sum", "avg", "min", "max", "count", "distinct_count", "median", "stdev", "variance")


@query(
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, "
    "round(avg(l_quantity), 4) AS avg_qty, count(*) AS rows FROM lineitem WHERE epoch_ms(CAST(l_shipdate AS TIMESTAMP)) <= 904694400000 GROUP BY ALL"
)
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide aggregate over a filter: the whole path from scan to groups."""
    disc = {"k": "bin", "op": "mul", "l": _col("l_extendedprice"), "r": {"k": "bin", "op": "sub", "l": {"k": "lit", "v": 1}, "r": _col("l_discount")}}
    spec = {
        "filter": [{"column": "l_shipdate", "op": "lessThanOrEqual", "value": 904694400000}], "computed": [{"as": "disc_price", "expr": disc}], "groupBy": ["l_returnflag", "l_linestatus"],
        "aggregates": [
            {"column": "l_quantity", "fn": "sum", "as": "sum_qty"}, {"column": "l_extendedprice", "fn": "sum", "as": "sum_base"}, {"column": "disc_price", "fn": "sum", "as": "sum_disc"},
            {"column": "l_quantity", "fn": "avg", "as": "avg_qty"}, {"column": "*", "fn": "count", "as": "rows"},
        ],
    }
    df = View(read(spark, sf_dir, "lineitem"), spec).levels().where("__level = 1")
    keep = df.select("l_returnflag", "l_linestatus", F.round("sum_qty", 2).alias("sum_qty"), F.round("sum_base", 2).alias("sum_base"), F.round("sum_disc", 2).alias("sum_disc"), F.round("avg_qty", 4).alias("avg_qty"), "rows")
    return keep


def _col(name: str) -> dict:
    return {"k": "col", "name": name}


@query(
    "SELECT round(coalesce(sum(l_extendedprice), 0), 2) AS sum, round(avg(l_extendedprice), 2) AS avg, min(l_extendedprice) AS min, max(l_extendedprice) AS max, count(*) AS count, "
    "count(DISTINCT l_extendedprice) AS distinct_count, round(median(l_extendedprice), 2) AS median, round(stddev_samp(l_extendedprice), 2) AS stdev, round(var_samp(l_extendedprice) / 1e6, 2) AS variance_m FROM lineitem"
)
def flat_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"aggregates": [{"column": "l_extendedprice", "fn": f, "as": f} for f in _AGGS]}
    return rounded(View(read(spark, sf_dir, "lineitem"), spec).totals().withColumn("variance_m", F.col("variance") / 1e6).drop("variance"))


def _grouped(fn: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spec = {"groupBy": ["o_orderpriority"], "aggregates": [{"column": "o_totalprice", "fn": fn, "as": "value"}]}
        return rounded(View(read(spark, sf_dir, "orders"), spec).groups().select("o_orderpriority", "value"))

    return run


_DUCK = {
    "sum": "coalesce(sum(o_totalprice), 0)", "avg": "avg(o_totalprice)", "min": "min(o_totalprice)", "max": "max(o_totalprice)", "count": "count(*)", "distinct_count": "count(DISTINCT o_totalprice)",
    "median": "median(o_totalprice)", "stdev": "stddev_samp(o_totalprice)",
}
for _fn, _sql in _DUCK.items():
    query(f"SELECT o_orderpriority, {'round(' + _sql + ', 2)' if 'count' not in _fn else _sql} AS value FROM orders GROUP BY 1", f"agg_{_fn}")(_grouped(_fn))


@query("SELECT l_returnflag, round(var_samp(l_quantity), 6) AS value FROM lineitem GROUP BY 1")
def agg_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["l_returnflag"], "aggregates": [{"column": "l_quantity", "fn": "variance", "as": "value"}]}
    return rounded(View(read(spark, sf_dir, "lineitem"), spec).groups().select("l_returnflag", "value"), 6)


@query("SELECT l_returnflag, arg_min(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS first, arg_max(l_quantity, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey) AS last FROM lineitem GROUP BY 1")
def agg_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["l_returnflag"], "aggregates": [{"column": "l_quantity", "fn": "first", "as": "first"}, {"column": "l_quantity", "fn": "last", "as": "last"}]}
    return View(book(spark, sf_dir), spec).groups().select("l_returnflag", "first", "last")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY 1")
def agg_weighted_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["l_returnflag"], "aggregates": [{"column": "l_discount", "fn": "weightedAvg", "weight": "l_quantity", "as": "weighted"}]}
    return rounded(View(read(spark, sf_dir, "lineitem"), spec).groups().select("l_returnflag", "weighted"), 6)


@query(
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 2) AS avg, count(o_totalprice) AS n, round(median(o_totalprice), 2) AS median, coalesce(round(stddev_samp(o_totalprice), 2), 0) AS stdev, max(o_totalprice) AS max FROM orders GROUP BY 1"
)
def expression_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.cell("o_totalprice", "float")
    named = {"sum": "sum", "avg": "avg", "n": "count", "median": "median", "stdev": "stdev", "max": "max"}
    df = read(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*[aggregates.expression(f, t).alias(n) for n, f in named.items()])
    return rounded(df.withColumn("n", F.col("n").cast("long")))


# groups, trees, pivots


@query("SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1")
def group_by_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["l_returnflag"], "aggregates": {"l_quantity": "sum"}}
    return rounded(View(read(spark, sf_dir, "lineitem"), spec).groups().select("l_returnflag", F.col("__count").alias("n"), F.col("l_quantity").alias("qty")))


@query(
    "SELECT l_returnflag, l_linestatus, CAST(grouping(l_linestatus) AS INTEGER) AS rolled, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem "
    "GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))"
)
def group_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["l_returnflag", "l_linestatus"], "aggregates": [{"column": "l_quantity", "fn": "sum", "as": "qty"}, {"column": "l_discount", "fn": "avg", "as": "disc"}]}
    df = View(read(spark, sf_dir, "lineitem"), spec).levels()
    return df.select("l_returnflag", "l_linestatus", (1 - F.col("__level")).cast("int").alias("rolled"), F.col("__count").alias("n"), F.round("qty", 2).alias("qty"), F.round("disc", 6).alias("disc"))


@query(
    "WITH t AS (SELECT o_orderstatus, o_orderpriority, CAST(1 - grouping(o_orderpriority) AS INTEGER) AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders "
    "GROUP BY GROUPING SETS ((o_orderstatus), (o_orderstatus, o_orderpriority))) SELECT * FROM t WHERE level = 0 OR o_orderstatus = 'F'"
)
def group_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["o_orderstatus", "o_orderpriority"], "aggregates": [{"column": "o_totalprice", "fn": "sum", "as": "total"}]}
    df = View(orders(spark, sf_dir), spec).tree([("F",)], leaves=False)
    return df.select("o_orderstatus", "o_orderpriority", F.col("__level").cast("int").alias("level"), F.col("__count").alias("n"), F.round("total", 2).alias("total"))


@query(
    "SELECT 0 AS level, c_nationkey, NULL AS c_custkey, count(*) AS n FROM customer GROUP BY c_nationkey"
    " UNION ALL SELECT 1, c_nationkey, c_custkey, NULL FROM customer WHERE c_nationkey = 2"
)
def group_tree_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer").withColumn("__seq", F.col("c_custkey"))
    tree = View(df, {"groupBy": ["c_nationkey"], "sort": [{"column": "c_name", "sort": "asc"}]}).tree([(2,)])
    return tree.select(F.col("__level").cast("int").alias("level"), "c_nationkey", "c_custkey", F.col("__count").alias("n"))


@query(
    "SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 2) AS \"F|qty\", round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 2) AS \"O|qty\", count(*) AS __count FROM lineitem GROUP BY 1"
)
def pivot_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["l_returnflag"], "splitBy": ["l_linestatus"], "aggregates": [{"column": "l_quantity", "fn": "sum", "as": "qty"}]}
    return rounded(View(read(spark, sf_dir, "lineitem"), spec).pivot())


@query(
    "SELECT count(*) AS __count, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS \"F|p\", round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS \"O|p\", round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS \"P|p\" FROM orders"
)
def pivot_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"splitBy": ["o_orderstatus"], "aggregates": [{"column": "o_totalprice", "fn": "avg", "as": "p"}]}
    return rounded(View(read(spark, sf_dir, "orders"), spec).pivot(["F", "O", "P"]))


@query("SELECT DISTINCT o_orderstatus || '|' || o_orderpriority AS field FROM orders")
def pivot_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = View(read(spark, sf_dir, "orders"), {"splitBy": ["o_orderstatus", "o_orderpriority"]})
    return spark.createDataFrame([(v,) for v in view.pivot_values()], "field string")


@query("SELECT p_brand AS value FROM part GROUP BY 1 ORDER BY min(p_partkey) LIMIT 15")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(read(spark, sf_dir, "part").withColumn("__seq", F.col("p_partkey")), {}).distinct("p_brand", 15)


@query("SELECT DISTINCT p_type AS value FROM part WHERE starts_with(lower(p_type), 's') ORDER BY 1 LIMIT 20")
def prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(read(spark, sf_dir, "part"), {}).starting_with("p_type", "S", 20)


# computed columns


def _bin(op: str, left: object, right: object) -> dict:
    return {"k": "bin", "op": op, "l": left, "r": right}


def _fn(name: str, *args: object) -> dict:
    return {"k": "fn", "name": name, "args": list(args)}


def _lit(v: object) -> dict:
    return {"k": "lit", "v": v}


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS charge FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 50000 ORDER BY l_extendedprice * (1 - l_discount) * (1 + l_tax) DESC, l_orderkey, l_linenumber LIMIT 50")
def computed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = _bin("mul", _col("l_extendedprice"), _bin("sub", _lit(1), _col("l_discount")))
    spec = {
        "computed": [{"as": "net", "expr": net}, {"as": "charge", "expr": _bin("mul", _col("net"), _bin("add", _lit(1), _col("l_tax")))}],
        "filter": [{"column": "net", "op": "greaterThan", "value": 50000}], "sort": [{"column": "charge", "sort": "desc"}],
    }
    return rounded(View(book(spark, sf_dir), spec).rows(0, 50).select("l_orderkey", "l_linenumber", "charge"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS ratio FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_returnflag, l_linestatus))")
def node_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ratio of sums, worked out for each group by itself."""
    spec = {
        "groupBy": ["l_returnflag", "l_linestatus"],
        "computed": [{"as": "xw", "expr": _bin("mul", _col("l_discount"), _col("l_quantity"))}, {"as": "ratio", "expr": _bin("div", {"k": "agg", "fn": "sum", "col": "xw"}, {"k": "agg", "fn": "sum", "col": "l_quantity"})}],
    }
    return View(read(spark, sf_dir, "lineitem"), spec).levels().select("l_returnflag", "l_linestatus", F.round("ratio", 6).alias("ratio"))


@query("SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'P'), 9) AS share FROM orders WHERE o_orderstatus = 'P'")
def share_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"filter": [{"column": "o_orderstatus", "op": "equals", "value": "P"}], "computed": [{"as": "share", "expr": _bin("div", _col("o_totalprice"), {"k": "agg", "fn": "sum", "col": "o_totalprice"})}]}
    return View(read(spark, sf_dir, "orders"), spec).filtered().select("o_orderkey", F.round("share", 9).alias("share"))


@query("WITH s AS (SELECT o_orderstatus, o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_orderstatus) AS x FROM orders) SELECT o_orderstatus, round(max(x), 9) AS share FROM s GROUP BY 1")
def share_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = {"groupBy": ["o_orderstatus"], "computed": [{"as": "share", "expr": _bin("div", _col("o_totalprice"), {"k": "agg", "fn": "sum", "col": "o_totalprice"})}]}
    return rounded(View(read(spark, sf_dir, "orders"), spec).mixed("share", "max"), 9)


_EXPRESSIONS: Mapping[str, tuple[object, str]] = {
    "abs": (_fn("ABS", _col("c_acctbal")), "abs(c_acctbal)"),
    "floor": (_fn("FLOOR", _col("c_acctbal")), "floor(c_acctbal)"),
    "ceil": (_fn("CEIL", _col("c_acctbal")), "ceil(c_acctbal)"),
    "round1": (_fn("ROUND", _col("c_acctbal"), _lit(1)), "floor(c_acctbal * 10 + 0.5) / 10"),
    "root": (_fn("ROUND", _fn("SQRT", _fn("ABS", _col("c_acctbal"))), _lit(4)), "floor(sqrt(abs(c_acctbal)) * 10000 + 0.5) / 10000"),
    "modulo": (_bin("mod", _col("c_custkey"), _lit(7)), "CAST(c_custkey % 7 AS DOUBLE)"),
    "guarded": (_bin("div", _col("c_custkey"), _bin("mod", _col("c_custkey"), _lit(2))), "CASE WHEN c_custkey % 2 <> 0 THEN CAST(c_custkey AS DOUBLE) END"),
    "label": (_fn("CONCAT", _fn("UPPER", _col("c_mktsegment")), _lit(":"), _fn("LOWER", _col("c_name"))), "upper(c_mktsegment) || ':' || lower(c_name)"),
    "part_of": (_fn("SUBSTRING", _col("c_name"), _lit(0), _lit(4)), "substr(c_name, 1, 4)"),
    "longness": (_fn("LEN", _col("c_name")), "CAST(length(c_name) AS BIGINT)"),
    "swapped": (_fn("REPLACE", _col("c_name"), _lit("C"), _lit("K")), "replace(c_name, 'C', 'K')"),
    "has_build": (_fn("CONTAINS", _col("c_mktsegment"), _lit("BUILD")), "contains(c_mktsegment, 'BUILD')"),
    "size": ({"k": "cond", "branches": [{"when": _bin("gt", _col("c_acctbal"), _lit(5000)), "then": _lit("big")}, {"when": _bin("lt", _col("c_acctbal"), _lit(0)), "then": _lit("debt")}], "else": _lit("small")}, "CASE WHEN c_acctbal > 5000 THEN 'big' WHEN c_acctbal < 0 THEN 'debt' ELSE 'small' END"),
    "is_in": ({"k": "in", "a": _col("c_nationkey"), "list": [_lit(1), _lit(2), _lit(3)]}, "c_nationkey IN (1, 2, 3)"),
    "mid": ({"k": "between", "a": _col("c_acctbal"), "lo": _lit(100), "hi": _lit(2000)}, "c_acctbal BETWEEN 100 AND 2000"),
    "either": (_bin("or", _fn("STARTS_WITH", _col("c_name"), _lit("X")), _bin("ge", _col("c_acctbal"), _lit(0))), "starts_with(c_name, 'X') OR c_acctbal >= 0"),
    "neither": ({"k": "un", "op": "not", "a": _bin("eq", _col("c_mktsegment"), _lit("BUILDING"))}, "c_mktsegment <> 'BUILDING'"),
    "switched": (_fn("SWITCH", _col("c_nationkey"), _lit(0), _lit("zero"), _lit(1), _lit("one"), _lit("many")), "CASE c_nationkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END"),
    "least_of": (_fn("MIN", _col("c_acctbal"), _lit(100)), "least(c_acctbal, 100)"),
    "text_sum": (_bin("add", _lit("n"), _col("c_custkey")), "'n' || c_custkey"),
    "filled": (_fn("ISNULL", _col("c_name"), _lit("none")), "coalesce(c_name, 'none')"),
}


@query(f"SELECT c_custkey, {', '.join(f'{sql} AS {name}' for name, (_, sql) in _EXPRESSIONS.items())} FROM customer")
def expression_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer")
    k = V.kinds(df)
    return df.select("c_custkey", *[wire.compile_expression(e, k).column.alias(n) for n, (e, _) in _EXPRESSIONS.items()])


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS y, CAST(month(o_orderdate) AS DOUBLE) AS m, CAST(day(o_orderdate) AS DOUBLE) AS d, isodow(o_orderdate) <= 5 AS weekday FROM orders")
def expression_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "orders")
    k = V.kinds(df)
    made = {"y": "YEAR", "m": "MONTH", "d": "DAY", "weekday": "IS_WEEKDAY"}
    return df.select("o_orderkey", *[wire.compile_expression(_fn(f, _col("o_orderdate")), k).column.alias(n) for n, f in made.items()])


_RULES: Mapping[str, tuple[str, str]] = {
    "worth": ("abs(c_acctbal) * 2 + 1", "abs(c_acctbal) * 2 + 1"),
    "rounded": ("round(c_acctbal / 10)", "floor(c_acctbal / 10 + 0.5)"),
    "segment": ("upper('x' + lower(c_mktsegment))", "upper('x' || lower(c_mktsegment))"),
    "matched": ("contains(c_name, '1') and not (c_mktsegment == 'building')", "contains(c_name, '1') AND NOT lower(c_mktsegment) = 'building'"),
    "chosen": ("if(c_acctbal > 0, max(c_acctbal, 10), min(-1, c_acctbal))", "CASE WHEN c_acctbal > 0 THEN greatest(c_acctbal, 10) ELSE least(-1, c_acctbal) END"),
    "either": ("startsWith(c_name, 'C') or endsWith(c_name, '0') || length(c_name) <= 3", "starts_with(c_name, 'C') OR ends_with(c_name, '0') OR length(c_name) <= 3"),
    "none": ("c_name == null", "c_name IS NULL"),
}


@query(f"SELECT c_custkey, {', '.join(f'{sql} AS {name}' for name, (_, sql) in _RULES.items())} FROM customer")
def rule_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "customer")
    k = V.kinds(df)
    return df.select("c_custkey", *[dsl.compile_rule(r, k).column.alias(n) for n, (r, _) in _RULES.items()])


# messages, versions, changes


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as messages keyed by user: purchases write value, others the type; errors delete."""
    df = read(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    present = F.when(F.col("event_type") == "purchase", F.array(F.lit("value"), F.lit("event_type"))).otherwise(F.array(F.lit("event_type")))
    return df.select(F.col("user_id").cast("string").alias("__key"), F.col("event_id").alias("__seq"), op.alias("__op"), present.alias("__present"), "event_type", "value")


_MERGED = (
    "WITH d AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN event_id END) AS gone FROM events{where} GROUP BY 1), "
    "l AS (SELECT e.* FROM events e JOIN d USING (user_id) WHERE event_type <> 'error' AND (gone IS NULL OR event_id > gone){also}) "
    "SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, event_id) AS event_type, arg_max(CASE WHEN event_type = 'purchase' THEN value END, CASE WHEN event_type = 'purchase' THEN event_id END) AS value FROM l GROUP BY 1"
)


@query(_MERGED.format(where="", also=""))
def merge_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.fold_messages(feed(spark, sf_dir), ["event_type", "value"]).where("__op <> 'delete'")
    return merged.select(F.col("__key").alias("key"), "event_type", "value")


@query(_MERGED.format(where="", also=""))
def merge_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same messages, applied to a live table in three versions."""
    live = LiveTable(spark, f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", "event_type string, value double", buckets=4)
    messages = feed(spark, sf_dir)
    last = messages.agg(F.max("__seq")).head()[0] or 0
    for i in range(3):
        live.apply(messages.where((F.col("__seq") > last * i // 3 - (i == 0)) & (F.col("__seq") <= last * (i + 1) // 3)))
    return live.read().select(F.col("__key").alias("key"), "event_type", "value")


_CUT = "(SELECT max(event_id) // 2 FROM events)"


@query(
    "WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) GROUP BY 1) "
    "SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN b.user_id IS NULL THEN 'remove' WHEN a.user_id IS NULL THEN 'insert' WHEN a.t IS NOT DISTINCT FROM b.t THEN 'same' ELSE 'update' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id"
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return diff.snapshot_diff(a, b, "user_id").select("user_id", "change")


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each user's last event type in the first and in the second half of events."""
    df = read(spark, sf_dir, "events")
    cut = (df.agg(F.max("event_id")).head()[0] or 0) // 2
    last = lambda d: d.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"))
    return last(df.where(F.col("event_id") <= cut)), last(df.where(F.col("event_id") > cut))


@query(
    "WITH a AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1), b AS (SELECT event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1) "
    "SELECT event_type, CASE WHEN a.n IS NULL THEN 'insert' ELSE 'update' END AS change, b.n AS n FROM b LEFT JOIN a USING (event_type) WHERE a.n IS DISTINCT FROM b.n OR a.v IS DISTINCT FROM b.v"
)
def group_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    cut = (df.agg(F.max("event_id")).head()[0] or 0) // 2
    spec = {"groupBy": ["event_type"], "aggregates": [{"column": "value", "fn": "sum", "as": "v"}]}
    levels = lambda d: View(d, spec).levels()
    return diff.group_diff(levels(df.where(F.col("event_id") <= cut)), levels(df), ["event_type"], 1e-6).select("event_type", "change", F.col("__count").alias("n"))


@query(
    "WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) GROUP BY 1) "
    "SELECT 'entered' AS event, user_id FROM b WHERE t = 'click' AND user_id NOT IN (SELECT user_id FROM a WHERE t = 'click') UNION ALL SELECT 'left', user_id FROM a WHERE t = 'click' AND user_id NOT IN (SELECT user_id FROM b WHERE t = 'click')"
)
def membership_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    spec = {"filter": [{"column": "t", "op": "equals", "value": "CLICK"}]}
    return diff.membership(View(a, spec).filtered(), View(b, spec).filtered(), "user_id")


@query(
    "WITH a AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY 1), b AS (SELECT user_id, arg_max(event_type, event_id) AS t FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) GROUP BY 1) "
    "SELECT 'fired' AS event, user_id FROM b WHERE t IN ('error', 'view') AND user_id NOT IN (SELECT user_id FROM a WHERE t IN ('error', 'view')) UNION ALL SELECT 'cleared', user_id FROM a WHERE t IN ('error', 'view') AND user_id NOT IN (SELECT user_id FROM b WHERE t IN ('error', 'view'))"
)
def alert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _halves(spark, sf_dir)
    return diff.alert_transitions(a, b, dsl.predicate("t == 'error' or t == 'View'", V.kinds(b)), "user_id")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def conflated(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select(F.col("user_id"), F.col("event_id").alias("__seq"), "event_type", "value")
    return diff.conflate(df, "user_id").select("user_id", "event_type", "value")


@query(
    "WITH d AS (SELECT user_id, max(event_id) AS e FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) AND event_type <> 'error' GROUP BY 1), g AS (SELECT user_id, max(CASE WHEN event_type = 'error' THEN event_id END) AS gone, max(event_id) AS last, max(CASE WHEN event_type <> 'error' THEN event_id END) AS live FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) GROUP BY 1) "
    "SELECT CAST(user_id AS VARCHAR) AS key FROM g WHERE live IS NOT NULL AND (gone IS NULL OR live > gone)"
)
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the second of two versions wrote."""
    live = LiveTable(spark, f"{shared_dir(spark)}/live-{uuid.uuid4().hex}", "event_type string, value double", buckets=4)
    messages = feed(spark, sf_dir)
    cut = (messages.agg(F.max("__seq")).head()[0] or 0) // 2
    first = live.apply(messages.where(F.col("__seq") <= cut))
    live.apply(messages.where(F.col("__seq") > cut))
    return live.changed_since(first)[0].select(F.col("__key").alias("key"))


@query(
    "SELECT CASE event_type WHEN 'signup' THEN 'insert' WHEN 'purchase' THEN 'update' WHEN 'error' THEN 'delete' ELSE 'aside' END AS op,"
    " count(*) AS rows FROM events GROUP BY 1"
)
def operation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operation tokens mapped; rows of unknown ones set aside."""
    df = read(spark, sf_dir, "events")
    good, aside = as_messages(df, ["user_id"], F.col("event_id"), "event_type", {"signup": "insert", "purchase": "update", "error": "delete"})
    ops = good.select(F.col("__op").alias("op")).unionByName(aside.select(F.lit("aside").alias("op")))
    return ops.groupBy("op").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "SELECT user_id, coalesce(arg_max(event_type, event_id) FILTER (WHERE event_type IN ('error', 'signup')) = 'error', false) AS deleted FROM events GROUP BY 1"
)
def soft_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes raise a flag and inserts lower it; updates between or after them leave it as it is."""
    messages = merge.soft_delete(feed(spark, sf_dir), "deleted")
    merged = merge.fold_messages(messages, ["event_type", "value", "deleted"])
    return merged.select(F.col("__key").cast("long").alias("user_id"), F.coalesce("deleted", F.lit(False)).alias("deleted"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS status FROM orders")
def edit_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits hold where upstream still has what they were made on; those made on something else give way."""
    df = orders(spark, sf_dir)
    edits = df.where("o_orderkey % 5 = 0").select("__key", F.lit("o_orderstatus").alias("column"), F.lit("X").alias("value"), F.when(F.col("o_orderkey") % 10 == 0, F.col("o_orderstatus")).otherwise("?").alias("baseline"))
    return merge.overlay(df, edits, ["o_orderstatus"]).select("o_orderkey", F.col("o_orderstatus").alias("status"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (1, 5, 9)")
def selection_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection(read(spark, sf_dir, "customer"), "c_custkey", True, [1, 5, 9]).select("c_custkey")


# sources


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS props_k FROM events")
def flatten_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("props"))
    return flatten.flatten(df)


@query("SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) AS turns_0_role, count(*) AS turns_n, CAST(sum(turn) AS DOUBLE) AS turns_sum FROM conversations GROUP BY 1")
def flatten_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array items by place, and aggregates of them."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns")
    df = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns).withColumns({"n": F.col("turns"), "s": F.col("turns")})
    rules = flatten.Flatten(arrays={"turns": flatten.ArrayRule("pin", 1), "n": flatten.ArrayRule("aggregate"), "s": flatten.ArrayRule("aggregate", fn="sum", path="turn")})
    out = flatten.flatten(df, rules)
    first = F.when(F.col("turns_0_turn") == 0, F.col("turns_0_role"))
    return out.select("conv_id", first.alias("turns_0_role"), F.col("n").alias("turns_n"), F.col("s").alias("turns_sum"))


@query("SELECT CAST(conv_id AS VARCHAR) AS parent, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS INTEGER) AS idx, role FROM conversations")
def explode_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("turns"))
    child = flatten.children(df, F.col("conv_id").cast("string"), "turns")
    return child.select(F.col("__parentKey").alias("parent"), F.col("__index").alias("idx"), "role")


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS whole, CAST(p_size AS DOUBLE) AS size, CAST(p_partkey AS VARCHAR) AS name FROM part")
def declared_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("string").alias("whole"), F.col("p_size").cast("string").alias("size"), F.col("p_partkey").alias("name"))
    return flatten.typed(df, {"p_partkey": "integer", "whole": "integer", "size": "float", "name": "string"})


@query("SELECT p_partkey, 90 + p_size % 10 + (p_size % 32 + 0.5) / 32 AS decimal FROM part")
def coerce_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.concat((90 + F.col("p_size") % 10).cast("string"), F.lit("-"), F.lpad((F.col("p_size") % 32).cast("string"), 2, "0"), F.lit("+"))
    return flatten.coerce(read(spark, sf_dir, "part").withColumn("price", price), "price", "ticks-to-decimal", "decimal").select("p_partkey", "decimal")


@query("SELECT event_id, strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS at FROM events")
def coerce_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    return flatten.coerce(df, "ms", "epoch-to-datetime", "iso").select("event_id", F.substring("iso", 1, 19).alias("at"))


@query("SELECT 'k' AS path, count(*) AS rows FROM events WHERE props IS NOT NULL")
def unknown_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.unknown_paths(read(spark, sf_dir, "events"), "props", [])


@query(
    "SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS col,"
    " unnest(['integer', 'datetime', 'integer', 'string', 'float', 'string']) AS type"
)
def infer_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(c, d.type) for c, d in infer.infer(read(spark, sf_dir, "events")).items()], "col string, type string")


_LEAVES = ["event_id", "ts", "user_id", "event_type", "value", "props"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS leaf, count({c}) AS seen, count({c}) >= 20 AS enough FROM events" for c in _LEAVES))
def sampling_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infer.progress(read(spark, sf_dir, "events").select(*_LEAVES), 20)


# sinks


@query(
    """SELECT event_id || ',' || event_type || ',' || CASE WHEN regexp_matches(props, '[",\\r\\n]')
    THEN '"' || replace(props, '"', '""') || '"' ELSE coalesce(props, '') END AS line FROM events"""
)
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(read(spark, sf_dir, "events"), {}).as_csv(["event_id", "event_type", "props"])


@query("SELECT c_custkey || chr(9) || c_name || chr(9) || c_mktsegment AS line FROM customer")
def tsv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return View(read(spark, sf_dir, "customer"), {}).as_tsv(["c_custkey", "c_name", "c_mktsegment"])


def _key_column() -> Column:
    return merge.row_key(["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS rows, count(DISTINCT l_orderkey || chr(1) || l_linenumber) AS keys FROM lineitem")
def composite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(_key_column().alias("k")).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("k").alias("keys"))
