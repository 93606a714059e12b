"""Every query with SQL against DuckDB over the same tables."""

import math
import os

import duckdb
import pytest

from tidegrid import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return str(v)


def table(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(plain(r[i])) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_as_sql(name, spark, data, duck):
    df = catalog.queries()[name](spark, data)
    other = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert table(df.collect(), df.columns) == table(other.fetchall(), other.columns)


def test_filters_reach_the_scan(spark, data):
    plan = catalog.queries()["filter_greater_than"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double>" in plan or "l_shipdate" not in plan


def test_no_python_in_query_plans(spark, data):
    for name in ("group_tree", "pivot_groups", "computed_columns", "merge_patches", "rank_of_key"):
        plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
