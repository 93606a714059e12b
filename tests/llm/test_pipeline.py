"""The pipeline's stages on odd rows and on the smallest tables; queries with SQL against DuckDB."""

import corpus_pipeline
import duckdb
import pytest

from tidegrid.llm import queries


def test_stages_keep_the_columns(spark, odd, data):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns, name
        assert after.count() <= docs.count()
        docs = after
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(corpus_pipeline.STAGES[-1][1](spark, docs, data).columns)


def test_empty(spark, none, data):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert docs.count() == 0


def test_run(spark, data):
    out = corpus_pipeline.run(spark, data)
    documents = spark.read.parquet(f"{data}/documents.parquet")
    kept = out.select("doc_id").distinct()
    assert 0.6 * documents.count() < kept.count() <= documents.count()
    bad = queries.op10_winnowing(spark, data).where("contaminated").select("doc_id")
    assert kept.join(bad, "doc_id").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_as_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df, other = queries.QUERIES[name](spark, data), con.sql(queries.SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    order = [other.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, (tuple(r[i] for i in order) for r in other.fetchall())))
