"""Exact top-k search by inner product over integer vectors with MaxScore.

A term is a component. Over a shard (a run of candidate rows), the contribution of a term to a query's score lies between
a least and a greatest value, known from the shard's extremes. Terms are taken by falling spread of that range. With a
current k-th best score, the trailing terms whose bounds, together with the least of the others, cannot reach it are
non-essential: the essential ones are traversed for all rows of the shard, and the others are probed only for rows that
are still competitive, a few terms at a time. Each shard yields its k best per query, and these are merged. Scores are
integers and exact; ties go to the smaller id.

Queries are applied in blocks of `query_block` vectors, so that what is sent to executors has a fixed size; a shard holds
`shard_rows` vectors at most, whatever the partition's size.

Defined cases: vectors that are null or hold null or non-finite components take no part, as query or as candidate; rows
with the query's own id are not its candidates; vectors of other lengths are compared over the components that both have;
repeated query rows count once; repeated candidates are candidates each; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import arrow

SCALE = 256
SHARD = "query_no long, query_id long, vec_id long, score long"
PROBE = 8


def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer components of the batch's rows that take part; short vectors are filled up with zeros."""
    lists = batch.column(1)
    n = len(lists)
    offsets = lists.offsets.to_numpy()
    lengths = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(offsets), 0)
    value = lists.values.cast(pa.float64())
    bad = ~value.is_valid().to_numpy(zero_copy_only=False)
    x = value.fill_null(0.0).to_numpy(zero_copy_only=False)
    bad |= ~np.isfinite(x)
    row = np.repeat(np.arange(n), lengths)
    at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    src = np.repeat(offsets[:-1], lengths) + at
    ok = lists.is_valid().to_numpy(zero_copy_only=False) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)
    ok[row[bad[src]]] = False
    out = np.zeros((n, int(lengths.max(initial=0))))
    out[row, at] = np.where(bad[src], 0.0, np.floor(SCALE * np.where(bad[src], 0.0, x[src])))
    return batch.column(0).cast(pa.int64()).fill_null(0).to_numpy()[ok], out[ok]


def _fit(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1]))) if x.shape[1] < dims else x[:, :dims]


class Best:
    """A query's k best rows so far."""

    __slots__ = ("ids", "k", "scores")

    def __init__(self, k: int) -> None:
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.k else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # those below the k-th best of these alone can go at once
            keep = scores >= np.partition(scores, len(scores) - self.k)[-self.k]
            ids, scores = ids[keep], scores[keep]
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids, self.scores = ids[order], scores[order]


def search_shard(ids: np.ndarray, terms: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, best: list[Best]) -> None:
    """Improve each query's best rows by a shard; terms: components by rows, each of them a posting list over the shard."""
    low, high = terms.min(axis=1), terms.max(axis=1)
    for no in range(len(query_ids)):
        q, top = queries[no], best[no]
        a, b = q * low, q * high
        least, most = np.minimum(a, b), np.maximum(a, b)
        bar = top.least
        if most.sum() < bar:
            continue
        order = np.argsort(least - most, kind="stable")
        rest = np.concatenate([np.cumsum(most[order][::-1])[::-1], [0.0]])
        floor = np.concatenate([[0.0], np.cumsum(least[order])])
        essential = int(np.flatnonzero(floor + rest >= bar)[-1]) if np.isfinite(bar) else len(order)
        essential = min(len(order), -(-essential // PROBE) * PROBE)
        use = order[:essential]
        score = q[use] @ terms[use]
        live = np.flatnonzero((score + rest[essential] >= bar) & (ids != query_ids[no]))
        score = score[live]
        for j in range(essential, len(order), PROBE):
            if not len(live):
                break
            use = order[j : j + PROBE]
            score = score + q[use] @ terms[np.ix_(use, live)]
            keep = score + rest[min(j + PROBE, len(order))] >= bar
            live, score = live[keep], score[keep]
        if len(live):
            top.add(ids[live], score)


def _search(candidates: DataFrame, query_ids: np.ndarray, queries: np.ndarray, first: int, k: int, shard_rows: int) -> DataFrame:
    dims = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in query_ids]
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def search() -> None:
            if held:
                terms = np.ascontiguousarray(np.concatenate([x for _, x in held]).T)
                search_shard(np.concatenate([i for i, _ in held]), terms, query_ids, queries, best)
                held.clear()

        for batch in batches:
            ids, x = vectors(batch)
            x = _fit(x, dims)
            for s in range(0, len(ids), shard_rows):
                held.append((ids[s : s + shard_rows], x[s : s + shard_rows]))
                if sum(len(i) for i, _ in held) >= shard_rows:
                    search()
        search()
        n = [len(b.ids) for b in best]
        if sum(n):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(first, first + len(best)), n)),
                    pa.array(np.repeat(query_ids, n)),
                    pa.array(np.concatenate([b.ids for b in best])),
                    pa.array(np.concatenate([b.scores for b in best]).astype(np.int64)),
                ],
                names=["query_no", "query_id", "vec_id", "score"],
            )

    return arrow(candidates, run, SHARD)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 4096, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates. Both tables: vec_id, embedding."""
    spark = candidates.sparkSession
    whole = queries.select("vec_id", "embedding").distinct()
    dims_of = lambda df: df.agg(F.max(F.size("embedding"))).head()[0] or 0
    dims = max(int(dims_of(queries)), 1)
    parts, held, first = [], [], 0

    def flush() -> None:
        nonlocal held, first
        ids = np.concatenate([i for i, _ in held])
        parts.append(_search(candidates.select("vec_id", "embedding"), ids, np.concatenate([x for _, x in held]), first, k, shard_rows))
        first, held = first + len(ids), []

    for row in whole.toLocalIterator():
        batch = pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row[1]], pa.list_(pa.float64()))], names=["vec_id", "embedding"])
        ids, x = vectors(batch)
        if len(ids):
            held.append((ids, _fit(x, dims)))
            if len(held) >= query_block:
                flush()
    if held:
        flush()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id")
    ranked = reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
