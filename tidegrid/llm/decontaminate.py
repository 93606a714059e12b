"""Benchmark decontamination by winnowing.

A fingerprint is the smallest hash of `w` consecutive k-grams of words, kept for each window of a text. Two texts that
share k + w - 1 words in a row share a fingerprint there, so with k = 5 and w = 9 no shared run of 13 words is missed.
The benchmark's fingerprints are the index; a document's fingerprints are looked up in it, and every hit is extended
to the left and right while the words agree. Runs of 13 or more words are hits; n-grams of items that are shorter
than 13 words are one window each and are looked up by the hash of all their words.

The index holds at most `block_words` benchmark words at a time: a larger benchmark is cut into blocks of items, each
applied to all documents, and the hit words of the blocks are merged document by document. So what is sent to the
executors has a fixed bound, and documents are never shuffled for a benchmark of one block.

Defined cases: null texts have no words; items without words have no window; repeated documents each get their row;
repeated item ids count once in n_items; a null item_id takes no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegrid.llm.buffers import ALNUM, blocks, grams, inside, words
from tidegrid.llm.common import arrow

WINDOW, GRAM = 13, 5
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<long>, spans array<struct<first: long, last: long>>, text_hash long"


@dataclass
class Index:
    """Benchmark words, item by item, and where each fingerprint stands; short items by number of words and hash."""

    ids: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    prints: np.ndarray
    places: np.ndarray
    items: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def winnow(value: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest (rightmost, if several) of each `window` values in a row; of all, if there are fewer."""
    n = len(value) - window + 1
    if n <= 0:
        return np.array([len(value) - 1 - int(np.argmin(value[::-1]))]) if len(value) else np.zeros(0, np.int64)
    least, reach = value, 1
    while reach * 2 <= window:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = window - reach
    if rest:
        least = np.minimum(least[: len(least) - rest], least[rest:])
    # a value is kept if some window that holds it has it as its minimum
    low = np.concatenate([least, np.zeros(window - 1, np.uint64)])
    reach = 1
    while reach * 2 <= window:
        low[reach:] = np.maximum(low[reach:], low[:-reach].copy())
        reach *= 2
    if window > reach:
        rest = window - reach
        low[rest:] = np.maximum(low[rest:], low[:-rest].copy())
    return np.flatnonzero(low >= value)


def build_index(ids: list[int], texts: list[str | None], window: int = WINDOW, gram: int = GRAM) -> Index:
    hashes, bounds, prints, places, items = [], [0], [], [], []
    short: dict[int, list[tuple[int, int]]] = {}
    for block in blocks(pa.array(texts, pa.large_string())):
        w = words(block, ALNUM)
        for d in range(block.n_docs):
            item = len(bounds) - 1
            h = w.hash[w.bounds[d] : w.bounds[d + 1]]
            hashes.append(h)
            bounds.append(bounds[-1] + len(h))
            if len(h) >= window:
                g = grams(h, gram)
                at = winnow(g, window - gram + 1)
                prints.append(g[at])
                places.append(at)
                items.append(np.full(len(at), item))
            elif len(h):
                short.setdefault(len(h), []).append((int(grams(h, len(h))[0]), item))
    cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
    value = cat(prints, np.uint64)
    order = np.argsort(value, kind="stable")
    tables = {}
    for n, pairs in short.items():
        pairs.sort()
        tables[n] = (np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs]))
    return Index(np.array(ids, np.int64), cat(hashes, np.uint64), np.array(bounds), value[order], cat(places, np.int64)[order], cat(items, np.int64)[order], tables)


def matches(table: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (place in value, place in the sorted table) with the same hash."""
    lo = np.searchsorted(table, value, side="left")
    found = np.flatnonzero((lo < len(table)) & (table[np.minimum(lo, len(table) - 1)] == value)) if len(table) else np.zeros(0, np.int64)
    hi = np.searchsorted(table, value[found], side="right")
    n = hi - lo[found]
    at = np.repeat(found, n)
    first = np.repeat(lo[found] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(found) else np.zeros(0, np.int64)
    return at, first + np.arange(len(at))


def hits(h: np.ndarray, doc: np.ndarray, bounds: np.ndarray, g: np.ndarray, ok: np.ndarray, index: Index, window: int, gram: int) -> list[tuple[int, int, int]]:
    """(first word, last word + 1, item) of each run of words that a document of the block shares with an item."""
    span = window - gram + 1
    out: list[tuple[int, int, int]] = []
    if len(index.prints) and len(g):
        # over a border, a window of k-grams has foreign ones; so each document's k-grams stand with large values between
        at = winnow(np.where(ok, g, np.uint64(0xFFFFFFFFFFFFFFFF)), span)
        at = at[ok[at]]
        i, j = matches(index.prints, g[at])
        i = at[i]
        item, place = index.items[j], index.places[j]
        diagonal = i - place
        seen: dict[tuple[int, int], int] = {}
        for a, it, pl, dg in zip(i.tolist(), item.tolist(), place.tolist(), diagonal.tolist(), strict=True):
            if seen.get((it, dg), -1) > a:
                continue
            d = doc[a]
            lo, hi = bounds[d], bounds[d + 1]
            b, e = index.bounds[it], index.bounds[it + 1]
            first, last = max(lo, dg), min(hi, dg + (e - b))
            same = h[first:last] == index.hash[b + first - dg : b + last - dg]
            left = a - first
            stop = np.flatnonzero(~same[:left][::-1])
            start = a - (int(stop[0]) if len(stop) else left)
            stop = np.flatnonzero(~same[left:])
            end = a + (int(stop[0]) if len(stop) else len(same) - left)
            seen[(it, dg)] = max(end, a + 1)
            if end - start >= window:
                out.append((start, end, it))
    for n, (table, of) in index.short.items():
        s = grams(h, n)
        if not len(s):
            continue
        same_doc = doc[: len(s)] == doc[n - 1 :]
        i, j = matches(table, s)
        out += [(a, a + n, it) for a, it in zip(i.tolist(), of[j].tolist(), strict=True) if same_doc[a]]
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, as disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def finish(n_words: int, spans: list[tuple[int, int]], items: set[int]) -> tuple:
    spans = merged(spans)
    n_hit = sum(b - a for a, b in spans)
    named = ",".join(sorted(map(str, items)))
    return n_words, n_hit, len(items), hashlib.sha256(named.encode()).hexdigest(), n_hit > 0 and 20 * n_hit >= n_words, sorted(items), spans


def _rows(column: pa.Array, index: Index, window: int, gram: int) -> Iterator[tuple[int, list, set]]:
    """Of each text its number of words, hit spans and items."""
    for block in blocks(column):
        w = words(block, ALNUM)
        g, ok = grams(w.hash, gram), inside(w, gram)
        spans: dict[int, list] = {}
        named: dict[int, set] = {}
        for a, b, it in hits(w.hash, w.doc, w.bounds, g, ok, index, window, gram):
            d = int(w.doc[a])
            spans.setdefault(d, []).append((a - int(w.bounds[d]), b - int(w.bounds[d])))
            named.setdefault(d, set()).add(int(index.ids[it]))
        for d in range(block.n_docs):
            yield int(w.counts[d]), spans.get(d, []), named.get(d, set())


def scan(docs: DataFrame, index: Index, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """A result row for each document against one block of the benchmark."""
    schema = StructType.fromDDL(RESULT)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [finish(n, spans, items) for n, spans, items in _rows(batch.column(1), index, window, gram)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 7
            spans = [[{"first": a, "last": b - 1} for a, b in s] for s in cols[6]]
            arrays = [batch.column(0).cast(pa.int64()), *[pa.array(list(c), shape.field(k + 1).type) for k, c in enumerate(cols[:6])], pa.array(spans, shape.field(7).type), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), run, schema)


def benchmark_blocks(benchmark: DataFrame, most: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about `most` bytes of text; one block is on the driver at a time."""
    ids, texts, size = [], [], 0
    for row in benchmark.where("item_id IS NOT NULL").select("item_id", "text").toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1] or "")
        if size >= most:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = 8 << 20) -> DataFrame:
    """Of each document: words, hit words, items with windows in it, their digest, contaminated, items and spans of hit words."""
    parts = [scan(docs, build_index(*block, window, gram), window, gram) for block in benchmark_blocks(benchmark, block_bytes)]
    if len(parts) < 2:
        return parts[0] if parts else scan(docs, build_index([], [], window, gram), window, gram)
    # repeated documents are told apart only by their number: each is there once for each block of the benchmark
    key = ("doc_id", "n_words", "text_hash")
    once = [p.groupBy(*key, "items", "spans").agg(F.count(F.lit(1)).alias("copies")) for p in parts]
    grouped = reduce(DataFrame.unionByName, once).groupBy(*key).agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"), F.max("copies").alias("copies"))
    schema = parts[0].schema
    shape = to_arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found = finish(r["n_words"], [(s["first"], s["last"] + 1) for s in r["spans"]], set(r["items"]))
                row = dict(zip(schema.fieldNames(), (r["doc_id"], *found, r["text_hash"]), strict=True))
                out.append(row | {"spans": [{"first": a, "last": b - 1} for a, b in found[-1]]})
            yield pa.RecordBatch.from_pylist(out, schema=shape)

    copies = grouped.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
    return arrow(copies, merge, schema)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = 8 << 20) -> DataFrame:
    """The rows of docs that are not contaminated; docs may have any columns besides doc_id and text."""
    parts = benchmark_blocks(benchmark, block_bytes)
    first, more = next(parts, ([], [])), next(parts, None)
    if more is not None:
        bad = contamination(docs, benchmark, window, gram, block_bytes).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_anti")
    index, text = build_index(*first, window, gram), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not finish(n, spans, items)[4] for n, spans, items in _rows(batch.column(text), index, window, gram)], pa.bool_()))

    return arrow(docs, run, docs.schema)
