"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are lexicon densities (a fixed list of insults, and a list of words learned from the labels), the share of lexicon
words near a word of the second person, capitals, punctuation and obfuscation rates, and the like. The learned list holds
the words that toxic training documents have far more often than others; when trees are fitted, each half of the training
documents gets its features from the other half's list. A fifth of the training documents only calibrates.

The model is fitted on the driver over at most about `most` labelled documents (all, if fewer), chosen by a hash of the
id; it scores every whole text. Defined cases: null and empty texts have zero features and get the score these give;
without labels of both kinds every score is the share of toxic labels (0 without any); a document with several labels
counts as toxic if any label says so; a null doc_id has no label and is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.boosting import Isotonic, Trees, fit_isotonic, fit_trees
from tidegrid.llm.buffers import Words, blocks, signed
from tidegrid.llm.common import arrow, fold, relieve, sampled
from tidegrid.llm.textstats import features, held, near, per_doc

MOST, HOLD, LEAST_DOCS, MOST_WORDS, LEAST_ODDS = 12_000, 5, 3, 4096, 1.5
TOXIC = 0.5


@dataclass
class Lexicon:
    """Learned words by hash, with the log of how much more often toxic documents have them."""

    words: np.ndarray
    weight: np.ndarray


def learn_lexicon(sets: list[np.ndarray], y: np.ndarray) -> Lexicon:
    a = np.concatenate([s for s, v in zip(sets, y, strict=True) if v] or [np.zeros(0, np.uint64)])
    b = np.concatenate([s for s, v in zip(sets, y, strict=True) if not v] or [np.zeros(0, np.uint64)])
    word, n = np.unique(a, return_counts=True)
    keep = n >= LEAST_DOCS
    word, n = word[keep], n[keep]
    other, m = np.unique(b, return_counts=True)
    found, at = held(other, word)
    clean = np.where(found, m[at] if len(m) else 0, 0)
    odds = np.log((n + 0.5) / (y.sum() + 1)) - np.log((clean + 0.5) / (len(y) - y.sum() + 1))
    keep = np.flatnonzero(odds >= LEAST_ODDS)
    keep = np.sort(keep[np.argsort(-odds[keep] * np.log1p(n[keep]), kind="stable")[:MOST_WORDS]])
    return Lexicon(word[keep], odds[keep])


def lexicon_features(lexicon: Lexicon, w: Words, second: np.ndarray | None = None) -> np.ndarray:
    """Per document: density, weight a word, greatest weight, sum of weights, hits, hits near the second person."""
    found, at = held(lexicon.words, w.hash)
    weight = np.where(found, lexicon.weight[at] if len(lexicon.weight) else 0.0, 0.0)
    total = np.maximum(w.counts, 1)
    hits, mass = per_doc(found, w.bounds), per_doc(weight, w.bounds)
    top = np.zeros(len(w.counts))
    np.maximum.at(top, w.doc, weight)
    close = per_doc(near(found, second, w), w.bounds) if second is not None else np.zeros(len(hits))
    return np.stack([hits / total, mass / total, top, np.log1p(mass), np.log1p(hits), close / total], axis=1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    isotonic: Isotonic
    constant: float | None = None

    def score(self, base: np.ndarray, w: Words, second: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(base), self.constant)
        return self.isotonic(self.trees.margin(np.hstack([base, lexicon_features(self.lexicon, w, second)])))


def _second(w: Words) -> np.ndarray:
    from tidegrid.llm.textstats import _SECOND

    return held(_SECOND, w.hash)[0]


def training_rows(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: int) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most about `most` labelled documents for which `train` holds."""
    known = labels.select("doc_id", F.col(label).alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = sampled(known.where(train), F.col("doc_id"), most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    train = fold(F.col("doc_id"), HOLD) != 0

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, sets, seconds = [], [], []
            for block in blocks(batch.column(1)):
                x, w = features(block)
                base += x.tolist()
                s = _second(w)
                for d in range(block.n_docs):
                    a, b = w.bounds[d], w.bounds[d + 1]
                    sets.append(signed(w.hash[a:b]).tobytes())
                    seconds.append(np.packbits(s[a:b]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(pa.float64())), pa.array(sets, pa.binary()), batch.column(2).cast(pa.int32())], names=["doc_id", "x", "words", "y"])

    # one row an id, chosen on the executors: repeated rows never go to the driver
    rows = arrow(training_rows(docs, labels, "toxic", train, most), extract, "doc_id long, x array<double>, words binary, y int")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("x", "words", "y")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    y = rows.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), fit_trees(np.zeros((0, 1)), np.zeros(0)), Isotonic(np.zeros(0), np.zeros(0)), float(y.mean()) if len(y) else 0.0)
    x = np.array(rows.column("x").to_pylist())
    lists = [np.frombuffer(b.as_py(), dtype=np.uint64) for b in rows.column("words")]
    sets = [np.unique(v) for v in lists]
    group = np.array([int(np.uint32(hash_id(i))) for i in rows.column("doc_id").to_pylist()]) % 10
    half = {0: group < 4, 1: (group >= 4) & (group < 8)}
    calibrate = group >= 8
    pick = lambda mask: [sets[i] for i in np.flatnonzero(mask)]

    def wide(lexicon: Lexicon, at: np.ndarray) -> np.ndarray:
        n = [len(lists[i]) for i in at]
        bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        value = np.concatenate([lists[i] for i in at]) if len(at) else np.zeros(0, np.uint64)
        w = Words(np.repeat(np.arange(len(at)), n), bounds[:0], bounds[:0], value, bounds, np.array(n, np.int64))
        return np.hstack([x[at], lexicon_features(lexicon, w, _second(w))])

    xs, ys = [], []
    for k in (0, 1):
        at = np.flatnonzero(half[k])
        if len(at):
            xs.append(wide(learn_lexicon(pick(half[1 - k]), y[half[1 - k]]), at))
            ys.append(y[at])
    trees = fit_trees(np.vstack(xs), np.concatenate(ys))
    lexicon = learn_lexicon(pick(~calibrate), y[~calibrate])
    at = np.flatnonzero(calibrate)
    return Model(lexicon, trees, fit_isotonic(trees.margin(wide(lexicon, at)), y[at]) if len(at) else Isotonic(np.zeros(0), np.zeros(0)))


def hash_id(doc_id: int) -> int:
    """A fixed shuffle of ids for the fitting's own splits."""
    return (doc_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 32


def scores(column: pa.Array, model: Model) -> np.ndarray:
    out = []
    for block in blocks(column):
        x, w = features(block)
        out.append(model.score(x, w, _second(w)))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = scores(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(p), pa.array((p >= TOXIC).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, score double, predicted int")


def clean(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """The rows of docs that are not predicted to be toxic."""
    model, text = fit(docs, labels, most), docs.columns.index("text")
    relieve(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(text), model) < TOXIC))

    return arrow(docs, run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, score, predicted: fitted on the labels outside the held-out fold."""
    held_out = F.coalesce(fold(F.col("doc_id"), HOLD) == 0, F.lit(False))
    return score(docs, fit(docs, labels, most)).select("doc_id", held_out.alias("held_out"), "score", "predicted")
