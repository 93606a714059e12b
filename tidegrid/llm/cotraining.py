"""Quality classifier by co-training: text content and metadata as two views of a document.

The text view is boosted trees over dense features of the whole text; the metadata view is a logistic regression over what
is declared of it: the source and the language (hashed, and both together) and the number of characters. Each starts from
the labelled documents. In each round, each view gives the unlabelled documents of which it is surest to the other as
pseudo-labels: of each class the first by margin, a share of the pool times the class's base rate, if their calibrated
probability is above that base rate. They weigh less than real labels, in proportion to that probability. At the end each view is calibrated on labelled documents
that nothing was fitted on, and the calibrated views are combined by a logistic regression of their logits.

Fitted on the driver over at most about `most` labelled and as many unlabelled documents, chosen by a hash of the id;
every whole text is scored. Labels are learned only outside the held-out fold (crc32 of the id modulo 5 is 0).
Defined cases: null and empty texts and null metadata have features of their own and are scored; without labels of both
kinds every score is the share of good labels (0 without any); of several labels of a document the smallest holds; a null
doc_id has no label and is not held out; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.boosting import Isotonic, Logistic, Trees, fit_isotonic, fit_logistic, fit_trees, sigmoid
from tidegrid.llm.buffers import blocks
from tidegrid.llm.common import arrow, fold, sampled
from tidegrid.llm.textstats import features

MOST, HOLD, ROUNDS, SHARE, PSEUDO = 12_000, 5, 3, 0.02, 0.5
#: Places of hashed sources, languages, both together, and half powers of two of the declared length.
SOURCES, LANGS, PAIRS, SIZES = 64, 16, 128, 48


def _place(value: object, most: int) -> int:
    return 0 if value is None else 1 + xxhash.xxh32_intdigest(str(value)) % (most - 1)


def metadata(source: list, lang: list, n_chars: list) -> np.ndarray:
    """One row a document, of declared metadata only: hashed source, language and both, and the length, also in steps."""
    n = len(source)
    out = np.zeros((n, SOURCES + LANGS + PAIRS + SIZES + 3))
    declared = np.array([-1 if c is None else max(int(c), 0) for c in n_chars], dtype=float).reshape(n)
    length = np.log2(np.maximum(declared, 0) + 1)
    step = np.minimum(2 * length, SIZES - 1).astype(int)
    for i, (s, g) in enumerate(zip(source, lang, strict=True)):
        out[i, _place(s, SOURCES)] = 1
        out[i, SOURCES + _place(g, LANGS)] = 1
        out[i, SOURCES + LANGS + _place((s, g), PAIRS)] = 1
        out[i, SOURCES + LANGS + PAIRS + step[i]] = declared[i] >= 0
    out[:, -3] = declared < 0
    out[:, -2] = length
    out[:, -1] = length**2 / 10
    return out


def both_views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Features of (doc_id, text, source, lang, n_chars) rows: of the text, and of the metadata."""
    text = [features(block)[0] for block in blocks(batch.column(1))]
    return np.vstack(text), metadata(*[batch.column(i).to_pylist() for i in (2, 3, 4)])


@dataclass
class View:
    """A classifier and the calibration of its margin."""

    model: Trees | Logistic
    calibration: Isotonic

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.model.margin(x))


@dataclass
class Model:
    text: View | None
    meta: View | None
    blend: Logistic | None
    constant: float
    #: By round, how many pseudo-labels each view gave to the other, by class.
    given: list[dict[tuple[str, int], int]] = field(default_factory=list)
    #: The views before any exchange.
    first: tuple[View, View] | None = None

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            p = np.full(len(x), self.constant)
            return p, p, p
        a, b = self.text.probability(x), self.meta.probability(m)
        return a, b, sigmoid(self.blend.margin(logits(a, b)))


def logits(*p: np.ndarray) -> np.ndarray:
    x = np.stack(p, axis=1).clip(1e-4, 1 - 1e-4)
    return np.log(x / (1 - x))


def surest(view: View, pool: np.ndarray, known: dict[int, tuple[float, float]], base: float, share: float) -> dict[int, tuple[float, float]]:
    """(label, its probability) of the pool's rows of which a view is surest and the other has no label yet, by row."""
    out: dict[int, tuple[float, float]] = {}
    margin = view.model.margin(pool)
    p = view.calibration(margin)
    for label, rate, by, sure in ((1.0, base, -margin, p), (0.0, 1 - base, margin, 1 - p)):
        most = int(np.ceil(share * rate * len(pool)))
        ranked = [i for i in np.argsort(by, kind="stable").tolist() if sure[i] > rate and i not in known and i not in out]
        out |= {i: (label, float(sure[i])) for i in ranked[:most]}
    return out


def cotrain(x: np.ndarray, m: np.ndarray, y: np.ndarray, pool_x: np.ndarray, pool_m: np.ndarray, rounds: int = ROUNDS, share: float = SHARE) -> Model:
    """Labelled rows of both views in a random order, and an unlabelled pool."""
    if not len(y) or y.min() == y.max():
        return Model(None, None, None, float(y.mean()) if len(y) else 0.0)
    calibrate = np.arange(len(y)) % 5 == 0
    blend = np.arange(len(y)) % 10 == 5
    fit_on = ~calibrate & ~blend if len(y) > 100 else np.ones(len(y), dtype=bool)
    given: dict[str, dict[int, tuple[float, float]]] = {"text": {}, "meta": {}}
    base, told = float(y[fit_on].mean()), []

    def fit_view(name: str) -> View:
        rows, pool = (x, pool_x) if name == "text" else (m, pool_m)
        at = np.array(sorted(given[name]), dtype=np.int64)
        values = np.concatenate([y[fit_on], [given[name][i][0] for i in at.tolist()]])
        data = np.vstack([rows[fit_on], pool[at]]) if len(at) else rows[fit_on]
        weight = np.concatenate([np.ones(int(fit_on.sum())), [PSEUDO * given[name][i][1] for i in at.tolist()]])
        model = fit_trees(data, values, trees=60, weight=weight) if name == "text" else fit_logistic(data, values, ridge=5.0)
        return View(model, fit_isotonic(model.margin(rows[calibrate]), y[calibrate]))

    views = first = {name: fit_view(name) for name in given}
    for _ in range(rounds if len(pool_x) else 0):
        fresh = {"text": surest(views["meta"], pool_m, given["text"], base, share), "meta": surest(views["text"], pool_x, given["meta"], base, share)}
        if not any(fresh.values()):
            break
        for name in given:
            given[name] |= fresh[name]
        told.append({(name, label): sum(v[0] == label for v in fresh[other].values()) for name, other in (("text", "meta"), ("meta", "text")) for label in (0, 1)})
        views = {name: fit_view(name) for name in given}
    a, b = views["text"].probability(x), views["meta"].probability(m)
    on = blend if blend.any() and 0 < y[blend].mean() < 1 else np.ones(len(y), dtype=bool)
    return Model(views["text"], views["meta"], fit_logistic(logits(a, b)[on], y[on]), float(y.mean()), told, (first["text"], first["meta"]))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    known = labels.select("doc_id", F.col("quality").alias("y")).where("y IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("y").alias("y"))
    train = sampled(known.where(fold(F.col("doc_id"), HOLD) != 0), F.col("doc_id"), most)
    ids = docs.where("doc_id IS NOT NULL").select("doc_id")
    pool = sampled(ids.where(fold(F.col("doc_id"), HOLD) != 0).join(known.select("doc_id"), "doc_id", "left_anti"), F.xxhash64("doc_id"), most)
    chosen = train.unionByName(pool.select("doc_id", F.lit(None).cast("int").alias("y")).distinct())

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, m = both_views(batch)
                lists = [pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], pa.array(v.ravel())) for v in (x, m)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5).cast(pa.int32()), *lists], names=["doc_id", "y", "x", "m"])

    rows = arrow(docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(chosen), "doc_id"), extract, "doc_id long, y int, x array<double>, m array<double>")
    # one row an id, chosen on the executors: repeated rows never go to the driver
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("y", "x", "m")).alias("r")).select("doc_id", "r.*").toArrow()
    order = np.argsort([(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in rows.column("doc_id").to_pylist()], kind="stable")
    array = lambda name: np.stack([np.array(v.as_py()) for v in rows.column(name)])[order] if len(order) else np.zeros((0, 1))
    x, m = array("x"), array("m")
    y = np.array([np.nan if v is None else float(v > 0) for v in rows.column("y").to_pylist()])[order] if len(order) else np.zeros(0)
    has = ~np.isnan(y)
    return cotrain(x[has], m[has], y[has], x[~has], m[~has])


def classify(docs: DataFrame, labels: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, text_score, metadata_score, score (0 to 1, higher: better), predicted."""
    model = fit(docs, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, p = model.scores(*both_views(batch))
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(a), pa.array(b), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "text_score", "metadata_score", "score", "predicted"])

    scored = arrow(docs.select("doc_id", "text", "source", "lang", "n_chars"), run, "doc_id long, text_score double, metadata_score double, score double, predicted int")
    held_out = F.coalesce(fold(F.col("doc_id"), HOLD) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "text_score", "metadata_score", "score", "predicted")
