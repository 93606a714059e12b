"""Language ID by string kernels: blended-spectrum presence kernels, Nystroem landmarks, one-versus-rest kernel ridge regression.

A text is the set of its byte n-grams (n = 1 to `SPECTRUM`), lower-cased, with ASCII characters other than letters as
blanks; a set is a row of 0 and 1 over 2**`BITS` hashed n-grams. The kernel of two texts is the size of the sets'
intersection over the geometric mean of their sizes. Landmarks are training texts, as many of each language as there are
of others; a text's kernel values with them, times the inverse root of the landmarks' own kernel matrix, are its features
(Nystroem), and ridge regression on +1 and -1 gives one score a language. All of it is matrix products of batches.

Fitted on the driver over at most about `MOST` documents (all, if fewer), chosen by a hash of the id; every whole text is
scored. Defined cases: a text that is null, empty or without a letter is `und` with score 0, and so is every text if
nothing could be learned; repeated rows each get their row; with one language learned, all texts with letters have it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.buffers import Block, blocks, text_array
from tidegrid.llm.common import arrow, fold, relieve, sampled

SPECTRUM, BITS, LANDMARKS, MOST, RIDGE = 4, 14, 128, 4_000, 1e-3
UNKNOWN = "und"
#: A text whose best score is below this is in none of the languages.
LEAST = 0.25
_BLANK = np.arange(256, dtype=np.uint32)
_BLANK[:97] = 32
_BLANK[123:128] = 32


def presence(block: Block) -> np.ndarray:
    """0/1 rows of the block's documents (texts lower-cased) over the hashed n-grams."""
    data = _BLANK[block.data]
    n = len(data)
    out = np.zeros((block.n_docs, 1 << BITS), dtype=bool)
    doc = np.repeat(np.arange(block.n_docs), np.diff(block.offsets))
    code = np.zeros(n, dtype=np.uint32)
    ok = np.ones(n, dtype=bool)
    blank = data == 32
    for size in range(1, SPECTRUM + 1):
        m = n - size + 1
        if m <= 0:
            break
        code, ok = code[:m] * np.uint32(257) + data[size - 1 :] + np.uint32(1), ok[:m]
        if size > 1:
            ok = ok & (doc[:m] == doc[size - 1 :]) & ~(blank[size - 2 : n - 1] & blank[size - 1 :])
        place = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        out[doc[:m][ok], place[ok]] = True
    return out


def kernel(x: np.ndarray, landmarks: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Kernel values of presence rows with landmarks (as float32, by columns); root: the root of each landmark's size."""
    size = np.sqrt(np.maximum(x.sum(axis=1), 1)).astype(np.float32)
    return (x.astype(np.float32) @ landmarks) / (size[:, None] * root[None, :])


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray
    root: np.ndarray
    weight: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        k = kernel(x, self.landmarks, self.root)
        return k @ self.weight[:-1] + self.weight[-1]


def fit_model(x: np.ndarray, lang: np.ndarray) -> Model | None:
    """From presence rows and their languages."""
    names = sorted(set(lang.tolist()))
    if not names:
        return None
    each = -(-LANDMARKS // len(names))
    at = np.concatenate([np.flatnonzero(lang == name)[:each] for name in names])
    chosen = x[at]
    root = np.sqrt(np.maximum(chosen.sum(axis=1), 1)).astype(np.float32)
    marks = np.ascontiguousarray(chosen.T.astype(np.float32))
    own = kernel(chosen, marks, root).astype(float)
    value, vector = np.linalg.eigh((own + own.T) / 2)
    keep = value > 1e-6 * value[-1]
    inverse_root = vector[:, keep] / np.sqrt(value[keep])
    k = np.vstack([kernel(x[i : i + 256], marks, root) for i in range(0, len(x), 256)]).astype(float)
    phi = np.hstack([k @ inverse_root, np.ones((len(x), 1))])
    target = np.where(lang[:, None] == np.array(names)[None, :], 1.0, -1.0)
    # each language weighs the same, however many texts it has
    weight = 1 / np.array([np.mean(lang == name) for name in lang])
    gram = phi.T @ (phi * weight[:, None]) + RIDGE * len(x) * np.eye(phi.shape[1])
    solved = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return Model(names, marks, root, np.vstack([inverse_root @ solved[:-1], solved[-1:]]).astype(np.float32))


def fit(docs: DataFrame, most: int = MOST) -> Model | None:
    """docs: doc_id, text, lang; only rows with a language and outside the held-out fold are learned from."""
    train = (fold(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull()
    rows = sampled(docs.where(train).select("doc_id", "text", "lang"), F.col("doc_id"), most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.utf8_lower(text_array(batch.column(1)))
            bits = [np.packbits(row).tobytes() for block in blocks(text, 1 << 18) for row in presence(block)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits, pa.binary())], names=["doc_id", "lang", "bits"])

    # one row an id, chosen on the executors: repeated rows never go to the driver
    got = arrow(rows, extract, "doc_id long, lang string, bits binary").groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("r")).select("doc_id", "r.*").toArrow()
    if not got.num_rows:
        return None
    # landmarks are the first of each language in this order: that of a hash of the id
    order = np.argsort([(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) for i in got.column("doc_id").to_pylist()], kind="stable")
    x = np.array([np.unpackbits(np.frombuffer(got.column("bits")[int(i)].as_py(), np.uint8)) for i in order], dtype=bool).reshape(len(order), -1)
    return fit_model(x, np.array(got.column("lang").to_pylist(), dtype=object)[order])


def judged(column: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the language and its score (from the best regression value: 0 at -1 or less, 1 at 1 or more)."""
    text = text_array(column)
    known = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False)
    best, score = np.zeros(len(text), np.int64), np.zeros(len(text))
    if model is None:
        known = np.zeros(len(text), dtype=bool)
    else:
        for block in blocks(pc.utf8_lower(text), 1 << 18):
            for first in range(0, block.n_docs, 256):
                last = min(first + 256, block.n_docs)
                part = Block(block.first + first, block.first + last, block.data[block.offsets[first] : block.offsets[last]], block.offsets[first : last + 1] - block.offsets[first])
                s = model.scores(presence(part))
                best[part.first : part.last] = s.argmax(axis=1)
                score[part.first : part.last] = np.clip((s.max(axis=1) + 1) / 2, 0, 1)
    names = np.array([*(model.languages if model else []), UNKNOWN], dtype=object)
    return names[np.where(known, best, len(names) - 1)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = judged(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang.tolist(), pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, least: float = LEAST, most: int = MOST) -> DataFrame:
    """The rows of docs whose text is in one of the languages learned, with at least this score."""
    model, text = fit(docs, most), docs.columns.index("text")
    relieve(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = judged(batch.column(text), model)
            yield batch.filter(pa.array((lang != UNKNOWN) & (score >= least)))

    return arrow(docs, run, docs.schema)


def identify(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs, fit(docs, most)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
