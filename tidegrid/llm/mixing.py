"""LM scoring by logistic context mixing: hashed-context bit predictors, gated weights, and an adaptive refinement.

A text's bytes (A-Z lower-cased, an end byte last) are predicted bit by bit, from the high bit on. For each of the `ORDERS`
zeros and ones are counted by that many bytes before and the bits already known: exactly, for every context there is. The
log odds of each table are inputs of a mixer; which of its weight vectors is used is chosen by a gate: the bit's number
and the longest context that was seen before. The mixed probability is refined by a table over the known bits and the
quantised log odds, and averaged with what it says. The text's score is the sum over all bits, as log10 of its probability.

A bit's probability depends on a window only: its byte and the bytes before it that the longest context has. Distinct windows
are counted over all training documents and dealt by their last three context bytes, so that all counts of the contexts of
three bytes or more are in one task; windows of the shorter contexts, at most 2^24, go to all tasks. Weights and refinement
are learned online over the windows of one training document in `LEARN`, against the counts of all others (or else the long
contexts would always be right), in an order that only the windows decide, and averaged over tasks. Shares are of documents and tasks of windows, both by hash, so a score does not depend on how the documents are split or ordered. Then each distinct window's cost is worked out
once. Costs of the windows most often used (at most `HEAD_WINDOWS`) go to all tasks; others are joined by the window.

The word model beside it gives base_score. Counts of the words most often used (at most `HEAD`) go to all tasks; others
are joined by the word's hash, one row a document and word.

Defined cases: a null or empty text is the end byte, and the end token, alone; a null doc_id takes part in training;
repeated rows are counted and scored each; without training documents each bit costs one bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.boosting import sigmoid
from tidegrid.llm.buffers import _LOWER, SPACED, Block, blocks, mix, signed, words
from tidegrid.llm.common import Scratch, arrow, fold

ORDERS = (1, 2, 3, 4, 5)
Find = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
BITS, HOLD, HEAD, HEAD_WINDOWS = 19, 10, 1 << 16, 1 << 21
CHUNK, TAKEN, STEP, RATE, PRIOR = 1 << 20, 1 << 21, 4096, 0.05, 0.4
DEALT = 24
#: Shares of the training documents: those that weights are learned from (one in `LEARN`, by a hash of the id), and the others;
#: and the number that says held-out ones. A window's number has its share above its bytes.
LEARN, FOLDS, WINDOW_BITS = 8, 2, 8 * (max(ORDERS) + 1)
#: Orders whose counts go to all tasks.
SHORT = 2
GATES = 8 * (len(ORDERS) + 1)
INPUTS = len(ORDERS) + 1
LEVELS, REACH, SLOW = 33, 8.0, 20.0
END_BYTE = 0xFF
#: The end token's key among the words' hashes.
END_TOKEN = -1


def windows(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end byte: that byte and those before it that the longest context has, as one number; and the document."""
    n, size = block.n_docs, np.diff(block.offsets)
    # before each text as many zeros as a number has bytes besides the last; the end byte after it
    data = np.zeros(len(block.data) + 9 * n + 8, dtype=np.uint8)
    inside = np.zeros(len(data) - 7, dtype=bool)
    lowered = _LOWER[block.data]
    first = 0
    for begin, end in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True):
        length = end - begin
        data[first + 7 : first + 7 + length] = lowered[begin:end]
        data[first + 7 + length] = END_BYTE
        inside[first : first + length + 1] = True
        first += length + 9
    # eight bytes from any place on, read as one number
    every = np.ndarray((len(data) - 7,), dtype=">u8", buffer=data, strides=(1,)).astype(np.uint64)
    return every[inside] & np.uint64((1 << 8 * (max(ORDERS) + 1)) - 1), np.repeat(np.arange(n), size + 1)


@dataclass
class Distinct:
    """Windows of several blocks with their counts, put together now and then."""

    keys: list[np.ndarray] = field(default_factory=list)
    times: list[np.ndarray] = field(default_factory=list)
    size: int = 0
    total: int = 0

    def add(self, key: np.ndarray) -> None:
        k, n = np.unique(key, return_counts=True)
        self.keys.append(k)
        self.times.append(n)
        self.size += len(k)
        self.total += len(key)

    def compact(self) -> None:
        key, n = self.take()
        if len(key):
            self.keys, self.times, self.size = [key], [n], len(key)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key, times = np.concatenate(self.keys), np.concatenate(self.times)
        self.keys, self.times, self.size, self.total = [], [], 0, 0
        order = np.argsort(key)
        key, times = key[order], times[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[starts], np.add.reduceat(times, starts)


class Known:
    """Costs of windows worked out before, in a table of fixed size; what is not there is worked out again."""

    def __init__(self, work: Callable[[np.ndarray], np.ndarray], bits: int = 21) -> None:
        self.work, self.bits = work, bits
        self.key = np.full(1 << bits, 1 << 63, dtype=np.uint64)
        self.cost = np.zeros(1 << bits)

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = self.place(key)
        out = self.cost[at]
        missing = np.flatnonzero(self.key[at] != key)
        if len(missing):
            fresh, where = np.unique(key[missing], return_inverse=True)
            value = self.work(fresh)
            out[missing] = value[where]
            at = self.place(fresh)
            self.key[at], self.cost[at] = fresh, value
            # where several new ones meet at a place, none of them stays
            self.key[at[self.key[at] != fresh]] = np.uint64(1 << 63)
        return out


def known_bits(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window's last byte, bit by bit: the bits known before (with a leading one), and the bit. (bits, windows)"""
    byte = (key & np.uint64(255)).astype(np.int64)
    shift = np.arange(8)[:, None]
    return (1 << shift) | (byte[None, :] >> (8 - shift)), (byte[None, :] >> (7 - shift)) & 1


class Contexts:
    """Places of all contexts and known bits that some windows have, each with a place of its own.

    low: sorted windows of the short orders; key: sorted windows.
    """

    def __init__(self, low: np.ndarray, key: np.ndarray) -> None:
        self.low, self.key, self.size = low, key, 0
        self.low_at, self.at = self._numbered(low, ORDERS[:SHORT]), self._numbered(key, ORDERS[SHORT:])

    def _numbered(self, key: np.ndarray, orders: tuple[int, ...]) -> np.ndarray:
        node = known_bits(key)[0].astype(np.uint64)
        out = np.empty((len(orders), *node.shape), np.int64)
        for i, order in enumerate(orders):
            context = (key >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
            code, at = np.unique(context[None, :] << np.uint64(8) | node, return_inverse=True)
            out[i] = at.reshape(node.shape) + self.size
            self.size += len(code)
        return out

    def slots(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As slots(), for windows that are known."""
        low = self.low_at[:, :, np.searchsorted(self.low, key & _mask(SHORT + 1))]
        return np.concatenate([low, self.at[:, :, np.searchsorted(self.key, key)]]), *known_bits(key)

    def counts(self, low: tuple[np.ndarray, np.ndarray], own: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The table of (zeros, ones) of windows and their times, those of the short orders first."""
        table = np.zeros(2 * self.size)
        for known, at, (key, times) in ((self.low, self.low_at, low), (self.key, self.at, own)):
            place = 2 * at[:, :, np.searchsorted(known, key)] + known_bits(key)[1]
            table += np.bincount(place.ravel(), np.broadcast_to(times.astype(float), place.shape).ravel(), len(table))
        return table.reshape(-1, 2)


def _mask(size: int) -> np.uint64:
    return np.uint64((1 << 8 * size) - 1)


# places, slots and count are the form with hashed tables of fixed size, for few windows


def places(key: np.ndarray, node: np.ndarray, i: int) -> np.ndarray:
    """Places in the i-th order's table. (bits, windows)"""
    context = (key >> np.uint64(8)) & np.uint64((1 << 8 * ORDERS[i]) - 1)
    h = mix(context * np.uint64(2 * len(ORDERS) + 1) + np.uint64(i))
    at = node.astype(np.uint64)
    at *= np.uint64(0xD6E8FEB86659FD93)
    at += h[None, :]
    at *= np.uint64(0x9E3779B97F4A7C15)
    at >>= np.uint64(64 - BITS)
    return at.view(np.int64)


def slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: places in all tables (orders, bits, windows), the known bits before each bit, and the bits."""
    node, bit = known_bits(key)
    return np.stack([places(key, node, i) + (i << BITS) for i in range(len(ORDERS))]), node, bit


def count(key: np.ndarray, times: np.ndarray, table: np.ndarray) -> None:
    """Add windows to the table of (zeros, ones)."""
    for first in range(0, len(key), 1 << 17):
        part = key[first : first + (1 << 17)]
        node, bit = known_bits(part)
        weight = np.broadcast_to(times[first : first + (1 << 17)].astype(float), bit.shape).ravel()
        for i in range(len(ORDERS)):
            place = places(part, node, i)
            place *= 2
            place += bit
            table[i << BITS : (i + 1) << BITS] += np.bincount(place.ravel(), weight, 2 << BITS).reshape(-1, 2)


def odds_and_seen(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each place's log odds of a one, and whether it was seen."""
    return (np.log(table[:, 1] + PRIOR) - np.log(table[:, 0] + PRIOR)).astype(np.float32), table.sum(axis=1) > 0.5


@dataclass
class Mixer:
    """Weights by gate, the refinement's sums (ones and all, by known bits and level), and the bits learned from by gate."""

    weight: np.ndarray
    ones: np.ndarray
    total: np.ndarray
    mass: np.ndarray = field(default_factory=lambda: np.zeros(GATES))

    @staticmethod
    def fresh() -> Mixer:
        weight = np.full((GATES, INPUTS), 0.3)
        weight[:, -1] = 0
        return Mixer(weight, np.zeros((256, LEVELS)), np.zeros((256, LEVELS)))

    def refinement(self) -> np.ndarray:
        centre = sigmoid(np.linspace(-REACH, REACH, LEVELS))
        return (self.ones + SLOW * centre[None, :]) / (self.total + SLOW)


def inputs(at: np.ndarray, odds: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mixer inputs (inputs, bits, windows) and gates (bits, windows)."""
    x = np.ones((INPUTS, *at.shape[1:]), dtype=np.float32)
    longest = np.zeros(at.shape[1:], dtype=np.int64)
    for i in range(len(ORDERS)):
        x[i] = odds[at[i]]
        longest = np.where(seen[at[i]], i + 1, longest)
    return x, longest * 8 + np.arange(8)[:, None]


def mixed(x: np.ndarray, weight: np.ndarray, gate: np.ndarray) -> np.ndarray:
    """The inputs' sum by the gates' weights."""
    out = np.zeros(gate.shape)
    for i in range(INPUTS):
        out += x[i] * weight[:, i][gate]
    return out


def levels(odds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The refinement's lower level for log odds, and how far they are on the way to the next."""
    place = (np.clip(odds, -REACH, REACH - 1e-6) + REACH) * ((LEVELS - 1) / (2 * REACH))
    low = place.astype(np.int64)
    return low, place - low


def learn(mixer: Mixer, square: np.ndarray, key: np.ndarray, times: np.ndarray, odds: np.ndarray, seen: np.ndarray, find: Find = slots) -> None:
    """Online steps over windows in a fixed random order."""
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(key))
    for first in range(0, len(key), STEP):
        part = order[first : first + STEP]
        at, node, bit = find(key[part])
        x, gate = inputs(at, odds, seen)
        weight = np.broadcast_to(times[part].astype(float), bit.shape)
        z = mixed(x, mixer.weight, gate)
        miss = (bit - sigmoid(z)) * weight
        flat = gate.ravel()
        mass = np.bincount(flat, weight.ravel(), GATES)
        mixer.mass += mass
        grad = np.stack([np.bincount(flat, (miss * x[i]).ravel(), GATES) for i in range(INPUTS)], axis=1) / np.maximum(mass, 1e-9)[:, None]
        square += grad**2
        mixer.weight += np.where(mass[:, None] > 0, RATE * grad / np.sqrt(square + 1e-6), 0)
        low, up = levels(z)
        place = (node * LEVELS + low + (up >= 0.5)).ravel()
        mixer.total += np.bincount(place, weight.ravel(), 256 * LEVELS).reshape(256, LEVELS)
        mixer.ones += np.bincount(place, (weight * bit).ravel(), 256 * LEVELS).reshape(256, LEVELS)


def costs(key: np.ndarray, mixer: Mixer, refined: np.ndarray, odds: np.ndarray, seen: np.ndarray, find: Find = slots) -> np.ndarray:
    """log10 of each window's probability of its last byte."""
    out = np.empty(len(key))
    for first in range(0, len(key), STEP):
        at, node, bit = find(key[first : first + STEP])
        x, gate = inputs(at, odds, seen)
        z = mixed(x, mixer.weight, gate)
        low, up = levels(z)
        row = node * LEVELS + low
        p = 0.5 * sigmoid(z) + 0.5 * ((1 - up) * refined.ravel()[row] + up * refined.ravel()[row + 1])
        p = np.clip(p, 1e-6, 1 - 1e-6)
        out[first : first + STEP] = np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=0)
    return out


def gather(docs: DataFrame) -> DataFrame:
    """(kind, key, n), with a key in several rows: training documents' words (kind 0); windows (kind 1) and those of the short
    orders (kind 2), with the document's share of the corpus above their bytes. docs: text, held_out, share.

    A task holds `TAKEN` keys at most; they are put together, and given out if that leaves more than half of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = 0
        found, taken = Distinct(), [Distinct() for _ in range(FOLDS + 1)]

        def rows(some: Distinct, share: int) -> Iterator[pa.RecordBatch]:
            key, n = some.take()
            low, at = np.unique(key & _mask(SHORT + 1), return_inverse=True)
            yield _rows(2, low, np.bincount(at, n, len(low)), share)
            yield _rows(1, key, n, share)

        def full(some: list[Distinct]) -> bool:
            if sum(d.size for d in some) < TAKEN:
                return False
            for d in some:
                d.compact()
            return sum(d.size for d in some) >= TAKEN // 2

        for batch in batches:
            of = np.where(batch.column(1).to_numpy(zero_copy_only=False), FOLDS, batch.column(2).to_numpy())
            for share in range(FOLDS + 1):
                text = batch.column(0).filter(pa.array(of == share))
                texts += len(text) if share < FOLDS else 0
                for block in blocks(text, CHUNK):
                    taken[share].add(windows(block)[0])
                    if full(taken):
                        for k, some in enumerate(taken):
                            yield from rows(some, k)
                    if share < FOLDS:
                        found.add(words(block, SPACED).hash)
                        if full([found]):
                            value, n = found.take()
                            yield _rows(0, signed(value), n)
        for k, some in enumerate(taken):
            yield from rows(some, k)
        if texts:
            value, n = found.take()
            yield _rows(0, np.append(signed(value), END_TOKEN), np.append(n, texts))

    return arrow(docs.select("text", "held_out", "share"), run, "kind int, key long, n long")


def _rows(kind: int, key: np.ndarray, n: np.ndarray, share: int = 0) -> pa.RecordBatch:
    columns = [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64) + (share << WINDOW_BITS)), pa.array(n.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n"])


@dataclass
class Shares:
    """Windows with their times in each share of the corpus, sorted by window."""

    key: np.ndarray
    share: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(batches: Iterator[pa.RecordBatch]) -> Shares:
        """From rows of key and n."""
        rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        packed, n = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        # sorted by the window, then the share
        packed = ((packed & ((1 << WINDOW_BITS) - 1)) << 8 | packed >> WINDOW_BITS).astype(np.uint64)
        value, at = np.unique(packed, return_inverse=True)
        return Shares(value >> np.uint64(8), (value & np.uint64(255)).astype(np.int64), np.bincount(at, n, len(value)))

    def keys(self) -> np.ndarray:
        return np.unique(self.key)

    def taken(self, share: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Windows and times of a share, or of all training documents."""
        at = self.share != FOLDS if share is None else self.share == share
        return self.key[at], self.times[at]


def learn_mixer(windows: DataFrame, short: Shares) -> Mixer:
    """Each task learns over its windows of the first share, against the counts of the other; a gate's weights are averaged
    by the bytes seen with it, refinement sums are added. windows: key, n, dealt out by their last three context bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixer, square = Mixer.fresh(), np.zeros((GATES, INPUTS))
        mine = Shares.of(batches)
        if not len(mine.taken()[0]):
            return
        contexts = Contexts(short.keys(), mine.keys())
        table = contexts.counts(short.taken(), mine.taken())
        key, times = mine.taken(0)
        if len(key):
            own = contexts.counts(short.taken(0), (key, times))
            learn(mixer, square, key, times, *odds_and_seen(np.maximum(table - own, 0)), contexts.slots)
        mass = np.repeat(mixer.mass + 1e-9, INPUTS)
        a = np.concatenate([mixer.weight.ravel() * mass, mixer.ones.ravel()])
        b = np.concatenate([mass, mixer.total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(a))), pa.array(a), pa.array(b)], names=["place", "a", "b"])

    got = arrow(windows, run, "place long, a double, b double").groupBy("place").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    mixer = Mixer.fresh()
    if got.num_rows:
        order = np.argsort(got.column("place").to_numpy())
        a, b = got.column("a").to_numpy()[order], got.column("b").to_numpy()[order]
        m = mixer.weight.size
        mixer = Mixer((a[:m] / b[:m]).reshape(GATES, INPUTS), a[m:].reshape(256, LEVELS), b[m:].reshape(256, LEVELS))
    return mixer


def window_costs(windows: DataFrame, short: Shares, mixer: Mixer) -> DataFrame:
    """Of each distinct window its key, times in training documents (c), and cost. windows as in learn_mixer."""
    refined = mixer.refinement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Shares.of(batches)
        key = mine.keys()
        if not len(key):
            return
        contexts = Contexts(short.keys(), key)
        odds, seen = odds_and_seen(contexts.counts(short.taken(), mine.taken()))
        known, times = mine.taken()
        c = np.bincount(np.searchsorted(key, known), times, len(key)).astype(np.int64)
        cost = costs(key, mixer, refined, odds, seen, contexts.slots)
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.array(c), pa.array(cost)], names=["key", "c", "cost"])

    return arrow(windows, run, "key long, c long, cost double")


def score_texts(docs: DataFrame, costly: tuple[np.ndarray, np.ndarray], head: tuple[np.ndarray, np.ndarray], floor: float, end: int) -> DataFrame:
    """A row each document: its own number, counts of tokens, what head words and the windows of known cost give, its other
    words and windows."""
    keys, counts = head
    window, cost_of = costly
    gain = np.log10(counts + 0.1) - floor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40

        def look(key: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(window, key), max(len(window) - 1, 0))
            return np.where(window[at] == key, cost_of[at], np.nan) if len(window) else np.full(len(key), np.nan)

        cost = Known(look)
        for batch in batches:
            score, n_bytes, n_tokens, known, base, rare, times, others = [], [], [], [], [], [], [], []
            for block in blocks(batch.column(1), CHUNK):
                key, doc = windows(block)
                each = cost(key)
                other = np.isnan(each)
                n_bytes.append(np.bincount(doc, minlength=block.n_docs))
                score.append(np.bincount(doc, np.where(other, 0, each), block.n_docs))
                others += np.split(key[other], np.searchsorted(doc[other], np.arange(1, block.n_docs)))[: block.n_docs]
                w = words(block, SPACED)
                h = signed(w.hash)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                in_head = keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)
                n_tokens.append(w.counts + 1)
                known.append(np.bincount(w.doc[in_head], minlength=block.n_docs) + (end > 0))
                base.append(np.bincount(w.doc[in_head], gain[at[in_head]] if len(gain) else None, block.n_docs) + np.log10(end + 0.1) - floor)
                rest, bounds = h[~in_head], np.searchsorted(w.doc[~in_head], np.arange(block.n_docs + 1))
                for d in range(block.n_docs):
                    value, n = np.unique(rest[bounds[d] : bounds[d + 1]], return_counts=True)
                    rare.append(value)
                    times.append(n)
            m = batch.num_rows
            offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum([len(v) for v in x])]).astype(np.int32))
            flat = lambda x, t: pa.ListArray.from_arrays(offsets(x), pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t)))
            cat = lambda x, t: pa.array(np.concatenate(x).astype(t) if x else np.zeros(0, t))
            columns = [pa.array(np.arange(number, number + m)), batch.column(0).cast(pa.int64()), cat(n_tokens, np.int64), cat(known, np.int64), cat(base, float), cat(score, float), flat(rare, np.int64), flat(times, np.int64), flat(others, np.int64), cat(n_bytes, np.int64)]
            number += m
            yield pa.RecordBatch.from_arrays(columns, names=["number", "doc_id", "n_tokens", "head_known", "head_score", "score", "rare", "times", "others", "n_bytes"])

    return arrow(docs.select("doc_id", "text"), run, "number long, doc_id long, n_tokens long, head_known long, head_score double, score double, rare array<long>, times array<long>, others array<long>, n_bytes long")


def most_used(counts: DataFrame, most: int, value: str = "c") -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and values of those with at least 2**i occurrences (c), for the least i that leaves at most `most`."""
    counts = counts.where("c > 0")
    levels = counts.groupBy(F.floor(F.log2("c")).alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 64, 0
    for row in sorted(levels, key=lambda r: -r["level"]):
        if total + row["n"] > most:
            break
        least, total = row["level"], total + row["n"]
    got = counts.where(F.floor(F.log2("c")) >= least).select("key", value).toArrow()
    order = np.argsort(got.column("key").to_numpy())
    return got.column("key").to_numpy()[order], got.column(value).to_numpy()[order].astype(float)


def evaluate(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte (its end byte counts) for every document."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    held_out = F.coalesce(fold(F.col("doc_id"), HOLD) == 0, F.lit(False))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).head()["n"]
    share = F.when(F.pmod(F.xxhash64("doc_id"), F.lit(LEARN)) == 0, 0).otherwise(1)
    # keys come sorted: written as differences
    packed = {"compression": "zstd", "parquet.writer.version": "v2"}
    gathered = scratch.save(gather(docs.select("text", held_out.alias("held_out"), share.alias("share"))), **packed)
    short = Shares.of(gathered.where("kind = 2").groupBy("key").agg(F.sum("n").alias("n")).toArrow().to_batches())
    # with the corpus grow the parts, not the contexts in each
    dealt = gathered.where("kind = 1").select("key", "n").repartition(max(1, size >> DEALT), F.expr(f"(key >> 8) & {(1 << 24) - 1}"))
    mixer = learn_mixer(dealt, short)
    priced = scratch.save(window_costs(dealt, short, mixer))
    window, cost = most_used(priced, HEAD_WINDOWS, "cost")
    counts = scratch.save(gathered.where("kind = 0").groupBy("key").agg(F.sum("n").alias("c")))
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(F.max(F.when(F.col("key") == END_TOKEN, F.col("c"))), F.lit(0)).alias("e")).head()
    floor = float(np.log10(total["n"] + 0.1 * (total["v"] + 1)))
    scored = scratch.save(score_texts(docs, (window.astype(np.uint64), cost), most_used(counts, HEAD), floor, total["e"]))
    each = scored.select("number", F.explode(F.arrays_zip("rare", "times")).alias("word")).select("number", F.col("word.rare").alias("key"), F.col("word.times").alias("times"))
    c = F.coalesce("c", F.lit(0))
    value = F.col("times") * (F.log10(c + F.lit(0.1)) - F.lit(floor))
    rest = each.join(counts, "key", "left").groupBy("number").agg(F.sum(value).alias("rest"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rest_known"))
    more = scored.select("number", F.explode("others").alias("key")).join(priced.select("key", "cost"), "key").groupBy("number").agg(F.sum("cost").alias("more"))
    out = scored.drop("rare", "times", "others").join(rest, "number", "left").join(more, "number", "left")
    total_score = F.col("score") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        (F.col("head_known") + F.coalesce("rest_known", F.lit(0))).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        total_score.alias("score"),
        (-total_score / (F.lit(np.log10(2)) * F.col("n_bytes"))).alias("bits_per_byte"),
    )
