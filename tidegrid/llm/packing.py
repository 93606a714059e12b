"""Packing documents into sequences by cutting-stock column generation.

A document's ids are cut into pieces of the sequence's length and a rest. Pieces fall into classes of lengths (in units of
`unit` ids, rounded up; 1, so that no room is lost to rounding). The number of pieces in each class is all that the driver
gets: a table of at most capacity / unit rows. A linear program over patterns (how many pieces of each class a sequence
takes) is solved by column generation: its first columns are the patterns of one class each; the program over the columns
known is solved by first-order steps, and its duals price new patterns by knapsack programs, until the value is within `GAP`
of a bound that prices give. Pattern counts are rounded down, the program is solved anew for what is left
over, and so on; only the last `FEW` sequences are filled without it. Then the pieces of each class are ranked (by a salt of
the document, then the document), and a rank tells the sequence and the place in it, so pieces are assigned where they are, in
parallel. Ids never move: a piece is known by its document, start and length.

Defined cases: a null or empty text has one piece of the end token; repeated documents are packed each; a null doc_id
takes part like any other; a text of any length is cut, never dropped; ties in rank between repeated documents are equal
pieces; columns besides doc_id and text are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import Scratch, arrow, relieve
from tidegrid.llm.tokens import word_ids

LENGTH, END, UNIT = 4096, 2, 1
#: How close to its optimum the linear program is solved, and how many sequences at the end are filled without it.
GAP, FEW = 3e-4, 8
#: Patterns worth less than one by no more than this are fixed first.
FULL = 1e-4
#: Pricing: knapsack programs a round, how far apart their duals are, and about how many classes each takes besides its own; the
#: program is no longer bettered if so many rounds together gain less than a quarter of the gap.
PASSES, FEWEST, APART, AMONG, ROUNDS = 30, 6, 0.2, 64, 6
SALT_ROWS, MOST_SALTS = 256, 1 << 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Each document's ids, the end token last, cut at multiples of the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer)
        tail = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = memoryview(ids_of.text(text.as_py() or "") + tail)
                n = len(ids) // 4
                for start in range(0, n, length):
                    part = ids[4 * start : 4 * (start + length)]
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return arrow(docs.select("doc_id", "text"), run, PIECES)


@dataclass
class Plan:
    """Patterns as (number of sequences, {class: pieces of it in each}); how many pieces have theirs from the linear program; the
    program's value, and a number of sequences that no plan is below; how many patterns all programs priced."""

    patterns: list[tuple[int, dict[int, int]]]
    by_program: int = 0
    value: float = 0.0
    bound: float = 0.0
    priced: int = 0

    @property
    def sequences(self) -> int:
        return sum(n for n, _ in self.patterns)


def bounded(price: np.ndarray, size: np.ndarray, most: np.ndarray, capacity: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
    """A knapsack program over lots of each class (1, 2, 4, ... pieces, `most` together): the most that a capacity is worth,
    the lots as (class, pieces), and at which capacities each was taken."""
    lots = []
    for i in np.flatnonzero(price > 1e-12).tolist():
        n, k = int(most[i]), 1
        while n > 0:
            lots.append((i, min(k, n)))
            n, k = n - k, 2 * k
    best, taken, more = np.zeros(capacity + 1), np.zeros((len(lots), capacity + 1), dtype=bool), np.empty(capacity + 1)
    for at, (i, n) in enumerate(lots):
        w = int(size[i]) * n
        with_it, without = more[: capacity + 1 - w], best[w:]
        np.add(best[: capacity + 1 - w], price[i] * n, out=with_it)
        np.greater(with_it, without + 1e-12, out=taken[at, w:])
        np.maximum(without, with_it, out=without)
    return best, lots, taken


def chosen(room: np.ndarray, size: np.ndarray, lots: list[tuple[int, int]], taken: np.ndarray) -> list[Counter]:
    """The pieces, by class, of the best patterns for each of some capacities."""
    room, out = room.copy(), [Counter() for _ in room]
    for at in range(len(lots) - 1, -1, -1):
        hit = taken[at][room].nonzero()[0]
        if len(hit):
            i, n = lots[at]
            for j in hit.tolist():
                out[j][i] += n
            room[hit] -= size[i] * n
    return out


def knapsack(price: np.ndarray, classes: list[int], capacity: int) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of classes within the capacity."""
    size = np.array(classes)
    best, lots, taken = bounded(price, size, capacity // size, capacity)
    (pattern,) = chosen(np.array([capacity]), size, lots, taken)
    return float(best[capacity]), {classes[i]: n for i, n in pattern.items()}


@dataclass
class Program:
    """The linear program's patterns with how often each is used, its value, and a value that no plan is below; the prices of
    the pieces that say so (no pattern is worth more than 1), and how many patterns were priced."""

    patterns: list[tuple[float, dict[int, int]]]
    value: float
    bound: float
    prices: dict[int, float]
    priced: int


class Master:
    """The program over the patterns known so far, solved by primal and dual steps (PDHG with restarts).

    A piece may always be had from a pattern of its class alone, so its price is at most its share of that (`dear`), and any
    use of patterns is made whole by those. No matrix is inverted, so nothing is lost where bases are ill-conditioned.
    """

    def __init__(self, d: np.ndarray, dear: np.ndarray, y: np.ndarray):
        self.d, self.dear, self.y, self.m = d, dear, y, len(d)
        self.col, self.row, self.n, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
        self.x = self.best = np.zeros(0)
        self.value = float(dear @ d)

    def add(self, patterns: list[dict[int, int]], x: list[float]) -> None:
        entries = [(self.count + j, i, n) for j, p in enumerate(patterns) for i, n in p.items()]
        col, row, n = (np.array(c) for c in zip(*entries, strict=True)) if entries else (self.col[:0], self.row[:0], self.n[:0])
        self.col, self.row, self.n = np.concatenate([self.col, col]), np.concatenate([self.row, row]), np.concatenate([self.n, n.astype(float)])
        self.x, self.best = np.concatenate([self.x, x]), np.concatenate([self.best, x])
        self.count += len(patterns)

    def worth(self, y: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.n * y[self.row], self.count)

    def packed(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.n * x[self.col], self.m)

    def whole(self, x: np.ndarray) -> float:
        return float(x.sum() + self.dear @ np.maximum(self.d - self.packed(x), 0))

    def forget(self, most: int) -> None:
        """Of the patterns that are not used keep those of the most worth."""
        if self.count > 2 * most:
            worth = self.worth(self.y)
            keep = (self.x > 1e-7) | (self.best > 1e-7) | (worth >= np.partition(worth, -most)[-most])
            at, stay = np.cumsum(keep) - 1, keep[self.col]
            self.col, self.row, self.n = at[self.col[stay]], self.row[stay], self.n[stay]
            self.x, self.best, self.count = self.x[keep], self.best[keep], int(keep.sum())

    def solve(self, steps: int = 200) -> None:
        """So many steps from where it stands; averages are gone on from where they are closer."""
        if not self.count:
            self.y = self.dear
            return
        scale = 2 * max(float(np.linalg.norm(self.best)), 1.0) / max(float(np.linalg.norm(self.y)), 1e-9)
        tau = scale / np.bincount(self.col, self.n, self.count)
        sigma = 1 / (scale * np.maximum(np.bincount(self.row, self.n, self.m), 1e-9))
        self.value = self.whole(self.best)
        x, y, worth = self.x, self.y, self.worth(self.y)
        sums, k = [np.zeros(self.count), np.zeros(self.m)], 0
        for step in range(1, steps + 1):
            after = np.maximum(x - tau * (1 - worth), 0)
            y = np.clip(y + sigma * (self.d - self.packed(2 * after - x)), 0, self.dear)
            x, worth = after, self.worth(y)
            sums[0] += x
            sums[1] += y
            k += 1
            if step % 50 == 0:
                apart = []
                for a, b in ((x, y), (sums[0] / k, sums[1] / k)):
                    value = self.whole(a)
                    apart.append(value - float(b @ self.d) / max(1.0, float(self.worth(b).max())))
                    if value < self.value:
                        self.value, self.best = value, a
                if k >= 200 or apart[1] < apart[0] / 2:
                    if apart[1] < apart[0]:
                        x, y = sums[0] / k, sums[1] / k
                        worth = self.worth(y)
                    sums, k = [np.zeros(self.count), np.zeros(self.m)], 0
        self.x, self.y = x, y


def column_generation(demand: dict[int, int], capacity: int, first: list[tuple], gap: float = GAP) -> Program:
    """Solve the program: the fewest patterns that cover the demand, within `gap` of its optimum, or until it is no longer bettered.

    Its columns are `first` (as often as used, pattern, ...; may be empty), the patterns of one class each, and those that are
    priced: a round takes the duals, as they are or smoothed towards those of the best bound (at first each class's share of
    the capacity), and finds for every class a pattern that is worth much with it. Its knapsack programs, each for a part of
    the classes, take besides them some at random and duals a little apart from the round's, since the best patterns of one
    program share the same few classes; the bound is told by a program over all classes at the duals themselves.
    """
    classes = sorted(demand)
    m, at = len(classes), {u: i for i, u in enumerate(classes)}
    size, d = np.array(classes), np.array([demand[u] for u in classes], dtype=float)
    most = np.minimum(capacity // size, d).astype(np.int64)
    limit, stable, bound, priced = most.tolist(), size / capacity, 0.0, 0
    master = Master(d, 1 / most, np.minimum(stable, 1 / most))
    master.add([{at[u]: n for u, n in f[1].items()} for f in first], [float(f[0]) for f in first])
    rng, history, among, grown = np.random.Generator(np.random.PCG64(3)), [], AMONG, 0
    while True:
        master.solve()
        y, dual = master.y, master.y.tolist()
        price = (stable, y, 0.7 * y + 0.3 * stable)[1 + len(history) % 2 if history else 0]
        exact = bounded(price, size, most, capacity)
        worth = float(exact[0][capacity])
        if price @ d / worth > bound:
            bound, stable = float(price @ d / worth), price / worth
        history.append(master.value)
        if master.value <= bound * (1 + (gap if priced else 1e-9)):
            break
        if len(history) - grown > ROUNDS and history[-ROUNDS] - master.value < gap * master.value / 4:
            if among >= m:
                break
            among, grown = 4 * among, len(history)
        found: dict[tuple, dict[int, int]] = {}
        parts = np.array_split(rng.permutation(m), min(m, max(FEWEST, min(PASSES, m // 16) * AMONG // among)))
        for k, part in enumerate(parts):
            if k:
                apart = price * (1 + APART * rng.random(m))
                apart[rng.random(m) * m > among] = 0
            _, lots, taken = bounded(apart, size, most, capacity) if k else exact
            for i, pattern in zip(part.tolist(), chosen(capacity - size[part], size, lots, taken), strict=True):
                pattern[i] = min(pattern[i] + 1, limit[i])
                if sum(dual[j] * n for j, n in pattern.items()) > 1 + 1e-6:
                    found[tuple(sorted(pattern.items()))] = pattern
        master.forget(2 * m)
        master.add(list(found.values()), [0.0] * len(found))
        priced += len(found)
    if bound * (1 + 10 * gap) < master.value:
        stable = master.y / max(1.0, float(master.worth(master.y).max(initial=0)))
    x = np.where(master.best > 1e-6, master.best, 0)
    patterns: list[dict[int, int]] = [{} for _ in range(master.count)]
    for j, i, n in zip(master.col.tolist(), master.row.tolist(), master.n.tolist(), strict=True):
        patterns[j][classes[i]] = int(n)
    rest = np.maximum(d - master.packed(x), 0) / most
    used = [(float(v), p) for v, p in zip(x, patterns, strict=True) if v] + [(float(v), {classes[i]: int(most[i])}) for i, v in enumerate(rest) if v > 1e-9]
    return Program(used, float(sum(v for v, _ in used)), max(bound, least_size(demand, capacity)), dict(zip(classes, stable.tolist(), strict=True)), priced)


def fill(left: dict[int, int], room: int) -> dict[int, int]:
    """Of the pieces left, by class, those that fill the room best (of several ways, with the largest): by reachable sums as bits."""
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for u, n in left.items():
        if u > room:
            continue
        steps.append((u, n, reach))
        for k in range(1, min(n, room // u) + 1):
            more = steps[-1][2] << u * k & mask
            if not more & ~reach:
                break
            reach |= more
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for u, n, before in reversed(steps):
        k = 0
        while not before >> at & 1:
            at -= u
            k += 1
        if k:
            out[u] = k
    return out


def fill_all(demand: dict[int, int], capacity: int, whole: bool = True) -> list[tuple[float, dict[int, int], int]]:
    """Sequence after sequence: the largest piece left, and what fills the rest of it best. (times, pattern, class that ends it)

    A pattern is used as long as its pieces last; if not whole, also for parts of a sequence, so that a class is used up.
    """
    left, out = {u: n for u, n in sorted(demand.items(), reverse=True) if n > 0}, []
    while left:
        largest = next(iter(left))
        left[largest] -= 1
        pattern = Counter(fill({u: int(np.ceil(n)) for u, n in left.items() if n > 0}, capacity - largest))
        left[largest] += 1
        pattern[largest] += 1
        end = min(pattern, key=lambda u: left[u] // pattern[u] if whole else left[u] / pattern[u])
        times = left[end] // pattern[end] if whole else left[end] / pattern[end]
        out.append((times, dict(pattern), end))
        for u, k in pattern.items():
            left[u] -= times * k
            if left[u] < 1e-9 or u == end and not whole:
                del left[u]
    return out


def least_size(demand: dict[int, int], capacity: int) -> float:
    """The linear program is at least this: by the pieces' whole size, and by dual feasible functions, which say e.g. that no two
    pieces of over half a sequence fit in one, and no three of over a third."""
    size, n = np.array(list(demand), dtype=np.int64), np.array(list(demand.values()), dtype=float)
    bounds = [float(n @ size) / capacity]
    for k in range(1, 51):
        whole, rest = np.divmod((k + 1) * size, capacity)
        bounds.append(float(n @ np.where(rest == 0, size / capacity, whole / k)))
    return max(bounds)


def make_plan(demand: dict[int, int], capacity: int) -> Plan:
    """Whole numbers of patterns that hold every piece: the program's, rounded down; then those of what is left over, and so on.

    Patterns worth the most at the program's prices go first, so that what its value is above the bound is left to the
    programs that follow; of those worth the same the ones of few pieces, since small pieces fill what is left at the end. Where rounding down fixes less than half, patterns used in part are rounded up until half is fixed.
    The last few sequences' pieces are filled.
    """
    left, patterns, told = {u: n for u, n in demand.items() if n}, [], None
    by_program, priced, first = 0, 0, []
    while left:
        if told and sum(u * n for u, n in left.items()) <= FEW * capacity:
            last = fill_all(left, capacity)
            if sum(n for n, _, _ in last) <= FEW:
                patterns += [(n, p) for n, p, _ in last]
                break
        program = column_generation(left, capacity, first)
        told, priced = told or program, priced + program.priced
        before, fixed = sum(left.values()), 0
        price = program.prices
        used = [(x, p, sum(price[u] * n for u, n in p.items())) for x, p in program.patterns]
        used.sort(key=lambda t: (-round(t[2] / FULL), sum(t[1].values()), -t[0]))
        for x, pattern, worth in used:
            if worth >= 1 - FULL:
                times = min(int(x + 1e-6), *(left.get(u, 0) // n for u, n in pattern.items()))
                take(left, patterns, pattern, times)
                fixed += times
        for _, pattern, worth in used:
            if fixed >= program.value / 2 or worth < 1 - FULL and fixed >= program.value / 8:
                break
            if all(left.get(u, 0) >= n for u, n in pattern.items()):
                take(left, patterns, pattern, 1)
                fixed += 1
        if not fixed:
            held = {u: min(n, left[u]) for u, n in used[0][1].items()}
            take(left, patterns, held, 1)
        by_program += before - sum(left.values())
        first = [(x % 1, p) for x, p in program.patterns if all(left.get(u, 0) >= n for u, n in p.items())]
    return Plan(patterns, by_program, told.value if told else 0.0, told.bound if told else 0.0, priced)


def take(left: dict[int, int], patterns: list[tuple[int, dict[int, int]]], pattern: dict[int, int], times: int) -> None:
    """Use a pattern so many times."""
    if times:
        patterns.append((times, pattern))
        for u, n in pattern.items():
            left[u] -= n * times
            if not left[u]:
                del left[u]


def intervals(plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: first rank, first sequence, and pieces a sequence, of each pattern that holds the class."""
    ranks: Counter = Counter()
    rows: dict[int, list] = {}
    sequence = 0
    for times, pattern in plan.patterns:
        for u, n in pattern.items():
            rows.setdefault(u, []).append((ranks[u], sequence, n))
            ranks[u] += n * times
        sequence += times
    return {u: tuple(np.array(c) for c in zip(*r, strict=True)) for u, r in rows.items()}


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, unit: int = UNIT) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padding."""
    scratch = Scratch(docs.sparkSession)
    salted = F.pmod(F.xxhash64("doc_id", "start"), F.lit(MOST_SALTS)).cast("int")
    cut = scratch.save(pieces(docs, tokenizer, length, end).withColumn("class", F.ceil(F.col("length") / unit).cast("int")).withColumn("salt", salted))
    demand = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = intervals(make_plan(demand, length // unit))
    relieve(docs.sparkSession)
    salts = [(u, min(MOST_SALTS, max(1, n // SALT_ROWS))) for u, n in demand.items()]
    salts = docs.sparkSession.createDataFrame(salts, "class int, salts int")
    cut = cut.join(F.broadcast(salts), "class").withColumn("salt", F.pmod("salt", F.col("salts"))).drop("salts")
    counts = cut.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("class", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start", "doc_tokens", "ids_crc32"))
    ranked = cut.withColumn("within", within).join(counts, ["class", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", (F.col("before") + F.col("within") - 1).alias("rank"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, rank = batch.column(5).to_numpy(), batch.column(6).to_numpy()
            sequence, place = np.zeros(len(kind), np.int64), np.zeros(len(kind), np.int64)
            order = np.argsort(kind, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1) if len(kind) else []:
                first, base, n = table[int(kind[at[0]])]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at] = base[k] + (rank[at] - first[k]) // n[k]
                place[at] = (rank[at] - first[k]) % n[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(place)], names=[*PIECE_NAMES, "sequence_id", "place"])

    placed = arrow(ranked, assign, PIECES + ", sequence_id long, place long")
    in_sequence = Window.partitionBy("sequence_id")
    ordered = in_sequence.orderBy(F.desc("length"), "place", "doc_id", "start")
    total = F.sum("length").over(in_sequence)
    offset = F.coalesce(F.sum("length").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.select(*PIECE_NAMES, "sequence_id", offset.alias("offset"), total.alias("sequence_tokens"))
    power = F.expr("(sequence_tokens & (sequence_tokens - 1)) = 0")
    return out.withColumn("padding", F.when(power, F.lit(0)).otherwise(F.lit(length) - F.col("sequence_tokens")).cast("long"))


PIECE_NAMES = [c.split()[0] for c in PIECES.split(", ")]
