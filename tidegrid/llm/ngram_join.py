"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Documents with the same set are one node. Two nodes link if their sets' Jaccard similarity is at least `percent` / 100; the
result is each document's connected component and its number of links. With o = the overlap that a pair needs, its k-th
common shingle stands among the first n - o + k of each of its sets, in any order common to all sets. The order here puts
hot shingles (those that many prefixes hold) last, the hotter the later, others by hash. Small sets (fewer shingles than the
boundary) enumerate the 2-subsets of their prefix (k = 2), so that a shared key is rare among unrelated texts; large sets,
and the small ones that can link to them, stand in inverted lists of single shingles (k = 1). The boundary is where the
expected cost of enumerating passes that of scanning the lists, from the histogram of set sizes and the mean list length.

Groups of near copies are contracted before pairs are made from the lists: in each round every long list names a few pivots
at random, each node tries those that look nearest to it, and what the exact check confirms becomes one label. Rounds go on
while a fair share of the tries links, and adds to the links found; then all pairs across labels are made, from the short lists too: the rows of a list
that are not of its commonest label meet the whole list, chunk by chunk, in tasks of their own. No partner is left out. A
pair that shares many keys is made at the first of them: each row holds the few keys that its set has before, and one that
both rows hold has made the pair already. Sizes, the places of the shared key in both prefixes, and sketches (parities, whose
difference bounds that of the sets) rule out pairs that cannot link; all others are checked on whole sets. Inside a component
links are counted by products of incidence matrices, block by block: no row stands for a pair there.

Shingles and sets are known by 64-bit hashes. Defined cases: null or empty texts have no shingle, and link with nothing;
texts of fewer words than a shingle are one shingle of their own; a text of any length is one set; repeated rows each get
their row, and count as links of each other; a null doc_id does not count for the smallest id; columns besides doc_id and
text are not looked at, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidegrid.llm.buffers import blocks, mix, shingle_sets, signed
from tidegrid.llm.common import Scratch, arrow
from tidegrid.llm.components import components

SIZE, PERCENT = 5, 80
#: Bits that tell hot shingles, lists' chunk size, and sizes that the cost model tells apart.
HOT_BITS, CHUNK, MOST_SIZE = 24, 512, 4096
#: Longs in a sketch, keys that a row holds of those before its own, rows that make a list long, bits that tell ids.
SKETCH, BEFORE, LONG, ID_BITS = 8, 4, 8, 22
#: Pivots of a list in a round, and the share of a round's tries, and of the links of all rounds, that must link for another.
PIVOTS, FAIR = 2, 0.05
#: Shingles in a block of sets whose links are counted by one product.
BLOCK = 1 << 16
NO_ID = -(1 << 63)


def needed(n: int, percent: int = PERCENT) -> int:
    """The overlap that a set of n shingles has with any set it links to."""
    return -(-percent * n // 100)


def _signature(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def sketch(s: np.ndarray) -> list[int]:
    """Bits, each the parity of how many shingles fall to it: bits that differ are at most as many as shingles that do."""
    parity = np.bincount((s & np.uint64(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64).tolist()


def signatures(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n (set size), sig (the set's hash) and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for block in blocks(batch.column(1)) for s in shingle_sets(block, size)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_signature(s) for s in sets], pa.int64()),
                    pa.array([sketch(s) for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n", "sig", "sketch"],
            )

    return arrow(docs.select("doc_id", "text"), run, "doc_id long, n long, sig long, sketch array<long>")


def bitmap(df: DataFrame, bit: Column, bits: int) -> np.ndarray:
    """2**bits flags as bools: a table of fixed size, whatever the number of rows."""
    rows = (
        df.select(bit.cast("long").alias("bit"))
        .groupBy(F.expr("bit >> 15").alias("page"))
        .agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("bytes"))
        .collect()
    )
    out = np.zeros((max(1, (1 << bits) >> 15), 4096), dtype=np.uint8)
    for r in rows:
        out[r["page"]] = np.frombuffer(bytes(r["bytes"]), dtype=np.uint8)
    return np.unpackbits(out.ravel(), bitorder="little")[: 1 << bits].astype(bool)


def _id_bit(doc_id: str, bits: int = ID_BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(NO_ID))), 64 - bits)


def sets_of(docs: DataFrame, wanted: np.ndarray, size: int = SIZE) -> DataFrame:
    """sig and whole set of the documents whose id's flag is up; some others may be among them."""
    flags = np.packbits(wanted, bitorder="little").view(np.int64).tolist()
    flags = F.broadcast(docs.sparkSession.createDataFrame([(flags,)], "flags array<long>"))
    flag = F.expr("shiftrightunsigned(get(flags, cast(bit >> 6 as int)), cast(bit & 63 as int)) & 1")
    kept = docs.select("text", _id_bit("doc_id").alias("bit")).join(flags, flag == 1).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                sets = shingle_sets(block, size)
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays([pa.array([_signature(s) for s in sets], pa.int64()), flat], names=["sig", "shingles"])

    return arrow(kept, run, "sig long, shingles array<long>")


def whole_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """sig and shingles of the nodes (sig, id), a row each."""
    found = sets_of(docs, bitmap(ids, _id_bit("id"), ID_BITS), size)
    return found.join(ids.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])


def linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes that link, checked on whole sets; with inter (size of the intersection).

    Both sides read one exchange of the sets by sig, so they are shuffled once, and once more with a pair.
    """
    ends = pairs.select(F.col("a").alias("sig")).union(pairs.select("b"))
    ids = scratch.save(nodes.join(ends, "sig", "left_semi").select("sig", "id"))
    sets = whole_sets(ids, docs, size)
    side = lambda k: sets.select(F.col("sig").alias(k), F.col("shingles").alias(f"set_{k}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("set_a", "set_b"))
    found = both.select("a", "b", inter.alias("inter"), (F.size("set_a") + F.size("set_b")).alias("both"))
    out = scratch.save(found.where(100 * F.col("inter") >= percent * (F.col("both") - F.col("inter"))).select("a", "b", "inter"))
    scratch.drop(ids)
    return out


def prefix_counts(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """How many prefixes (by hash order) hold a shingle; copies in one task count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(0)):
                parts = []
                for s in shingle_sets(block, size):
                    if len(s) and (sig := _signature(s)) not in seen:
                        seen.add(sig)
                        parts.append(s[: len(s) - needed(len(s), percent) + 1])
                if parts:
                    value, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(value)), pa.array(n.astype(np.int64))], names=["key", "c"])

    return arrow(docs.select("text"), run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def hot_and_cost(counts: DataFrame, most: int = 1 << 20) -> tuple[np.ndarray, float]:
    """How hot shingles are, by the first bits of their hash (0: cold; else the log of the count), and the mean list length
    that a cold entry meets. At most about `most` shingles are hot: a table of fixed size."""
    levels = [1 << i for i in range(2, 40)]
    row = counts.agg(*[F.count_if(F.col("c") > x).alias(f"over_{x}") for x in levels]).head()
    limit = next(x for x in levels if row[f"over_{x}"] <= most)
    cold = counts.where(F.col("c") <= limit).agg(F.sum(F.col("c") * F.col("c")).alias("s"), F.sum("c").alias("n")).head()
    hot = counts.where(F.col("c") > limit).select(F.shiftrightunsigned(F.col("key"), 64 - HOT_BITS).alias("at"), F.floor(F.log2("c") * 4).cast("int").alias("level"))
    got = hot.groupBy("at").agg(F.max("level").alias("level")).toArrow()
    table = np.zeros(1 << HOT_BITS, dtype=np.uint8)
    table[got.column("at").to_numpy()] = np.minimum(got.column("level").to_numpy(), 255)
    return table, float(cold["s"] or 1) / float(cold["n"] or 1)


def boundary(sizes: dict[int, int], mean: float, percent: int = PERCENT) -> int:
    """The set size below which enumerating 2-subsets costs less than scanning the inverted lists."""
    enum, scan = {}, {}
    for n in sizes:
        p = n - needed(n, percent)
        enum[n] = sizes[n] * (p + 2) * (p + 1) / 2 * 1.05
        scan[n] = sizes[n] * (p + 1) * (1 + mean)
    best, cost, least = 2, sum(scan.values()), sum(scan.values())
    for n in sorted(sizes):
        cost += enum[n] - scan[n]
        if cost < least:
            best, least = n + 1, cost
    return best


def entries(docs: DataFrame, hot: np.ndarray, border: int, size: int, percent: int) -> DataFrame:
    """(key, single, sig, n, pos): the prefix keys of every set, with the place of their last shingle in the order; copies in
    one task are there once."""
    low = needed(border, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in blocks(batch.column(0)):
                keys, places, each = [], [], []
                for s in shingle_sets(block, size):
                    n = len(s)
                    if not n or (sig := _signature(s)) in seen:
                        continue
                    seen.add(sig)
                    level = hot[(s >> np.uint64(64 - HOT_BITS)).astype(np.int64)]
                    p = n - needed(n, percent)
                    order = s[np.flatnonzero(level == 0)[: p + 2]]
                    if len(order) < p + 2:
                        order = s[np.argsort(level, kind="stable")[: p + 2]]
                    if n >= low:
                        keys.append(order[: p + 1])
                        places.append(np.arange(p + 1))
                        each.append((sig, n, True, p + 1))
                    if n < border and n > 1:
                        i, j = np.triu_indices(min(n, p + 2), 1)
                        a, b = np.minimum(order[i], order[j]), np.maximum(order[i], order[j])
                        keys.append(mix(a * np.uint64(0x9E3779B97F4A7C15) + b))
                        places.append(j)
                        each.append((sig, n, False, len(i)))
                if keys:
                    sig, n, single, times = (np.array(c) for c in zip(*each, strict=True))
                    columns = [
                        pa.array(signed(np.concatenate(keys))),
                        pa.array(np.repeat(single, times)),
                        pa.array(np.repeat(sig, times)),
                        pa.array(np.repeat(n, times).astype(np.int32)),
                        pa.array(np.concatenate(places).astype(np.int32)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "single", "sig", "n", "pos"])

    return arrow(docs.select("text"), run, "key long, single boolean, sig long, n int, pos int")


def overlap(a: str, b: str, percent: int) -> Column:
    """The intersection that sets of these sizes need."""
    return F.expr(f"({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent}")


def alike(sketch_a: Column, sketch_b: Column, n_a: Column, n_b: Column, needs: Column, percent: int) -> tuple[Column, Column]:
    """Whether sizes and sketches let sets link, and how many bits of the sketches differ."""
    apart = sum((F.bit_count(sketch_a[i].bitwiseXOR(sketch_b[i])) for i in range(SKETCH)), F.lit(0))
    fits = percent * F.greatest(n_a, n_b) <= 100 * F.least(n_a, n_b)
    return fits & (apart <= n_a + n_b - 2 * needs), apart


def mixed(lists: DataFrame, scratch: Scratch, *columns: Column) -> DataFrame:
    """The keys whose rows have several labels, with these aggregates."""
    several = F.min("label").alias("lo"), F.max("label").alias("hi")
    return scratch.save(lists.groupBy("key", "single").agg(*several, *columns).where("lo <> hi").drop("lo", "hi"))


def tries(lists: DataFrame, scratch: Scratch, turn: int, percent: int) -> DataFrame:
    """Of each node the pivots of its lists that look nearest to it, of another label: at most PIVOTS pairs (a, b) a node."""
    row = F.struct("sig", "n", "label", "sketch")
    pivots = F.array(*[F.min_by(row, F.xxhash64("sig", "key", F.lit(turn * PIVOTS + i))) for i in range(PIVOTS)])
    by_key = mixed(lists, scratch, pivots.alias("pivots"))
    met = lists.join(by_key, ["key", "single"]).select("sig", "n", "label", "sketch", F.posexplode("pivots").alias("i", "to"))
    met = met.where("label <> to.label")
    near, apart = alike(F.col("sketch"), F.col("to.sketch"), F.col("n"), F.col("to.n"), overlap("n", "to.n", percent), percent)
    share = apart / (F.col("n") + F.col("to.n"))
    best = met.where(near).groupBy("sig", "i").agg(F.min(F.struct(share.alias("share"), F.col("to.sig").alias("b"), F.col("label").alias("from"), F.col("to.label").alias("to"))).alias("best"))
    out = scratch.save(best.select(F.col("sig").alias("a"), "best.b", "best.from", "best.to").distinct())
    scratch.drop(by_key)
    return out


def contracted(lists: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, size: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """The lists with a label a node, and the links that the labels come from: rounds over the long lists, others make few pairs."""
    many = lists.groupBy("key", "single").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LONG).select("key", "single")
    long = scratch.save(lists.drop("before").join(many, ["key", "single"], "left_semi").withColumn("label", F.col("sig")))
    links: list[DataFrame] = []
    every = 0
    while True:
        tried = tries(long, scratch, len(links), percent)
        n = tried.count()
        if not n:
            scratch.drop(tried)
            break
        found = linked(tried, nodes, docs, scratch, size, percent)
        links.append(found)
        new = found.count()
        every += new
        if new < FAIR * max(n, every):
            scratch.drop(tried)
            break
        edges = tried.join(found.select("a", "b"), ["a", "b"], "left_semi").select(F.col("from").alias("a"), F.col("to").alias("b"))
        labels = components(edges, scratch)
        newer = long.withColumnRenamed("label", "node").join(labels, "node", "left")
        newer = scratch.save(newer.withColumn("label", F.coalesce("label", "node")).drop("node"))
        scratch.drop(tried, long)
        long = newer
    scratch.drop(long)
    if not links:
        return lists.withColumn("label", F.col("sig")), links
    labels = components(reduce(DataFrame.unionByName, links), scratch).withColumnRenamed("node", "sig")
    return scratch.save(lists.join(labels, "sig", "left").withColumn("label", F.coalesce("label", "sig"))), links


def across(lists: DataFrame, scratch: Scratch, border: int, percent: int) -> DataFrame:
    """Pairs of nodes (a < b) that share a key but no label, and that sizes, places and sketches let link.

    lists: key, single, sig, n, pos, label, sketch, before. The rows of a list that are not of its commonest label meet its
    chunks. Where both rows hold the same key before this one, that key makes the pair: its places are earlier in both.
    """
    by_label = lists.groupBy("key", "single", "label").agg(F.count(F.lit(1)).alias("c"))
    by_key = by_label.groupBy("key", "single").agg(F.max_by("label", "c").alias("common"), F.sum("c").alias("c"), F.count(F.lit(1)).alias("labels"))
    by_key = scratch.save(by_key.where("labels > 1").select("key", "single", "common", F.ceil(F.col("c") / CHUNK).cast("int").alias("m")))
    rows = scratch.save(lists.join(by_key, ["key", "single"]).withColumn("x", F.pmod(F.xxhash64("sig"), F.col("m")).cast("int")))
    met = meeting(rows, border, percent)
    pairs = scratch.save(met.distinct())
    scratch.drop(by_key, rows)
    return pairs


def meeting(rows: DataFrame, border: int, percent: int) -> DataFrame:
    """The pairs (a < b) of the rows' lists, nearly each once. rows: as in `across`, with common, m (chunks of the list) and x."""
    named = lambda k: [F.col(c).alias(f"{c}_{k}") for c in ("sig", "n", "pos", "label", "sketch", "before")]
    left = rows.where("label <> common").select("key", "single", *named("a"), F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    right = rows.select("key", "single", *named("b"), "common", "x")
    needs = overlap("n_a", "n_b", percent)
    # the first common key of a pair that links stands early enough in both
    late = F.when(F.col("single"), 0).otherwise(1)
    early = (F.col("pos_a") <= F.col("n_a") - needs + late) & (F.col("pos_b") <= F.col("n_b") - needs + late)
    large = ~F.col("single") | (F.greatest("n_a", "n_b") >= border)
    other = (F.col("label_a") != F.col("label_b")) & ((F.col("label_b") == F.col("common")) | (F.col("sig_a") < F.col("sig_b")))
    near, _ = alike(F.col("sketch_a"), F.col("sketch_b"), F.col("n_a"), F.col("n_b"), needs, percent)
    met = left.join(right, ["key", "single", "x"]).where(other & early & large & near & ~F.arrays_overlap("before_a", "before_b"))
    return met.select(F.least("sig_a", "sig_b").alias("a"), F.greatest("sig_a", "sig_b").alias("b"))


def count_links(members: DataFrame, percent: int) -> DataFrame:
    """sig and links: to how many documents of its component's other sets a set links.

    members: component, sig, copies, shingles. A component of more than BLOCK shingles is cut into blocks by the sets' hash; each
    two blocks are a task's work, and so is a bucket of small components. The product of a block's incidence matrix with
    another's holds all intersections, so no pair is ever a row.
    """
    sized = members.groupBy("component").agg(F.sum(F.size("shingles")).alias("size"), F.count(F.lit(1)).alias("c")).where("c > 1")
    whole = members.join(sized, "component")
    small = whole.where(F.col("size") <= BLOCK)
    total = sized.where(F.col("size") <= BLOCK).agg(F.sum("size").alias("s")).head()["s"] or 0
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, int(total) // BLOCK))).cast("int")
    kept = ["component", "sig", "copies", "shingles"]
    one = small.select(*kept, bucket.cast("long").alias("at"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(-1).alias("x"))
    m = F.ceil(F.col("size") / BLOCK).cast("int")
    cut = whole.where(F.col("size") > BLOCK).withColumn("m", m).withColumn("x", F.pmod(F.xxhash64("sig"), F.col("m")).cast("int"))
    cells = cut.select(*kept, F.col("component").alias("at"), "x", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("y"))
    large = cells.select(*kept, "at", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "x")

    def count(table: pa.Table) -> pa.Table:
        sig, copies = table.column("sig").to_numpy(), table.column("copies").to_numpy().astype(float)
        lists = table.column("shingles").combine_chunks()
        offsets, value = lists.offsets.to_numpy(), lists.values.to_numpy()
        n = np.diff(offsets)
        # columns of the incidence matrix are the distinct shingles of a component's rows
        component, i, j, x = (table.column(c).to_numpy() for c in ("component", "i", "j", "x"))
        links = np.zeros(len(sig))
        order = np.argsort(component, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(component[order])) + 1) if len(order) else []:
            parts = [value[offsets[r] : offsets[r + 1]] for r in at]
            column = np.unique(np.concatenate(parts), return_inverse=True)[1]
            row = np.repeat(np.arange(len(at)), n[at])
            firsts = np.flatnonzero(x[at] == i[at]) if i[at[0]] >= 0 else np.arange(len(at))
            others = np.flatnonzero(x[at] == j[at]) if i[at[0]] >= 0 else firsts
            inter = np.zeros((len(firsts), len(others)), dtype=np.float32)
            side = [np.full(len(at), -1), np.full(len(at), -1)]
            side[0][firsts], side[1][others] = np.arange(len(firsts)), np.arange(len(others))
            for low in range(0, int(column.max()) + 1, 1 << 12):  # some columns at a time
                held = (column >= low) & (column < low + (1 << 12))
                dense = []
                for k, size in ((0, len(firsts)), (1, len(others))):
                    mine = side[k][row]
                    ok = held & (mine >= 0)
                    matrix = np.zeros((size, 1 << 12), dtype=np.float32)
                    matrix[mine[ok], column[ok] - low] = 1
                    dense.append(matrix)
                inter += dense[0] @ dense[1].T
            both = n[at[firsts]][:, None] + n[at[others]][None, :]
            link = 100 * inter.astype(np.int64) >= percent * (both - inter.astype(np.int64))
            link &= sig[at[firsts]][:, None] != sig[at[others]][None, :]
            links[at[firsts]] += link @ copies[at[others]]
            if len(firsts) and len(others) and i[at[0]] != j[at[0]]:
                links[at[others]] += link.T @ copies[at[firsts]]
        return pa.table({"sig": pa.array(sig), "links": pa.array(links.astype(np.int64))})

    cells = one.unionByName(large).groupBy("at", "i", "j").applyInArrow(count, "sig long, links long")
    return cells.groupBy("sig").agg(F.sum("links").alias("links"))


@dataclass
class Join:
    """base: doc_id, n, sig of each document; nodes: sig, n, id, rep, copies; final: sig, component_id, keeper (the sig that stands
    for the component: that of its smallest id); links: confirmed links (a, b, inter) that connect every component."""

    base: DataFrame
    nodes: DataFrame
    final: DataFrame
    links: DataFrame
    docs: DataFrame
    scratch: Scratch
    size: int
    percent: int

    def documents(self, links: bool = False) -> DataFrame:
        """doc_id, n_shingles, component_id for every document, and with `links` n_links: how many other documents it links to."""
        told = self.final.select("sig", "component_id")
        if links:
            more = self.final.withColumnRenamed("keeper", "component").join(self.nodes.select("sig", "copies"), "sig")
            groups = self.scratch.save(more.groupBy("component").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("component"))
            members = self.scratch.save(more.join(groups, "component").select("sig", "component", "copies"))
            ids = self.scratch.save(self.nodes.join(members, "sig", "left_semi").select("sig", "id"))
            sets = self.scratch.save(whole_sets(ids, self.docs, self.size))
            counted = self.scratch.save(count_links(members.join(sets, "sig"), self.percent))
            self.scratch.drop(groups, members, ids, sets)
            told = told.join(self.nodes.select("sig", "copies"), "sig").join(counted, "sig", "left")
            told = told.select("sig", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
        filled = self.base.where("n > 0").join(told, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), *told.columns[1:])
        none = [F.lit(0).cast("long").alias("n_links")] if links else []
        return filled.unionByName(self.base.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *none))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> Join:
    """Find the components of the documents (doc_id, text)."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(prefix_counts(docs, size, percent).where("c > 1"))
    hot, mean = hot_and_cost(counts)
    scratch.drop(counts)
    marked = scratch.save(signatures(docs, size))
    copies = F.count(F.lit(1)).alias("copies")
    ids = [F.max("n").alias("n"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("id"), F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")]
    nodes = scratch.save(marked.where("n > 0").groupBy("sig").agg(*ids, copies))
    base = scratch.save(marked.select("doc_id", "n", "sig"))
    scratch.drop(marked)
    sizes = {r["n"]: r["c"] for r in nodes.groupBy(F.least("n", F.lit(MOST_SIZE)).alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    border = boundary(sizes, mean, percent)
    every = scratch.save(entries(docs, hot, border, size, percent))
    ends = F.min("sig").alias("lo"), F.max("sig").alias("hi")
    shared = scratch.save(every.groupBy("key", "single").agg(*ends).where("lo <> hi").select("key", "single"))
    several = scratch.save(every.join(shared, ["key", "single"]).distinct())
    scratch.drop(every, shared)
    # keys of 2-subsets have no order of their own
    earlier = Window.partitionBy("sig", "single").orderBy("pos").rowsBetween(-BEFORE, -1)
    before = F.when(F.col("single"), F.collect_list("key").over(earlier)).otherwise(F.array().cast("array<long>"))
    lists = scratch.save(several.withColumn("before", before).join(nodes.select("sig", "sketch"), "sig"))
    scratch.drop(several)
    labelled, links = contracted(lists, nodes, docs, scratch, size, percent)
    pairs = across(labelled, scratch, border, percent)
    scratch.drop(lists, *([labelled] if links else []))
    links.append(linked(pairs, nodes, docs, scratch, size, percent))
    scratch.drop(pairs)
    confirmed = reduce(DataFrame.unionByName, links)
    labels = components(confirmed, scratch)
    full = nodes.select("sig", "rep").join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    full = scratch.save(full.select("sig", "rep", F.coalesce("label", "sig").alias("label")))
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "sig")).alias("first")
    least = scratch.save(full.groupBy("label").agg(first).select("label", F.col("first.rep").alias("component_id"), F.col("first.sig").alias("keeper")))
    final = scratch.save(full.join(least, "label").select("sig", "component_id", "keeper"))
    scratch.drop(full, least)
    return Join(base, nodes, final, confirmed, docs, scratch, size, percent)


def one_of_each(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The documents less near duplicates: of each component the one of the smallest id stays, of repeated rows one.

    Documents without shingles all stay. docs may have any columns besides doc_id and text.
    """
    found = join(docs, size, percent)
    columns = docs.columns
    text, number = columns.index("text"), columns.index("doc_id")
    schema = StructType([*docs.schema.fields, StructField("_sig", LongType()), StructField("_id", LongType()), StructField("_n", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [(_signature(s), len(s)) for block in blocks(batch.column(text)) for s in shingle_sets(block, size)]
            sig, n = zip(*sets, strict=True) if sets else ((), ())
            ids = batch.column(number).cast(pa.int64()).fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.int64()), ids, pa.array(n, pa.int64())], names=[*columns, "_sig", "_id", "_n"])

    marked = arrow(docs, run, schema)
    keepers = found.final.where("sig = keeper").select(F.col("sig").alias("_sig"), F.coalesce("component_id", F.lit(NO_ID)).alias("_id"))
    kept = marked.where("_n > 0").join(keepers, ["_sig", "_id"], "left_semi")
    if found.base.where("n > 0").groupBy("sig", "doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["_sig", "_id"])
    return kept.unionByName(marked.where("_n = 0")).select(*columns)
