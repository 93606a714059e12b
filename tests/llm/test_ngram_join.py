"""The join against counting every pair's shingles."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidegrid.llm import ngram_join
from tidegrid.llm.buffers import blocks, hash_words, shingle_sets, words, SPACED

from .conftest import SCHEMA, prose

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return frozenset(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders, links = defaultdict(list), [0] * len(rows)
    for k, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                parent[find(k)] = find(j)
                links[k] += 1
                links[j] += 1
        for x in s:
            holders[x].append(k)
    least = {}
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(k) and rows[j][0] is not None]
        least[k] = min(ids, default=None)
    return Counter((r[0], len(sets[k]), least[k] if sets[k] else r[0], links[k]) for k, r in enumerate(rows))


def got(df):
    rows = ngram_join.join(df).documents(links=True).collect()
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in rows)


def test_odd_documents(odd, odd_rows):
    assert got(odd) == brute(odd_rows)


def test_empty(none):
    assert got(none) == Counter()


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_copies_and_common_passages(spark, seed):
    rng = random.Random(seed)
    passage = prose(rng, "en", 30)
    rows, base = [], prose(rng, "fr", 60).split()
    for i in range(160):
        kind = rng.random()
        if kind < 0.5:  # edited copies, some of copies
            w = list(base if kind < 0.3 or not rows else rows[rng.randrange(len(rows))][1].split())
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(999)}"
            text = " ".join(w)
        elif kind < 0.8:
            text = f"{prose(rng, 'de', rng.randrange(2, 30))} {passage}"
        else:
            text = prose(rng, "en", rng.randrange(1, 12))
        rows.append((i, text, "en", "s", 1))
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


@pytest.mark.parametrize("block", [1 << 16, 512])
def test_large_group_and_common_passage(spark, monkeypatch, block):
    """A large group of near copies, some of which link to few others only, and texts that are one passage for the most part;
    with small blocks a component is counted by several."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(90)]
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(40))
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3])):
            at = rng.randrange(len(w))
            w[at : at + 1] = [f"x{rng.randrange(10**6)}"]
        rows.append((i, " ".join(w), "en", "s", 1))
    for i in range(400, 700):
        rows.append((i, f"{passage} {prose(rng, 'en', rng.randrange(0, 40))}", "en", "s", 1))
    expected = brute(rows)
    assert max(r[3] for r in expected) > 50
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == expected


def test_one_of_each(odd, odd_rows):
    kept = ngram_join.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[104] == 1 and ids[105] == 0 and ids[None] == 0 and ids[106] == 1 and ids[107] == 0 and ids[100] == ids[101] == ids[102] == ids[103] == 1
    assert sum(ids.values()) == len(odd_rows) - 4


def test_hash_of_words_and_bounds():
    block = next(blocks(pa.array(["Ab  c", None, "ab"])))
    w = words(block, SPACED)
    assert w.hash.tolist() == hash_words(["ab", "c", "ab"]).tolist() and w.counts.tolist() == [2, 0, 1]
    assert [len(s) for s in shingle_sets(block)] == [1, 0, 1]
    a, b = (np.sort(np.random.default_rng(i).integers(0, 1 << 63, 200).astype(np.uint64)) for i in (1, 2))
    apart = sum(int(x ^ y & (1 << 64) - 1).bit_count() if x ^ y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(ngram_join.sketch(a), ngram_join.sketch(b)))
    assert apart <= len(set(a.tolist()) ^ set(b.tolist()))
    assert ngram_join.boundary({5: 10, 50: 10, 500: 10}, 2.0) > 5 and ngram_join.boundary({}, 2.0) == 2


def test_a_pair_is_made_at_its_first_key(spark, monkeypatch):
    """Copies of one text edited so much that few link share most of their prefixes: pairs are made about once, not at every key."""
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(300)], []
    for i in range(80):
        w = list(base)
        for _ in range(rng.randrange(4, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    made = []

    def meeting(*args, before=ngram_join.meeting):
        out = before(*args)
        made.append((out.count(), out.distinct().count()))
        return out

    monkeypatch.setattr(ngram_join, "meeting", meeting)
    monkeypatch.setattr(ngram_join, "FAIR", 2)
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    assert made[0][1] >= 50 and made[0][0] <= 1.5 * made[0][1]
