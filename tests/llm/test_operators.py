"""The other operators against plain versions of themselves, and on odd rows."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidegrid.llm import cotraining, decontaminate, language, licenses, maxscore, mixing, packing, toxicity, url_filter
from tidegrid.llm.queries import tokenizer_path

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def alnum(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(LOWER))


def rows(df):
    return [tuple(r) for r in df.collect()]


# 3


def test_maxscore_is_exact(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=12) / 3]) for i in range(400)] + [(i, [0.5] * 12) for i in range(400, 410)]
    vectors += [(500, None), (501, [1.0, None] + [0.0] * 10), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (450, [])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(5)
    q = df.where("vec_id % 50 = 0")
    got = {}
    for a, rank, b, score in rows(maxscore.top_k(df, q, query_block=3, shard_rows=64)):
        got.setdefault(a, {})[rank] = (b, score)
    ints = {i: np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for i, v in vectors if i < 500}
    ints[450] = np.zeros(12)
    for a in [i for i in ints if i % 50 == 0]:
        want = sorted((-int(ints[a] @ v), b) for b, v in ints.items() if b != a)[:5]
        assert [got[a][r] for r in range(1, 6)] == [(b, -s) for s, b in want]
    assert 500 not in got and rows(maxscore.top_k(df.where("false"), q.where("false"))) == []


# 4


def test_license_base_and_fuzzy(spark, odd, odd_rows):
    docs = spark.createDataFrame(
        [(1, "The MIT License. mit-license; MIT\nLICENSE"), (2, "under the MIT licence"), (3, "Permission is hereby granted, free of charg, to any persn obtaining a copy"), (4, "GNU General Public License and Apache License"), (5, "admit licenses"), (6, None)],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["score"]) == (3, 1, 5, "mit", 1.0)
    assert got[2]["n_base"] == 0 and got[2]["labels"] == "mit" and 0 < got[2]["score"] < 1 and got[2]["spans"][0]["edits"] == 1 and got[2]["spans"][0]["first_word"] == 2
    assert got[3]["labels"] == "mit" and got[4]["base_labels"] == "apache,gpl" and got[5]["labels"] == "" and got[6]["n_words"] == 0 and got[6]["score"] == 0.0
    want = Counter((r[0], len(alnum(r[1]))) for r in odd_rows)
    assert Counter((r["doc_id"], r["n_words"]) for r in licenses.scan(odd).collect()) == want


def test_every_fuzzy_place_is_told(spark):
    """All places of a notice, the inexact ones beside exact ones too; base columns against a plain count."""
    docs = spark.createDataFrame([(1, "mit licenze mit license"), (2, "apache licenze, apache license and apache licence"), (3, "mit license x mit licens")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in r["spans"]] for r in licenses.scan(docs).collect()}
    assert got[1] == [("mit", 0, 1, 1), ("mit", 2, 3, 0)] and got[3] == [("mit", 0, 1, 0), ("mit", 3, 4, 1)]
    assert got[2] == [("apache", 0, 1, 1), ("apache", 2, 3, 0), ("apache", 5, 6, 1)]


def test_license_base_against_a_plain_scan(spark):
    import random

    rng, parts = random.Random(8), ["MIT", "License", "apache", "general", "public", "license", "the", "-", "é", "\n"]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(300)]
    phrases = {b"mit license": "mit", b"apache license": "apache", b"general public license": "gpl"}
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        w = alnum(text)
        places = [(at, label) for p, label in phrases.items() for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
        starts = [at for at, _ in places]
        want = (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places})))
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == want


@pytest.mark.parametrize("notice", list(licenses.NOTICES))
def test_every_notice_with_its_edits_is_found(notice):
    import random

    import pyarrow as pa

    from tidegrid.llm.buffers import blocks

    rng, e = random.Random(1), licenses.edits(notice)
    for _ in range(20):
        text = list(notice)
        for _ in range(e):
            at = rng.randrange(1, len(text) - 1)
            if text[at] != " ":
                text[at] = rng.choice("abcxyz")
        block = next(blocks(pa.array([f"some words before {''.join(text)} and after"])))
        assert any(s[1] == notice for s in licenses.fuzzy(block, licenses.NOTICES).get(0, []))


# 5, 7, 1


def test_language(odd, none, odd_rows):
    got = {r["doc_id"]: r for r in language.identify(odd).collect()}
    truth = {r[0]: r[2] for r in odd_rows[:60]}
    assert sum(got[i]["lang_pred"] == truth[i] for i in truth) >= 0.9 * len(truth)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (100, 101, 102, 108)) and got[103]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["held_out"] == (zlib.crc32(b"1") % 4 == 2)
    assert language.identify(none).count() == 0 and language.accepted(none).count() == 0
    kept = language.accepted(odd)
    assert kept.columns == odd.columns and {100, 101, 102, 108} & {r["doc_id"] for r in kept.collect()} == set()


def test_toxicity_and_quality(spark, odd, none, labels, odd_rows):
    for df in (toxicity.classify(odd, labels), cotraining.classify(odd, labels)):
        got = df.collect()
        assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert next(r for r in got if r["doc_id"] == 7)["held_out"] == (zlib.crc32(b"7") % 5 == 0)
    for df in (toxicity.classify(none, labels), cotraining.classify(none, labels)):
        assert df.count() == 0
    empty = labels.where("false")
    assert {r["score"] for r in toxicity.classify(odd, empty).collect()} == {0.0} == {r["score"] for r in cotraining.classify(odd, empty).collect()}
    assert toxicity.clean(odd, empty).columns == odd.columns


def test_toxicity_on_held_out(spark, data):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{data.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count(F.lit(1))).head()
    assert right / n >= 0.9
    good = cotraining.classify(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = good.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count(F.lit(1))).head()
    assert right / n >= 0.9


def test_isotonic_rises():
    from tidegrid.llm.boosting import fit_isotonic, fit_trees

    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] + 0.3 * rng.normal(size=500) > 0).astype(float)
    trees = fit_trees(x, y, trees=20)
    p = fit_isotonic(trees.margin(x), y)(np.linspace(-5, 5, 50))
    assert (np.diff(p) >= 0).all() and ((trees.margin(x) > 0) == y).mean() > 0.9


def test_views_exchange_labels():
    """Both views give labels of both classes in the first round, and the text model is another one for it."""
    rng = np.random.default_rng(3)
    y = (rng.random(3000) < 0.8).astype(float)
    x = y[:, None] * 1.5 + rng.normal(size=(3000, 4))
    m = y[:, None] * 0.5 + rng.normal(size=(3000, 3))
    model = cotraining.cotrain(x[:200], m[:200], y[:200], x[200:], m[200:])
    assert len(model.given) == cotraining.ROUNDS and all(model.given[0][view, label] > 0 for view in ("text", "meta") for label in (0, 1))
    assert not np.array_equal(model.first[0].model.margin(x), model.text.model.margin(x))
    alone = cotraining.cotrain(x[:200], m[:200], y[:200], x[:0], m[:0])
    right = [((c.scores(x[200:], m[200:])[2] >= 0.5) == y[200:]).mean() for c in (model, alone)]
    assert alone.given == [] and right[0] >= right[1] - 0.01 and right[0] > 0.85


def test_repeated_rows_of_an_id_are_one_training_row(spark, odd_rows, labels):
    df = spark.createDataFrame([*odd_rows[:60], *[odd_rows[1]] * 500], "doc_id long, text string, lang string, source string, n_chars long")
    plain = spark.createDataFrame(odd_rows[:60], df.schema)
    for op in (cotraining, toxicity):
        a, b = ({r["doc_id"]: r["score"] for r in op.classify(d, labels).collect()} for d in (df, plain))
        assert a == pytest.approx(b)
    a, b = ({r["doc_id"]: r for r in language.identify(d).collect()} for d in (df, plain))
    assert all(a[i]["lang_pred"] == b[i]["lang_pred"] and a[i]["score"] == pytest.approx(b[i]["score"], abs=1e-4) for i in b)


# 6


def test_packing_is_a_round_trip(spark, odd, none, odd_rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for r in odd_rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        for s in range(0, len(ids), 4096):
            want[r[0], s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes()), len(ids)] += 1
    got = packing.pack(odd, tokenizer_path()).collect()
    assert Counter(tuple(r[:5]) for r in got) == want
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_ids_of_any_vocabulary_file(tmp_path, odd_rows):
    """Word by word where the file says that words are apart, else by whole texts: the ids are the library's own."""
    import json

    from tokenizers import Tokenizer

    from tidegrid.llm.tokens import WordIds

    assert WordIds(tokenizer_path()).by_word
    told = json.loads(open(tokenizer_path(), encoding="utf-8").read())
    told["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(told), encoding="utf-8")
    other, ids = Tokenizer.from_file(str(tmp_path / "other.json")), WordIds(str(tmp_path / "other.json"))
    assert not ids.by_word
    for r in odd_rows:
        if r[1] is not None and len(r[1]) < 10_000:
            assert np.frombuffer(ids.text(r[1]), "<u4").tolist() == other.encode(r[1], add_special_tokens=False).ids


def test_packing_plan_wastes_little():
    rng = np.random.default_rng(2)
    demand = dict(Counter(rng.integers(1, 512, 4000).tolist()))
    plan = packing.make_plan(demand, 512)
    packed = Counter()
    for times, pattern in plan.patterns:
        assert sum(u * n for u, n in pattern.items()) <= 512
        for u, n in pattern.items():
            packed[u] += times * n
    assert packed == demand
    least = max(sum(u * n for u, n in demand.items()) / 512, sum(n for u, n in demand.items() if u > 256))
    assert plan.sequences <= 1.005 * least + 1 and plan.by_program >= 0.95 * sum(demand.values())


def test_column_generation_betters_what_filling_finds():
    """Lengths between a sixth and two fifths of a sequence: filling is above the bound, the program comes close to it."""
    rng = np.random.default_rng(5)
    demand = dict(Counter(rng.integers(90, 210, 6000).tolist()))
    first = packing.fill_all(demand, 512)
    program = packing.column_generation(demand, 512, first)
    packed = Counter()
    for x, pattern in program.patterns:
        assert x > 0 and sum(u * n for u, n in pattern.items()) <= 512
        for u, n in pattern.items():
            packed[u] += x * n
    assert all(packed[u] >= n - 1e-3 * n for u, n in demand.items())
    assert program.bound <= program.value < sum(n for n, _, _ in first) and program.value <= 1.002 * program.bound
    plan = packing.make_plan(demand, 512)
    assert plan.sequences <= sum(n for n, _, _ in first) and plan.by_program >= 0.95 * sum(demand.values())


def test_patterns_are_priced_where_filling_is_as_good_as_the_bound(monkeypatch):
    """The plan is the program's also where filling alone would do: only the last few sequences are filled."""
    rng = np.random.default_rng(2)
    demand = dict(Counter(rng.integers(1, 200, 4000).tolist()))
    filled, fill_all = [], packing.fill_all
    first = fill_all(demand, 512)
    filling = sum(n for n, _, _ in first)
    assert filling <= packing.least_size(demand, 512) + 1
    assert packing.column_generation(demand, 512, first).priced > 0
    monkeypatch.setattr(packing, "fill_all", lambda left, capacity: filled.append(sum(u * n for u, n in left.items())) or fill_all(left, capacity))
    plan = packing.make_plan(demand, 512)
    assert max(filled) <= packing.FEW * 512 and plan.priced > len(demand) and plan.sequences <= filling + 1
    assert plan.bound <= plan.value <= (1 + packing.GAP) * plan.bound
    # the bound is the prices' own: no pattern is worth more than one sequence
    program = packing.column_generation(demand, 512, [])
    classes = sorted(demand)
    assert packing.knapsack(np.array([program.prices[u] for u in classes]), classes, 512)[0] <= 1 + 1e-9
    assert sum(program.prices[u] * n for u, n in demand.items()) == pytest.approx(program.bound, rel=packing.GAP)


def test_knapsack_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(20):
        classes = sorted(set(rng.integers(1, 12, 4).tolist()))
        price = rng.random(len(classes))
        best = max(sum(p * k for p, k in zip(price, ks)) for ks in itertools.product(*[range(13 // c + 1) for c in classes]) if sum(c * k for c, k in zip(classes, ks)) <= 13)
        worth, pattern = packing.knapsack(price, classes, 13)
        assert worth == pytest.approx(best) and sum(c * k for c, k in pattern.items()) <= 13
        assert sum(price[classes.index(c)] * k for c, k in pattern.items()) == pytest.approx(best)


def test_packing_fills_sequences_with_short_texts(spark):
    """Sequences are filled to single ids: empty texts are one id each."""
    texts = spark.createDataFrame([(i, "") for i in range(5000)], "doc_id long, text string")
    got = packing.pack(texts, tokenizer_path()).groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert sorted(r[1] for r in got) == [904, 4096]
    plan = packing.make_plan({9: 50_000}, 4096)
    assert packing.UNIT == 1 and plan.sequences == -(-50_000 // 455)


# 8


def test_base_score_and_probabilities(odd, none, odd_rows):
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(LOWER)), None]
    counts = Counter(w for r in odd_rows for w in split(r[1]) if r[0] is None or zlib.crc32(str(r[0]).encode()) % 10)
    n, v = sum(counts.values()), len(counts)
    want = Counter((r[0], len(split(r[1])), sum(counts[w] > 0 for w in split(r[1])), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(r[1])), 4)) for r in odd_rows)
    got = mixing.evaluate(odd).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    size = {r[0]: len((r[1] or "").encode()) + 1 for r in odd_rows}
    assert all(-12 * size[r["doc_id"]] < r["score"] < 0 for r in got) and mixing.evaluate(none).count() == 0
    assert -sum(r["score"] for r in got) / math.log10(2) < 3 * sum(len((r[1] or "").encode()) + 1 for r in odd_rows)


def test_a_bytes_probabilities_sum_to_one():
    """Over all next bytes in one context."""
    table = np.zeros((len(mixing.ORDERS) << mixing.BITS, 2), np.float32)
    key = np.frombuffer(np.random.default_rng(1).bytes(8 * 500), np.uint64) & np.uint64((1 << 40) - 1)
    mixing.count(key, np.ones(len(key), np.int64), table)
    mixer = mixing.Mixer.fresh()
    odds, seen = mixing.odds_and_seen(table)
    mixing.learn(mixer, np.zeros((mixing.GATES, mixing.INPUTS)), key, np.ones(len(key), np.int64), odds, seen)
    every = (key[0] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    assert (10 ** mixing.costs(every, mixer, mixer.refinement(), odds, seen)).sum() == pytest.approx(1, abs=1e-4)
    known = mixing.Known(lambda k: mixing.costs(k, mixer, mixer.refinement(), odds, seen), bits=4)
    assert np.allclose(known(key), known(key)) and np.allclose(known(key), mixing.costs(key, mixer, mixer.refinement(), odds, seen))


def test_contexts_far_more_than_a_fixed_table_stay_apart(spark):
    """Held-out copies of random texts are known well, however many other contexts there are; other random texts are not."""
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz012345"), 3000)) for _ in range(260)]
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:20]
    free = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10]
    train = texts[:250] * 2
    rows_in = [*zip(free, train), *zip(held, texts[:10] + texts[250:])]
    got = {r["doc_id"]: -r["score"] / math.log10(2) / 3001 for r in mixing.evaluate(spark.createDataFrame(rows_in, "doc_id long, text string").coalesce(2)).collect()}
    assert max(got[i] for i in held[:10]) < 1.5 and min(got[i] for i in held[10:]) > 4.5


# 9


def test_url_rules(spark):
    urls = {
        "http://WWW.Example.COM/en/x?y": ("www.example.com/en/", "allow"), "https://a.example.com/en/": ("example.com/en/", "block"), "https://example.com/EN/": ("com/", "allow"), "http://x.net/es/1#a": ("net/es/", "block"),
        "ftp://net/fr/": ("net/fr/", "block"), "http://notnet/es/": (None, "allow"), "http://a.com": (None, "allow"), "no scheme.com/en/": (None, "allow"), None: (None, "allow"), "http://cheap-pills.example.org/": (None, "block"),
        "http://docs.casino.example.org/": (None, "allow"), "http://casino.example.org/": (None, "block"), "http://b.com/?://x.net/es/": ("com/", "allow"), "://": (None, "allow"),
    }
    df = spark.createDataFrame([*enumerate(urls), (0, next(iter(urls)))], "page_id long, url string")
    got = url_filter.judge(df, url_filter.default_rules()).collect()
    want = dict(enumerate(urls.values()))
    assert len(got) == len(urls) + 1 and all((r["rule"], r["verdict"]) == want[r["page_id"]] for r in got)
    plan = url_filter.judge(df, url_filter.default_rules())._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    catch_all = [*url_filter.default_rules(), url_filter.pattern_rule("block", "*a*")]
    assert url_filter.judge(df, catch_all).where("verdict = 'block'").count() > 4 and url_filter.judge(df.where("false"), catch_all).count() == 0


# 10


def contamination_brute(docs, items):
    out = Counter()
    for i, text in docs:
        w, hit, named = alnum(text), set(), set()
        for k, t in items:
            b = alnum(t)
            n = min(13, len(b))
            grams = {tuple(b[j : j + n]) for j in range(len(b) - n + 1)} if n else set()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j : j + n]) in grams:
                    hit |= set(range(j, j + n))
                    named.add(k)
        out[i, len(w), len(hit), len(named), len(hit) > 0 and 20 * len(hit) >= len(w)] += 1
    return out


@pytest.mark.parametrize("block", [8 << 20, 60])
def test_contamination(spark, odd, none, odd_rows, block):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words)), (2, "short item"), (3, " ".join(words[5:30])), (4, None), (5, "W3, w4; w5"), (None, "one"), (2, "short item")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(200, "a " * 50 + " ".join(words[3:20]) + " b" * 50), (201, " ".join(words[3:15])), (202, "x short ITEM y"), (203, "-".join(words * 2)), (204, " ".join(words[:13]) + " z" * 400), (203, "-".join(words * 2))]
    df = odd.select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(df, benchmark, block_bytes=block).collect())
    every = [(r[0], r[1]) for r in odd_rows] + docs
    assert got == contamination_brute(every, [i for i in items if i[0] is not None])
    left = Counter(r["doc_id"] for r in decontaminate.without_contaminated(df.withColumn("n_hit", df.doc_id), benchmark, block_bytes=block).collect())
    assert left == Counter(k[0] for k, n in got.items() for _ in range(n) if not k[4])
    assert decontaminate.contamination(none, benchmark).count() == 0 and decontaminate.contamination(df, benchmark.where("false")).where("n_hit > 0").count() == 0


def test_winnowing_keeps_each_windows_least():
    rng = np.random.default_rng(3)
    for n in (1, 5, 9, 10, 60):
        x = rng.integers(0, 9, n).astype(np.uint64)
        kept = set(decontaminate.winnow(x, 9).tolist())
        assert kept and all(any(x[j] == x[i : i + 9].min() and j in kept for j in range(i, i + 9)) for i in range(n - 8))


def test_score_does_not_depend_on_the_split(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    got = [{r["doc_id"]: (r["score"], r["bits_per_byte"], r["base_score"]) for r in mixing.evaluate(d).collect()} for d in (docs.coalesce(1), docs.repartition(3), docs.repartition(8))]
    for other in got[1:]:
        assert set(other) == set(got[0]) and all(other[i] == pytest.approx(got[0][i], rel=1e-6) for i in other)
    assert all(0 < b < 20 for _, b, _ in got[0].values())
