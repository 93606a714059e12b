"""License scans: exact phrases, and a fuzzy search for short notices.

A text is brought to its words, lower-cased and joined by single spaces. A notice may differ from it by a bounded number
e of edits (`edits`). Cut into e + 1 pieces, a notice that is there with at most e edits has one of the pieces unchanged
(pigeonhole), so the places of the pieces are the candidates. Around each of them the `regex` library's bounded-error
matching decides, and tells the edits and the span.

Defined cases: a null or empty text has no words, no labels and score 0; places of one notice that overlap count once;
repeated rows each get their row.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidegrid.llm.buffers import _LOWER, ALNUM, Block, blocks, hash_words, words
from tidegrid.llm.common import arrow

#: Phrases of whole words, and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices for the fuzzy search, and the labels they give.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache",
    "this program is free software you can redistribute it and or modify": "gpl",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "licensed under a creative commons attribution": "cc",
    "free and unencumbered software released into the public domain": "unlicense",
}
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, notice: string, first_word: long, last_word: long, edits: int>>"
)


def edits(notice: str) -> int:
    """The edits that a notice may have: one, and one more for each 16 characters beyond 16."""
    return 1 + max(0, len(notice) - 16) // 16


def seeds(notice: str, e: int) -> list[tuple[str, int]]:
    """e + 1 pieces of about one length, and where each begins."""
    cuts = [round(i * len(notice) / (e + 1)) for i in range(e + 2)]
    return [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=None)
def _pattern(notice: str, e: int) -> regex.Pattern:
    return regex.compile(f"(?b)(?<![^ ])(?:{regex.escape(notice)}){{e<={e}}}(?![^ ])")


@lru_cache(maxsize=1 << 16)
def verify(notice: str, e: int, window: str) -> tuple[tuple[int, int, int], ...]:
    """Spans and edits of the notice's matches of whole words in a window: the best one, then those before it and after it."""
    out, parts = [], [(0, len(window))]
    while parts:
        lo, hi = parts.pop()
        m = _pattern(notice, e).search(window, lo, hi) if hi - lo >= len(notice) - e else None
        if m:
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            parts += [(lo, m.start()), (m.end(), hi)]
    return tuple(out)


def apart(found: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Of (last word, edits) by first word those that don't overlap, in their order: fewest edits first, then the first place."""
    kept: list[tuple[int, int, int]] = []
    for first, (last, n) in sorted(found.items(), key=lambda f: (f[1][1], f[0])):
        at = bisect_left(kept, (first, last, n))
        if (at == 0 or kept[at - 1][1] < first) and (at == len(kept) or kept[at][0] > last):
            kept.insert(at, (first, last, n))
    return kept


def normal(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's words with one blank after each, where each document begins there, and the bytes kept before each byte."""
    data = _LOWER[block.data]
    is_word = ALNUM[data]
    n = len(data)
    last = is_word.copy()  # last byte of a word
    border = np.zeros(n + 1, dtype=bool)
    border[block.offsets] = True
    if n:
        last[:-1] &= ~is_word[1:] | border[1:n]
    size = is_word.astype(np.int64) + last
    ends = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(ends[-1]), 0x20, dtype=np.uint8)
    out[ends[:-1][is_word]] = data[is_word]
    return out, ends[block.offsets], ends


def fuzzy(block: Block, notices: dict[str, str]) -> dict[int, list[tuple[str, str, int, int, int]]]:
    """By document (label, notice, first word, last word, edits) of each notice found."""
    text, begins, _ = normal(block)
    whole = text.tobytes()
    starts = np.concatenate([[0], np.flatnonzero(text == 0x20) + 1])
    out: dict[int, list] = {}
    for notice, label in notices.items():
        e = edits(notice)
        places: dict[int, set[tuple[int, int]]] = {}
        for piece, shift in seeds(notice, e):
            key = piece.encode()
            at = whole.find(key)
            while at >= 0:
                d = int(np.searchsorted(begins, at, side="right")) - 1
                lo = max(int(begins[d]), at - len(piece) - shift - 2 * e)
                hi = min(int(begins[d + 1]), at + len(notice) - shift + len(piece) + 2 * e)
                lo = int(starts[np.searchsorted(starts, lo, side="right") - 1])
                if lo < begins[d]:
                    lo = int(begins[d])
                stop = whole.find(b" ", hi - 1, int(begins[d + 1]))
                hi = stop if stop >= 0 else int(begins[d + 1])
                places.setdefault(d, set()).add((lo, hi))
                at = whole.find(key, at + 1)
        for d, windows in places.items():
            found: dict[int, tuple[int, int]] = {}
            for lo, hi in windows:
                raw = whole[lo:hi].rstrip()
                window = raw.decode("utf-8", "replace")
                for hit in verify(notice, e, window):
                    a = lo + len(window[: hit[0]].encode())
                    b = lo + len(window[: hit[1]].encode())
                    base = int(np.searchsorted(starts, begins[d]))
                    first = int(np.searchsorted(starts, a, side="right")) - 1 - base
                    last = int(np.searchsorted(starts, b - 1, side="right")) - 1 - base
                    if first not in found or found[first][1] > hit[2]:
                        found[first] = (last, hit[2])
            out.setdefault(d, []).extend((label, notice, first, last, n) for first, last, n in apart(found))
    return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Base places and labels, all labels, a score (1 for an exact phrase, else 1 less the share of edits), and the spans."""
    phrases, notices = phrases or PHRASES, notices or NOTICES
    schema = StructType.fromDDL(RESULT)
    shape = to_arrow_schema(schema)
    hashed = [(hash_words(p.split()), label) for p, label in phrases.items()]

    def rows(column: pa.Array) -> Iterator[tuple]:
        for block in blocks(column):
            w = words(block, ALNUM)
            n = block.n_docs
            base = np.zeros(n, np.int64)
            first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
            labels: list[set[str]] = [set() for _ in range(n)]
            for hs, label in hashed:
                m = len(w.hash) - len(hs) + 1
                if m <= 0:
                    continue
                same = w.doc[:m] == w.doc[len(hs) - 1 :]
                for j, h in enumerate(hs):
                    same &= w.hash[j : j + m] == h
                at = np.flatnonzero(same)
                d, place = w.doc[at], at - w.bounds[w.doc[at]]
                np.add.at(base, d, 1)
                np.minimum.at(first, d, place)
                np.maximum.at(last, d, place)
                for x in np.unique(d).tolist():
                    labels[x].add(label)
            found = fuzzy(block, notices)
            for d in range(n):
                spans = found.get(d, [])
                every = labels[d] | {s[0] for s in spans}
                score = 1.0 if base[d] else max((1 - s[4] / len(s[1]) for s in spans), default=0.0)
                none = not base[d]
                yield (
                    int(w.counts[d]), int(base[d]), None if none else int(first[d]), None if none else int(last[d]), ",".join(sorted(labels[d])), ",".join(sorted(every)), score,
                    [dict(zip(("label", "notice", "first_word", "last_word", "edits"), s, strict=True)) for s in spans],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*rows(batch.column(1)), strict=True)) or [[]] * 8
            arrays = [batch.column(0).cast(pa.int64()), *[pa.array(list(c), shape.field(k + 1).type) for k, c in enumerate(cols)]]
            yield pa.RecordBatch.from_arrays(arrays, schema=shape)

    return arrow(docs.select("doc_id", "text"), run, schema)
