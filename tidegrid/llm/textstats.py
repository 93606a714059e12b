"""Dense features of whole texts, a block of documents at a time."""

from __future__ import annotations

import numpy as np

from tidegrid.llm.buffers import ALNUM, SPACED, Block, Words, hash_words, words

#: Byte classes.
CLASSES = ("upper", "lower", "digit", "wide", "exclaim", "question", "stop", "symbol", "bar", "line", "blank", "other")
_CLASS = np.full(256, CLASSES.index("other"), dtype=np.int64)
for _name, _bytes in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "wide": range(128, 256), "exclaim": b"!", "question": b"?",
    "stop": b".,;:'\"()-", "symbol": b"#$%&*@^~_+=<>\\/`", "bar": b"|[]{}", "line": b"\n\r", "blank": b" \t\x0b\x0c",
}.items():
    _CLASS[list(_bytes)] = CLASSES.index(_name)

#: Insults and words of the second person, in the languages at hand.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers scum trash clown clowns pathetic worthless disgusting garbage imbecile fool jerk creep freak "
    "idiota imbécil estúpido estúpida basura payaso patético asqueroso tonto inútil dummkopf trottel blödmann abschaum versager widerlich erbärmlich "
    "idiote imbécile stupide ordure pathétique minable dégoûtant crétin nul abruti"
).split()
SECOND = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tus vosotros".split()
_INSULTS, _SECOND = np.unique(hash_words(INSULTS)), np.unique(hash_words(SECOND))

NAMES = (
    *(f"share_{c}" for c in CLASSES), "log_bytes", "log_words", "word_length", "long_words", "capital_words", "odd_words", "masked", "repeats", "distinct", "line_words", "mean_run",
    "insults", "second", "insults_near_second",
)
REACH = 5


def held(table: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value whether it is in the sorted table, and where."""
    if not len(table):
        return np.zeros(len(value), dtype=bool), np.zeros(len(value), dtype=np.int64)
    at = np.minimum(np.searchsorted(table, value), len(table) - 1)
    return table[at] == value, at


def per_doc(flag: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a value over each document's stretch."""
    sums = np.concatenate([[0.0], np.cumsum(flag, dtype=float)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def near(hit: np.ndarray, other: np.ndarray, w: Words) -> np.ndarray:
    """Which hits have one of the others within REACH words, in their document."""
    sums = np.concatenate([[0], np.cumsum(other)])
    at = np.flatnonzero(hit)
    lo = np.maximum(at - REACH, w.bounds[w.doc[at]])
    hi = np.minimum(at + REACH + 1, w.bounds[w.doc[at] + 1])
    out = np.zeros(len(hit), dtype=bool)
    out[at] = sums[hi] > sums[lo]
    return out


def features(block: Block) -> tuple[np.ndarray, Words]:
    """A row of NAMES for each document (an empty one: zeros), and the words they were taken from."""
    data, n = block.data, block.n_docs
    size = np.diff(block.offsets)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, -1).astype(float)
    w = words(block, ALNUM)
    total = np.maximum(w.counts, 1)
    length = w.end - w.start
    letter = (kind == 0) | (kind == 1) | (kind == 3)
    upper = np.concatenate([[0], np.cumsum(kind == 0)])
    capitals = (upper[w.end] - upper[w.start] == length) & (length > 1)
    digits = np.concatenate([[0], np.cumsum(kind == 2)])
    n_digits = digits[w.end] - digits[w.start]
    masked = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        masked[1:-1] = np.isin(kind[1:-1], (2, 4, 7)) & letter[:-2] & letter[2:]
    same = np.zeros(len(w.hash), dtype=bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    insult, second = held(_INSULTS, w.hash)[0], held(_SECOND, w.hash)[0]
    rate = lambda flag: per_doc(flag, w.bounds) / total
    spaced = words(block, SPACED, hashed=False)
    columns = [
        *(counts / np.maximum(size, 1)[:, None]).T,
        np.log1p(size),
        np.log1p(w.counts),
        rate(length),
        rate(length > 14),
        rate(capitals),
        rate((n_digits > 0) & (n_digits < length)),
        per_doc(masked, block.offsets) / total,
        rate(same),
        np.bincount(d[fresh], minlength=n) / total,
        w.counts / (counts[:, CLASSES.index("line")] + 1),
        size / np.maximum(spaced.counts, 1),
        rate(insult),
        rate(second),
        rate(near(insult, second, w)),
    ]
    return np.stack(columns, axis=1), w
