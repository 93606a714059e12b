"""Vectorised word and shingle work on Arrow string buffers.

Every function takes whole texts: a batch is cut into blocks at document borders only, so a
document is never split, however long it is. Hashes are 64 bit and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a word in the sense of [^\x20\x09-\x0D]+
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word in the sense of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = np.zeros(256, dtype=bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n; kept, and grown when a longer block comes."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_P, _P_INV)):
            table = np.full(n, base, dtype=np.uint64)
            table[0] = 1
            _POWERS[k] = np.multiply.accumulate(table)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Block:
    """Some documents of a batch: rows [first, last), their bytes, and each document's place in them."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def n_docs(self) -> int:
        return self.last - self.first


@dataclass
class Words:
    """Words of a block in order: document (from 0 in the block), byte range, hash; bounds[d]:bounds[d + 1] are those of d."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    counts: np.ndarray


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as large strings without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column's texts in blocks of about `most` bytes, or one document where that is longer."""
    array = text_array(column)
    n = len(array)
    if not n:
        return
    bufs = array.buffers()
    offsets = np.frombuffer(bufs[1], dtype=np.int64, count=n + 1 + array.offset)[array.offset :]
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def words(block: Block, kind: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """The block's words: maximal runs of bytes of the kind, inside one document."""
    data = _LOWER[block.data] if lower else block.data
    inside = kind[data]
    n = len(data)
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[block.offsets] = True
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1] | fresh[1:n]
        ends[:-1] &= ~inside[1:] | fresh[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(start, block.offsets)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(block.n_docs), counts)
    value = np.zeros(0, dtype=np.uint64)
    if hashed and len(start):
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        value = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    return Words(doc, start, end, value, bounds, counts)


def hash_words(texts: list[str]) -> np.ndarray:
    """The hashes that `words` gives to these words, each taken as one word as it stands."""
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, text in enumerate(texts):
        b = np.frombuffer(text.encode(), dtype=np.uint8)
        up, _ = _powers(len(b) + 1)
        total = np.add.reduce(_BYTE[b] * up[: len(b)], dtype=np.uint64) if len(b) else np.uint64(0)
        out[i] = mix(np.array([total + np.uint64(len(b))], dtype=np.uint64))[0]
    return out


def grams(value: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` word hashes, by its first; runs over a document's border are among them."""
    n = len(value) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out += value[j : j + n] * _STEP[j % 64]
    return mix(out)


def inside(w: Words, size: int) -> np.ndarray:
    """For each run of `size` words whether it lies in one document."""
    n = len(w.doc) - size + 1
    return w.doc[:n] == w.doc[size - 1 :] if n > 0 else np.zeros(0, dtype=bool)


def shingle_sets(block: Block, size: int = 5) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes: runs of `size` words, or all words where there are fewer."""
    w = words(block, SPACED)
    g = grams(w.hash, size)
    empty = np.zeros(0, dtype=np.uint64)
    out = []
    for d in range(block.n_docs):
        a, b = w.bounds[d], w.bounds[d + 1]
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            out.append(grams(w.hash[a:b], int(b - a)))
        else:
            out.append(empty)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, as Spark's long holds it."""
    return np.ascontiguousarray(x).view(np.int64)
