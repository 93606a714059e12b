"""Token ids of whole texts by a public word-level BPE, with each distinct word given to the tokenizer once.

A tokenizer of the kind in `KIND` never lets a token reach over white space, so a text's ids are those of its words, one
after the other; that is checked when a file is loaded, and a text goes to any other kind as a whole. A worker keeps the ids of the words it has seen (in two generations, so that memory stays bounded), and joins bytes.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: How the vocabulary's file describes the only kind whose words are apart from each other.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
)
#: Pre-tokens of a printable Latin word, as the tokenizer's own pattern gives them.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: str.split takes these for white space; the tokenizer does not.
_NO_SPACE = re.compile(r"[\x1c-\x1f]")
_SPACE = re.compile(r"[\x09-\x0d\x20]+")
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level BPE writes for bytes: printable ones stand for themselves, the others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class WordIds:
    """ids(text): the text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = 300_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        told = json.loads(self.tokenizer.to_str())
        self.by_word = (told["normalizer"], told["pre_tokenizer"], told["post_processor"]) == KIND
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.new, self.old, self.pieces = most, {}, {}, {}

    def text(self, text: str) -> bytes:
        if not self.by_word or any(s in text for s in self.special):
            return self._encode(text)
        split = _SPACE.split(text) if _NO_SPACE.search(text) else text.split()
        new, out = self.new, []
        for word in split:
            ids = new.get(word)
            if ids is None:
                ids = self._word(word)
            out.append(ids)
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = b"".join(map(self._piece, _PIECES.findall(word.lower()))) if _PLAIN.fullmatch(word) else self._encode(word)
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[word] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
            ids = np.array([t.id for t in self.model.tokenize(letters)], dtype="<u4").tobytes()
            if len(self.pieces) >= self.most:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


_KEPT: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The process's tokenizer for a vocabulary file."""
    if path not in _KEPT:
        _KEPT[path] = WordIds(path)
    return _KEPT[path]
