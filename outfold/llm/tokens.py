"""Tokens of whole texts with a public tokenizer, pre-token by pre-token.

A tokenizer of the form ``SPLITS`` never joins characters across pre-tokens, nor
pre-tokens across a space or line feed, so a text's tokens are those of its
pre-tokens in a row. Pre-tokens repeat; each Python worker keeps the answers for
those it has seen in a bounded table. Any other tokenizer is given whole texts.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Pre-tokens that a Python worker keeps, in two halves: when the newer half is
#: full, the older one is dropped.
CACHE_PIECES = 300_000

# Texts of ASCII and Latin-1 letters only: there lower case is letter by letter,
# composition (NFC) changes nothing, and the tokenizer's own pattern can be
# written for this alphabet. Other words go through the tokenizer's normalizer
# and pre-tokenizer.
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_PLAIN_TEXT = re.compile(f"[\t\n\r -~{_LATIN}]*").fullmatch
_PLAIN = re.compile(f"[!-~{_LATIN}]+").fullmatch
_SMALL = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_SMALL}]+|[0-9]|[^\\s0-9{_SMALL}]+").findall

# The normalizer, pre-tokenizer and model settings that the patterns
# above are written for, as the tokenizer's file states them.
SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}


def splits(t) -> bool:
    """Is the tokenizer one that may be asked pre-token by pre-token?"""
    parts = json.loads(t.to_str())
    model, added = parts["model"], parts["added_tokens"]
    return (all(parts[k] == v for k, v in SPLITS.items()) and model["type"] == "BPE" and not model["dropout"]
            and not any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added))


def byte_alphabet() -> dict[int, int]:
    """Byte -> character of byte-level tokenizers: printable bytes stand for
    themselves, the n-th other byte for character 256 + n."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + n for n, b in enumerate(hidden)}


_BYTES = byte_alphabet()


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def words_of(text: str) -> list[str]:
    return text.replace("\n", " ").split(" ")


def whole_tokens(path: str) -> dict[str, int]:
    """Pre-tokens that are one token, and its id, proved by running the model on
    every string of the vocabulary (a few tens of thousands, once, on the driver)."""
    t = load(path)
    end = getattr(t.model, "end_of_word_suffix", None) or ""
    proved = {}
    for s in t.get_vocab():
        s = s[:-len(end)] if end and s.endswith(end) else s
        if s and s not in proved and len(found := t.model.tokenize(s)) == 1:
            proved[s] = found[0].id
    return proved


class Cache(dict):
    """A bounded table: ``make`` is asked for what is in neither half."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit // 2, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Words:
    """Answers for whole texts: how many tokens (``count``), and their ids as
    little-endian unsigned 32-bit integers (``encode``)."""

    def __init__(self, path: str, proved: dict[str, int]):
        self.t, self.proved = load(path), proved
        self.splits = splits(self.t)
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.ids = Cache(self._ids, CACHE_PIECES)
        self.counts = Cache(self._count, CACHE_PIECES)

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text. As they stand where the text is plain; after
        NUL in the byte alphabet; after SOH a word with a special string inside,
        which only the tokenizer as a whole knows how to treat."""
        special = any(s in text for s in self.special)
        if not special and _PLAIN_TEXT(text):
            return _PIECES(text.lower())
        out = []
        for word in words_of(text):
            if special and any(s in word for s in self.special):
                out.append("\1" + word)
            elif _PLAIN(word):
                out += _PIECES(word.lower())
            elif word:
                out += ["\0" + p for p, _ in self.t.pre_tokenizer.pre_tokenize_str(
                    self.t.normalizer.normalize_str(word))]
        return out

    def _known(self, piece: str) -> tuple[str, int | None]:
        """The piece in the byte alphabet, and its id if it is proved whole."""
        piece = piece[1:] if piece[0] == "\0" else piece if piece.isascii() else \
            piece.encode().decode("latin-1").translate(_BYTES)
        return piece, self.proved.get(piece)

    def _ids(self, piece: str) -> bytes:
        if piece[0] == "\1":
            ids = self.t.encode(piece[1:], add_special_tokens=False).ids
        else:
            piece, one = self._known(piece)
            ids = [x.id for x in self.t.model.tokenize(piece)] if one is None else (one,)
        return array("I", ids).tobytes()

    def _count(self, piece: str) -> int:
        """Pre-tokens proved whole count 1; only the rest is merged."""
        if piece[0] == "\1":
            return len(self.t.encode(piece[1:], add_special_tokens=False).ids)
        piece, one = self._known(piece)
        return len(self.t.model.tokenize(piece)) if one is None else 1

    def count(self, text: str) -> int:
        if not self.splits:
            return len(self.t.encode(text, add_special_tokens=False).ids)
        return sum(map(self.counts.__getitem__, self.pieces(text)))

    def encode(self, text: str) -> bytes:
        if not self.splits:
            return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.ids.__getitem__, self.pieces(text)))


_words: dict[str, Words] = {}


def worker_words(path: str, proved: dict[str, int]) -> Words:
    """The tables of this Python worker; they outlive a task."""
    if path not in _words:
        _words.clear()
        _words[path] = Words(path, proved)
    return _words[path]
