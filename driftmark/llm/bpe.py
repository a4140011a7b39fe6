"""Byte-level BPE with a whole-token shortcut, equal to the `tokenizers` library.

Offline proof, once for each vocabulary and process: a vocabulary string is *whole* if
merging its bytes, pair by pair and with no look-up of the string itself, ends in that one
token; strings that no merge reaches, or that other merges cut differently, are not. A pre-token equal to a whole
string is that token without any merge; all other pre-tokens, of any length, are merged by the library's model.

Text made of letters below U+0250 and ordinary white space is split by a compiled class
table; any other text is split by the library's own pre-tokenizer, so that both agree with
the library on every Unicode version. Strings of added tokens inside a text become their id,
as is the library's default.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Merged pieces of a generation that a process remembers.
MEMO = 300_000
#: Code points that the class table covers.
COVERED = 0x250


def _class(kind: str) -> str:
    """Regex class of the covered code points whose general category starts with `kind`, as ranges."""
    codes = [c for c in range(COVERED) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c in codes if c - 1 not in codes]
    ends = [c for c in codes if c + 1 not in codes]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends, strict=True))


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class _Memo(dict):
    """Packed ids of pieces: those of whole strings always, of others the ones met of late, in two generations."""

    def __init__(self, whole: dict[str, bytes], make):
        super().__init__(whole)
        self.whole, self.make, self.old = whole, make, {}

    def __missing__(self, piece):
        value = self.old.get(piece) or self.make(piece)
        if len(piece) <= 64:
            if len(self) >= MEMO + len(self.whole):
                self.old = dict(self)
                self.clear()
                self.update(self.whole)
            self[piece] = value
        return value


class ByteBPE:
    """Ids and counts of texts under a byte-level BPE file of the `tokenizers` library."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            raise ValueError("a plain BPE file is needed")
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without prefix space or normalizer is needed")
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.added = added
        self.letters = byte_letters()
        self._letter = {b: s for s, b in self.letters.items()}
        self.whole = self._proved({s: i for s, i in model["vocab"].items() if s not in added})
        letter, number = _class("L"), _class("N")
        self._split = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^\s{letter}{number}]+|\s+(?!\S)|\s+"
        ).findall
        self._outside = re.compile(rf"[^\t-\r -~ -\u{COVERED - 1:04x}]").search
        self._special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self._ids = _Memo({text: struct.pack("<I", i) for text, i in self.whole.items()}, self._packed)

    def _proved(self, vocab: dict[str, int]) -> dict[str, int]:
        """The strings of a vocabulary, as text, whose bytes merge into their one token."""
        found = {}
        for letters, i in vocab.items():
            try:
                text = bytes(self.letters[x] for x in letters).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue  # no text by itself
            if self.merge(text) == [i]:
                found[text] = i
        return found

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-token by merging its bytes."""
        return [t.id for t in self.library.model.tokenize(piece.encode("utf-8").decode("latin-1").translate(self._letter))]

    def _packed(self, piece: str) -> bytes:
        ids = self.merge(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text without added tokens."""
        if not self._outside(text):
            return self._split(text)
        letters = self.letters
        return [bytes(letters[x] for x in p).decode("utf-8") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _parts(self, text: str) -> list[str]:
        return self._special.split(text) if self._special else [text]

    def count(self, text: str | None) -> int:
        """Number of ids of a text; null counts as empty."""
        total = 0
        for part in self._parts(text or ""):
            if part in self.added:
                total += 1
            elif part:
                total += sum(map(len, map(self._ids.__getitem__, self.pretokens(part)))) // 4
        return total

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text as unsigned 32-bit integers."""
        out = []
        for part in self._parts(text or ""):
            if part in self.added:
                out.append(struct.pack("<I", self.added[part]))
            elif part:
                out.extend(map(self._ids.__getitem__, self.pretokens(part)))
        return np.frombuffer(b"".join(out), "<u4")


@lru_cache(4)
def byte_bpe(path: str) -> ByteBPE:
    """One table for each file and process."""
    return ByteBPE(path)
