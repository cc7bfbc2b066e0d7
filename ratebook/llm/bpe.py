"""Exact BPE lengths and ids by pieces, with worker caches.

A text is cut before every single space that is followed by a plain
character. Both tokenizers' patterns always start a new pre-token there and
no special string holds a space, so the ids of a text are the ids of its
pieces in order. The pieces of real text repeat heavily: most are found in a
table, the others are encoded once per worker and remembered. Of any other
tokenizer file (``cuts_at_spaces``) texts are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
import struct

# The rules of the two tokenizer files for which the cuts below are exact.
BYTE_RULES = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
}
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
# A space before white space (any kind, in the widest reading) or at the end: cut less there.
_ODD_SPACE = re.compile(r" (?=\s|$)")
_PIECE_START = re.compile(r"(?= \S)")
# Pieces of these characters alone (ASCII without ' and <, and the letters of Latin-1) hold no special
# string and no contraction, and neither NFC nor lower-casing by character treats them in a special way.
# For them the tokenizers' patterns read as below.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_NOT_SIMPLE = re.compile(rf"[^\n\r\t -&(-;=-~{_LETTERS}]")
_BYTE_PARTS = re.compile(rf" ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9]+|\s+(?!\S)|\s+")
_WORD_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+")
CACHE_ENTRIES = 250_000
CACHED_CHARS = 64


class Cache(dict):
    """A dict of bounded size in two generations: a full one becomes the old one, and hits there are kept."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= CACHED_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value

    def make(self, key: str):
        raise NotImplementedError


def _byte_chars() -> dict[int, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


def byte_level(text: str) -> str:
    if text.isascii() and text.removeprefix(" ").isalpha():
        return text.replace(" ", "\u0120")
    return text.encode().decode("latin-1").translate(BYTE_CHARS)


def cut(text: str) -> tuple[str, list[str]]:
    """The first piece and the later ones; a later piece stands for a space and itself."""
    if _ODD_SPACE.search(text):
        parts = _PIECE_START.split(text)
        return parts[0], [p[1:] for p in parts[1:]]
    parts = text.split(" ")
    return parts[0], parts[1:]


_LOADED: dict = {}


def load(path: str):
    """The tokenizer of a file, read once per worker."""
    if path not in _LOADED:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = _LOADED[path] = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
    return _LOADED[path]


@functools.cache
def cuts_at_spaces(path: str, word_end: bool) -> bool:
    """Whether the file has the rules for which cuts before spaces, and pre-tokens found by pattern, give its ids."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    want, model = WORD_RULES if word_end else BYTE_RULES, rules["model"]
    plain = (model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix")
             and bool(model.get("end_of_word_suffix")) == word_end)
    # special strings start outside the plain characters and take no space with them
    special = all(t["content"][:1] == "<" and " " not in t["content"] and not (t["single_word"] or t["lstrip"] or t["rstrip"])
                  for t in rules.get("added_tokens") or [])
    return plain and special and all(rules.get(name) == value for name, value in want.items())


class _PartIds(Cache):
    """Pre-token -> its ids, little-endian uint32."""

    def __init__(self, tok):
        super().__init__()
        self.model = tok.model

    def make(self, part: str) -> bytes:
        return pack_ids([t.id for t in self.model.tokenize(byte_level(part))])


class _PartLengths(_PartIds):
    """Pre-token -> the number of its ids; ``frequent`` has those of frequent pieces, without the space before them."""

    def __init__(self, tok, frequent: dict[str, int]):
        super().__init__(tok)
        self.frequent = frequent

    def make(self, part: str) -> int:
        known = self.frequent.get(part[1:]) if part[0] == " " else None
        return len(self.model.tokenize(byte_level(part))) if known is None else known


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Lengths(Cache):
    """Number of byte-level BPE tokens of whole texts.

    Stretches of plain characters are cut into pre-tokens at once. A pre-token is
    looked up in ``frequent`` (piece behind one space -> tokens), the first tier;
    a miss is encoded and remembered in ``parts``, the second. A piece with any
    other character is encoded as it stands, with the space before it: these
    pieces are the keys of this cache.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__()
        self.tok = load(path)
        self.parts = _PartLengths(self.tok, frequent)
        self.cuts = cuts_at_spaces(path, word_end=False)

    def make(self, piece: str) -> int:
        known = self.parts.frequent.get(piece[1:]) if piece[0] == " " else None
        return self.exact(piece) if known is None else known

    def exact(self, text: str) -> int:
        return len(self.tok.encode(text, add_special_tokens=False).ids)

    def plain(self, stretch: str) -> int:
        return sum(map(self.parts.__getitem__, _BYTE_PARTS.findall(stretch)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.cuts:
            return self.exact(text)
        n, at = 0, 0
        while odd := _NOT_SIMPLE.search(text, at):
            start, end = piece_around(text, at, odd)
            n += self.plain(text[at:start]) + self[text[start:end]]
            at = end
        return n + self.plain(text[at:])


class Ids(Cache):
    """Ids as little-endian uint32 bytes, for the word-end BPE (lower case, white space dropped).

    Stretches of plain characters are cut into pre-tokens at once and looked up
    one by one. A piece with any other character is encoded as a whole: these
    pieces are the keys of this cache.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tok = load(path)
        self.parts = _PartIds(self.tok)
        self.cuts = cuts_at_spaces(path, word_end=True)

    def make(self, piece: str) -> bytes:
        return pack_ids(self.tok.encode(" " + piece, add_special_tokens=False).ids)

    def plain(self, stretch: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, _WORD_PARTS.findall(stretch.lower())))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts:
            return pack_ids(self.tok.encode(text, add_special_tokens=False).ids)
        out, at = [], 0
        while odd := _NOT_SIMPLE.search(text, at):
            start, end = piece_around(text, at, odd)
            out += self.plain(text[at:start]), self[text[start + (text[start] == " "):end]]
            at = end
        out.append(self.plain(text[at:]))
        return b"".join(out)


def piece_around(text: str, at: int, found: re.Match) -> tuple[int, int]:
    """Start and end of the piece that holds the match; no start before ``at``, where a piece starts."""
    start = text.rfind(" ", at, found.start())
    while start >= 0 and text[start + 1].isspace():
        start = text.rfind(" ", at, start)
    after = _PIECE_START.search(text, found.end())
    return max(start, at), after.start() if after else len(text)
