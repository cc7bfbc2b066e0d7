"""Operator 13: byte-level BPE encoding and decoding by padded matrices.

Texts are cut into pieces (``bpe.cut``), the distinct pieces of a run are split
by the vocabulary's pattern, and the distinct pre-tokens that are no token
themselves are put in length buckets, one padded matrix of token ids each.
Each round, every row merges its leftmost pair of minimum rank: ranks come from
an open-addressing hash table over pairs of ids, held in numpy arrays, and the
merged column is taken out of every row, so the matrix narrows by one column a
round; rows with no pair left are written out and dropped. Pre-tokens beyond
``WIDEST`` bytes are rows of their own, where all pairs of the minimum rank are
merged in one round if no pair with that token ranks below it (else one).
Pieces already met are remembered per worker, in a cache of bounded size.

All work is in the tasks that read the texts; nothing is shuffled. Encoding is
exact: the ids are those of the library for the same file and pattern, and
decoding gives back the text's UTF-8 bytes. Special tokens are ordinary text.

Null and empty texts have no ids (an empty array), null ids decode to no bytes,
an id outside the vocabulary is an error. Repeated rows each give a row, an
empty table an empty result; a kept column named like a new one gives way.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ratebook.llm.bpe import CACHE_ENTRIES, CACHED_CHARS, cut
from ratebook.llm.common import col, map_texts, quoted, ship

NONE = np.int32(2**31 - 1)
WIDEST = 512
CELLS = 1 << 18
RUN_CHARS = 1_000_000
_FREE = np.uint64(2**64 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


class Pairs:
    """(left id, right id) -> id of their concatenation, by hashed lookups on whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(len(left) * 3 + 1))))
        self.keys = np.full(1 << self.bits, _FREE, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        keys = self.key(left, right)
        slots = self.slot(keys)
        waiting = np.arange(len(keys))
        while len(waiting):
            free = waiting[self.keys[slots[waiting]] == _FREE]
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]] = keys[placed]
            self.values[slots[placed]] = merged[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slots[waiting] = (slots[waiting] + 1) & (len(self.keys) - 1)

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint32).astype(np.uint64) << np.uint64(32)) | right.astype(np.uint32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, ``NONE`` where they make no token (or one side is padding)."""
        shape = left.shape
        keys = self.key(left, right).ravel()
        out = np.full(len(keys), NONE, dtype=np.int32)
        rows = np.arange(len(keys))
        slots = self.slot(keys)
        while len(rows):
            held = self.keys[slots]
            hit = held == keys[rows]
            out[rows[hit]] = self.values[slots[hit]]
            on = ~hit & (held != _FREE)
            rows, slots = rows[on], (slots[on] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Vocabulary:
    """A rank file with its pattern: encoding of many texts, decoding of many id arrays."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.pattern = regex.compile(pattern)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for at in range(1, len(token)):
                a, b = self.ranks.get(token[:at]), self.ranks.get(token[at:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        left, right, merged = (np.array(x, dtype=np.int32) for x in (left, right, merged))
        self.pairs = Pairs(left, right, merged)
        size = max(self.ranks.values()) + 1
        lowest = np.full(size, NONE, dtype=np.int32)
        np.minimum.at(lowest, left, merged)
        np.minimum.at(lowest, right, merged)
        self.all_at_once = lowest > np.arange(size)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.known = np.zeros(size, dtype=bool)
        self.known[list(self.ranks.values())] = True
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.met: dict[str, bytes] = {}
        self.met_before: dict[str, bytes] = {}

    # --- encoding

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids, as little-endian unsigned 32-bit numbers."""
        cuts = [cut(t) if t else ("", []) for t in texts]
        firsts = sorted({first for first, _ in cuts})
        found = self._known_pieces({p for _, rest in cuts for p in rest})
        missing = [p for p, ids in found.items() if ids is None]
        made = self._encode_pieces(firsts + [" " + p for p in missing])
        leading = dict(zip(firsts, made))
        for piece, ids in zip(missing, made[len(firsts):], strict=True):
            found[piece] = ids
            if len(piece) <= CACHED_CHARS:
                self._remember(piece, ids)
        return [leading[first] + b"".join(map(found.__getitem__, rest)) for first, rest in cuts]

    def _known_pieces(self, pieces: set[str]) -> dict[str, bytes | None]:
        found = {}
        for p in pieces:
            ids = self.met.get(p)
            if ids is None and (ids := self.met_before.get(p)) is not None:
                self._remember(p, ids)
            found[p] = ids
        return found

    def _remember(self, piece: str, ids: bytes) -> None:
        if len(self.met) >= CACHE_ENTRIES:
            self.met, self.met_before = {}, self.met
        self.met[piece] = ids

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        parts = [self.split(p) for p in pieces]
        number: dict[str, int] = {}
        for p in parts:
            for part in p:
                number.setdefault(part, len(number))
        ids = self._encode_parts([part.encode() for part in number])
        return [b"".join([ids[number[part]] for part in p]) for p in parts]

    def split(self, piece: str) -> list[str]:
        """Pre-tokens by the pattern, with the library's classes of characters."""
        if piece.isascii():
            return self.pattern.findall(piece)
        stand_ins = class_changes()
        as_read = piece.translate(stand_ins) if stand_ins else piece
        if as_read == piece:
            return self.pattern.findall(piece)
        return [piece[m.start():m.end()] for m in self.pattern.finditer(as_read)]

    def _encode_parts(self, raws: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(raws)
        buckets: dict[int, list[int]] = {}
        for i, raw in enumerate(raws):
            whole = self.ranks.get(raw)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            else:
                buckets.setdefault(max(4, 1 << (len(raw) - 1).bit_length()), []).append(i)
        for width, rows in buckets.items():
            if width > WIDEST:
                for i in rows:
                    out[i] = self._merge_one(raws[i])
                continue
            step = max(1, CELLS // width)
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                for i, ids in zip(some, self._merge_rows([raws[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, raws: list[bytes]) -> list[bytes]:
        """One round per merge: every row merges its leftmost pair of least rank, then all close up by a column."""
        lengths = np.array([len(r) for r in raws])
        width = int(lengths.max())
        rows = np.full((len(raws), width), -1, dtype=np.int32)
        rows[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(raws), dtype=np.uint8)]
        ranks = self.pairs.find(rows[:, :-1], rows[:, 1:])
        out: list[bytes] = [b""] * len(raws)
        live = np.arange(len(raws))
        while True:
            n, width = rows.shape
            at = ranks.argmin(axis=1) if width > 1 else np.zeros(n, dtype=np.int64)
            best = ranks[np.arange(n), at] if width > 1 else np.full(n, NONE)
            on = best != NONE
            if not on.all():
                ended = rows[~on]
                sizes, raw = (ended >= 0).sum(axis=1), ended.astype("<u4").tobytes()
                for k, (i, size) in enumerate(zip(live[~on], sizes, strict=True)):
                    out[i] = raw[4 * k * width:4 * (k * width + size)]
                rows, ranks, live, at, best = rows[on], ranks[on], live[on], at[on], best[on]
                if not len(live):
                    return out
                n = len(live)
            i = np.arange(n)
            rows[i, at] = best
            kept = np.ones((n, width), dtype=bool)
            kept[i, at + 1] = False
            rows = rows[kept].reshape(n, width - 1)
            kept = np.ones((n, width - 1), dtype=bool)
            kept[i, at] = False
            ranks = ranks[kept].reshape(n, width - 2)
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            a = at[before]
            ranks[before, a - 1] = self.pairs.find(rows[before, a - 1], rows[before, a])
            a = at[after]
            ranks[after, a] = self.pairs.find(rows[after, a], rows[after, a + 1])

    def _merge_one(self, raw: bytes) -> bytes:
        """A long pre-token: rounds over one row, each merging every pair of the least rank where that is the same."""
        ids = self.byte_ids[np.frombuffer(raw, dtype=np.uint8)]
        ranks = self.pairs.find(ids[:-1], ids[1:])
        while len(ranks) and (best := ranks.min()) != NONE:
            if self.all_at_once[best]:
                at = np.flatnonzero(ranks == best)
                run = np.cumsum(np.diff(at, prepend=-2) > 1)
                first = at[np.searchsorted(run, run)]
                at = at[(at - first) % 2 == 0]  # of overlapping pairs, every second one from the left
            else:
                at = np.array([ranks.argmin()])
            ids[at] = best
            ids = np.delete(ids, at + 1)
            ranks = np.delete(ranks, at)
            at = at - np.arange(len(at))
            before, after = at[at > 0] - 1, at[at < len(ids) - 1]
            near = np.concatenate([before, after])
            ranks[near] = self.pairs.find(ids[near], ids[near + 1])
        return ids.astype("<u4").tobytes()

    # --- decoding

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all arrays behind each other and where each ends; ``ids`` holds them concatenated."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("an id outside the vocabulary")
        sizes = self.lengths[ids]
        at = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.starts[ids] - at[:-1], sizes) + np.arange(at[-1])
        return self.bytes[source], at[ends]


@functools.cache
def class_changes() -> dict[int, str]:
    """Characters the library's Unicode tables class otherwise than this module's, with a stand-in of their class there.

    The library's own matcher is asked: an encoding by single bytes gives back
    the characters that its pattern matches.
    """
    import tiktoken
    changes: dict[int, str] = {}
    for cls, stand_in in ((r"\s", "\n"), (r"\p{N}", "0"), (r"\p{L}", "a")):
        enc = tiktoken.Encoding("classes", pat_str=cls, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for at in range(0x80, 0x110000, 0x2000):
            some = "".join(chr(c) for c in range(at, at + 0x2000) if c < 0x110000 and not 0xD800 <= c < 0xE000)
            theirs, ours = set(bytes(enc.encode_ordinary(some)).decode()), set(regex.findall(cls, some))
            changes |= {ord(c): "!" for c in ours - theirs if ord(c) not in changes}
            changes |= {ord(c): stand_in for c in theirs - ours}
    return changes


@functools.cache
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """Built once per worker."""
    return Vocabulary(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) and ``ids``, the text's token ids in order."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def make():
        vocab = vocabulary(path, pattern)

        def score(texts):
            ids, ends = _lists(vocab.encode(texts))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))]
        return score

    return map_texts(df, text_col, keep, [IDS], make, RUN_CHARS)


def _lists(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts behind each other, and where each text's begin and end."""
    return np.frombuffer(b"".join(raws), dtype="<u4").astype(np.int32), np.cumsum([0, *[len(r) // 4 for r in raws]])


def _binaries(vocab: Vocabulary, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    raw, at = vocab.decode(ids, ends)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)])


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text), ``ids`` and ``decoded``: both directions in one pass over the texts."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep

    def make():
        vocab = vocabulary(path, pattern)

        def score(texts):
            ids, ends = _lists(vocab.encode(texts))
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), _binaries(vocab, ids, ends)]
        return score

    return map_texts(df, text_col, keep, [IDS, T.StructField("decoded", T.BinaryType())], make, RUN_CHARS)


def decode_ids(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) and ``decoded``, the bytes of the row's ids."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "decoded"]
    src = df.select(*[col(c) for c in keep], col(ids_col).cast("array<int>").alias("__ids"))
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            lists = batch.column(len(keep))
            ends = np.cumsum([0, *lists.value_lengths().fill_null(0).to_pylist()])
            step = start = 0
            while start < batch.num_rows:  # about RUN_CHARS ids at once, one row at least
                step = max(start + 1, int(np.searchsorted(ends, ends[start] + RUN_CHARS, side="right")) - 1)
                flat = lists.slice(start, step - start).flatten().to_numpy(zero_copy_only=False)
                made = _binaries(vocab, flat.astype(np.int64), ends[start:step + 1] - ends[start])
                yield pa.RecordBatch.from_arrays(
                    [c.slice(start, step - start).cast(f.type) for c, f in zip(batch.columns[:len(keep)], arrow)] + [made], schema=arrow)
                start = step

    ship(df.sparkSession)
    return src.mapInArrow(run, schema)


def ids_text(ids_col: str = "ids") -> str:
    """SQL expression: the decimal ids joined by one space."""
    return f"array_join(cast({quoted(ids_col)} as array<string>), ' ')"
