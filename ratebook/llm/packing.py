"""Operator 5: hierarchical multi-length packing.

Documents become token ids plus an end id. Whole windows of the longest
context are cut off first. What is left of a document is routed to the tier
of the smallest context that holds it; tiers are packed from the longest
down: a window is opened by the longest waiting piece, its gap is filled by
the longest shorter pieces that fit, and the last gap by cutting the shortest
one. So every window is exactly full, at one of the context sizes.

Each task packs its own rows as they stream by (at most ``WAITING`` tokens
wait at a time). What does not fill a window, less than one window a task,
goes with its ids to a second packing over ``TASKS_TOGETHER`` tasks; only its
last sequence may be short. No text or id is shuffled but for those tails.

Sequences are numbered within their tier and dealt into step groups of
``STEP_TOKENS`` tokens, each of one context size, so that steps cost alike.

A null or empty text is its end id alone. Repeated rows are packed each for
themselves. Output rows are pieces: an empty table gives none. Kept columns
named like one of the result's own give way to it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ratebook.llm.bpe import Ids
from ratebook.llm.common import col, long, ship, staged, text_runs

TIERS = (512, 1024, 2048, 4096)
WAITING = 512 * 4096
TASKS_TOGETHER = 64
STEP_TOKENS = 8 * 4096


class Packer:
    """Waiting pieces by length, and the windows they fill. ``emit(tier, pieces)`` gets each full window."""

    def __init__(self, emit, tiers=TIERS):
        self.emit, self.tiers = emit, tiers
        self.order: list[tuple[int, int]] = []
        self.pieces: dict[int, tuple] = {}
        self.total = self.n = 0

    def add(self, doc, start: int, ids: bytes, doc_tokens: int) -> None:
        """``ids``: 4 bytes each. Whole longest windows leave at once."""
        longest = self.tiers[-1] * 4
        while len(ids) >= longest:
            self.emit(self.tiers[-1], [(doc, start, ids[:longest], doc_tokens)])
            start, ids = start + self.tiers[-1], ids[longest:]
        self._wait(doc, start, ids, doc_tokens)
        if self.total >= WAITING:
            self.pack()

    def _wait(self, doc, start, ids, doc_tokens):
        if ids:
            self.n += 1
            insort(self.order, (len(ids) // 4, self.n))
            self.pieces[self.n] = (doc, start, ids, doc_tokens)
            self.total += len(ids) // 4

    def _take(self, at: int) -> tuple:
        length, n = self.order.pop(at)
        self.total -= length
        return self.pieces.pop(n)

    def pack(self) -> None:
        """Fill windows until what waits is less than the window its longest piece asks for."""
        while self.order:
            tier = next(c for c in self.tiers if c >= self.order[-1][0])
            if self.total < tier:
                return
            window = [self._take(-1)]
            gap = tier - len(window[0][2]) // 4
            while gap:
                fits = bisect_right(self.order, (gap, float("inf"))) - 1
                if fits >= 0:
                    window.append(self._take(fits))
                else:
                    doc, start, ids, doc_tokens = self._take(0)
                    window.append((doc, start, ids[:4 * gap], doc_tokens))
                    self._wait(doc, start + gap, ids[4 * gap:], doc_tokens)
                gap -= len(window[-1][2]) // 4
            self.emit(tier, window)

    def rest(self) -> list[tuple]:
        """What is left, longest first."""
        return [self._take(-1) for _ in range(len(self.order))]


class _Rows:
    """Piece rows of the windows, and tail rows (no window yet, with their ids)."""

    def __init__(self, schema: pa.Schema, part: int, with_ids: bool):
        self.schema, self.part, self.with_ids, self.rows, self.local = schema, part, with_ids, [], 0

    def window(self, tier: int, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, doc_tokens in pieces:
            n = len(ids) // 4
            self.rows.append((*doc, start, n, zlib.crc32(ids), doc_tokens, offset, tier, self.part, self.local,
                              ids if self.with_ids else None))
            offset += n
        self.local += 1

    def tail(self, pieces: list[tuple]) -> None:
        self.rows += [(*doc, start, len(ids) // 4, None, doc_tokens, None, None, self.part, None, ids)
                      for doc, start, ids, doc_tokens in pieces]

    def flush(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.rows) > least:
            rows, self.rows = self.rows, []
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*rows), self.schema)],
                                             schema=self.schema)


def pack_documents(df: DataFrame, path: str, end_id: int = 2, text_col: str = "text", keep: list[str] | None = None,
                   with_ids: bool = True) -> DataFrame:
    """One row per piece: ``keep`` columns (default: doc_id) with start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier, step_group, and ids (little-endian uint32) with ``with_ids``."""
    new = {"start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"} | ({"ids"} if with_ids else set())
    names = {c: f"__k{i}" for i, c in enumerate(c for c in (["doc_id"] if keep is None else keep) if c.lower() not in new)}
    keep = list(names.values())
    src = df.select(*[col(c).alias(k) for c, k in names.items()], col(text_col).alias("__text"))
    schema = T.StructType([src.schema[c] for c in keep] + [
        long("start"), long("length"), long("ids_crc32"), long("doc_tokens"), long("offset"), long("tier"),
        long("part"), long("local"), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)
    width = len(keep)
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        rows = _Rows(arrow, TaskContext.get().partitionId(), with_ids)
        packer, ids = Packer(rows.window), _ids(path)
        for batch in batches:
            for part in text_runs(batch, width, 4_000_000):
                kept = list(zip(*[part.column(i).to_pylist() for i in range(width)]))
                for doc, text in zip(kept, part.column(width).to_pylist()):
                    tokens = ids.encode(text) + end
                    packer.add(doc, 0, tokens, len(tokens) // 4)
                yield from rows.flush(20_000)
        packer.pack()
        rows.tail(packer.rest())
        yield from rows.flush()

    def pack_tails(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(arrow, -1 - key[0].as_py(), with_ids)
        packer = Packer(rows.window)
        tails = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["part"], -r["length"], r["start"]))
        for r in tails:
            packer.add(tuple(r[c] for c in keep), r["start"], r["ids"], r["doc_tokens"])
        packer.pack()
        last = packer.rest()
        if last:
            length = sum(len(p[2]) for p in last) // 4
            rows.window(next(c for c in TIERS if c >= length) if length in TIERS else TIERS[-1], last)
        yield from rows.flush()

    ship(df.sparkSession)
    first = staged(src.mapInArrow(pack, schema), "packed")
    tails = first.where("tier is null").withColumn("group", F.floor(F.col("part") / TASKS_TOGETHER).cast("long"))
    second = staged(_apply_arrow(tails, pack_tails, schema), "tails")
    return _numbered(first.where("tier is not null").unionByName(second), names, with_ids)


def _apply_arrow(tails: DataFrame, fn, schema) -> DataFrame:
    def run(key, table):
        batches = list(fn(key, iter(table.to_batches())))
        return pa.Table.from_batches(batches, schema=to_arrow_schema(schema))
    return tails.groupBy("group").applyInArrow(run, schema)


def _ids(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


_IDS: dict[str, Ids] = {}


def _numbered(pieces: DataFrame, keep: dict[str, str], with_ids: bool) -> DataFrame:
    """Global sequence numbers, tier by tier; step groups of equal token counts within a tier."""
    counts = pieces.groupBy("tier", "part").agg(F.max("local").alias("most"),
                                                F.countDistinct("local").alias("n"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tier", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    firsts = pieces.where("offset = 0").select("tier", "part", "local")
    inside = Window.partitionBy("tier", "part").orderBy("local")
    ranks = firsts.withColumn("rank", F.row_number().over(inside) - 1)
    named = (ranks.join(offsets, ["tier", "part"])
             .select("part", "local", (F.col("before") + F.col("rank")).alias("in_tier")))
    out = pieces.join(named, ["part", "local"])
    sequence = F.col("in_tier") * len(TIERS) + F.log2("tier").cast("long") - F.lit(TIERS[0].bit_length() - 1)
    shown = out.select(*[F.col(k).alias(c) for c, k in keep.items()], "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"),
                       "offset", "tier", F.floor(F.col("in_tier") * F.col("tier") / STEP_TOKENS).alias("step_group"),
                       *(["ids"] if with_ids else []))
    return shown
