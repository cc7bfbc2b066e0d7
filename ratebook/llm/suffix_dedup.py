"""Operator 6: repeated byte strings, by distributed prefix doubling over position ranks.

A byte is removed if a string of ``least`` bytes that covers it also starts in
a document with a smaller id. Strings are compared through names (ranks) of
growing lengths: the name of a longer string is made of the pair of names at
a place and an offset further on, and places whose name is unique drop out
before the next length.

1. Names of ``gram`` bytes (half of ``least``, by doubling within the tasks).
   Of each window of ``least`` bytes only its anchor, the first gram with the
   smallest name, is sent; equal windows have equal anchors. The names are
   sorted across documents; those of one document only drop out, and all
   windows on such an anchor with them.
2. The windows on one surviving anchor are a unit, and their bytes a strip of
   fewer than two windows' length. Strips are named and sorted: an anchor name
   with one strip answers all its windows at once with its smallest document.
   A block sends two strips of an anchor name at most, and how many it has.
3. Where an anchor name has several strips, their windows are ranked by pairs
   of half-window names at the full length. At the edges of a passage that many
   rows share, each row has a strip of its own: where the blocks have more than
   ``HOT_STRIPS`` strips of an anchor name, they send the names of its windows
   instead, so that only equal windows meet and the anchor name's windows
   spread over all tasks.
4. Each document compares its id with the answers, and the covered bytes go.

Documents lie in blocks of about ``BLOCK_BYTES`` of text, in a scratch table
bucketed by block, so answers meet their texts without a shuffle of texts. A
block's names and strips are distinct with the smallest document before they
are shuffled, so a passage that a third of all rows share is one entry a
block for each name within it. What is shuffled is packed arrays. Names that decide have 96 bits for
strips (of one anchor name) and 128 bits for windows.

Null texts are empty. Rows with a null id neither lose bytes nor make others
lose any. Repeated rows are judged alike, and rows of one id do not remove
each other's bytes. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.llm.common import bucketed, col, ship, staged, text_runs
from ratebook.llm.repeats import Run, least_documents, same_as_before, shared_keys, strip_names, window_names

BLOCK_BYTES = 6_000_000
RUN_BYTES = 1_000_000
BUCKET_BYTES = 16_000_000
#: Strips of one anchor name that are compared in one task; they take about 100 bytes each, and 26 names.
HOT_STRIPS = 50_000
#: A window's name is longer than what it adds to the text: names of windows have so many times the buckets.
WINDOW_BUCKETS = 4
WINDOWS_AT_ONCE = 500_000
NO_DOCUMENT = np.iinfo(np.int64).max


def text_blocks(df: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(block, row, id, raw): the texts as bytes, in blocks of rows that were read together."""
    src = df.select(col(id_col).cast("long").alias("id"), F.coalesce(col(text_col), F.lit("")).alias("raw"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in text_runs(batch, 1, BLOCK_BYTES):
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int32()), part.column(0),
                     part.column(1).cast(pa.binary())], names=["block", "row", "id", "raw"])
                block += 1

    ship(df.sparkSession)
    return bucketed(src.mapInArrow(number, "block long, row int, id long, raw binary"), "block", "blocks")


def _runs(raws: list[bytes], least: int, gram: int) -> Iterator[tuple[int, Run]]:
    """(first document's place in the list, Run) over about RUN_BYTES each."""
    start, size = 0, 0
    for i, raw in enumerate(raws):
        if size and size + len(raw) > RUN_BYTES:
            yield start, Run(raws[start:i], least, gram)
            start, size = i, 0
        size += len(raw)
    if raws:
        yield start, Run(raws[start:], least, gram)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _slices(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Of sorted buckets, each that occurs and its rows."""
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)):
        yield int(b), slice(int(ends[b]), int(ends[b + 1]))


def anchor_rows(least: int, gram: int, buckets: int):
    """Step 1, map side: a batch's distinct anchor names, by bucket, marked if two documents hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            cuts = np.append(np.flatnonzero(np.diff(blocks, prepend=-1)), len(blocks))
            for a, b in zip(cuts, cuts[1:]):
                found = [(k, d + at) for at, r in _runs(batch.column(1).slice(a, b - a).to_pylist(), least, gram)
                         for k, d in [r.anchors()]]
                key = np.concatenate([k for k, _ in found])
                doc = np.concatenate([d for _, d in found])
                order = np.argsort(key, kind="stable")
                key, doc = key[order], doc[order]
                first = np.flatnonzero(~same_as_before(key))
                if not len(first):
                    continue
                last = np.append(first[1:], len(key)) - 1
                several = doc[first] != doc[last]  # documents ascend within equal keys
                key = key[first]
                rows = [(x, int(blocks[a]), key[s].tobytes(), np.packbits(several[s]).tobytes())
                        for x, s in _slices(_bucket(key, buckets), buckets)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, type=t) for v, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["bucket", "block", "keys", "several"])
    return run


def shared_rows(group):
    """Step 1, reduce side: which names of each block are held by two documents or more."""
    keys = [np.frombuffer(x, dtype=np.uint64) for x in group["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=len(k)).astype(bool)
               for x, k in zip(group["several"].to_pylist(), keys)]
    shared = shared_keys(np.concatenate(keys), np.concatenate(several))
    out, at = [[], []], 0
    for block, k in zip(group["block"].to_pylist(), keys):
        mine = k[shared[at:at + len(k)]]
        at += len(k)
        if len(mine):
            out[0].append(block)
            out[1].append(mine.tobytes())
    return pa.table({"block": pa.array(out[0], pa.int64()), "shared": pa.array(out[1], pa.binary())})


STRIP_NAME = np.dtype([("key", "<u4"), ("name", "<u8"), ("doc", "<i8"), ("strips", "<u2")])


class Units:
    """The units of a block, sorted by strip: (key, name), then text order."""

    def __init__(self, texts, shared: np.ndarray, least: int, gram: int):
        self.least, self.width = least, 2 * least - gram
        raws = texts["raw"].to_pylist()
        has_id = texts["id"].is_valid().to_numpy(zero_copy_only=False)
        ids = texts["id"].fill_null(NO_DOCUMENT).to_numpy()
        self.rows = texts["row"].to_numpy()
        self.runs, found = [], []
        for at, r in _runs(raws, least, gram):
            place, count, offset, key = r.units(shared)
            doc = r.document(place)
            known = np.flatnonzero(has_id[at + doc])
            place, count, offset, key, doc = (x[known] for x in (place, count, offset, key, doc))
            name, = strip_names(r.strips(place, count, self.width), count, offset, kinds=(0,))
            number = np.full(len(key), len(self.runs))
            self.runs.append(r)
            found.append((key, name, count, offset, at + doc, place - r.starts[doc], place, number))
        key, name, *others = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((name, key))
        self.key, self.name = key[order], name[order]
        self.count, self.offset, doc, self.place, self.at, self.number = (x[order] for x in others)
        self.row, self.id = self.rows[doc], ids[doc]
        new = ~same_as_before(self.key, self.name)
        self.first = np.flatnonzero(new)
        self.strip = np.cumsum(new) - 1
        self.best = np.minimum.reduceat(self.id, self.first) if len(self.first) else self.id

    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first two strips of each key, which tell whether a key has several; and each key's first strip and number of strips."""
        same = same_as_before(self.key[self.first])
        third = same.copy()
        third[1:] &= same[:-1]
        begin = np.flatnonzero(~same)
        return np.flatnonzero(~third), begin, np.diff(np.append(begin, len(same)))

    def bytes(self, units: np.ndarray) -> np.ndarray:
        """The padded strips of some units."""
        out = np.empty((len(units), self.width), dtype=np.uint8)
        for number, r in enumerate(self.runs):
            mine = np.flatnonzero(self.number[units] == number)
            out[mine] = r.strips(self.at[units[mine]], self.count[units[mine]], self.width)
        return out


def _joined(chunks, dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, dtype=dtype) for x in chunks] or [np.zeros(0, dtype=dtype)])


def strip_rows(least: int, gram: int, buckets: int):
    """Step 2, map side: a block's distinct strips by name, with their smallest documents, by bucket."""
    def run(texts, replies):
        out = []
        if texts.num_rows and replies.num_rows:
            u = Units(texts, np.unique(_joined(replies["shared"].to_pylist(), np.uint64)), least, gram)
            sent, begin, size = u.sent()
            one = u.first[sent]
            strips = np.zeros(len(u.first), dtype=np.uint16)
            strips[begin] = np.minimum(size, np.iinfo(np.uint16).max)
            table = np.empty(len(one), dtype=STRIP_NAME)
            table["key"] = u.key[one].astype(np.uint32)
            table["name"], table["doc"], table["strips"] = u.name[one], u.best[sent], strips[sent]
            block = texts["block"][0].as_py()
            out = [(b, block, table[s].tobytes()) for b, s in _slices(_bucket(u.key[one], buckets), buckets)]
        return pa.table({"bucket": pa.array([o[0] for o in out], pa.int32()),
                         "block": pa.array([o[1] for o in out], pa.int64()),
                         "strips": pa.array([o[2] for o in out], pa.binary())})
    return run


def answer_rows(hot_strips: int):
    """Step 2, reduce side: each strip's smallest document, and whether its key has several strips, or more than ``hot_strips``."""
    def run(group):
        tables = [np.frombuffer(x, dtype=STRIP_NAME) for x in group["strips"].to_pylist()]
        every = np.concatenate(tables)
        order = np.lexsort((every["name"], every["key"]))
        key, name = every["key"][order], every["name"][order]
        first = np.flatnonzero(~same_as_before(key, name))
        size = np.diff(np.append(first, len(key)))
        start = np.flatnonzero(~same_as_before(key[first]))
        variants = np.diff(np.append(start, len(first)))
        of_key = np.add.reduceat(every["strips"][order].astype(np.int64), first[start])
        best, several, hot = np.empty(len(key), dtype=np.int64), np.empty(len(key), dtype=bool), np.empty(len(key), dtype=bool)
        best[order] = np.repeat(np.minimum.reduceat(every["doc"][order], first), size)
        several[order] = np.repeat(np.repeat(variants > 1, variants), size)
        hot[order] = np.repeat(np.repeat(of_key > hot_strips, variants), size)
        ends = np.cumsum([len(t) for t in tables])

        def bits(mask):
            return pa.array([np.packbits(mask[e - len(t):e]).tobytes() for t, e in zip(tables, ends)], pa.binary())
        return pa.table({
            "block": group["block"].cast(pa.int64()), "bucket": group["bucket"].cast(pa.int32()),
            "best": pa.array([best[e - len(t):e].tobytes() for t, e in zip(tables, ends)], pa.binary()),
            "several": bits(several), "hot": bits(hot & several)})
    return run


UNIT = np.dtype([("row", "<u4"), ("place", "<u4"), ("strip", "<u4"), ("count", "u1"), ("doc", "<i8")])
STRIP = np.dtype([("key", "<u8"), ("doc", "<i8"), ("count", "u1"), ("offset", "u1")])
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("doc", "<i8")])
PLACE = np.dtype([("window", "<u4"), ("row", "<u4"), ("start", "<u4")])
COVER = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])
WINDOW_ROWS = "block long, bucket int, strips binary, bytes binary, units binary, part int, windows binary, places binary, cover binary"


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The union of byte runs, per row, as COVER records."""
    order = np.lexsort((start, row))
    row, start, end = (x[order].astype(np.int64) for x in (row, start, end))
    # a running end that cannot reach over to the next row
    reach = np.maximum.accumulate(end + (row << 33)) if len(row) else end
    new = np.ones(len(row), dtype=bool)
    new[1:] = (start[1:] + (row[1:] << 33)) > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    out = np.empty(len(first), dtype=COVER)
    out["row"], out["start"] = row[first], start[first]
    out["end"] = reach[last] - (row[last] << 33) if len(row) else 0
    return out


def window_rows(least: int, gram: int, buckets: int):
    """Step 2's answers applied, and step 3's map side: strips and units of keys with several strips, or names of the windows of hot ones.

    A unit whose strip a smaller document of the block holds is covered, and so
    is a named window that one holds; the others wait for the answers.
    """
    def run(texts, replies):
        out = []
        if texts.num_rows and replies.num_rows:
            block = texts["block"][0].as_py()
            u = Units(texts, np.unique(_joined(replies["shared"].drop_null().to_pylist(), np.uint64)), least, gram)
            answered = sorted((x for x in zip(*(replies[c].to_pylist() for c in ("bucket", "best", "several", "hot"))) if x[1] is not None),
                              key=lambda x: x[0])
            sent, begin, size = u.sent()

            def bits(i):
                return np.concatenate([np.unpackbits(np.frombuffer(x[i], dtype=np.uint8), count=len(x[1]) // 8).astype(bool)
                                       for x in answered] or [np.zeros(0, dtype=bool)])
            best, several, hot = u.best.copy(), np.ones(len(u.first), dtype=bool), np.zeros(len(u.first), dtype=bool)
            best[sent], several[sent], hot[sent] = _joined([x[1] for x in answered], np.int64), bits(2), bits(3)
            hot = np.repeat(hot[begin], size)
            open_ = several[u.strip]
            sure = np.flatnonzero(np.where(open_, u.best[u.strip], best[u.strip]) < u.id)
            covers = [merged(u.row[sure], u.place[sure], u.place[sure] + u.count[sure] + least - 1)]
            waits = open_ & (u.best[u.strip] == u.id)

            strips = np.flatnonzero(several & ~hot)
            one = u.first[strips]
            table = np.empty(len(one), dtype=STRIP)
            table["key"], table["doc"], table["count"], table["offset"] = u.key[one], u.best[strips], u.count[one], u.offset[one]
            shown = u.bytes(one)
            mine = np.flatnonzero(waits & ~hot[u.strip])
            units = np.empty(len(mine), dtype=UNIT)
            units["row"], units["place"], units["count"], units["doc"] = u.row[mine], u.place[mine], u.count[mine], u.id[mine]
            owner = np.searchsorted(strips, u.strip[mine])
            for b, s in _slices(_bucket(table["key"], buckets), buckets):
                a, z = np.searchsorted(owner, [s.start, s.stop])
                part = units[a:z].copy()
                part["strip"] = owner[a:z] - s.start
                out.append((block, b, table[s].tobytes(), shown[s].tobytes(), part.tobytes(), None, None, None, None))

            rest = np.flatnonzero(waits & hot[u.strip])
            step = max(1, WINDOWS_AT_ONCE // (least - gram + 1))
            for part, units in enumerate(rest[a:a + step] for a in range(0, len(rest), step)):
                h1, h2, own, w = window_names(u.bytes(units), u.count[units], least)
                own = units[own]
                order = np.lexsort((u.id[own], h2, h1))
                h1, h2, own, w = (x[order] for x in (h1, h2, own, w))
                doc, row, start = u.id[own], u.row[own], u.place[own] + w
                new = ~same_as_before(h1, h2)
                first, window = np.flatnonzero(new), np.cumsum(new) - 1
                table = np.empty(len(first), dtype=WINDOW)
                table["h1"], table["h2"], table["doc"] = h1[first], h2[first], doc[first]
                later = table["doc"][window] < doc
                covers.append(merged(row[later], start[later], start[later] + least))
                places = np.empty(int((~later).sum()), dtype=PLACE)
                places["window"], places["row"], places["start"] = window[~later], row[~later], start[~later]
                out.append((block, None, None, None, None, part, None, places.tobytes(), None))
                out.extend((block, b, None, None, None, part, table[s].tobytes(), None, None)
                           for b, s in _slices(_bucket(table["h1"], WINDOW_BUCKETS * buckets), WINDOW_BUCKETS * buckets))
            out.extend((block, *[None] * 7, c.tobytes()) for c in covers if len(c))
        kinds = (pa.int64(), pa.int32(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 3)
        return pa.Table.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                                    names=["block", "bucket", "strips", "bytes", "units", "part", "windows", "places", "cover"])
    return run


def window_answers(least: int, gram: int):
    """Step 3, reduce side: the smallest document of each window of each strip."""
    width = 2 * least - gram

    def run(group):
        tables = [np.frombuffer(x, dtype=STRIP) for x in group["strips"].to_pylist()]
        strips = np.concatenate([np.frombuffer(x, dtype=np.uint8).reshape(-1, width) for x in group["bytes"].to_pylist()])
        every = np.concatenate(tables)
        answer, by_window, windows = least_documents(every["key"], strips, every["count"], every["offset"],
                                                     every["doc"], least)
        # a strip alone with its whole key here has one answer for all its windows
        each = every["count"].astype(np.int64)
        full = np.repeat(answer, each)
        full[np.repeat(by_window, each)] = windows
        ends = np.cumsum([int(t["count"].sum(dtype=np.int64)) for t in tables])
        return pa.table({"block": group["block"].cast(pa.int64()), "bucket": group["bucket"].cast(pa.int32()),
                         "windows": pa.array([full[e - int(t["count"].sum(dtype=np.int64)):e].tobytes()
                                              for t, e in zip(tables, ends)], pa.binary())})
    return run


def named_answers(group):
    """Step 3, reduce side, hot keys: whether a smaller document than the block's smallest holds a window."""
    tables = [np.frombuffer(x, dtype=WINDOW) for x in group["windows"].to_pylist()]
    every = np.concatenate(tables)
    order = np.lexsort((every["h2"], every["h1"]))
    first = np.flatnonzero(~same_as_before(every["h1"][order], every["h2"][order]))
    least = np.minimum.reduceat(every["doc"][order], first)
    smaller = np.empty(len(every), dtype=bool)
    smaller[order] = np.repeat(least, np.diff(np.append(first, len(order)))) < every["doc"][order]
    ends = np.cumsum([len(t) for t in tables])
    return pa.table({
        "block": group["block"].cast(pa.int64()), "part": group["part"].cast(pa.int32()), "bucket": group["bucket"].cast(pa.int32()),
        "n": pa.array([len(t) for t in tables], pa.int32()),
        "smaller": pa.array([np.packbits(smaller[e - len(t):e]).tobytes() for t, e in zip(tables, ends)], pa.binary())})


def cover_rows(least: int):
    """Step 4: the byte runs that each open unit's repeated windows cover."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], []]
            for block, strips, units, windows in zip(*(c.to_pylist() for c in batch.columns)):
                u = np.frombuffer(units, dtype=UNIT)
                per = np.frombuffer(windows, dtype=np.int64)
                sizes = np.frombuffer(strips, dtype=STRIP)["count"].astype(np.int64)
                begin = np.cumsum(sizes) - sizes
                n = u["count"].astype(np.int64)
                own = np.repeat(np.arange(len(u)), n)
                w = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                hit = np.flatnonzero(per[begin[u["strip"]][own] + w] < u["doc"][own])
                start = u["place"][own[hit]] + w[hit]
                cover = merged(u["row"][own[hit]], start, start + least)
                if len(cover):
                    out[0].append(block)
                    out[1].append(cover.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary())],
                                             names=["block", "cover"])
    return run


def named_cover_rows(least: int):
    """Step 4, hot keys: the byte runs that a block's repeated windows cover."""
    def run(waiting, answers):
        out, block = [], None
        if waiting.num_rows and answers.num_rows:
            block = waiting["block"][0].as_py()
            answered: dict[int, list] = {}
            for part, _, n, smaller in sorted(zip(*(answers[c].to_pylist() for c in ("part", "bucket", "n", "smaller")))):
                answered.setdefault(part, []).append(np.unpackbits(np.frombuffer(smaller, dtype=np.uint8), count=n).astype(bool))
            for part, places in zip(waiting["part"].to_pylist(), waiting["places"].to_pylist()):
                at = np.frombuffer(places, dtype=PLACE)
                at = at[np.concatenate(answered[part])[at["window"]]]
                start = at["start"].astype(np.int64)
                cover = merged(at["row"], start, start + least)
                if len(cover):
                    out.append(cover.tobytes())
        return pa.table({"block": pa.array([block] * len(out), pa.int64()), "cover": pa.array(out, pa.binary())})
    return run


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def cut_rows(texts, covers):
    """Step 4: the removed runs and what is kept of a block's texts."""
    out = [[] for _ in range(5)]
    if texts.num_rows:
        cover = _joined(covers["cover"].to_pylist(), COVER)
        cover = merged(cover["row"], cover["start"], cover["end"])
        rows = texts["row"].to_numpy()
        begins, ends = (np.searchsorted(cover["row"], rows, side=s) for s in ("left", "right"))
        for i, raw, a, b in zip(texts["id"].to_pylist(), texts["raw"].to_pylist(), begins, ends):
            spans = list(zip(cover["start"][a:b].tolist(), cover["end"][a:b].tolist()))
            edges = [0, *[x for s in spans for x in s], len(raw)]
            kept = hashlib.sha256()
            for x, y in zip(edges[::2], edges[1::2]):
                kept.update(raw[x:y])
            for values, v in zip(out, (i, len(raw), sum(y - x for x, y in spans),
                                       [{"start": x, "end": y} for x, y in spans], kept.hexdigest())):
                values.append(v)
    return pa.Table.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), SPANS, pa.string()))],
                                names=["id", "n_bytes", "n_removed", "spans", "kept_sha256"])


def repeated_strings(df: DataFrame, least: int = 50, text_col: str = "text", id_col: str = "doc_id",
                     hot_strips: int = HOT_STRIPS) -> DataFrame:
    """(id, n_bytes, n_removed, spans, kept_sha256) of every row; spans are byte runs, end exclusive."""
    gram = max(1, least // 2)
    texts = text_blocks(df, text_col, id_col)
    n_blocks = texts.select("block").distinct().count()
    buckets = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                  math.ceil(n_blocks * BLOCK_BYTES / BUCKET_BYTES))

    def with_texts(replies: DataFrame, fn, schema: str) -> DataFrame:
        return (texts.groupBy("block").cogroup(replies.withColumnRenamed("block", "at").groupBy("at"))
                .applyInArrow(fn, schema))

    anchors = texts.select("block", "raw").mapInArrow(
        anchor_rows(least, gram, buckets), "bucket int, block long, keys binary, several binary")
    shared = staged(anchors.groupBy("bucket").applyInArrow(shared_rows, "block long, shared binary"), "shared")
    strips = with_texts(shared, strip_rows(least, gram, buckets), "bucket int, block long, strips binary")
    answers = staged(strips.groupBy("bucket").applyInArrow(
        answer_rows(hot_strips), "block long, bucket int, best binary, several binary, hot binary"), "answers")
    windows = staged(with_texts(shared.unionByName(answers, allowMissingColumns=True),
                                window_rows(least, gram, buckets), WINDOW_ROWS), "windows")
    opened = windows.where("strips is not null")
    ranked = staged(opened.select("block", "bucket", "strips", "bytes").groupBy("bucket").applyInArrow(
        window_answers(least, gram), "block long, bucket int, windows binary"), "ranked")
    late = (opened.select("block", "bucket", "strips", "units").join(ranked, ["block", "bucket"])
            .select("block", "strips", "units", "windows").mapInArrow(cover_rows(least), "block long, cover binary"))
    named = staged(windows.where("windows is not null").select("block", "part", "bucket", "windows").groupBy("bucket").applyInArrow(
        named_answers, "block long, part int, bucket int, n int, smaller binary"), "named")
    waiting = windows.where("places is not null").select("block", "part", "places")
    late = late.unionByName(waiting.groupBy("block").cogroup(named.withColumnRenamed("block", "at").groupBy("at"))
                            .applyInArrow(named_cover_rows(least), "block long, cover binary"))
    covers = staged(windows.where("cover is not null").select("block", "cover").unionByName(late), "covers")
    return with_texts(covers, cut_rows, "id long, n_bytes long, n_removed long, "
                      "spans array<struct<start:int,end:int>>, kept_sha256 string").withColumnRenamed("id", id_col)
