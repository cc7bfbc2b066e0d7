"""Operator 8: SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint is 8 positional bytes. Fingerprints at ``max_bits`` differing
bits or fewer differ in at most ``max_bits`` bytes, so they share at least
``8 - max_bits`` positional bytes: that is the guaranteed tally of a pair.
Postings of single bytes hold 1/256 of everything and would have to emit all
pairs to tally them; so postings are kept per set of that many positional
bytes (70 sets of 4 out of 8 for the contract's distance 4). A pair reaches
the tally exactly if it meets in one such posting, and then its bits are
compared.

Equal fingerprints are one entry. In a posting, entries near a pivot are
linked to it; every other entry is compared with the whole posting, and only
links that join two parts are emitted. So a posting emits fewer links than
it has entries, and no link between different parts is lost.

Null and empty texts, and texts without words, have fingerprint zero, linked
like any other. Rows with a null id take part and get the component's
smallest id. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.llm.common import col, long, map_texts, ship, staged
from ratebook.llm.components import components

SEED = 42
LOWER_ASCII = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: For each byte, its bits in 8 lanes of 8 bits, lowest first.
LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], dtype=np.uint64)
RUN = 255


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit value: a bit is set if over half of the shingles' XXH64 have it."""
    import xxhash
    words = (text or "").encode().translate(LOWER_ASCII).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in
                              zip(starts[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())),
                             dtype=np.uint64, count=len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 256 * RUN):
        part = hashes[at:at + 256 * RUN]
        lanes = LANES[part.view(np.uint8).reshape(-1, 8)]
        lanes = np.concatenate([lanes, np.zeros((-len(lanes) % RUN, 8), dtype=np.uint64)])
        counts += np.ascontiguousarray(lanes.reshape(-1, RUN, 8).sum(axis=1)).view(np.uint8).reshape(-1, 64).sum(
            axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, shingle: int = 4, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all but the text) with fp, the fingerprint as a signed long."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    return map_texts(df, text_col, keep, [long("fp")],
                     lambda: lambda texts: [[fingerprint(t, shingle) for t in texts]])


def posting_links(entries: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (fewer than entries) that join what is connected within one posting."""
    def differ(x):
        return np.bitwise_count(entries ^ x)

    half = len(entries) / 2
    lanes = LANES[entries.view(np.uint8).reshape(-1, 8)]
    usual = np.array([[int(((lanes[:, b] >> np.uint64(8 * i)) & np.uint64(1)).sum()) > half for i in range(8)]
                      for b in range(8)])
    centre = np.packbits(usual.ravel(), bitorder="little").view("<u8")[0]
    pivot = int(np.argmin(differ(centre)))
    part = np.arange(len(entries))
    near = differ(entries[pivot]) <= max_bits
    part[near] = pivot
    links = [(int(entries[pivot]), int(x)) for i, x in enumerate(entries) if near[i] and i != pivot]
    for i in np.flatnonzero(~near):
        met = np.flatnonzero((differ(entries[i]) <= max_bits) & (part != part[i]))
        others, one = np.unique(part[met], return_index=True)
        links += [(int(entries[i]), int(entries[j])) for j in met[one]]
        if len(others):
            part[np.isin(part, others)] = part[i]
    return links


def near_links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b) links over fp (distinct values) that connect all fingerprints within ``max_bits``."""
    if not 0 <= max_bits < 8:
        raise ValueError("positional bytes guarantee a match for at most 7 differing bits")
    masks = [sum(0xFF << (8 * p) for p in at) for at in combinations(range(8), 8 - max_bits)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = (fps
                .select("fp", F.posexplode(F.array(*[F.lit(m) for m in signed])).alias("m", "mask"))
                .select("m", F.col("fp").bitwiseAND(F.col("mask")).alias("k"), "fp"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.zeros(0, dtype=np.int64)] * 3
        for now, last in _with_last(batches):
            m, k, f = (np.concatenate([old, new]) for old, new in zip(kept, now))
            if not len(m):
                continue
            starts = np.concatenate([[0], np.flatnonzero((m[1:] != m[:-1]) | (k[1:] != k[:-1])) + 1])
            whole = len(m) if last else starts[-1]
            kept = [m[whole:], k[whole:], f[whole:]]
            starts = starts[starts < whole]
            ends = np.append(starts[1:], whole)
            u = f.view(np.uint64)
            two = starts[ends - starts == 2]
            two = two[np.bitwise_count(u[two] ^ u[two + 1]) <= max_bits]
            found = list(zip(f[two].tolist(), f[two + 1].tolist()))
            for i in np.flatnonzero(ends - starts > 2):
                found += [(_signed(a), _signed(b)) for a, b in posting_links(u[starts[i]:ends[i]], max_bits)]
            found = forest(found)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], type=pa.int64()),
                                              pa.array([y for _, y in found], type=pa.int64())], names=["a", "b"])

    ship(fps.sparkSession)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (postings.repartition(n, "m", "k").sortWithinPartitions("m", "k").mapInArrow(link, "a long, b long"))


def _with_last(batches: Iterator[pa.RecordBatch]):
    """The batches as lists of arrays, then one empty batch marked as the last."""
    for batch in batches:
        yield [c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns], False
    yield [np.zeros(0, dtype=np.int64)] * 3, True


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The links that join two parts, in order (a spanning forest)."""
    parent: dict[int, int] = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[x]
        return x

    out = []
    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def simhash_groups(df: DataFrame, shingle: int = 4, max_bits: int = 4, text_col: str = "text",
                   id_col: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: the id) with fp, component_id (the smallest id reachable over links) and
    component_fp, which names the component also where ids repeat or are null."""
    keep = [id_col] if keep is None else keep
    kept = [c for c in keep if c.lower() not in ("fp", "component_id", "component_fp")]
    carried = list(dict.fromkeys([*kept, id_col]))
    fps = staged(fingerprints(df, shingle, text_col, carried), "fingerprints")
    first = staged(fps.groupBy("fp").agg(F.min(col(id_col)).alias("first")), "first")
    parts = components(near_links(first, max_bits))
    roots = (parts.join(first, parts.node == first.fp).groupBy("root").agg(F.min("first").alias("least")))
    own = first.select(F.col("fp").alias("root"), F.col("first").alias("own"))
    roots = roots.join(own, "root").select("root", F.least("own", "least").alias("cid"))
    linked = parts.select(F.col("node").alias("fp"), "root").unionByName(
        roots.select(F.col("root").alias("fp"), "root")).join(roots, "root").select("fp", "root", "cid")
    named = staged(first.join(linked, "fp", "left")
                   .select("fp", F.coalesce("cid", "first").alias("component_id"),
                           F.coalesce("root", "fp").alias("component_fp")), "components")
    return fps.join(named, "fp").select(*[fps[f"`{c}`"] for c in kept], "fp", "component_id", "component_fp")
