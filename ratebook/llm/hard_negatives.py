"""Operator 12: hard negatives by an inverted multi-index.

Vectors become integers (``floor(scale * x)``), so a score is an exact inner
product. Their two halves are coded by a codebook each, fitted on a bounded
sample of at most about ``FIT_ROWS`` rows (``FIT_VALUES`` numbers); a pair of codes is a cell. All rows are coded, and
each code's radius is the largest distance of any row's half to its centroid,
so no row of a cell scores above the sum of the two halves' bounds (centroid
score plus length of the anchor's half times radius).

Cells in order of their codes are dealt to blocks of bounded size; a cell
larger than a block is split by a hash of the row id, so a vector held by a
third of all rows is several blocks. An anchor goes to the blocks whose bound
reaches the score it surely needs, which a look at the sample gives. Spark
shuffles rows and anchors by block and sorts rows first, so a task holds one
block at a time and anchors stream past it. There a heap over the two sorted
code lists hands out the block's cells by falling bound, until the next bound
is below the last score of a full answer: a certified window. Per block at most
one answer per anchor is left, and the answers of all blocks are merged by
anchor.

First each anchor finds its positives: the ``positives`` best other rows of its
label. Then, with their scores known, it finds for every positive the
``negatives`` best rows of other labels whose score lies from ``low`` to
``high`` hundredths of the positive's score. Both answers are exact, also where
the data have no structure and all cells must be visited.

Ties go to the smaller id. Rows with a null id, label or vector or a null or
non-finite component take no part; of rows with one id the least (label, vector)
counts; shorter vectors are read as padded with zeros. A positive with a negative
score has no window. Without anchors, positives or negatives the result is
empty. Other columns are not read. Scores must fit a long (else an error).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratebook.llm.common import col, ship, staged

CODES = 32
FIT_ROWS = 8192
FIT_VALUES = 1 << 21
ROUNDS = 8
BLOCKS = 128
LEAST_ROWS = 2048
MOST_VALUES = 1 << 23
FIRST_LOOK = 256
MOST_LOOK = 8192
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Space:
    """What every task knows: width, number types, codebooks, radii, blocks and the sample. Its size is bounded."""

    def __init__(self, width: int, largest: int, rows: int):
        self.width, self.half, self.rows = width, (width + 1) // 2, rows
        most = width * largest * largest
        if most >= 2**63:
            raise ValueError("scores of these vectors do not fit a long")
        self.stored = next(t for t, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if largest < top)
        # Sums of products stay below these powers of two, where floating-point integers are exact.
        self.exact = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64

    def matrix(self, raws: list[bytes]) -> np.ndarray:
        out = np.frombuffer(b"".join(raws), dtype=self.stored)
        return out.reshape(len(raws), self.width).astype(self.exact)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = x.astype(np.float64)
        return x[:, :self.half], x[:, self.half:]

    def fit(self, ids: np.ndarray, labels: np.ndarray, raws: list[bytes]) -> None:
        self.ids, self.labels, self.sample = ids, labels, self.matrix(raws)
        codes = max(1, min(CODES, math.isqrt(len(ids))))
        self.books = [centroids(h, codes, seed) for seed, h in enumerate(self.halves(self.sample))]

    def code(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per half the nearest centroid and the distance to it."""
        return [nearest(h, book) for h, book in zip(self.halves(x), self.books, strict=True)]

    def lay_out(self, cells: dict[tuple[int, int], tuple[int, float, float]]) -> None:
        """Radii of the codes, and cells to blocks: block numbers of a cell are first .. first + parts - 1."""
        self.radii = [np.zeros(len(b)) for b in self.books]
        for (a, b), (_, ra, rb) in cells.items():
            self.radii[0][a] = max(self.radii[0][a], ra)
            self.radii[1][b] = max(self.radii[1][b], rb)
        size = min(max(self.rows // BLOCKS, LEAST_ROWS), max(256, MOST_VALUES // max(self.width, 1)))
        self.blocks: dict[tuple[int, int], tuple[int, int]] = {}
        number, filled = 0, 0
        for cell, (count, _, _) in sorted(cells.items()):
            parts = -(-count // size)
            if filled and (filled + count > size or parts > 1):
                number, filled = number + 1, 0
            self.blocks[cell] = number, parts
            filled += count
            if parts > 1:
                number, filled = number + parts, 0
        self.cells = np.array(sorted(self.blocks), dtype=np.int64).reshape(-1, 2)

    def bounds(self, q: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per half what its codes can give at most and at least to the anchors' scores, a little widened."""
        top, low = [], []
        for h, book, radius in zip(self.halves(q), self.books, self.radii, strict=True):
            centre, reach = h @ book.T, np.sqrt((h * h).sum(axis=1))[:, None] * radius
            slack = 1e-6 * (1 + np.abs(centre) + reach)
            top.append(centre + reach + slack)
            low.append(centre - reach - slack)
        return top, low


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and the distance to it from the coordinates themselves."""
    code = ((book * book).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)
    gap = x - book[code]
    return code, np.sqrt((gap * gap).sum(axis=1))


def centroids(x: np.ndarray, codes: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from random rows; a code without rows keeps its place."""
    book = x[np.random.default_rng(seed).permutation(len(x))[:codes]].copy()
    for _ in range(ROUNDS):
        code, _ = nearest(x, book)
        count = np.bincount(code, minlength=len(book))
        total = np.zeros_like(book)
        np.add.at(total, code, x)
        book[count > 0] = total[count > 0] / count[count > 0, None]
    return book


def cells_by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(bound, i, j) of all pairs by falling first[i] + second[j], from a heap with one entry per opened i."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    u, v = (-first[a]).tolist(), (-second[b]).tolist()
    a, b = a.tolist(), b.tolist()
    heap = [(u[0] + v[0], 0, 0)]
    while heap:
        bound, i, j = heap[0]
        if j + 1 < len(v):
            heapq.heapreplace(heap, (u[i] + v[j + 1], i, j + 1))
        else:
            heapq.heappop(heap)
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (u[i + 1] + v[0], i + 1, 0))
        yield -bound, a[i], b[j]


class Best:
    """The best ``size`` (score, id) seen between two scores; ``need`` is what a further row must reach."""

    def __init__(self, size: int, low, high):
        self.size, self.low, self.high, self.need = size, low, high, low
        self.scores, self.ids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        on = (scores >= self.need) & (scores <= self.high)
        if not on.any():
            return
        scores, ids = np.concatenate([self.scores, scores[on].astype(np.int64)]), np.concatenate([self.ids, ids[on]])
        if len(scores) > self.size:
            some = scores >= np.partition(scores, -self.size)[-self.size]
            scores, ids = scores[some], ids[some]
        order = np.lexsort([ids, -scores])[:self.size]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.size:
            self.need = max(self.need, int(self.scores[-1]))


class Block:
    """The rows of one block in order of their cells."""

    def __init__(self, space: Space, ids, labels, first, second, raws):
        order = np.lexsort([second, first])
        self.ids, self.labels, self.x = ids[order], labels[order], space.matrix([raws[i] for i in order])
        first, second = first[order], second[order]
        at = np.flatnonzero(np.diff(first, prepend=-1) | np.diff(second, prepend=-1))
        ends = [*at[1:], len(order)]
        self.places = {(a, b): (s, e) for a, b, s, e in zip(first[at].tolist(), second[at].tolist(), at.tolist(), ends, strict=True)}
        self.first, self.second = np.unique(first), np.unique(second)

    def search(self, q: np.ndarray, top, low, answers: list[Best], usable) -> None:
        """Fill the answers from cells by falling bound, until no cell left can hold a row they need.

        Cells are scored together once they hold ``FIRST_LOOK`` rows, then twice as many each time.
        """
        ceiling = max(a.high for a in answers)
        waiting, held, look = [], 0, FIRST_LOOK
        first, second = self.first.tolist(), self.second.tolist()
        for bound, i, j in cells_by_bound(top[0][self.first], top[1][self.second]):
            if bound < min(a.need for a in answers):
                break
            place = self.places.get((first[i], second[j]))
            if place is None or low[0][first[i]] + low[1][second[j]] > ceiling:
                continue
            waiting.append(place)
            held += place[1] - place[0]
            if held >= look:
                self._score(q, waiting, answers, usable)
                waiting, held, look = [], 0, min(look * 2, MOST_LOOK)
        if waiting:
            self._score(q, waiting, answers, usable)

    def _score(self, q, places, answers, usable) -> None:
        rows = np.concatenate([np.arange(s, e) for s, e in places]) if len(places) > 1 else np.arange(*places[0])
        rows = rows[usable[rows]]
        scores, ids = self.x[rows] @ q, self.ids[rows]
        for a in answers:
            a.add(scores, ids)


def _rows(batch: pa.RecordBatch, *names: str):
    return [batch.column(n).to_pylist() if batch.schema.field(n).type in (pa.binary(), pa.string()) or pa.types.is_list(batch.schema.field(n).type)
            else batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, label_col, scale: float) -> tuple[DataFrame, Space]:
    """(id, label, raw) of the rows that take part, as integers of equal width, one row per id."""
    label = col(label_col) if isinstance(label_col, str) else label_col
    v = F.col("v")
    ints = (df.select(col(id_col).cast("long").alias("id"), label.cast("string").alias("label"),
                      col(vector_col).cast("array<double>").alias("v"))
            .where("id is not null and label is not null and v is not null")
            .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
            .withColumn("v", F.transform(v, lambda x: F.floor(x * scale))))
    size = ints.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("rows"), F.max(F.array_max(v)).alias("top"),
                    F.min(F.array_min(v)).alias("low")).first()
    space = Space(size.width or 0, max(abs(size.top or 0), abs(size.low or 0)), size.rows)
    width, stored = space.width, space.stored

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            x = np.zeros((b.num_rows, width), dtype=stored)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            x[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())],
                                             names=["id", "label", "raw"])

    ship(df.sparkSession)
    packed = ints.mapInArrow(pack, "id long, label string, raw binary")
    return staged(packed.groupBy("id").agg(F.min(F.struct("label", "raw")).alias("r")).select("id", "r.*"), "vectors"), space


def coded_rows(rows: DataFrame, space: Space) -> DataFrame:
    """(id, label, raw, a, b, block): all rows with their cell and block; the space learns radii and blocks."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (a, ra), (b, rb) = space.code(space.matrix(batch.column(2).to_pylist()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)),
                                                  pa.array(ra), pa.array(rb)],
                                                 names=["id", "label", "raw", "a", "b", "ra", "rb"])

    coded = staged(rows.mapInArrow(assign, "id long, label string, raw binary, a int, b int, ra double, rb double"), "coded")
    cells = coded.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("ra").alias("ra"), F.max("rb").alias("rb"))
    space.lay_out({(r.a, r.b): (r.n, r.ra, r.rb) for r in cells.collect()})  # at most CODES * CODES rows
    spark = rows.sparkSession
    blocks = F.broadcast(spark.createDataFrame([(*c, *b) for c, b in space.blocks.items()], "a int, b int, first int, parts int"))
    return coded.join(blocks, ["a", "b"]).select(
        "id", "label", "raw", "a", "b", F.expr("first + cast(pmod(xxhash64(id), parts) as int)").alias("block"))


def _windows(wants, low: int, high: int, negatives: int) -> list[tuple[dict, Best]]:
    """Per positive the answer to fill, for windows that can hold a score."""
    out = []
    for w in wants:
        least, most = -(-low * w["score"] // 100), high * w["score"] // 100
        if least <= most:
            out.append((w, Best(negatives, least, most)))
    return out


def visit(rows: DataFrame, anchors: DataFrame, space: Space, size: int, window: tuple[int, int] | None) -> DataFrame:
    """(anchor_id, positive_id, positive_score, id, score): the anchors' answers in every block they must see.

    Without a window the best rows of the anchor's label; with one the best rows
    of other labels per entry of the anchors' ``wants``.
    """
    shared = anchors.sparkSession.sparkContext.broadcast(space)
    wanted = "array<struct<id: bigint, score: bigint>>"

    def answers_for(wants) -> list[tuple[dict | None, Best]]:
        return [(None, Best(size, -2**63, 2**63 - 1))] if window is None else _windows(wants, *window, size)

    def usable(labels: np.ndarray, label: str, ids: np.ndarray, own: int) -> np.ndarray:
        return (labels == label) & (ids != own) if window is None else labels != label

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        edges: dict[int, list[int]] = {}
        for i, cell in enumerate(map(tuple, s.cells.tolist())):
            for block in range(s.blocks[cell][0], sum(s.blocks[cell])):
                edges.setdefault(block, []).append(i)
        numbers = np.array(list(edges), dtype=np.int32)
        members = np.concatenate([np.array(m) for m in edges.values()])
        starts = np.cumsum([0, *[len(m) for m in edges.values()]])[:-1]
        for batch in batches:
            ids, labels, raws, wants = _rows(batch, "id", "label", "raw", "wants")
            if not len(ids):
                continue
            q = s.matrix(raws)
            top, _ = s.bounds(q)
            goes, floors = [], []
            for k in range(len(ids)):
                answers = [a for _, a in answers_for(wants[k])]
                on = usable(s.labels, labels[k], s.ids, ids[k])
                for a in answers:
                    a.add(s.sample[on] @ q[k], s.ids[on])
                need = min((a.need for a in answers), default=math.inf)
                reach = np.maximum.reduceat((top[0][k][s.cells[:, 0]] + top[1][k][s.cells[:, 1]])[members], starts)
                goes.append(numbers[reach >= need])
                floors.append([a.need for a in answers])
            counts = [len(g) for g in goes]
            at = pa.array(np.repeat(np.arange(len(ids)), counts))
            out = batch.select(["id", "label", "raw", "wants"]).take(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(goes)), *out.columns, pa.array(floors, pa.list_(pa.int64())).take(at)],
                names=["block", "id", "label", "raw", "wants", "floors"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        current, held, block = None, [], None
        for batch in batches:
            blocks, kinds = _rows(batch, "block", "kind")
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if blocks[start] != current:
                    current, held, block = blocks[start], [], None
                if kinds[start] == 0:
                    held.append(part)
                elif held or block is not None:
                    if block is None:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        ids, labels, a, b, raws = _rows(whole, "id", "label", "a", "b", "raw")
                        block, held = Block(s, ids, np.array(labels, dtype=object), a, b, raws), []
                    yield from asked(s, block, part)

    def asked(s: Space, block: Block, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, labels, raws, wants, floors = _rows(part, "id", "label", "raw", "wants", "floors")
        q = s.matrix(raws)
        top, low = s.bounds(q)
        out = [[] for _ in range(5)]
        same = {label: block.labels == label for label in set(labels)}
        for k in range(len(ids)):
            answers = answers_for(wants[k])
            on = same[labels[k]] & (block.ids != ids[k]) if window is None else ~same[labels[k]]
            for (_, a), floor in zip(answers, floors[k], strict=True):
                a.need = floor  # the sample's rows are rows like all others: below what they reach nothing is needed
            if answers:
                block.search(q[k], [t[k] for t in top], [x[k] for x in low], [a for _, a in answers], on)
            for w, a in answers:
                for values, v in zip(out, (ids[k], w and w["id"], w and w["score"]), strict=False):
                    values.extend([v] * len(a.ids))
                out[3].extend(a.ids)
                out[4].extend(a.scores)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out],
                                         names=["anchor_id", "positive_id", "positive_score", "id", "score"])

    wanting = anchors.withColumn("wants", F.lit(None).cast(wanted)) if window is None else anchors
    sent = wanting.select("id", "label", "raw", "wants").mapInArrow(
        route, f"block int, id long, label string, raw binary, wants {wanted}, floors array<bigint>")
    both = (rows.withColumn("kind", F.lit(0)).withColumn("wants", F.lit(None).cast(wanted))
            .unionByName(sent.withColumn("kind", F.lit(1)), allowMissingColumns=True))
    return (both.repartition("block").sortWithinPartitions("block", "kind")
            .select("block", "kind", "id", "label", "a", "b", "raw", "wants", "floors")
            .mapInArrow(search, "anchor_id long, positive_id long, positive_score long, id long, score long"))


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col="label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``anchor`` is a condition on ``id``."""
    spark = df.sparkSession
    rows, space = whole_vectors(df, id_col, vector_col, label_col, scale)
    if not space.rows:
        return spark.createDataFrame([], RESULT)
    fit = max(256, min(FIT_ROWS, FIT_VALUES // max(space.width, 1)))
    sample = rows.sample(fraction=min(1.0, fit / space.rows), seed=11).collect() or rows.limit(fit).collect()
    space.fit(np.array([r.id for r in sample], dtype=np.int64), np.array([r.label for r in sample], dtype=object),
              [bytes(r.raw) for r in sample])
    indexed = coded_rows(rows, space)
    anchors = rows.where(anchor)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    found = (visit(indexed, anchors, space, positives, None).withColumn("rank", F.row_number().over(best))
             .where(F.col("rank") <= positives))
    wants = found.groupBy("anchor_id").agg(F.collect_list(F.struct("id", "score")).alias("wants")).withColumnRenamed("anchor_id", "id")
    asking = staged(anchors.join(wants, "id"), "asking")
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    return (visit(indexed, asking, space, negatives, (low, high)).withColumn("rank", F.row_number().over(best))
            .where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))


def oracle(table: str = "embeddings") -> str:
    """The same result in DuckDB SQL, every anchor against every row."""
    return f"""
with whole as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from {table}
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
shifted as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from whole),
vectors as (select vec_id, min(row(label::varchar, v))[1] as label, min(row(label::varchar, v))[2] as v from shifted group by vec_id),
scores as (select a.vec_id as anchor_id, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score
  from vectors a join vectors r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id),
positives as (select anchor_id, vec_id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over w :: int as rank, vec_id as negative_id, positive_score, score as negative_score
from positives join scores using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, vec_id)
qualify row_number() over w <= 10
"""
