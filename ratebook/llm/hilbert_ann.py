"""Operator 4: approximate nearest neighbours over shifted Hilbert curves.

Each distinct vector gets, for every curve, a random orthonormal projection to
``DIMS`` numbers, their ranks in [0, 1) (quantiles of a bounded sample), a
random shift, and the Hilbert key of the shifted point. Spark range-partitions
the keys of a curve and numbers them; a query looks at the ``window`` places
before and after its own on every curve. Places are grouped into blocks of
``BLOCK`` vectors, so a query meets its window by equi-joins of bounded size.
The windows' vectors are ranked by their exact distance in double precision.

The window is measured: up to ``RECALL_SAMPLE`` queries are compared with all
vectors, and the window is the place distance within which ``TARGET`` of their
true neighbours lie on some curve. Clustered vectors get short windows;
vectors without any structure need windows in proportion to the table.

Copies of a vector are one place with its smallest ids, as many as an answer
can need, so a vector held by very many rows stays small. Vectors that are
null, zero, of another than the commonest length, or hold null or non-finite
components take no part, nor do null ids; repeated rows count once. Without
queries or vectors the result is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.llm.common import col, ship, staged

CURVES = 8
DIMS = 8
BITS = 6
BLOCK = 2048
FIT_ROWS = 5_000
RECALL_SAMPLE = 100
TARGET = 0.96
KNOTS = 257


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of points with ``bits``-bit coordinates.

    The coordinates' bits are taken from the top; each level's octant is put
    in Gray-code order and the lower bits are reflected or exchanged to match.
    """
    x = cells.astype(np.uint64).T.copy()
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        low = np.uint64((1 << level) - 1)
        for i in range(len(x)):
            high = (x[i] >> np.uint64(level)) & one == one
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= ((x[-1] >> np.uint64(level)) & one) * np.uint64((1 << level) - 1)
    x ^= flip
    key = np.zeros(x.shape[1], dtype=np.uint64)
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = (key << one) | ((row >> np.uint64(level)) & one)
    return key.astype(np.int64)


class Curves:
    """Projections, quantile knots and shifts, fitted on a bounded sample of vectors."""

    def __init__(self, sample: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        width = sample.shape[1]
        dims = min(DIMS, width)
        self.maps = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(CURVES)]
        self.shifts = rng.random((CURVES, dims))
        grid = np.linspace(0, 1, KNOTS)
        self.knots = [np.quantile(sample @ m, grid, axis=0) for m in self.maps]

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        y = x @ self.maps[curve]
        grid = np.linspace(0, 1 - 1e-9, KNOTS)
        ranks = np.stack([np.interp(y[:, i], self.knots[curve][:, i], grid) for i in range(y.shape[1])], axis=1)
        return hilbert_keys(((ranks + self.shifts[curve]) * (1 << (BITS - 1))).astype(np.uint64), BITS)


def _matrix(raws, kind: str) -> np.ndarray:
    """Vectors of equal length from their bytes, in double precision."""
    return np.stack([np.frombuffer(r, dtype=kind) for r in raws]).astype(np.float64)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = x - q
    return np.sqrt((gap * gap).sum(axis=1))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(vec_id, raw) of the vectors that take part, and the numpy kind of raw."""
    element = df.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    kept = "float" if kind == "<f4" else "double"
    v = F.col("v")
    whole = (df.select(col(id_col).cast("long").alias("vec_id"), col(vector_col).cast(f"array<{kept}>").alias("v"))
             .where(F.col("vec_id").isNotNull() & v.isNotNull())
             .where(~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                    & F.exists(v, lambda x: x != 0)))
    usual = whole.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    whole = whole.where(F.size(v) == (usual.n if usual else 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                width = len(b.column(1)[0])
                flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary())],
                                                 names=["vec_id", "raw"])
    ship(df.sparkSession)
    return staged(whole.mapInArrow(pack, "vec_id long, raw binary"), "vectors"), kind


def distinct_points(vectors: DataFrame, most: int) -> DataFrame:
    """(raw, ids): each distinct vector with its ``most`` smallest ids, combined in the tasks before the shuffle."""
    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, list[int]] = {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(best), pa.binary()),
                                               pa.array(list(best.values()), pa.list_(pa.int64()))],
                                              names=["raw", "ids"])
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = best.setdefault(raw, [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > most:
                        ids.remove(max(ids))
            if len(best) > 20_000:
                yield out()
                best.clear()
        yield out()
    partial = vectors.mapInArrow(combine, "raw binary, ids array<long>")
    return partial.groupBy("raw").agg(
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, most).alias("ids"))


def curve_places(points: DataFrame, curves: Curves, kind: str) -> DataFrame:
    """(curve, place, raw, ids): the points numbered along every curve."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0).to_pylist(), kind)
            for c in range(CURVES):
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(x), pa.int32()), pa.array(curves.keys(x, c)),
                                                  b.column(0), b.column(1)], names=["curve", "key", "raw", "ids"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            local = []
            for c in b.column(0).to_pylist():
                local.append(seen.get(c, 0))
                seen[c] = local[-1] + 1
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * n, pa.int32()), pa.array(local, pa.int64()),
                                              b.column(2), b.column(3)], names=["curve", "part", "local", "raw", "ids"])

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["curve", "key", "raw"]
    ranged = (points.mapInArrow(keyed, "curve int, key long, raw binary, ids array<long>")
              .repartitionByRange(n, *order).sortWithinPartitions(*order))
    rows = staged(ranged.mapInArrow(numbered, "curve int, part int, local long, raw binary, ids array<long>"), "curves")
    counts = rows.groupBy("curve", "part").count()
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("curve", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = rows.join(offsets, ["curve", "part"])
    return staged(placed.select("curve", (F.col("before") + F.col("local")).alias("place"), "raw", "ids"), "places")


def measured_window(points: DataFrame, places: DataFrame, raws: list[bytes], kind: str, k: int) -> int:
    """The place distance within which TARGET of the sample's true neighbours lie on some curve."""
    shared = points.sparkSession.sparkContext.broadcast(raws)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = _matrix(shared.value, kind)
        for b in batches:
            if not b.num_rows:
                continue
            held = b.column(0).to_pylist()
            x = _matrix(held, kind)
            for i in range(len(q)):
                d = distances(x, q[i])
                d[[j for j, r in enumerate(held) if r == shared.value[i]]] = np.inf
                top = np.argsort(d, kind="stable")[:k]
                top = top[np.isfinite(d[top])]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(top), pa.int32()), pa.array(d[top]),
                                                  pa.array([held[j] for j in top], pa.binary())], names=["q", "d", "raw"])

    best = Window.partitionBy("q").orderBy("d", "raw")
    true = (points.select("raw").mapInArrow(nearest, "q int, d double, raw binary")
            .withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).select("q", "raw").collect())
    wanted = {bytes(r.raw) for r in true} | set(raws)
    seen = points.sparkSession.createDataFrame([(bytearray(r),) for r in sorted(wanted)], "raw binary")
    at = {(r.curve, bytes(r.raw)): r.place
          for r in places.join(F.broadcast(seen), "raw", "left_semi").select("curve", "raw", "place").collect()}
    gaps = [min(abs(at[c, raws[r.q]] - at[c, bytes(r.raw)]) for c in range(CURVES)) for r in true]
    return max(k, math.ceil(np.quantile(gaps, TARGET))) if gaps else k


def window_matches(places: DataFrame, sought: DataFrame, window: int, kind: str, most: int) -> DataFrame:
    """(q, vec_id, score): the best ``most`` entries of every window block; ``sought`` holds the queries' raw."""
    own = places.join(sought, "raw", "left_semi").select("curve", "place", F.col("raw").alias("q"))
    spans = own.select(F.col("curve").alias("on"), "q", (F.col("place") - window).alias("low"), (F.col("place") + window).alias("high"))
    asked = spans.select("*", F.explode(F.sequence(F.floor(F.greatest("low", F.lit(0)) / BLOCK),
                                                   F.floor(F.col("high") / BLOCK))).alias("at"))
    held = places.withColumn("block", F.floor(F.col("place") / BLOCK))

    def rank(key, left, right):
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            x = _matrix(left["raw"].to_pylist(), kind)
            place = left["place"].to_numpy()
            ids = left["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            for q, low, high in zip(*(right[c].to_pylist() for c in ("q", "low", "high"))):
                at = np.flatnonzero((place >= low) & (place <= high))
                d = distances(x[at], np.frombuffer(q, dtype=kind).astype(np.float64))
                for j in np.lexsort((first[at], d))[:most]:
                    for i in ids[at[j]]:
                        out[0].append(q)
                        out[1].append(i)
                        out[2].append(d[j])
        return pa.table({"q": pa.array(out[0], pa.binary()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})

    return (held.groupBy("curve", "block").cogroup(asked.groupBy("on", "at"))
            .applyInArrow(rank, "q binary, vec_id long, score double"))


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", window: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query; ``is_query`` is a condition on vec_id."""
    spark = df.sparkSession
    vectors, kind = usable_vectors(df, id_col, vector_col)
    queries = vectors.where(is_query).select(F.col("vec_id").alias("query_id"), "raw").distinct()
    points = staged(distinct_points(vectors, k + 1), "points")
    n = points.count()
    sample = [bytes(r.raw) for r in points.select("raw").sample(fraction=min(1.0, FIT_ROWS / max(n, 1)), seed=2).collect()]
    if not sample:
        sample = [bytes(r.raw) for r in points.select("raw").limit(FIT_ROWS).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    curves = Curves(_matrix(sorted(sample), kind))
    places = curve_places(points, curves, kind)
    sought = queries.select("raw").distinct()
    if window is None:
        few = [bytes(r.raw) for r in sought.orderBy(F.xxhash64("raw"), "raw").limit(RECALL_SAMPLE).collect()]
        window = measured_window(points, places, few, kind, k) if few else k
    found = window_matches(places, sought, window, kind, k + 1).groupBy("q", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("q").orderBy("score", "vec_id")
    top = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1).drop("r")
    paired = queries.join(top, queries.raw == top.q).where("vec_id != query_id")
    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (paired.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
            .withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
