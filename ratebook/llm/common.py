"""Helpers shared by the operators: reading, shipping code, text batches, shared scratch tables."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ratebook.session import scratch_dir, ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared scratch folder and read back.

    Cuts lineage and survives lost executors: the files lie in the folder named
    by ``spark.checkpoint.dir``, which every executor sees.
    """
    path = scratch_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Like ``staged``, as an external table bucketed by ``key``: grouping by it needs no shuffle."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    table_name = "ratebook_" + re.sub("[^a-z0-9]", "_", path.rsplit("/", 1)[1].lower())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with shuffles_dropped(spark):
        df.write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(table_name)
    return spark.table(table_name)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within this block, a finished query's shuffle files go at once: its result has been written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str):
    return F.col(quoted(name))


def map_texts(df: DataFrame, text_col: str, keep: list[str], fields: list[T.StructField],
              make: Callable[[], Callable[[list], list]], max_chars: int = 16_000_000) -> DataFrame:
    """Columns computed from whole texts, in Arrow batches, with no shuffle.

    ``make()`` runs once per task and returns a function from a list of texts
    (None for null) to one list per field. Kept columns that clash with a new
    field's name give way to it. Batches are handed over in runs of about
    ``max_chars`` characters, so memory stays bounded with long texts.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in keep if c.lower() not in new]
    src = df.select(*[col(c) for c in kept], *([] if text_col in kept else [col(text_col).alias("__text")]))
    text_at = kept.index(text_col) if text_col in kept else len(kept)
    schema = T.StructType([src.schema[c] for c in kept] + fields)
    arrow = to_arrow_schema(schema)
    types = [f.type for f in arrow][len(kept):]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            for part in text_runs(batch, text_at, max_chars):
                values = score(part.column(text_at).to_pylist())
                new_cols = [pa.array(v, type=t) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) for c, f in zip(part.columns[:len(kept)], arrow)] + new_cols, schema=arrow)

    ship(df.sparkSession)
    return src.mapInArrow(run, schema)


def text_runs(batch: pa.RecordBatch, text_at: int, max_chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``max_chars`` bytes of text each (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False)
    at = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = at[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(at, base + max_chars, side="right")))
        yield batch.slice(start, end - start)
        start = end


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def boolean(name: str) -> T.StructField:
    return T.StructField(name, T.BooleanType())


def double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def string(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())
