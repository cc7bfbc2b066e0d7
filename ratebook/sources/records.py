"""CSV records of files of any size, in many tasks.

The text reader cuts a file into splits at line breaks, but a quoted cell may
hold line breaks, so whether a line begins a record depends on all lines
before it. Each task therefore scans its splits under both readings: the split
begins outside quotes, or inside. Per split it tells how each reading ends and
how many records it begins; a fold over a file's splits (one row each) picks
the reading and the number of records before it. That gives every record its
place in its file without a window over the file. Only records of several
lines are put together by a shuffle; all others are parsed where they are.

Nothing is dropped in silence: a record with more cells than its file's header,
one whose quote is never closed and a file without a record are rows of a side
table, with place and reason. A record with fewer cells is kept, its missing
cells null, as a pandas read takes it, and listed there as well. Lines of white
space alone are no records.
"""

from __future__ import annotations

import contextlib
import csv
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.staging import written

_CELL = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
_WHOLE = re.compile(rf"{_CELL}(?:,{_CELL})*+", re.DOTALL)
_CLOSES = re.compile(rf'(?:[^"]|"")*+"[^,]*+(?:,{_CELL})*+', re.DOTALL)
_LINES = ("file string, start long, line long, value string, "
          "out_record long, out_before boolean, out_after boolean, in_record long, in_before boolean, in_after boolean")


def stays_open(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, begun inside or outside one."""
    if '"' not in line:
        return inside
    return not (_CLOSES if inside else _WHOLE).fullmatch(line)


def scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each split and its records under both readings (0: outside at first, 1: inside)."""
    split, place, record, state = None, 0, [0, 0], [False, True]
    for batch in batches:
        out: list[list] = [[] for _ in range(10)]
        for value, file, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if (file, start) != split:
                split, place, record, state = (file, start), 0, [0, 0], [False, True]
            place += 1
            row = [file, start, place, value]
            for k in (0, 1):
                before = state[k]
                state[k] = stays_open(value, before)
                if not before:
                    if not value.strip():  # no record
                        row += [None, False, False]
                        continue
                    record[k] += 1
                row += [record[k], before, state[k]]
            for values, v in zip(out, row, strict=True):
                values.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.int64(), pa.bool_(), pa.bool_()] * 2),
                                            strict=True)],
            names=[c.split()[0] for c in _LINES.split(", ")])


def parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's records as cells; null where they cannot be read."""
    csv.field_size_limit(sys.maxsize)

    def cells(record):
        try:
            return next(csv.reader([record.removesuffix("\r")]), [])
        except csv.Error:
            return None
    for batch in batches:
        parsed = pa.array([cells(r) for r in batch.column("record").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, parsed], names=[*batch.schema.names, "cells"])


def split_states(lines: DataFrame) -> DataFrame:
    """(file, start, inside, first, open_record): per split its reading and the records begun before it;
    ``open_record`` is the file's last record if its quote is never closed."""
    each = lines.groupBy("file", "start").agg(
        F.coalesce(F.max("out_record"), F.lit(0)).alias("out_n"), F.coalesce(F.max("in_record"), F.lit(0)).alias("in_n"),
        F.max_by("out_after", "line").alias("out_end"), F.max_by("in_after", "line").alias("in_end"))
    ordered = each.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "out_n", "in_n", "out_end", "in_end"))).alias("splits"))
    folded = ordered.select("file", F.expr("""
        aggregate(splits, cast(array() as array<struct<start: bigint, inside: boolean, first: bigint, ends: boolean, total: bigint>>),
          (done, s) -> array_append(done, named_struct(
            'start', s.start,
            'inside', coalesce(try_element_at(done, -1).ends, false),
            'first', coalesce(try_element_at(done, -1).total, 0L),
            'ends', if(coalesce(try_element_at(done, -1).ends, false), s.in_end, s.out_end),
            'total', coalesce(try_element_at(done, -1).total, 0L) + if(coalesce(try_element_at(done, -1).ends, false), s.in_n, s.out_n))))""")
                            .alias("splits"))
    last = F.try_element_at("splits", F.lit(-1))
    return folded.select("file", F.when(last["ends"], last["total"]).alias("open_record"), F.inline("splits")).select(
        "file", "start", "inside", "first", "open_record")


@contextlib.contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Within this block, a reader lists its paths in a few tasks per core; by default each path, up to 10,000, is a task."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(_path, source_row, record, cells, open) of all records, the headers (source_row 1) included."""
    with listed_in_few_tasks(spark):
        text = spark.read.option("lineSep", "\n").text(files)
    text = text.select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = written(text.mapInArrow(scan_lines, _LINES), "form-lines")

    def read(name):
        return F.when(F.col("inside"), F.col(f"in_{name}")).otherwise(F.col(f"out_{name}"))
    placed = (lines.join(split_states(lines), ["file", "start"])
              .select("file", "start", "line", "value", (F.col("first") + read("record")).alias("source_row"),
                      read("before").alias("before"), read("after").alias("after"), "open_record")
              .where("source_row is not null").withColumn("open", F.coalesce(F.col("source_row") == F.col("open_record"), F.lit(False)))
              .where("not (open and before)"))  # of a record that never ends the first line is kept
    single = placed.where("open or not (before or after)").select("file", "source_row", F.col("value").alias("record"), "open")
    several = (placed.where("not open and (before or after)").groupBy("file", "source_row")
               .agg(F.array_sort(F.collect_list(F.struct("start", "line", "value"))).alias("l"))
               .select("file", "source_row", F.array_join("l.value", "\n").alias("record"), F.lit(False).alias("open")))
    parsed = single.unionByName(several).mapInArrow(
        parse_records, "file string, source_row long, record string, open boolean, cells array<string>")
    return parsed.withColumnRenamed("file", "_path")


def by_layout(spark: SparkSession, files: list[str]) -> tuple[list[list[str]], DataFrame, DataFrame]:
    """The distinct headers (one per layout), the files, and the records below the headers, both with ``layout``,
    the header's place in that list.

    Records are written once. A listed file without any record is one row with source_row 0 and no layout.
    """
    records = written(read_records(spark, files), "form-records")
    headers = records.where("source_row = 1").select(
        "_path", F.transform(F.coalesce("cells", F.array("record")), lambda c: F.ltrim(c, F.lit("\ufeff"))).alias("header"))
    layouts = sorted(r.header for r in headers.select("header").distinct().collect())
    ids = spark.createDataFrame(list(enumerate(layouts)), "layout int, header array<string>")
    with listed_in_few_tasks(spark):
        found = spark.read.format("binaryFile").load(files)
    listed = found.select(
        F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("source_file"))
    known = (listed.join(headers.join(F.broadcast(ids), "header"), "_path", "left")
             .select("_path", "source_file", "layout", F.size("header").alias("expected")))
    below = records.where("source_row > 1 or open").join(known, "_path")
    empty = known.where("layout is null").withColumn("source_row", F.lit(0).cast("long")).withColumn("open", F.lit(False))
    return layouts, known, below.unionByName(empty, allowMissingColumns=True)


def malformed(rows: DataFrame) -> DataFrame:
    """The side table: records longer or shorter than their header, unreadable and unclosed ones, empty files."""
    n = F.size("cells")
    reason = (F.when(F.col("source_row") == 0, "empty file").when(F.col("open"), "unclosed quote")
              .when(F.col("cells").isNull(), "unreadable").when(n > F.col("expected"), "long").when(n < F.col("expected"), "short"))
    return rows.withColumn("reason", reason).where("reason is not null").select(
        "source_file", "_path", "source_row", "reason", n.alias("cells"), "expected", "record", (F.col("reason") == "short").alias("kept"))


def well_formed(rows: DataFrame) -> DataFrame:
    """The records that fit their header."""
    return rows.where("source_row > 0 and not open and cells is not null and size(cells) <= expected")
