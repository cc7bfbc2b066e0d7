"""Form files (S1, S7, P6 for CSV): many files, many header layouts.

One CSV read over files with different headers would apply one file's
header to all, so records are read first (``sources/records.py``) and grouped
by the header of their file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.sources import records
from ratebook.sources.tables import NA_TOKENS


def expand_paths(spark: SparkSession, patterns) -> list[str]:
    """Expand glob patterns; a pattern without match is an error; directories and
    hidden files (``_SUCCESS``, ``.crc``: names starting with ``_`` or ``.``, as Spark's
    readers skip them) are skipped; resolved paths are deduplicated in order."""
    return [path for path, _ in _listed(spark, patterns)]


def _listed(spark: SparkSession, patterns) -> list[tuple[str, int]]:
    """(path, length) of the files, from one listing per pattern."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen, out = set(), []
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        fs = path.getFileSystem(conf)
        matches = fs.globStatus(path)
        if matches is None or len(matches) == 0:
            raise FileNotFoundError(f"no input matches: {pattern}")
        for st in sorted(matches, key=lambda s: s.getPath().toString()):
            if st.isDirectory() or st.getPath().getName()[:1] in ("_", "."):
                continue
            p = st.getPath().toString()
            if p not in seen:
                seen.add(p)
                out.append((p, st.getLen()))
    return out


def header_names(cells: list[str]) -> list[str]:
    """The columns of a header's cells; a repeated name gets ``.1``, ``.2``, as a pandas read names it."""
    taken: set[str] = set()
    out = []
    for i, cell in enumerate(cells):
        base = cell or f"Unnamed: {i}"
        name = next(n for n in (base, *(f"{base}.{k}" for k in range(1, len(cells) + 1))) if n not in taken)
        taken.add(name)
        out.append(name)
    return out


def read_form_group(rows: DataFrame, layout: int, header: list[str]) -> DataFrame:
    """The records of one layout, all text; pandas' NA tokens become null;
    lineage: source_file (name) and source_row (the record's place in its file, the header being 1)."""
    cell = [F.get("cells", F.lit(i)) for i in range(len(header))]
    cells = [F.when(~c.isin(list(NA_TOKENS)), c).alias(name) for c, name in zip(cell, header_names(header), strict=True)]
    return records.well_formed(rows.where(F.col("layout") == layout)).select(*cells, "_path", "source_file", "source_row")


def read_parquet_group(spark: SparkSession, files: list[str]) -> DataFrame:
    """Parquet forms sharing one schema; source_row from the physical row index (+2)."""
    df = spark.read.parquet(*files)
    cols = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    return df.select(*cols, F.col("_metadata.file_path").alias("_path"),
                     F.col("_metadata.file_name").alias("source_file"),
                     (F.col("_metadata.row_index") + 2).alias("source_row"))


@dataclass
class FormScan:
    """``groups``: (file names, frame) per distinct header; ``malformed``: records that do not fit their header,
    with place and reason (null without CSV files). A frame's rows and the malformed ones not kept add up to the files' records."""

    groups: list[tuple[tuple[str, ...], DataFrame]]
    malformed: DataFrame | None


def scan_forms(spark: SparkSession, patterns) -> list[tuple[tuple[str, ...], DataFrame]]:
    """The groups of ``read_forms``; map each with P3 and union."""
    return read_forms(spark, patterns).groups


def read_forms(spark: SparkSession, patterns) -> FormScan:
    """S1 with its side table.

    The suffix picks the reader: CSV files are grouped by header; Parquet files
    by schema (read from each footer on the driver); any other suffix is an error.
    """
    listed = _listed(spark, patterns)
    files = [f for f, _ in listed]
    if not files:
        raise ValueError("no input files provided")
    text = [(f, n) for f, n in listed if f.lower().endswith(".csv")]
    pq = [f for f in files if f.lower().endswith(".parquet")]
    other = [f for f in files if not f.lower().endswith((".csv", ".parquet"))]
    if other:
        raise ValueError(f"unsupported input file: {other[0]}")
    out, odd = [], None
    if text:
        scan = read_csv_forms(spark, [f for f, n in text if n], [f for f, n in text if not n])
        out, odd = scan.groups, scan.malformed
    if pq:
        by_schema: dict[str, list[str]] = {}
        for f in pq:
            by_schema.setdefault(spark.read.parquet(f).schema.simpleString(), []).append(f)
        out += [(_names(fs), read_parquet_group(spark, fs)) for _, fs in sorted(by_schema.items())]
    return FormScan(out, odd)


def read_csv_forms(spark: SparkSession, files: list[str], empty: list[str] = ()) -> FormScan:
    """The groups of CSV files by their headers; ``empty`` files have no bytes."""
    nothing = spark.createDataFrame([(f.rsplit("/", 1)[-1], f, 0, "empty file", False) for f in empty],
                                    "source_file string, _path string, source_row long, reason string, kept boolean")
    if not files:
        return FormScan([], nothing)
    layouts, known, rows = records.by_layout(spark, files)
    odd = records.malformed(rows).unionByName(nothing, allowMissingColumns=True)
    # the driver has listed these files itself; each layout's names go into the reports
    named = known.where("layout is not null").groupBy("layout").agg(F.array_sort(F.collect_list("source_file")).alias("names"))
    names = {r.layout: tuple(r.names) for r in named.collect()}
    return FormScan([(names[i], read_form_group(rows, i, header)) for i, header in enumerate(layouts)], odd)


def _names(files: list[str]) -> tuple[str, ...]:
    return tuple(sorted(f.rsplit("/", 1)[-1] for f in files))
