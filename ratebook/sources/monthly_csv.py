"""Read monthly cache CSV files whose first line may or may not be a header.

Files are grouped by layout and each group is projected with one select. A layout
is the headings that name a field, at their places: there are as many as spellings
and orders of the fields, however many files there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.functions.text import strip_unicode
from ratebook.operators.mapping import MONTHLY_ALIASES, alias_lookup, canonical_name
from ratebook.operators.monthly import normalize_monthly
from ratebook.operators.ordinal import last_wins
from ratebook.schemas import MONTHLY_FIELDS
from ratebook.sources.tables import csv_reader


def _headings(cells: Column) -> Column:
    """Of a file's first cells those that name a field, stripped, null elsewhere; null if none does (no header)."""
    known = [*alias_lookup(MONTHLY_ALIASES)]
    named = F.transform(cells, lambda c: F.when(F.lower(strip_unicode(c)).isin(known), strip_unicode(c)))
    return F.when(F.exists(named, lambda c: c.isNotNull()), named)


def _project(rows: DataFrame, headings: list | None) -> DataFrame:
    if headings is None:
        pairs = [(f, i) for i, f in enumerate(MONTHLY_FIELDS)]
    else:
        by_header = {h: i for i, h in enumerate(headings) if h is not None}  # equal header texts: the later column wins
        chosen = {canonical_name(h, MONTHLY_ALIASES, keep_unknown=False): i for h, i in by_header.items()}
        pairs = sorted(chosen.items(), key=lambda kv: kv[1])
    held = [(f, i) for f, i in pairs if f"_c{i}" in rows.columns]
    return rows.select("_ordinal", *[strip_unicode(F.col(f"_c{i}")).alias(f) for f, i in held])


def _width(spark: SparkSession, paths) -> int:
    """An upper bound of the cells of any row: the commas of the widest record, plus one.

    Read as one cell, a record of several is kept whole, with its quoted line breaks.
    """
    whole = csv_reader(spark, header=False).schema("_c0 string, _record string").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_record").csv(paths)
    commas = F.length("_record") - F.length(F.replace("_record", F.lit(","), F.lit("")))
    return (whole.agg(F.max(F.struct(F.coalesce(commas, F.lit(0)).alias("n"), "_c0"))["n"]).first()[0] or 0) + 1


def scan_monthly(spark: SparkSession, paths) -> DataFrame:
    """Monthly records (text, normalised) with last-wins per (year, month).

    The files' first rows are read for headings in Spark; only the distinct
    layouts reach the driver, none of them from a file without a header. A header
    is dropped by its cells, so no row number of another scan is needed.
    """
    names = [f"_c{i}" for i in range(_width(spark, paths))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    raw = (csv_reader(spark, header=False).schema(schema).option("mode", "PERMISSIVE").csv(paths)
           .select(*names, F.col("_metadata.file_path").alias("_file"),
                   F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                            F.monotonically_increasing_id().alias("i")).alias("_ordinal")))
    firsts = raw.groupBy("_file").agg(F.min(F.struct("_ordinal", F.array(*names).alias("cells")))["cells"].alias("_head")).select(
        F.col("_file").alias("_of"), "_head", _headings(F.col("_head")).alias("_headings"))
    tagged = raw.join(firsts, F.col("_file") == F.col("_of"))
    parts = []
    for (headings,) in firsts.select("_headings").distinct().collect():
        if headings is None:
            rows = tagged.where(F.col("_headings").isNull())
        else:
            same = F.col("_headings") == F.array(*[F.lit(h).cast("string") for h in headings])
            rows = tagged.where(same & ~F.array(*names).eqNullSafe(F.col("_head")))
        parts.append(_project(rows, headings))
    if not parts:
        return spark.createDataFrame([], "year string, month string")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    present = [c for c in MONTHLY_FIELDS if c in out.columns]
    non_blank = None
    for c in present:
        cond = F.coalesce(F.col(c) != "", F.lit(False))
        non_blank = cond if non_blank is None else non_blank | cond
    out = out.where(non_blank)
    norm = normalize_monthly(out, extra=("_ordinal",)).where(F.col("error").isNull()).drop("error")
    keyed = norm.withColumn("_y", F.col("year").cast("int")).withColumn("_m", F.col("month").cast("int"))
    return last_wins(keyed, ["_y", "_m"], "_ordinal").drop("_y", "_m", "_ordinal")
