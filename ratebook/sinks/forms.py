"""Form outputs (K3-K6): export, rejects, need-confirm, report.

``write_outcomes`` writes the validated frame once, partitioned by status;
every export is then a partition-pruned read of that table, so the frame is
neither recomputed nor cached for its three consumers.
"""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.schemas import EXPORT_COLUMNS


def _joined_issues(df: DataFrame) -> DataFrame:
    if "issues" in df.columns and isinstance(df.schema["issues"].dataType, T.ArrayType):
        return df.withColumn("issues", F.array_join("issues", "; "))
    return df


def export_frame(processed: DataFrame) -> DataFrame:
    """K3: accepted rows in the fixed export column order; absent columns null; lists joined."""
    acc = processed.where(F.col("status") == "ok")
    cols = set(acc.columns)
    exprs = []
    for c in EXPORT_COLUMNS:
        if c not in cols:
            exprs.append(F.lit(None).cast("string").alias(c))
        elif isinstance(acc.schema[c].dataType, T.ArrayType):
            exprs.append(F.array_join(c, "; ").alias(c))
        else:
            exprs.append(F.col(c))
    return acc.select(*exprs)


def rejects_frame(processed: DataFrame) -> DataFrame:
    """K4: rejected rows, all columns, issues joined with ``; ``."""
    return _joined_issues(processed.where(F.col("status") != "ok"))


def confirm_frame(processed: DataFrame) -> DataFrame:
    """K5: accepted rows flagged for confirmation, issues joined."""
    return _joined_issues(processed.where((F.col("status") == "ok") & F.col("need_confirm")))


REPORT_SCHEMA = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("item", T.StringType()),
    T.StructField("value", T.LongType()),
])


def report_frame(spark: SparkSession, result) -> DataFrame:
    """K6: outcome counts (one aggregate) plus per-file missing / unmapped columns."""
    p = result.processed
    ok = F.col("status") == "ok"
    counts = p.agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"),
                   F.count_if(ok & F.col("need_confirm")).alias("need_confirm"))
    counts = counts.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("item"), F.col(n).alias("value"))
        for n in ("accepted", "rejected", "need_confirm")])).alias("x"))
    counts = counts.select(F.lit("outcome").alias("section"), F.lit(None).cast("string").alias("file"),
                           "x.item", "x.value")
    diag_rows = []
    for name, res in result.diagnostics:
        diag_rows += [("missing_column", name, c, None) for c in res.missing]
        diag_rows += [("unmapped_column", name, c, None) for c in res.unmatched]
    diags = spark.createDataFrame(diag_rows, REPORT_SCHEMA)
    return counts.unionByName(diags)


#: Fixed texts of the report, by the section or item they show.
REPORT_TITLE = "# Form Processing Report"
REPORT_COUNTS = {"accepted": "- Accepted rows: {}", "rejected": "- Rejected rows: {}", "need_confirm": "- Need confirm rows: {}"}
REPORT_FILES = "## Mapping diagnostics"
REPORT_FILE = "- **{}**"
REPORT_COLUMNS = {"missing_column": "  - Missing columns: {}", "unmapped_column": "  - Unmapped source columns: {}"}


def report_text(rows: list[tuple]) -> str:
    """The rows of ``report_frame`` as a text: counts, then each file with its columns."""
    counts = {item: value for section, _, item, value in rows if section == "outcome"}
    columns: dict[str, dict[str, list[str]]] = {}
    for section, file, item, _ in rows:
        if section in REPORT_COLUMNS:
            columns.setdefault(file, {}).setdefault(section, []).append(item)
    blocks = [[REPORT_TITLE], [line.format(counts[item]) for item, line in REPORT_COUNTS.items()]]
    if columns:
        blocks.append([REPORT_FILES, *(line for file, found in columns.items() for line in (
            REPORT_FILE.format(file), *(REPORT_COLUMNS[s].format(", ".join(found[s])) for s in REPORT_COLUMNS if s in found)))])
    return "\n\n".join("\n".join(block) for block in blocks) + "\n"


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file on whatever file system the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def write_outcomes(result, out_dir: str) -> dict:
    """Write processed rows once (partitioned by status), then exports from that table."""
    spark = result.processed.sparkSession
    table_dir = os.path.join(out_dir, "processed")
    result.processed.write.mode("overwrite").partitionBy("status").parquet(table_dir)
    stored = spark.read.parquet(table_dir)
    row = stored.agg(F.count_if(F.col("status") == "ok").alias("accepted"),
                     F.count_if(F.col("status") != "ok").alias("rejected"),
                     F.count_if((F.col("status") == "ok") & F.col("need_confirm")).alias("need_confirm")).first()
    counts = row.asDict()
    if counts["accepted"] + counts["rejected"] == 0:
        raise ValueError("no data rows found in inputs")
    paths = {"processed": table_dir}
    export_frame(stored).write.mode("overwrite").option("escape", "\"").option("header", True).csv(
        os.path.join(out_dir, "processed_forms_export"))
    paths["export"] = os.path.join(out_dir, "processed_forms_export")
    if counts["rejected"]:
        paths["rejects"] = os.path.join(out_dir, "processed_forms_rejects")
        rejects_frame(stored).write.mode("overwrite").option("escape", "\"").option("header", True).csv(paths["rejects"])
    if counts["need_confirm"]:
        paths["need_confirm"] = os.path.join(out_dir, "processed_forms_need_confirm")
        confirm_frame(stored).write.mode("overwrite").option("escape", "\"").option("header", True).csv(paths["need_confirm"])
    paths["report"] = os.path.join(out_dir, "processed_forms_report.md")
    rows = [tuple(r) for r in report_frame(spark, replace(result, processed=stored)).collect()]
    _write_text(spark, paths["report"], report_text(rows))
    paths["counts"] = counts
    return paths
