"""A7 output: per-batch upload reports written as files, one folder per batch.

The reference returns, per batch, lists of succeeded, failed, skipped and
renamed items. Here each batch's items are written as JSON lines under
``batch_id=<id>/`` (the lists), next to one summary row per batch; no batch
is gathered into a single row or task.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.operators.inventory import batch_report


def write_batch_reports(outcomes: DataFrame, out_dir: str) -> dict:
    items = outcomes.select(
        "batch_id",
        F.when(F.col("status") == "uploaded", F.lit("success")).when(F.col("status") == "failed", F.lit("failed"))
        .otherwise(F.lit("skipped")).alias("list"),
        F.coalesce(F.col("final_name"), F.col("requested_name")).alias("name"),
        F.col("requested_name").alias("requested"),
        F.col("reason"),
        F.when((F.col("status") == "uploaded") & F.col("final_name").isNotNull()
               & (F.col("final_name") != F.col("requested_name")), F.col("final_name")).alias("renamed_to"),
        F.col("attempts"))
    items_dir = os.path.join(out_dir, "items")
    items.write.mode("errorifexists").partitionBy("batch_id").json(items_dir)
    summary_dir = os.path.join(out_dir, "summary")
    batch_report(outcomes).write.mode("errorifexists").json(summary_dir)
    return {"items": items_dir, "summary": summary_dir}
