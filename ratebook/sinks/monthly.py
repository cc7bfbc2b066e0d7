"""K2: write the monthly cache as one CSV with the seven Chinese headers.

The cache holds one row per month (bounded by the calendar), so a single
output file is written on purpose. The file goes to a new folder; the
previous output is never overwritten while it may be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ratebook.operators.monthly import to_output


def write_monthly(table: DataFrame, path: str) -> str:
    (to_output(table).coalesce(1).write.mode("errorifexists")
     .option("escape", "\"").option("header", True).option("encoding", "UTF-8").csv(path))
    return path
