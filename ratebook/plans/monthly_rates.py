"""C2 build_monthly_rates: months to process -> monthly lookup -> pending report -> merge -> write."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.monthly import (months_to_process, normalize_monthly, pending_report, result_rows,
                                        upsert_monthly)
from ratebook.operators.routing import monthly_lookup
from ratebook.operators.staging import written


@dataclass
class MonthlyBuild:
    table: DataFrame
    report: DataFrame
    stats: DataFrame


def build_monthly_rates(spark: SparkSession, existing: DataFrame, quotes: DataFrame, calendar: DataFrame,
                        start: str, end: str | None = None, refresh=(), rebuild: bool = False,
                        prefer: str = "auto", today: dt.date | None = None) -> MonthlyBuild:
    """The whole monthly job; ``existing`` is the scanned cache.

    The cache, the months and their results are calendar-sized and read by
    several branches, so each is written once and the branches read tables.
    """
    existing = spark.createDataFrame([], existing.schema) if rebuild else written(existing, "monthly-existing")
    todo = written(months_to_process(spark, existing, start, end, refresh, rebuild, today), "monthly-todo")
    results = written(monthly_lookup(todo, quotes, calendar, prefer), "monthly-results")
    report = pending_report(todo, results, prefer)
    rows = result_rows(results).withColumn(
        "_ordinal", F.col("year").cast("int") * 100 + F.col("month").cast("int"))
    batch = normalize_monthly(rows, extra=("_ordinal",)).drop("error")
    table, stats = upsert_monthly(existing, batch)
    return MonthlyBuild(table, report, stats)
