"""Working-day calendar (J9), first business day (X20) and month series.

The calendar is configuration (holidays and make-up workdays): a small
frame, broadcast by size. Month work explodes at most 31 days per month,
so every per-month group is bounded by the calendar, not by data volume.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CALENDAR_SCHEMA = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("kind", T.StringType()),
])


def calendar_frame(spark: SparkSession, holidays=(), workdays=()) -> DataFrame:
    """(day, is_holiday, is_workday), one row per listed day."""
    rows = [(dt.date.fromisoformat(str(d)), "holiday") for d in holidays]
    rows += [(dt.date.fromisoformat(str(d)), "workday") for d in workdays]
    raw = spark.createDataFrame(rows, CALENDAR_SCHEMA)
    return raw.groupBy("day").agg(F.bool_or(F.col("kind") == "holiday").alias("is_holiday"),
                                  F.bool_or(F.col("kind") == "workday").alias("is_workday"))


def rule_calendar(first_year: int = 1990, last_year: int = 2030) -> tuple[list[str], list[str]]:
    """A calendar by rule: 1 Jan, 1 May and 1-3 Oct are holidays; the last Sunday of
    September is a make-up workday."""
    holidays, workdays = [], []
    for y in range(first_year, last_year + 1):
        holidays += [f"{y}-01-01", f"{y}-05-01", f"{y}-10-01", f"{y}-10-02", f"{y}-10-03"]
        d = dt.date(y, 9, 30)
        d -= dt.timedelta(days=(d.weekday() + 1) % 7)
        workdays.append(d.isoformat())
    return holidays, workdays


def with_business_flag(df: DataFrame, day_col: str, calendar: DataFrame, out: str = "is_business") -> DataFrame:
    """Holiday -> no (even if also a workday); weekend -> only when a workday; else yes."""
    cal = calendar.select(F.col("day").alias("_cal_day"), "is_holiday", "is_workday")
    joined = df.join(cal, F.col(day_col) == F.col("_cal_day"), "left")
    weekend = F.dayofweek(F.col(day_col)).isin(1, 7)
    flag = (F.when(F.coalesce(F.col("is_holiday"), F.lit(False)), F.lit(False))
            .when(weekend, F.coalesce(F.col("is_workday"), F.lit(False)))
            .otherwise(F.lit(True)))
    return joined.withColumn(out, flag).drop("_cal_day", "is_holiday", "is_workday")


def month_days(months: DataFrame, month_col: str = "month_start") -> DataFrame:
    """Every calendar day of each month (at most 31 rows per month)."""
    return months.withColumn("day", F.explode(F.sequence(F.col(month_col), F.last_day(F.col(month_col)))))


def first_business_days(months: DataFrame, calendar: DataFrame, month_col: str = "month_start") -> DataFrame:
    """(month_start, first_business_day); null when the month has none."""
    days = with_business_flag(month_days(months.select(month_col).distinct(), month_col), "day", calendar)
    return days.groupBy(month_col).agg(
        F.min(F.when(F.col("is_business"), F.col("day"))).alias("first_business_day"))


def months_between(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Month starts from ``start``'s month to ``end``'s month, with year, month and month end."""
    df = spark.range(1).select(F.explode(F.sequence(
        F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"),
        F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    return with_month_fields(df)


def with_month_fields(df: DataFrame, month_col: str = "month_start") -> DataFrame:
    return (df.withColumn("year", F.year(month_col)).withColumn("month", F.month(month_col))
            .withColumn("month_end", F.last_day(month_col)))


def month_candidates(months: DataFrame, calendar: DataFrame, forward_tries: int = 3,
                     month_col: str = "month_start") -> DataFrame:
    """J6 candidates per month: (month_start, query_date, cand_rank, candidate).

    Rank 0 is the first business day; ranks 1..3 the next business days of the
    month; then every earlier day of the month, nearest first.
    """
    days = with_business_flag(month_days(months.select(month_col).distinct(), month_col), "day", calendar)
    fbd = days.groupBy(month_col).agg(F.min(F.when(F.col("is_business"), F.col("day"))).alias("query_date"))
    d = days.join(fbd.where(F.col("query_date").isNotNull()), month_col)
    after = d.where((F.col("day") > F.col("query_date")) & F.col("is_business"))
    w = Window.partitionBy(month_col).orderBy("day")  # at most 31 rows per month
    after = after.withColumn("cand_rank", F.row_number().over(w)).where(F.col("cand_rank") <= forward_tries)
    first = d.where(F.col("day") == F.col("query_date")).withColumn("cand_rank", F.lit(0))
    before = d.where(F.col("day") < F.col("query_date")).withColumn(
        "cand_rank", F.lit(forward_tries) + F.datediff(F.col("query_date"), F.col("day")))
    cols = [month_col, "query_date", F.col("cand_rank").cast("int").alias("cand_rank"),
            F.col("day").alias("candidate")]
    return first.select(*cols).unionByName(after.select(*cols)).unionByName(before.select(*cols))
