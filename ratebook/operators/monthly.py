"""Monthly USD/CNY cache: text records keyed by (year, month).

Records stay text (the cache's own form), so "changed" compares exactly
what the file holds. One row per month: every per-key group here is
bounded by the calendar.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ratebook.functions.text import blank_to_null, strip_unicode, try_cast
from ratebook.operators.mapping import MONTHLY_ALIASES
from ratebook.operators.ordinal import number_rows
from ratebook.schemas import MONTHLY_FIELDS, MONTHLY_OUTPUT_HEADER


def _field(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def normalize_monthly(df: DataFrame, extra=()) -> DataFrame:
    """Canonical keys (unknown dropped), text stripped, year as integer text,
    two-digit month, empty query_date <- source_date, empty fallback <- ``none``.
    Rows with missing or non-integer year/month get ``error``."""
    keep = [c for c in extra if c in df.columns]
    chosen = _chosen(df.drop(*keep))
    c = df.select(*[F.col(k) for k in keep], *[F.col(f"`{raw}`").alias(name) for name, raw in chosen.items()])
    y = try_cast(strip_unicode(_field(c, "year")), "int")
    m = try_cast(strip_unicode(_field(c, "month")), "int")
    text = {f: F.coalesce(blank_to_null(_field(c, f)), F.lit("")) for f in MONTHLY_FIELDS}
    query = F.when(text["query_date"] == "", text["source_date"]).otherwise(text["query_date"])
    fallback = F.when(text["fallback_used"] == "", F.lit("none")).otherwise(text["fallback_used"])
    return c.select(
        *keep,
        y.cast("string").alias("year"),
        F.lpad(m.cast("string"), 2, "0").alias("month"),
        text["mid_rate"].alias("mid_rate"),
        query.alias("query_date"),
        text["source_date"].alias("source_date"),
        text["rate_source"].alias("rate_source"),
        fallback.alias("fallback_used"),
        F.when(y.isNull() | m.isNull(), F.lit("missing or invalid year/month")).alias("error"))


def _chosen(df: DataFrame) -> dict:
    from ratebook.operators.mapping import canonical_name
    chosen = {}
    for raw in df.columns:
        name = canonical_name(raw, MONTHLY_ALIASES, keep_unknown=False)
        if name is not None:
            chosen[name] = raw
    return chosen


def result_rows(results: DataFrame) -> DataFrame:
    """Monthly lookup results -> cache text rows (4-decimal half-up rate, ISO dates)."""
    return results.select(
        F.col("year").cast("string").alias("year"),
        F.lpad(F.col("month").cast("string"), 2, "0").alias("month"),
        F.round("mid_rate", 4).cast("decimal(18,4)").cast("string").alias("mid_rate"),
        F.date_format("query_date", "yyyy-MM-dd").alias("query_date"),
        F.date_format("source_date", "yyyy-MM-dd").alias("source_date"),
        F.col("rate_source"),
        F.coalesce(F.col("fallback_used"), F.lit("none")).alias("fallback_used"))


def key_cols(df: DataFrame) -> DataFrame:
    return df.withColumn("_y", F.col("year").cast("int")).withColumn("_m", F.col("month").cast("int"))


def upsert_monthly(existing: DataFrame, batch: DataFrame, ordinal: str = "_ordinal") -> tuple[DataFrame, DataFrame]:
    """J2 + A5: merge normalised rows by (year, month), whole-record replace.

    Returns (table, stats). stats = consumed rows, changed rows (a row differs
    from the key's state just before it: the previous batch row of that key,
    else the stored record), total rows after the merge.
    """
    rec = list(MONTHLY_FIELDS)
    none = F.lit(None).cast(batch.schema[ordinal].dataType)
    old = key_cols(existing).select("_y", "_m", F.lit(0).alias("_new"), none.alias("_o"), F.struct(*rec).alias("_rec"))
    new = key_cols(batch).select("_y", "_m", F.lit(1).alias("_new"), F.col(ordinal).alias("_o"), F.struct(*rec).alias("_rec"))
    w = Window.partitionBy("_y", "_m").orderBy("_new", "_o")  # the stored record, then one month's batch rows
    rows = old.unionByName(new).select("*", F.lag("_rec").over(w).alias("_before"),
                                       F.lead("_new").over(w).isNull().alias("_last"))
    changed = (F.col("_new") == 1) & ~F.col("_before").eqNullSafe(F.col("_rec"))
    stats = rows.agg(F.coalesce(F.sum("_new"), F.lit(0)).cast("bigint").alias("consumed"),
                     F.count_if(changed).alias("changed"), F.count_if("_last").alias("total_rows"))
    table = rows.where("_last").orderBy("_y", "_m").select(*[F.col(f"_rec.{f}").alias(f) for f in rec])
    return table, stats


def months_in_range(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    from ratebook.operators.calendar import months_between
    return months_between(spark, start.isoformat(), end.isoformat()).select("year", "month", "month_start")


def missing_months(spark: SparkSession, existing: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Months of [start, end] without a stored record."""
    have = key_cols(existing).select(F.col("_y").alias("year"), F.col("_m").alias("month"))
    return months_in_range(spark, start, end).join(have, ["year", "month"], "left_anti")


def parse_month(text: str) -> dt.date:
    try:
        d = dt.datetime.strptime(text, "%Y-%m")
    except ValueError as exc:
        raise ValueError(f"month must be formatted as YYYY-MM: {text}") from exc
    return dt.date(d.year, d.month, 1)


def months_to_process(spark: SparkSession, existing: DataFrame, start: str, end: str | None = None,
                      refresh=(), rebuild: bool = False, today: dt.date | None = None) -> DataFrame:
    """(missing months, or all if rebuild) union refresh months, distinct, with checks on the range."""
    current = (today or dt.date.today()).replace(day=1)
    s = parse_month(start)
    e = parse_month(end) if end else current
    if s > current:
        raise ValueError("start month cannot be in the future")
    if e > current:
        raise ValueError("end month cannot be in the future")
    if s > e:
        raise ValueError("start month cannot exceed end month")
    base = months_in_range(spark, s, e) if rebuild else missing_months(spark, existing, s, e)
    refresh_rows = [(d.year, d.month) for d in (parse_month(r) for r in refresh)]
    out = base.select("year", "month")
    if refresh_rows:
        out = out.unionByName(spark.createDataFrame(refresh_rows, "year int, month int"))
    return out.distinct().withColumn("month_start", F.make_date("year", "month", F.lit(1)))


def pending_report(requested: DataFrame, results: DataFrame, prefer: str = "auto") -> DataFrame:
    """A4: each requested month as success or pending (with the reason); the run goes on."""
    r = results.select("year", "month", F.lit(True).alias("_hit"))
    j = requested.select("year", "month").join(r, ["year", "month"], "left")
    reason = F.concat(F.lit("USD/CNY rate unavailable for "), F.col("year").cast("string"), F.lit("-"),
                      F.lpad(F.col("month").cast("string"), 2, "0"))
    return j.select("year", "month",
                    F.when(F.col("_hit"), F.lit("success")).otherwise(F.lit("pending")).alias("status"),
                    F.when(F.col("_hit").isNull(), reason).alias("reason"),
                    F.lit(prefer).alias("prefer_source"))


def month_positions(table: DataFrame) -> DataFrame:
    """O3 as a column: ``position`` (from 1) of each month in ascending order; months are unique, as in the cache."""
    keyed = table.withColumn("_y", F.col("year").cast("int")).withColumn("_m", F.col("month").cast("int"))
    return number_rows(keyed, ["_y", "_m"], out="position").drop("_y", "_m")


def to_output(table: DataFrame) -> DataFrame:
    """K2 projection: the seven Chinese headers in canonical order, ordered by (year, month)."""
    return (table.orderBy(F.col("year").cast("int"), F.col("month").cast("int"))
            .select(*[F.col(f).alias(MONTHLY_OUTPUT_HEADER[f]) for f in MONTHLY_FIELDS]))


def monthly_typed(table: DataFrame) -> DataFrame:
    """The cache's text rows as the typed ``MONTHLY`` schema (int year/month, DECIMAL rate, dates)."""
    from ratebook.schemas import MONTHLY
    return table.select(
        try_cast(F.col("year"), "int").alias("year"), try_cast(F.col("month"), "int").alias("month"),
        try_cast(F.col("mid_rate"), "decimal(18,4)").alias("mid_rate"),
        try_cast(F.col("query_date"), "date").alias("query_date"),
        try_cast(F.col("source_date"), "date").alias("source_date"),
        F.col("rate_source"), F.col("fallback_used")).select(*[f.name for f in MONTHLY.fields])
