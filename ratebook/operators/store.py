"""FX rate store: record normalisation, batch merge, range queries.

A batch is merged with ONE join per batch (the reference rewrites the whole
store per record). Stored rows outside the months touched by the batch are
not joined at all: they are selected by partition filter and passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.functions.dates import date_from_year_month, normalize_fetch_ts, parse_store_date
from ratebook.functions.text import blank_to_null, col_, try_cast
from ratebook.operators.mapping import RATES_CSV_ALIASES, alias_columns
from ratebook.operators.ordinal import number_rows
from ratebook.operators.staging import barrier
from ratebook.schemas import RATE, RATES_COLUMNS

KEY = ("base_currency", "quote_currency", "rate_date")
REQUIRED = ("base_currency", "quote_currency", "rate_mid", "rate_date", "fetch_date", "source")


def _text(df: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in df.columns else F.lit(None).cast("string")


def _first_error(checks) -> Column:
    out = F.lit(None).cast("string")
    for cond, message in reversed(checks):
        out = F.when(cond, message).otherwise(out)
    return out


def rate_from_text(c, rounding: str = "half_even") -> Column:
    """X8 (half_even, dict/CSV path) or X9 (half_up, typed records): 4-decimal rate."""
    value = try_cast(blank_to_null(c), "decimal(30,10)")
    rounded = F.bround(value, 4) if rounding == "half_even" else F.round(value, 4)
    return rounded.cast(RATE)


def normalize_records(df: DataFrame, download_url: str | None = None,
                      rounding: str = "half_even") -> DataFrame:
    """Raw text records -> RATES columns plus ``error`` (null when valid).

    Six fields must be non-blank; currencies upper-cased; rate to 4 decimals;
    ISO date (X5); fetch timestamp with offset (X6); year/month from the date
    (X22); blank optional text -> ``""``; ``download_url`` argument wins.
    Built in stages (trim once, parse once) so each stage stays inside
    whole-stage codegen.
    """
    extra = [c for c in df.columns if c not in RATES_COLUMNS]
    trimmed = df.select(*[F.col(c) for c in extra],
                        *[_text(df, c).alias(f"_r_{c}") for c in RATES_COLUMNS],
                        *[blank_to_null(_text(df, c)).alias(f"_t_{c}") for c in RATES_COLUMNS])
    parsed = barrier(trimmed).select("*", rate_from_text(F.col("_t_rate_mid"), rounding).alias("_rate"),
                                     parse_store_date(F.col("_t_rate_date")).alias("_date"))
    fetched = barrier(barrier(parsed).select(
        "*", normalize_fetch_ts(F.col("_t_fetch_date"), F.col("_date")).alias("_fetch")))
    checks = [(F.col(f"_t_{c}").isNull(), F.lit(f"Missing required field: {c}")) for c in REQUIRED]
    checks += [
        (F.col("_rate").isNull(), F.concat(F.lit("Invalid rate_mid: "), F.col("_t_rate_mid"))),
        (F.col("_date").isNull(), F.concat(F.lit("Invalid rate_date: "), F.col("_t_rate_date"))),
        (F.col("_fetch").isNull(), F.concat(F.lit("Invalid fetch_date: "), F.col("_t_fetch_date"))),
    ]
    url = F.lit(download_url) if download_url is not None else F.coalesce(F.col("_t_download_url"), F.lit(""))
    return fetched.select(
        *[F.col(c) for c in extra],
        F.upper(F.col("_r_base_currency")).alias("base_currency"),
        F.upper(F.col("_r_quote_currency")).alias("quote_currency"),
        F.col("_rate").alias("rate_mid"),
        F.col("_date").alias("rate_date"),
        F.col("_fetch").alias("fetch_date"),
        F.col("_r_source").alias("source"),
        F.coalesce(F.col("_t_fallback_strategy"), F.lit("")).alias("fallback_strategy"),
        F.year("_date").alias("year"),
        F.month("_date").alias("month"),
        url.alias("download_url"),
        F.col("_t_created_at").alias("created_at"),
        F.col("_t_updated_at").alias("updated_at"),
        _first_error(checks).alias("error"))


def load_csv_records(df: DataFrame, base: str, quote: str, source: str,
                     fallback: str | None = None) -> DataFrame:
    """S3: historical CSV rows (any alias headers, all text) -> records + ``error``.

    Headers are canonicalised (P1). Rate required (half-even to 4). A missing
    rate_date comes from year-month-01 (X7); fetch_date falls back to the raw
    rate_date. Per-row source and fallback win over the arguments; base and
    quote come only from the arguments.
    """
    c = alias_columns(df, RATES_CSV_ALIASES, keep_unknown=True)
    names = ("rate_mid", "rate_date", "fetch_date", "year", "month", "fallback_strategy", "source", "download_url")
    extra = [x for x in c.columns if x.startswith("_")]
    raw = c.select(*extra, *[_text(c, n).alias(f"_r_{n}") for n in names])
    d = F.col("_r_rate_date")
    y = try_cast(F.col("_r_year"), "int")
    m = try_cast(F.col("_r_month"), "int")
    composed = F.when(y.isNotNull() & m.isNotNull(),
                      F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"),
                               F.lpad(m.cast("string"), 2, "0"), F.lit("-01")))
    f = F.col("_r_fetch_date")
    staged = raw.select("*", F.when(d.isNotNull() & (d != ""), d).otherwise(composed).alias("_date_text"))
    staged = staged.select("*", F.when(f.isNotNull() & (f != ""), f).otherwise(F.col("_date_text")).alias("_fetch_text"),
                           parse_store_date(F.col("_date_text")).alias("_date"),
                           rate_from_text(F.col("_r_rate_mid"), "half_even").alias("_rate"))
    staged = barrier(barrier(staged).select(
        "*", normalize_fetch_ts(F.col("_fetch_text"), F.col("_date")).alias("_fetch")))
    error = _first_error([
        (blank_to_null(F.col("_r_rate_mid")).isNull(), F.lit("rate_mid is required")),
        (F.col("_rate").isNull(), F.concat(F.lit("Invalid rate_mid: "), F.col("_r_rate_mid"))),
        (F.col("_date_text").isNull(), F.lit("CSV row missing rate_date/year/month")),
        (F.col("_date").isNull(), F.concat(F.lit("Invalid rate_date: "), F.col("_date_text"))),
        (F.col("_fetch").isNull(), F.concat(F.lit("Invalid fetch_date: "), F.col("_fetch_text"))),
    ])
    nonempty = lambda x: F.when(x != "", x)  # noqa: E731  (`or` on text: empty -> next)
    return staged.select(
        *extra,
        F.lit(base).alias("base_currency"),
        F.lit(quote).alias("quote_currency"),
        F.col("_rate").alias("rate_mid"),
        F.col("_date").alias("rate_date"),
        F.col("_fetch").alias("fetch_date"),
        F.coalesce(nonempty(F.col("_r_source")), F.lit(source)).alias("source"),
        F.coalesce(nonempty(F.col("_r_fallback_strategy")), F.lit(fallback or "")).alias("fallback_strategy"),
        F.year("_date").alias("year"),
        F.month("_date").alias("month"),
        F.coalesce(F.col("_r_download_url"), F.lit("")).alias("download_url"),
        F.lit(None).cast("string").alias("created_at"),
        F.lit(None).cast("string").alias("updated_at"),
        error.alias("error"))


def require_valid(records: DataFrame) -> DataFrame:
    """Strict mode: fail the job on the first invalid record, before anything is written.

    The check is a filter (not a dropped column), so the optimizer cannot prune it.
    """
    check = F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.lit(True))
    return records.where(check.cast("boolean")).drop("error")


def dedupe_batch(batch: DataFrame, ordinal: str) -> DataFrame:
    """W3 for a batch: per key the last row wins; ``created_at`` is the last one given.

    One aggregate with map-side partial aggregation (no window, no per-key task sort).
    """
    value_cols = [c for c in RATES_COLUMNS if c not in KEY and c != "created_at"]
    # max over (ordinal, values...) picks the last row; struct order compares the ordinal first.
    packed = F.struct(F.col(ordinal).alias("_o"), *[F.col(c) for c in value_cols])
    given = F.col("created_at").isNotNull()
    agg = batch.groupBy(*KEY).agg(
        F.max(packed).alias("_last"),
        F.max(F.when(given, F.struct(F.col(ordinal).alias("_o"), F.col("created_at").alias("v")))).alias("_c"),
        F.count(F.lit(1)).alias("_consumed"))
    return agg.select(*KEY, *[F.col("_last")[c].alias(c) for c in value_cols],
                      F.col("_c.v").alias("created_at"), "_consumed")


def upsert(stored: DataFrame, batch: DataFrame, now: str, ordinal: str = "_ordinal") -> DataFrame:
    """Merge a normalised batch into the stored table by (base, quote, rate_date).

    Matched -> batch row; ``created_at`` = last given in the batch, else the
    stored one; ``updated_at`` = now. New -> created_at given or now,
    updated_at = now. Stored rows of months the batch does not touch are
    passed through without a join.
    """
    b = dedupe_batch(batch, ordinal).drop("_consumed")
    months = b.select("year", "month").distinct()
    touched = stored.join(months, ["year", "month"], "left_semi")
    untouched = stored.join(months, ["year", "month"], "left_anti")
    s = touched.select(*KEY, F.col("created_at").alias("_s_created"), F.lit(True).alias("_in_store"),
                       *[F.col(c).alias(f"_s_{c}") for c in RATES_COLUMNS if c not in KEY + ("created_at",)])
    j = b.withColumn("_in_batch", F.lit(True)).join(s, list(KEY), "full_outer")
    in_batch = F.coalesce(F.col("_in_batch"), F.lit(False))
    exprs = []
    for c in RATES_COLUMNS:
        if c in KEY:
            exprs.append(F.col(c))
        elif c == "created_at":
            exprs.append(F.when(in_batch, F.coalesce(F.col("created_at"), F.col("_s_created"), F.lit(now)))
                         .otherwise(F.col("_s_created")).alias(c))
        elif c == "updated_at":
            exprs.append(F.when(in_batch, F.lit(now)).otherwise(F.col("_s_updated_at")).alias(c))
        else:
            exprs.append(F.when(in_batch, F.col(c)).otherwise(F.col(f"_s_{c}")).alias(c))
    merged = j.select(*exprs)
    return merged.unionByName(untouched.select(*RATES_COLUMNS))


def range_query(df: DataFrame, base: str | None = None, quote: str | None = None,
                start=None, end=None) -> DataFrame:
    """optional equality on upper base / quote; inclusive date bounds (a bound drops
    null dates). Predicates stay on stored columns so they reach the Parquet scan and
    prune (year, month) partitions."""
    preds = []
    if base:
        preds.append(F.col("base_currency") == base.upper())
    if quote:
        preds.append(F.col("quote_currency") == quote.upper())
    if start:
        preds.append(F.col("rate_date") >= F.lit(str(start)).cast("date"))
        preds.append(F.col("year") >= int(str(start)[:4]))
    if end:
        preds.append(F.col("rate_date") <= F.lit(str(end)).cast("date"))
        preds.append(F.col("year") <= int(str(end)[:4]))
    out = df
    for p in preds:
        out = out.where(p)
    return out


def parse_pair(pair: str | None, base: str | None = None, quote: str | None = None) -> tuple:
    """``BASE/QUOTE`` split in exactly two; explicit base / quote override."""
    b = q = None
    if pair:
        parts = pair.split("/")
        if len(parts) != 2:
            raise ValueError("pair must look like BASE/QUOTE")
        b, q = parts[0].strip(), parts[1].strip()
    return (base or b), (quote or q)


def sorted_rates(df: DataFrame) -> DataFrame:
    """O1: ascending rate_date, nulls last; (base, quote) break ties."""
    return df.orderBy(F.asc_nulls_last("rate_date"), "base_currency", "quote_currency")


def sorted_positions(df: DataFrame) -> DataFrame:
    """O1 as a column: ``position`` (from 1) in the ascending order, which survives shuffles and files.

    Rates of one pair and date must be unique, as in the store. Positions come
    from ranges of the whole key, so no task holds the table.
    """
    flagged = df.withColumn("_undated", F.col("rate_date").isNull())
    return number_rows(flagged, ["_undated", "rate_date", "base_currency", "quote_currency"], out="position").drop("_undated")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """O2: first ``n`` rows of the ordered result (a top-n, not a full sort) with 4-decimal rate text."""
    return sorted_rates(df).limit(n).withColumn("rate_mid", F.col("rate_mid").cast(RATE).cast("string"))


def derive_year_month(df: DataFrame) -> DataFrame:
    """Year and month recomputed from rate_date, overriding stored values."""
    return df.withColumn("year", F.year("rate_date")).withColumn("month", F.month("rate_date"))


def fallback_default(value, argument: str | None, empty: str = "") -> Column:
    """Blank -> argument; still missing -> ``empty`` ('' or 'none')."""
    v = blank_to_null(col_(value))
    return F.coalesce(v, F.lit(argument) if argument else F.lit(None).cast("string"), F.lit(empty))


__all__ = ["normalize_records", "load_csv_records", "require_valid", "dedupe_batch", "upsert",
           "range_query", "parse_pair", "sorted_rates", "sorted_positions", "preview", "derive_year_month",
           "fallback_default", "rate_from_text", "date_from_year_month"]
