"""Source routing (J7), SAFE forward window (J8) and the monthly lookup.

Quotes are landed data ``(source, quote_date, rate)``; trying sources and
candidate days in order becomes one equi join and one ``min(struct(rank...))``
aggregate per target, which combines map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.functions.dates import first_weekday
from ratebook.schemas import RATE

# Try order of sources per preference.
SOURCE_ORDER = {
    "auto": ("pbc", "cfets", "safe"),
    "pbc": ("pbc", "cfets", "safe"),
    "cfets": ("cfets", "safe"),
    "safe": ("safe",),
}
# The label each source gives its hits.
RATE_SOURCE = {"pbc": "pbc_notice", "cfets": "cfets_notice", "safe": "safe_portal"}
FORWARD_DAYS = 10


def source_order(prefer: str) -> tuple:
    p = (prefer or "auto").lower()
    if p not in SOURCE_ORDER:
        raise ValueError(f"Unsupported prefer-source: {prefer}")
    return SOURCE_ORDER[p]


def forward_window(quotes: DataFrame, months: DataFrame | None = None, source: str = "safe",
                   days: int = FORWARD_DAYS) -> DataFrame:
    """J8 per month: window = first weekday .. +``days``, cut at month end; earliest quote in it.

    Returns (month_start, window_start, window_end, safe_rate, safe_date) for
    months with a hit. Any target day of the month gets this answer.
    """
    q = quotes.where(F.col("source") == source).select("quote_date", "rate") \
        .withColumn("month_start", F.trunc("quote_date", "month"))
    start = first_weekday(F.col("month_start"))
    end = F.least(F.date_add(start, days), F.last_day(F.col("month_start")))
    q = q.withColumn("window_start", start).withColumn("window_end", end)
    q = q.where((F.col("quote_date") >= F.col("window_start")) & (F.col("quote_date") <= F.col("window_end")))
    if months is not None:
        q = q.join(months.select("month_start").distinct(), "month_start", "left_semi")
    # primitive buffers (date, decimal): a hash aggregate with map-side combining
    best = q.groupBy("month_start", "window_start", "window_end").agg(
        F.min("quote_date").alias("safe_date"), F.min_by("rate", "quote_date").alias("_rate"))
    return best.select("month_start", "window_start", "window_end",
                       F.col("_rate").cast(RATE).alias("safe_rate"), "safe_date")


def route(targets: DataFrame, quotes: DataFrame, prefer: str = "auto", group_cols=("target_date",),
          order_cols=()) -> DataFrame:
    """First hit per group over (order_cols..., source rank).

    ``targets`` has ``target_date`` plus the group and order columns. Output:
    group columns, ``request_date`` (the target that hit), rate, source_date,
    rate_source, fallback_used. Groups without any hit are absent.
    """
    order = source_order(prefer)
    t = targets.select("*", F.posexplode(F.array(*[F.lit(s) for s in order])).alias("src_rank", "source"))
    exact = quotes.where(F.col("source").isin("pbc", "cfets")).select(
        F.col("source").alias("_q_source"), F.col("quote_date").alias("_q_date"), F.col("rate").alias("_q_rate"))
    t = t.join(exact, (F.col("source") == F.col("_q_source")) & (F.col("target_date") == F.col("_q_date")), "left")
    if "safe" in order:
        months = t.select(F.trunc("target_date", "month").alias("month_start")).distinct()
        safe = forward_window(quotes, months).select(
            F.col("month_start").alias("_s_month"), "safe_rate", "safe_date")
        t = t.join(safe, (F.col("source") == "safe") & (F.trunc("target_date", "month") == F.col("_s_month")), "left")
    else:
        t = t.withColumn("safe_rate", F.lit(None).cast(RATE)).withColumn("safe_date", F.lit(None).cast("date"))
    rate = F.when(F.col("source") == "safe", F.col("safe_rate")).otherwise(F.col("_q_rate"))
    sdate = F.when(F.col("source") == "safe", F.col("safe_date")).otherwise(F.col("_q_date"))
    hits = t.withColumn("_rate", rate).withColumn("_sdate", sdate).where(F.col("_rate").isNotNull())
    # The try order is one long: (order columns..., source rank). min / min_by over it keep
    # every aggregation buffer primitive, so this is a hash aggregate combined map-side.
    rank = F.col("src_rank").cast("long")
    for c in reversed(order_cols):
        rank = rank + F.col(c).cast("long") * F.lit(len(order))
    best = hits.withColumn("_rank", rank).groupBy(*group_cols).agg(
        F.min("_rank").alias("_rank"), F.min_by("target_date", "_rank").alias("request_date"),
        F.min_by("_rate", "_rank").alias("rate"), F.min_by("_sdate", "_rank").alias("source_date"))
    src_rank = (F.col("_rank") % F.lit(len(order))).cast("int")
    source = F.element_at(F.array(*[F.lit(s) for s in order]), src_rank + 1)
    label = F.create_map(*[x for k, v in RATE_SOURCE.items() for x in (F.lit(k), F.lit(v))])
    fallback = (F.when((source == "safe") & (F.col("source_date") != F.col("request_date")), F.lit("forward"))
                .when(src_rank == 0, F.lit("none"))
                .otherwise(source))
    return best.select(*group_cols, "request_date", F.col("rate").cast(RATE).alias("rate"), "source_date",
                       label[source].alias("rate_source"), fallback.alias("fallback_used"))


def monthly_lookup(months: DataFrame, quotes: DataFrame, calendar: DataFrame, prefer: str = "auto") -> DataFrame:
    """J6 + J7: one monthly rate per month from the first business day with date and source fallbacks.

    Output: year, month, query_date, request_date, mid_rate (half-up 4),
    source_date, rate_source, fallback_used; months without a hit are absent.
    """
    from ratebook.operators.calendar import month_candidates
    cands = month_candidates(months, calendar)
    targets = cands.select("month_start", "query_date", "cand_rank", F.col("candidate").alias("target_date"))
    hit = route(targets, quotes, prefer, group_cols=("month_start", "query_date"), order_cols=("cand_rank",))
    return hit.select(F.year("month_start").alias("year"), F.month("month_start").alias("month"),
                      "query_date", "request_date", F.round("rate", 4).cast(RATE).alias("mid_rate"),
                      "source_date", "rate_source", "fallback_used")


def require_usd_cny(from_ccy: str, to_ccy: str) -> None:
    """The published mid rates are USD/CNY only; other pairs are an error."""
    if (from_ccy.upper(), to_ccy.upper()) != ("USD", "CNY"):
        raise NotImplementedError("only USD/CNY mid rates are published")


def single_rate(dates: DataFrame, quotes: DataFrame, from_ccy: str = "USD", to_ccy: str = "CNY",
                prefer: str = "auto") -> DataFrame:
    """Rate for a table of dates at once (``target_date``), routed by preference."""
    require_usd_cny(from_ccy, to_ccy)
    return route(dates, quotes, prefer)
