"""C4: landed pages of the three publishers -> quotes, in the layout the monthly job reads.

One quote per (source, day): the central bank's notice before its key chart,
the trading centre's notice, and the portal's table. Ties go to the first
page (for the portal, whose later pages correct earlier ones, to the last).
Every step works per page; only one small row per (source, day) is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.operators import notices as nt

QUOTE = "decimal(18,6)"


def extract_quotes(notices: DataFrame | None = None, charts: DataFrame | None = None,
                   portals: DataFrame | None = None) -> DataFrame:
    """(source, quote_date, rate); page tables have page_id and html, notices also target_date."""
    parts = []
    if notices is not None:
        parsed = nt.parse_notices(notices)
        parts.append(_candidates(parsed, "pbc", 0, "notice_date", "rate_a"))
        parts.append(_candidates(parsed, "cfets", 0, "date_b", "rate_b"))
    if charts is not None:
        day = F.substring("first_cell", 1, 10).try_cast("date")
        parts.append(_candidates(nt.keychart_rows(charts).withColumn("day", day), "pbc", 1, "day", "rate", "row_pos"))
    if portals is not None:
        quotes = nt.portal_quotes(portals).withColumn("last_first", -F.col("page_id"))
        parts.append(_candidates(quotes.drop("page_id").withColumnRenamed("last_first", "page_id"), "safe", 0, "quote_date", "rate"))
    if not parts:
        raise ValueError("no pages given")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    best = F.min(F.struct("rank", "page_id", "pos", "rate")).alias("best")
    return every.groupBy("source", "quote_date").agg(best).select("source", "quote_date", F.col("best.rate").alias("rate"))


def _candidates(df: DataFrame, source: str, rank: int, day: str, rate: str, pos: str | None = None) -> DataFrame:
    return df.where(F.col(day).isNotNull() & F.col(rate).isNotNull()).select(
        F.lit(source).alias("source"), F.col(day).alias("quote_date"), F.lit(rank).alias("rank"), "page_id",
        (F.col(pos) if pos else F.lit(0)).cast("int").alias("pos"), F.col(rate).cast(QUOTE).alias("rate"))
