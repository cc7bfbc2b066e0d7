"""Rate extraction from landed HTML (C4): notices, key chart, portal tables, links.

Each page is one row; every step is a column expression or an explode of a
page's own rows/anchors, so work splits by page and never gathers pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratebook.functions.dates import parse_table_date
from ratebook.functions.html import (NOTICE_RATE_PATTERN, anchors, extract_group, first_table, locate_column,
                                     notice_date, notice_rate, page_text, resolve_url, table_rows)
from ratebook.functions.text import strip_unicode, try_cast
from ratebook.operators.staging import barrier
from ratebook.schemas import RATE

SNAPSHOT_BYTES = 200_000  # fixed value: size cap of a stored page snapshot
# Header keywords of the portal table.
DATE_HEADER_KEYWORDS = ("日期",)
USD_HEADER_KEYWORDS = ("美元", "usd")


def snapshot(pages: DataFrame, limit: int = SNAPSHOT_BYTES) -> DataFrame:
    """Landed pages with the stored snapshot cut to ``limit`` bytes of UTF-8."""
    raw = F.encode(F.col("html"), "UTF-8")
    cut = F.substring(raw, 1, limit)
    return pages.select("page_id", "url", F.octet_length(raw).alias("html_bytes"),
                        F.octet_length(cut).alias("snapshot_bytes"), cut.alias("snapshot"))


def parse_notices(notices: DataFrame) -> DataFrame:
    """Both notice readings per page.

    Variant A (central bank): text joined by '，'; date or null; rate as written or null.
    Variant B (trading centre): text joined by ' '; rate needs 4 decimals (half-up 4);
    no date -> the requested date.
    """
    a_text = page_text(F.col("html"), "，")
    b_text = page_text(F.col("html"), " ")
    staged = notices.select("page_id", "target_date", a_text.alias("_a"), b_text.alias("_b"))
    return staged.select(
        "page_id", "target_date",
        notice_date(F.col("_a")).alias("notice_date"),
        notice_rate(F.col("_a")).alias("rate_a"),
        F.round(notice_rate(F.col("_b"), four_decimals=True), 4).cast(RATE).alias("rate_b"),
        F.coalesce(notice_date(F.col("_b")), F.col("target_date")).alias("date_b"))


def keychart_rows(pages: DataFrame) -> DataFrame:
    """Rows of each page's first table: (page_id, row_pos, first_cell, rate).

    ``rate`` is the first later cell matching the rate sentence (null when none).
    """
    rows = pages.select("page_id", F.posexplode(table_rows(first_table(F.col("html")))).alias("row_pos", "cells"))
    later = F.filter(F.slice(F.col("cells"), 2, F.size("cells")), lambda c: c.rlike(NOTICE_RATE_PATTERN))
    return rows.select(
        "page_id", "row_pos", F.col("cells")[0].alias("first_cell"),
        try_cast(extract_group(F.try_element_at(later, F.lit(1)), NOTICE_RATE_PATTERN, 1), "decimal(18,6)").alias("rate"))


def keychart_lookup(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """X16 per target day: the first row (page, row order) whose first cell starts with the
    ISO date and that has a rate cell. Equi join on the 10-character date prefix."""
    rows = keychart_rows(pages).withColumn("_prefix", F.substring("first_cell", 1, 10))
    t = targets.select("target_date", F.date_format("target_date", "yyyy-MM-dd").alias("_prefix"))
    hit = t.join(rows.where(F.col("rate").isNotNull()), "_prefix")
    first = F.min(F.struct("page_id", "row_pos", "rate")).alias("_f")
    return hit.groupBy("target_date").agg(first).select("target_date", F.col("_f.rate").alias("rate"))


def notice_then_chart(targets: DataFrame, notices: DataFrame, chart_pages: DataFrame,
                      from_ccy: str = "USD", to_ccy: str = "CNY") -> DataFrame:
    """Exact day only - first notice (link order) dated that day with a rate, else the
    key chart row, else a miss. Returns every target with rate/source_date/rate_source.
    USD/CNY only."""
    from ratebook.operators.routing import require_usd_cny
    require_usd_cny(from_ccy, to_ccy)
    parsed = parse_notices(notices).where(F.col("notice_date").isNotNull() & F.col("rate_a").isNotNull())
    first = parsed.groupBy(F.col("notice_date").alias("target_date")).agg(
        F.min_by("rate_a", "page_id").alias("_notice"))
    chart = keychart_lookup(targets, chart_pages).withColumnRenamed("rate", "_chart")
    j = targets.select("target_date").join(first, "target_date", "left").join(chart, "target_date", "left")
    rate = F.coalesce(F.col("_notice"), F.col("_chart"))
    src = F.when(F.col("_notice").isNotNull(), F.lit("pbc_notice")).when(F.col("_chart").isNotNull(),
                                                                        F.lit("pbc_keychart"))
    return j.select("target_date", rate.cast("decimal(18,6)").alias("rate"),
                    F.when(rate.isNotNull(), F.col("target_date")).alias("source_date"), src.alias("rate_source"))


def portal_tables(pages: DataFrame) -> DataFrame:
    """X15 + A6: parsed data rows of table ``InfoTable`` per page, with the per-100 decision.

    Date column = first header cell containing 日期, USD column = first containing
    美元 or usd; short rows, blank cells, bad dates or numbers are skipped. Per
    100 when the USD header holds '100' (or '每100'), when any parsed rate is at
    least 50, or when the page text holds '每100' or '100美元'. All of it is
    computed on each page's own row array: no shuffle between pages.
    """
    t = pages.select("page_id", table_rows(first_table(F.col("html"), "InfoTable")).alias("_rows"),
                     page_text(F.col("html"), " ").alias("_text"))
    t = t.where(F.size("_rows") > 1).select(
        "page_id", "_text", F.col("_rows")[0].alias("header"),
        F.slice(F.col("_rows"), 2, F.size("_rows")).alias("data"))
    t = t.withColumn("date_idx", locate_column(F.col("header"), DATE_HEADER_KEYWORDS)) \
         .withColumn("usd_idx", locate_column(F.col("header"), USD_HEADER_KEYWORDS))
    t = barrier(t.where(F.col("date_idx").isNotNull() & F.col("usd_idx").isNotNull()))
    need = F.greatest("date_idx", "usd_idx")

    def parse_row(cells, pos):
        ok = F.size(cells) > need
        d = F.when(ok, strip_unicode(F.element_at(cells, F.col("date_idx") + 1)))
        u = F.when(ok, strip_unicode(F.element_at(cells, F.col("usd_idx") + 1)))
        return F.struct(pos.alias("row_pos"),
                        F.when(u != "", parse_table_date(F.nullif(d, F.lit("")))).alias("quote_date"),
                        F.when(d != "", try_cast(F.replace(u, F.lit(","), F.lit("")), "decimal(30,10)"))
                        .alias("raw_rate"))

    parsed = F.filter(F.transform("data", parse_row),
                      lambda r: r["quote_date"].isNotNull() & r["raw_rate"].isNotNull())
    usd_head = F.element_at("header", F.col("usd_idx") + 1)
    per100 = (F.contains(F.lower(usd_head), F.lit("100")) | F.contains(usd_head, F.lit("每100"))
              | F.exists(parsed, lambda r: r["raw_rate"] >= 50)
              | F.contains("_text", F.lit("每100")) | F.contains("_text", F.lit("100美元")))
    t = t.select("page_id", parsed.alias("_parsed"), per100.alias("per100"))
    return t.select("page_id", "per100", F.inline("_parsed"))


def portal_quotes(pages: DataFrame) -> DataFrame:
    """X19 + W3: (page_id, quote_date, rate): per-100 divided, half-up 4; a later row of
    the same date on a page replaces an earlier one."""
    rows = portal_tables(pages)
    scaled = F.round(F.when(F.col("per100"), F.col("raw_rate") / F.lit(100)).otherwise(F.col("raw_rate")), 4)
    rows = rows.withColumn("rate", scaled.cast(RATE))
    return rows.groupBy("page_id", "quote_date").agg(F.max_by("rate", "row_pos").alias("rate"))


def page_links(pages: DataFrame) -> DataFrame:
    """Every anchor with text and href, URL resolved against the page URL."""
    a = pages.select("page_id", "url", F.explode(anchors(F.col("html"))).alias("a"))
    return a.select("page_id", F.col("a.pos").alias("pos"), F.col("a.text").alias("text"),
                    F.col("a.href").alias("href"), resolve_url(F.col("url"), F.col("a.href")).alias("link"))


def rate_links(pages: DataFrame, keyword: str) -> DataFrame:
    """anchors with non-empty text and href whose text contains ``keyword``."""
    links = page_links(pages)
    return links.where((F.col("text") != "") & (F.col("href") != "") & F.contains("text", F.lit(keyword)))


def first_seen_links(links: DataFrame) -> DataFrame:
    """Unique URLs, each with its first (page_id, pos).

    The smallest (page_id, pos) is kept, combined map-side, also for a URL
    that a third of all pages link to. Page ids may be of any ordered type.
    """
    first = links.groupBy("link").agg(F.min(F.struct("page_id", "pos")).alias("_f"))
    return first.select("link", F.col("_f.page_id").alias("page_id"), F.col("_f.pos").alias("pos"))
