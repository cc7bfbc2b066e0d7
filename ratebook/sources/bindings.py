"""Views of the engine's inputs derived from the shared test tables.

The test tables hold no fee forms or FX rates, so forms and rates are
derived from ``orders`` with fixed rules; the DuckDB oracle derives the
same views with the same rules (``oracles.py``). Every derived view
grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.ordinal import number_rows
from ratebook.schemas import RATE

# Currency of each order status in the derived rate table.
STATUS_CURRENCY = (("O", "USD"), ("F", "EUR"), ("P", "HKD"))
# Source name given to each currency when rates stand in for quotes.
CURRENCY_SOURCE = (("USD", "pbc"), ("EUR", "cfets"), ("HKD", "safe"))
# Headers of the two derived form files (English and Chinese layouts).
EN_HEADERS = ("Amount", "Currency", "Date", "Project", "Customer")
CN_HEADERS = ("金额", "币种", "日期", "项目名称", "备注")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _status_currency(status):
    expr = None
    for st, ccy in STATUS_CURRENCY:
        expr = (F.when(status == st, F.lit(ccy)) if expr is None
                else expr.when(status == st, F.lit(ccy)))
    return expr


def rates_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rate per (order status, weekday) over all orders.

    Rates are published on weekdays only, so weekend dates fall back to an
    earlier day and days without orders of a status leave gaps: exact,
    fallback and unavailable lookups all occur.
    """
    o = table(spark, sf_dir, "orders")
    return (o.where(~F.dayofweek("o_orderdate").isin(1, 7))
            .groupBy(_status_currency(F.col("o_orderstatus")).alias("base_currency"),
                     F.lit("CNY").alias("quote_currency"),
                     F.col("o_orderdate").cast("date").alias("rate_date"))
            .agg(F.min("o_orderkey").alias("_k"))
            .select("base_currency", "quote_currency", "rate_date",
                    ((F.lit(60000) + F.col("_k") % 20000).cast(RATE) / F.lit(10000))
                    .cast(RATE).alias("rate_mid")))


def _amount_text(k, price):
    cents = (price * 100).cast("bigint")
    thousands = F.floor(cents / F.lit(100000)).cast("bigint")
    rest = cents % 100000
    comma = F.concat(thousands.cast("string"), F.lit(","),
                     F.lpad(F.floor(rest / F.lit(100)).cast("bigint").cast("string"), 3, "0"),
                     F.lit("."), F.lpad((rest % 100).cast("string"), 2, "0"))
    return (F.when(k % 29 == 0, F.lit("n-a"))
            .when(k % 31 == 0, F.concat(F.lit("-"), price.cast("string")))
            .when(k % 47 == 0, F.lit(None).cast("string"))
            .otherwise(comma))


def forms_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw form row per order, all text, with lineage (source_file, source_row).

    Even keys come from file ``orders_en`` (English headers, an extra
    customer column, no remark), odd keys from ``orders_cn`` (Chinese
    headers); both are returned in one frame with neutral raw names.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    st = F.col("o_orderstatus")
    ts = F.col("o_orderdate")
    currency = (F.when(k % 11 == 0, F.lit("CNY")).when(k % 37 == 0, F.lit("DOLLAR"))
                .when(k % 41 == 0, F.lit("XYZ")).when(st == "O", F.lit(" usd "))
                .when(st == "F", F.lit("EUR")).otherwise(F.lit("Hkd")))
    date = (F.when(k % 43 == 0, F.lit("not a date"))
            .when(k % 13 == 0, F.date_format(ts, "MM/dd/yyyy"))
            .when(k % 17 == 0, F.date_format(ts, "yyyyMMdd"))
            .when(k % 2 == 1, F.date_format(ts, "yyyy/MM/dd"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd")))
    project = (F.when(k % 23 == 0, F.lit("  "))
               .when(k % 19 == 0, F.concat(F.lit("\u3000"), F.col("o_orderpriority"), F.lit("\u00a0")))
               .otherwise(F.col("o_orderpriority")))
    rows = o.select(
        k.alias("_key"),
        F.when(k % 2 == 0, F.lit("orders_en")).otherwise(F.lit("orders_cn")).alias("source_file"),
        _amount_text(k, price).alias("amount_raw"),
        currency.alias("currency_raw"),
        date.alias("date_raw"),
        project.alias("project_raw"),
        F.concat(F.lit("status "), st).alias("remark_raw"),
        F.col("o_custkey").cast("string").alias("customer_raw"))
    numbered = number_rows(rows, ["_key"], ["source_file"], out="_n")
    return numbered.withColumn("source_row", F.col("_n") + 1).drop("_n")


def form_files(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame]]:
    """The two derived form files with their own header layouts (as read from disk)."""
    raw = forms_raw(spark, sf_dir)
    out = []
    cells = {"orders_en": ("amount_raw", "currency_raw", "date_raw", "project_raw", "customer_raw"),
             "orders_cn": ("amount_raw", "currency_raw", "date_raw", "project_raw", "remark_raw")}
    for name, headers in (("orders_en", EN_HEADERS), ("orders_cn", CN_HEADERS)):
        part = raw.where(F.col("source_file") == name).select(
            "_key", "source_file", "source_row",
            *[F.col(src).alias(h) for src, h in zip(cells[name], headers)])
        out.append((name, part))
    return out


def quotes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates standing in for quotes of three sources: source, quote_date, rate."""
    r = rates_view(spark, sf_dir)
    src = None
    for ccy, name in CURRENCY_SOURCE:
        src = F.when(F.col("base_currency") == ccy, F.lit(name)) if src is None else \
            src.when(F.col("base_currency") == ccy, F.lit(name))
    return r.select(src.alias("source"), F.col("rate_date").alias("quote_date"),
                    F.col("rate_mid").alias("rate"))


def _ccy_index(base):
    return F.when(base == "USD", 0).when(base == "EUR", 1).otherwise(2)


def rate_records_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate records as text, the way callers hand them to the store.

    Variants by day of month exercise upper-casing, five-decimal rates (the
    two rounding modes), ISO dates with time and offset, blank required
    fields and unparsable dates. ``_ordinal`` is the record's input order.
    """
    r = rates_view(spark, sf_dir)
    d = F.col("rate_date")
    dn = F.dayofmonth(d)
    iso = F.date_format(d, "yyyy-MM-dd")
    base = F.col("base_currency")
    ordinal = (F.datediff(d, F.lit("1990-01-01").cast("date")) * 10 + _ccy_index(base)) * 2
    src = None
    for ccy, name in CURRENCY_SOURCE:
        src = F.when(base == ccy, F.lit(name)) if src is None else src.when(base == ccy, F.lit(name))
    return r.select(
        ordinal.cast("bigint").alias("_ordinal"),
        F.when(dn % 5 == 0, F.lower(base)).otherwise(base).alias("base_currency"),
        F.when(dn % 3 == 0, F.lit("cny")).otherwise(F.col("quote_currency")).alias("quote_currency"),
        F.when(dn % 2 == 0, F.concat(F.col("rate_mid").cast("string"), F.lit("5")))
        .otherwise(F.col("rate_mid").cast("string")).alias("rate_mid"),
        F.when(dn % 7 == 0, F.concat(iso, F.lit("T08:30:00+08:00")))
        .when(dn % 11 == 0, F.concat(F.lit("bad-"), iso)).otherwise(iso).alias("rate_date"),
        F.when(dn % 4 == 0, F.lit(""))
        .when(dn % 4 == 1, F.concat(iso, F.lit("T10:11:12")))
        .when(dn % 4 == 2, F.concat(iso, F.lit("T10:11:12.123456Z")))
        .otherwise(F.concat(iso, F.lit("T23:59:59+0800"))).alias("fetch_date"),
        F.when(dn % 13 == 0, F.lit(" ")).otherwise(src).alias("source"),
        F.when(dn % 6 == 0, F.lit("forward")).alias("fallback_strategy"),
        F.when(dn % 8 == 0, F.concat(F.lit("http://rates.example/"), iso)).alias("download_url"),
        F.when(dn % 9 == 0, F.lit("2023-06-01T00:00:00+00:00")).alias("created_at"))


# Timestamps of the derived store and of the merge.
STORE_CREATED = "2024-01-01T00:00:00+00:00"
MERGE_NOW = "2025-01-01T00:00:00+00:00"


def stored_rates(spark: SparkSession, sf_dir: str, even_days: bool = True) -> DataFrame:
    """A store (RATES schema) holding the rates (of even days of month by default)."""
    r = rates_view(spark, sf_dir)
    if even_days:
        r = r.where(F.dayofmonth("rate_date") % 2 == 0)
    src = None
    for ccy, name in CURRENCY_SOURCE:
        src = F.when(F.col("base_currency") == ccy, F.lit(name)) if src is None else \
            src.when(F.col("base_currency") == ccy, F.lit(name))
    return r.select(
        "base_currency", "quote_currency", "rate_mid", "rate_date",
        F.concat(F.date_format("rate_date", "yyyy-MM-dd"), F.lit("T00:00:00+00:00")).alias("fetch_date"),
        src.alias("source"), F.lit("").alias("fallback_strategy"),
        F.year("rate_date").alias("year"), F.month("rate_date").alias("month"),
        F.lit("").alias("download_url"), F.lit(STORE_CREATED).alias("created_at"),
        F.lit(STORE_CREATED).alias("updated_at"))


def rate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record, plus a later corrected copy of the records of days divisible by 9."""
    raw = rate_records_raw(spark, sf_dir)
    day = F.substring(F.regexp_extract("rate_date", r"(\d{4}-\d{2}-\d{2})", 1), 9, 2).cast("int")
    first = raw
    again = (raw.where(day % 9 == 0)
             .withColumn("_ordinal", F.col("_ordinal") + 1)
             .withColumn("rate_mid", F.concat(F.lit("1"), F.col("rate_mid")))
             .withColumn("created_at", F.lit(None).cast("string")))
    return first.unionByName(again)


# The monthly job's clock and refresh months.
MONTHLY_TODAY = "2026-01-01"
REFRESH_MONTHS = ("1996-05", "1999-07", "2003-01")


def span_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the first and last rate day (``a``, ``b``)."""
    return rates_view(spark, sf_dir).agg(F.min("rate_date").alias("a"), F.max("rate_date").alias("b"))


def rate_span(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """First and last rate day as text, for parameters that are text (one aggregate row)."""
    row = span_frame(spark, sf_dir).first()
    return row["a"].isoformat(), row["b"].isoformat()


def monthly_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored monthly cache: the first USD rate of each month whose number is not divisible by 3."""
    usd = rates_view(spark, sf_dir).where(F.col("base_currency") == "USD")
    first = usd.groupBy(F.year("rate_date").alias("y"), F.month("rate_date").alias("m")).agg(
        F.min("rate_date").alias("d"), F.min_by("rate_mid", "rate_date").alias("r")).where(F.col("m") % 3 != 0)
    iso = F.date_format("d", "yyyy-MM-dd")
    return first.select(
        F.col("y").cast("string").alias("year"), F.lpad(F.col("m").cast("string"), 2, "0").alias("month"),
        F.col("r").cast("string").alias("mid_rate"), iso.alias("query_date"), iso.alias("source_date"),
        F.lit("pbc_notice").alias("rate_source"), F.lit("none").alias("fallback_used"))


# ---- landed HTML derived from the rates (notices, key chart, portal tables) ----------------

def _ymd_cn(d):
    return F.concat(F.year(d).cast("string"), F.lit("年"), F.month(d).cast("string"), F.lit("月"),
                    F.dayofmonth(d).cast("string"), F.lit("日"))


def _set_id() -> Column:
    """Pages come in one set per currency, each standing in for the publisher's dollar pages."""
    return F.when(F.col("base_currency") == "USD", 0).when(F.col("base_currency") == "EUR", 1_000_000).otherwise(2_000_000)


def notice_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One published notice per currency and rate day (link order = page_id), with variants: no
    date, no rate, a two-decimal rate, a rate split by markup, and a script decoy."""
    r = rates_view(spark, sf_dir)
    d = F.col("rate_date")
    dn = F.dayofmonth(d)
    rate4 = F.col("rate_mid").cast("string")
    rate2 = F.round("rate_mid", 2).cast("decimal(18,2)").cast("string")
    date_part = F.when(dn % 7 == 0, F.lit("")).otherwise(_ymd_cn(d))
    rate_part = (F.when(dn % 5 == 0, F.lit(""))
                 .when(dn % 9 == 0, F.concat(F.lit("1美元对人民币<b>"), rate4, F.lit("</b>元")))
                 .when(dn % 4 == 0, F.concat(F.lit("1美元对人民币"), rate2, F.lit("元")))
                 .otherwise(F.concat(F.lit("1美元对人民币"), rate4, F.lit("元"))))
    html = F.concat(
        F.lit('<html><head><title>人民币汇率中间价公告</title><script>var x="1美元对人民币0.0000元";</script>'
              '</head><body><div class="notice"><p>中国外汇交易中心受权公布，'),
        date_part, F.lit("银行间外汇市场人民币汇率中间价为："), rate_part,
        F.lit("，1欧元对人民币8.0000元。</p></div></body></html>"))
    return r.select((_set_id() + F.datediff(d, F.lit("1990-01-01").cast("date"))).cast("bigint").alias("page_id"),
                    d.alias("target_date"), html.alias("html"))


def keychart_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One key-chart page per currency and month of rates: the first table lists (date, rate
    sentence) rows; a second table holds a decoy row."""
    r = rates_view(spark, sf_dir)
    d = F.col("rate_date")
    iso = F.date_format(d, "yyyy-MM-dd")
    cell = F.when(F.dayofmonth(d) % 6 == 0, F.lit("n/a")).otherwise(
        F.concat(F.lit("1美元对人民币"), F.col("rate_mid").cast("string"), F.lit("元")))
    rows = r.select(_set_id().alias("s"), F.trunc(d, "month").alias("m"), d.alias("d"),
                    F.concat(F.lit("<tr><td>"), iso, F.lit("</td><td>"), cell, F.lit("</td></tr>")).alias("tr"))
    # one page per month: at most 31 rows gathered per group
    pages = rows.groupBy("s", "m").agg(F.array_sort(F.collect_list(F.struct("d", "tr"))).alias("rows"))
    body = F.array_join(F.transform("rows", lambda x: x["tr"]), "")
    html = F.concat(F.lit('<html><body><h2>中间价</h2><table class="chart"><tr><th>日期</th><th>人民币汇率中间价</th></tr>'),
                    body, F.lit("</table><table><tr><td>"), F.date_format("m", "yyyy-MM-dd"),
                    F.lit("</td><td>1美元对人民币9.9999元</td></tr></table></body></html>"))
    return pages.select((F.col("s") + F.year("m") * 100 + F.month("m")).cast("bigint").alias("page_id"), html.alias("html"))


def portal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One portal page per currency and month of rates, standing in for the USD column of table
    ``InfoTable``: per-100 header on even months, x100 values on even and
    multiple-of-3 months, a '100美元' note on odd multiples of 5; mixed date formats,
    blank cells and a short footer row."""
    r = rates_view(spark, sf_dir)
    d = F.col("rate_date")
    dn = F.dayofmonth(d)
    mon = F.month(d)
    value = F.when((mon % 2 == 0) | (mon % 3 == 0),
                   (F.col("rate_mid") * 100).cast("decimal(18,2)").cast("string")).otherwise(
        F.col("rate_mid").cast("string"))
    value = F.when(dn % 7 == 0, F.lit("")).otherwise(value)
    date_text = (F.when(dn % 2 == 0, F.date_format(d, "yyyy/MM/dd")).when(dn % 5 == 0, _ymd_cn(d))
                 .otherwise(F.date_format(d, "yyyy-MM-dd")))
    rows = r.select(_set_id().alias("s"), F.trunc(d, "month").alias("m"), d.alias("d"),
                    F.concat(F.lit("<tr><td>"), date_text, F.lit("</td><td>8.0000</td><td>"), value,
                             F.lit("</td></tr>")).alias("tr"))
    pages = rows.groupBy("s", "m").agg(F.array_sort(F.collect_list(F.struct("d", "tr"))).alias("rows"))
    m = F.month("m")
    head = F.when(m % 2 == 0, F.lit("美元(每100美元)")).otherwise(F.lit("美元"))
    note = F.when((m % 2 == 1) & (m % 5 == 0), F.lit("<p>单位：人民币/100美元</p>")).otherwise(F.lit(""))
    html = F.concat(F.lit("<html><body>"), note,
                    F.lit('<table id="InfoTable"><tr><th>日期</th><th>欧元</th><th>'), head, F.lit("</th></tr>"),
                    F.array_join(F.transform("rows", lambda x: x["tr"]), ""),
                    F.lit("<tr><td>注</td></tr></table></body></html>"))
    return pages.select((F.col("s") + F.year("m") * 100 + F.month("m")).cast("bigint").alias("page_id"), html.alias("html"))


# ---- drive listings, paths and upload attempts -------------------------------------------

def _cust_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # nation and region are dimension tables of fixed, tiny size
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)


def drive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drive tree: region / nation / market segment folders, one file per customer."""
    g = _cust_geo(spark, sf_dir)
    seg_id = F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_mktsegment"))
    regions = g.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"),
                       F.col("r_name").alias("name"), F.lit("root").alias("parent_id")).distinct()
    nations = g.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"),
                       F.col("n_name").alias("name"),
                       F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent_id")).distinct()
    segs = g.select(seg_id.alias("id"), F.col("c_mktsegment").alias("name"),
                    F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent_id")).distinct()
    folders = regions.unionByName(nations).unionByName(segs).withColumn("item_type", F.lit("folder")) \
        .withColumn("size", F.lit(None).cast("bigint"))
    files = g.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"),
                     F.concat(F.col("c_name"), F.lit(".xlsx")).alias("name"), seg_id.alias("parent_id"),
                     F.lit("file").alias("item_type"), (F.col("c_custkey") * 100).alias("size"))
    return folders.unionByName(files)


def folder_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested folder paths per customer, some with missing tails or middles."""
    g = _cust_geo(spark, sf_dir)
    k = F.col("c_custkey")
    base = F.concat_ws("/", "r_name", "n_name", "c_mktsegment")
    path = (F.when(k % 25 == 0, F.concat(F.lit("root/"), F.col("r_name"), F.lit("/NOPE/"), F.col("c_mktsegment")))
            .when(k % 10 == 0, F.concat(base, F.lit("/archive_"), (k % 3).cast("string")))
            .otherwise(base))
    return g.select(path.alias("path"))


def upload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload destination paths per customer with the invalid shapes."""
    g = _cust_geo(spark, sf_dir)
    k = F.col("c_custkey")
    good = F.concat_ws("/", F.lit("企业盘"), "r_name", "n_name", "c_mktsegment")
    path = (F.when(k % 19 == 0, F.lit(""))
            .when(k % 7 == 0, F.concat(good, F.lit("/")))
            .when(k % 11 == 0, F.concat(F.lit("企业盘//"), F.col("n_name")))
            .when(k % 13 == 0, F.concat(good, F.lit("/财务?")))
            .when(k % 17 == 0, F.concat_ws("/", F.lit("企业盘"), "n_name", "n_name"))
            .otherwise(good))
    return g.select("c_custkey", path.alias("path"))


def drive_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent ids, item names and path fragments as users type them."""
    g = _cust_geo(spark, sf_dir)
    k = F.col("c_custkey")
    parent = (F.when(k % 5 == 0, F.lit(" root ")).when(k % 5 == 1, F.lit("/")).when(k % 5 == 2, F.lit(None))
              .when(k % 5 == 3, F.lit("ROOT"))
              .otherwise(F.concat(F.lit(" n"), F.col("c_nationkey").cast("string"), F.lit(" "))))
    name = F.when(k % 9 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")))
    return g.select("c_custkey", parent.alias("parent_raw"), name.alias("name_raw"),
                    F.concat(F.lit("/"), F.col("r_name"), F.lit("/")).alias("part1"),
                    F.concat(F.col("n_name"), F.lit("//./")).alias("part2"),
                    F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("part3"))


# Fixed value: the clock of the rename strategy.
UPLOAD_CLOCK = "2025-01-02 03:04:05"
STRATEGIES = ("skip", "overwrite", "rename")


def upload_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work items: each customer's file uploaded again (a conflict) or a new file."""
    g = _cust_geo(spark, sf_dir)
    k = F.col("c_custkey")
    seg_id = F.concat(F.lit("s"), F.col("c_nationkey").cast("string"), F.lit("_"), F.col("c_mktsegment"))
    name = F.when(k % 2 == 0, F.concat(F.col("c_name"), F.lit(".xlsx"))).otherwise(
        F.concat(F.lit("new_"), F.col("c_name"), F.lit(".xlsx")))
    strategy = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (k % 3 + 1).cast("int"))
    return g.select("c_custkey", seg_id.alias("folder_id"), name.alias("requested_name"), strategy.alias("strategy"))


def listing_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw drive-listing JSON per event, with the API's alternative key spellings."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    t = F.col("event_type")
    q = lambda s: F.concat(F.lit('"'), s, F.lit('"'))
    kind = (F.when(t == "view", F.lit('"type":"folder"')).when(t == "click", F.lit('"fileType":"file"'))
            .when(t == "purchase", F.lit('"nodeType":"file"')).when(t == "signup", F.lit('"type":"file"'))
            .otherwise(F.lit('"type":"link"')))
    ident = F.when(i % 2 == 0, F.concat(F.lit('"id":'), q(F.concat(F.lit("e"), i.cast("string"))))).otherwise(
        F.concat(F.when(t == "view", F.lit('"folderId":')).otherwise(F.lit('"fileId":')),
                 q(F.concat(F.lit("f"), i.cast("string")))))
    ts = F.col("ts")
    created = (F.when(i % 4 == 0, F.concat(F.lit('"createdAt":'), q(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))))
               .when(i % 4 == 1, F.concat(F.lit('"createdAt":'), q(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))))
               .when(i % 4 == 2, F.concat(F.lit('"gmtCreate":'), q(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"))))
               .otherwise(F.concat(F.lit('"gmtCreate":'), q(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")))))
    updated = F.concat(F.lit('"updatedAt":"","gmtModified":'), q(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")))
    size = F.when(i % 5 == 0, F.lit('"size":0')).otherwise(
        F.concat(F.lit('"fileSize":'), (F.col("value") * 100).cast("bigint").cast("string")))
    mime = F.when(i % 3 == 0, F.lit('"mimeType":"application/pdf"')).otherwise(F.lit('"contentType":"text/csv"'))
    body = F.concat(F.lit("{"), kind, F.lit(","), ident, F.lit(',"name":'), q(F.concat(F.lit("item_"), i.cast("string"))),
                    F.lit(',"parentId":'), q(F.concat(F.lit("u"), F.col("user_id").cast("string"))), F.lit(","),
                    created, F.lit(","), updated, F.lit(","), size, F.lit(","), mime, F.lit(',"version":'), (i % 9).cast("string"),
                    F.when(i % 6 == 0, F.lit(',"owner":{"name":"o"},"starred":true')).otherwise(F.lit("")), F.lit("}"))
    return e.select("event_id", body.alias("json"))


def upload_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upload attempt log: batch = user, item = one of seven documents, order = event id."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    t = F.col("event_type")
    doc = F.concat(F.lit("doc_"), (i % 7).cast("string"))
    name = F.concat(doc, F.lit(".xlsx"))
    path = F.concat(F.lit("/data/u"), F.col("user_id").cast("string"), F.lit("/"), name)
    status = (F.when(t.isin("purchase", "click"), F.lit("uploaded")).when(t == "view", F.lit("skipped"))
              .otherwise(F.lit("failed")))
    final = (F.when(t == "click", F.concat(doc, F.lit("_"), F.date_format("ts", "yyyyMMdd-HHmmss"), F.lit(".xlsx")))
             .when(t.isin("purchase", "view"), name))
    message = (F.when(t == "error", F.concat(F.lit("upload Timeout for "), path, F.lit("\nplease retry")))
               .when(t == "signup", F.concat(F.lit("permission denied: "), name, F.lit(" "))))
    error_class = F.when(t == "error", F.when(i % 2 == 0, F.lit("TimeoutError")).otherwise(F.lit("UploadFlowError"))) \
        .when(t == "signup", F.lit("UploadFlowError"))
    return e.select(F.col("user_id").alias("batch_id"), doc.alias("item"), i.alias("ordinal"), status.alias("status"),
                    name.alias("requested_name"), final.alias("final_name"), message.alias("message"),
                    error_class.alias("error_class"), path.alias("file_path"), F.col("ts").alias("at"))
