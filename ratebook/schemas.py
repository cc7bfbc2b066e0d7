"""Fixed schemas of the engine's tables (inputs vary, outputs do not)."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(19, 6)
RATE = T.DecimalType(18, 4)
EXCHANGE_RATE = T.DecimalType(18, 6)
BASE_AMOUNT = T.DecimalType(38, 6)

# The rate store's column order.
RATES_COLUMNS = (
    "base_currency", "quote_currency", "rate_mid", "rate_date", "fetch_date", "source",
    "fallback_strategy", "year", "month", "download_url", "created_at", "updated_at",
)

RATES = T.StructType([
    T.StructField("base_currency", T.StringType()),
    T.StructField("quote_currency", T.StringType()),
    T.StructField("rate_mid", RATE),
    T.StructField("rate_date", T.DateType()),
    T.StructField("fetch_date", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("fallback_strategy", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("download_url", T.StringType()),
    T.StructField("created_at", T.StringType()),
    T.StructField("updated_at", T.StringType()),
])

# Monthly cache fields in canonical order and their output headers.
MONTHLY_FIELDS = ("year", "month", "mid_rate", "query_date", "source_date", "rate_source", "fallback_used")
MONTHLY_OUTPUT_HEADER = {
    "year": "年份",
    "month": "月份",
    "mid_rate": "中间价",
    "query_date": "查询日期",
    "source_date": "来源日期",
    "rate_source": "数据源",
    "fallback_used": "回退策略",
}

MONTHLY = T.StructType([
    T.StructField("year", T.IntegerType()),
    T.StructField("month", T.IntegerType()),
    T.StructField("mid_rate", RATE),
    T.StructField("query_date", T.DateType()),
    T.StructField("source_date", T.DateType()),
    T.StructField("rate_source", T.StringType()),
    T.StructField("fallback_used", T.StringType()),
])

QUOTES = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("quote_date", T.DateType()),
    T.StructField("rate", RATE),
])

# Export column order of accepted form rows.
EXPORT_COLUMNS = (
    "project", "date", "currency", "amount", "base_currency", "base_amount", "exchange_rate",
    "rate_date_used", "need_confirm", "source_file", "source_row",
)

DRIVE_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("size", T.LongType()),
    T.StructField("mime_type", T.StringType()),
])
