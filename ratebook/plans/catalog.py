"""Registered queries: one callable per operator of the inventory, on the test tables.

Each callable takes (spark, sf_dir) and returns a DataFrame whose column
names match the oracle SQL of the same key (``oracles.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.functions.dates import parse_form_date
from ratebook.functions.html import RATE_LINK_KEYWORD
from ratebook.functions.numbers import parse_amount
from ratebook.functions.text import blank_to_null, strip_unicode
from ratebook.operators.forms import clean_forms, convert
from ratebook.operators.mapping import DEFAULT_MAPPING, apply_column_mapping
from ratebook.plans.process_forms import map_files, outcome_counts, process_forms
from ratebook.sources.bindings import form_files, forms_raw, rates_view, table

REGISTRY: dict = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


PROCESSED_COLS = ("source_file", "source_row", "project", "description", "amount", "currency", "date",
                  "base_currency", "exchange_rate", "base_amount", "rate_date_used", "issues", "status",
                  "need_confirm")


def _processed(spark, sf_dir, decisions=None):
    return process_forms(form_files(spark, sf_dir), rates=rates_view(spark, sf_dir),
                         decisions=decisions).processed


def _report(df: DataFrame) -> DataFrame:
    return df.withColumn("issues", F.array_join("issues", "; "))


@register("process_forms")
def q_process_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every form row with its conversion, issues and status."""
    return _report(_processed(spark, sf_dir)).select(*PROCESSED_COLS)


@register("trim_unicode")
def q_trim_unicode(spark, sf_dir):
    """Unicode strip of the text cells."""
    raw = forms_raw(spark, sf_dir)
    return raw.select("source_file", "source_row",
                      strip_unicode("project_raw").alias("project"),
                      strip_unicode("currency_raw").alias("currency"))


@register("parse_amount")
def q_parse_amount(spark, sf_dir):
    """Amounts without thousands commas as DECIMAL(19,6), with the invalid flag."""
    raw = forms_raw(spark, sf_dir)
    value, bad = parse_amount(F.col("amount_raw"))
    return raw.select("source_file", "source_row", value.alias("amount"), bad.alias("invalid_amount"))


@register("normalize_currency")
def q_normalize_currency(spark, sf_dir):
    """Trimmed upper-case currency; flagged (not rejected) when not 2-3 letters."""
    raw = forms_raw(spark, sf_dir)
    ccy = F.upper(blank_to_null("currency_raw"))
    return raw.select("source_file", "source_row", ccy.alias("currency"),
                      F.coalesce(~F.length(ccy).isin(2, 3), F.lit(False)).alias("invalid_currency"))


@register("parse_form_date")
def q_parse_form_date(spark, sf_dir):
    """Lenient date parse over the accepted layouts, with the invalid flag."""
    raw = forms_raw(spark, sf_dir)
    d, bad = parse_form_date(F.col("date_raw"))
    return raw.select("source_file", "source_row", d.alias("date"), bad.alias("invalid_date"))


def _typed(spark, sf_dir):
    combined, _ = map_files(form_files(spark, sf_dir), DEFAULT_MAPPING)
    return clean_forms(combined)


@register("rate_lookup_asof")
def q_rate_lookup_asof(spark, sf_dir):
    """Rate, day used and issue per form row (7-day backward window)."""
    conv = convert(_typed(spark, sf_dir), "CNY", 2, rates_view(spark, sf_dir), 7)
    return conv.select("source_file", "source_row", "currency", "date", "exchange_rate", "rate_date_used",
                       F.col("_rate_issue").alias("rate_issue"))


@register("outcome_counts")
def q_outcome_counts(spark, sf_dir):
    """A3: accepted / rejected / need-confirm counts."""
    return outcome_counts(_processed(spark, sf_dir))


# ---- form rules, each on the converted forms ---------------------------------------------

from ratebook.operators import forms as fo  # noqa: E402


def _converted(spark, sf_dir, rates=True, overrides=None):
    r = rates_view(spark, sf_dir) if rates else None
    return convert(_typed(spark, sf_dir), "CNY", 2, r, 7, overrides)


@register("required_check")
def q_required_check(spark, sf_dir):
    """missing required columns in rule order."""
    df = _converted(spark, sf_dir)
    issues, failed = fo.required_issues(df, DEFAULT_MAPPING.required)
    return df.select("source_file", "source_row",
                     F.array_join(F.array_compact(F.array(*issues)), "; ").alias("issues"),
                     failed.alias("rejected"))


@register("non_negative_check")
def q_non_negative_check(spark, sf_dir):
    """negative decimal amounts."""
    df = _converted(spark, sf_dir)
    issues, failed = fo.negative_issues(df, DEFAULT_MAPPING.non_negative)
    return df.select("source_file", "source_row", "amount",
                     F.array_join(F.array_compact(F.array(*issues)), "; ").alias("issues"),
                     failed.alias("rejected"))


@register("rate_missing_check")
def q_rate_missing_check(spark, sf_dir):
    """rate unavailable or base amount missing."""
    df = _converted(spark, sf_dir)
    issue, failed = fo.rate_check()
    return df.select("source_file", "source_row", F.col("_rate_issue").alias("rate_issue"),
                     issue.alias("base_issue"), failed.alias("rejected"))


@register("confirm_threshold")
def q_confirm_threshold(spark, sf_dir):
    """rows at or over the confirmation threshold (flag also on rejected rows)."""
    df = _processed(spark, sf_dir)
    return df.where(F.col("need_confirm")).select("source_file", "source_row", "base_amount", "status")


@register("status_split")
def q_status_split(spark, sf_dir):
    """accepted / rejected sets and the need-confirm subset of accepted, as counts per set."""
    df = _processed(spark, sf_dir)
    out_set = F.when(F.col("status") == "ok", F.lit("accepted")).otherwise(F.lit("rejected"))
    return df.groupBy(out_set.alias("output_set")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if((F.col("status") == "ok") & F.col("need_confirm")).alias("need_confirm_rows"))


@register("convert_amount")
def q_convert_amount(spark, sf_dir):
    """Base amount = half-up(amount x rate, 2) before validation rounding."""
    df = _converted(spark, sf_dir)
    return df.select("source_file", "source_row", "amount", "exchange_rate", "base_amount")


@register("round_columns")
def q_round_columns(spark, sf_dir):
    """X11: amounts after the rounding rules."""
    return _processed(spark, sf_dir).select("source_file", "source_row", "amount", "base_amount")


@register("issues_append")
def q_issues_append(spark, sf_dir):
    """The ordered issue list per row."""
    return _report(_processed(spark, sf_dir)).select("source_file", "source_row", "issues")


# Fixed parameters of the static-rate query.
STATIC_OVERRIDES = {("USD", "CNY"): "7.1000", ("EUR", "CNY"): "7.8000"}


@register("rate_lookup_static")
def q_rate_lookup_static(spark, sf_dir):
    """Identity 1, pair overrides, else default rate 1."""
    df = _converted(spark, sf_dir, rates=False, overrides=STATIC_OVERRIDES)
    return df.select("source_file", "source_row", "currency", "exchange_rate", "base_amount")


def decisions_view(spark, sf_dir):
    """Confirmation answers for part of the rows: declined when key % 4 == 1."""
    raw = forms_raw(spark, sf_dir)
    k = F.col("_key")
    return raw.where((k % 2 == 1) | (k % 4 == 0)).select(
        "source_file", "source_row", (k % 4 != 1).alias("confirmed"))


@register("confirm_decisions")
def q_confirm_decisions(spark, sf_dir):
    """Answers joined in place of the prompt."""
    df = _processed(spark, sf_dir, decisions=decisions_view(spark, sf_dir))
    return _report(df).select("source_file", "source_row", "base_amount", "issues", "status", "need_confirm")


@register("export_accepted")
def q_export_accepted(spark, sf_dir):
    """K3: accepted rows in the 11 export columns."""
    from ratebook.sinks.forms import export_frame
    return export_frame(_processed(spark, sf_dir))


@register("export_rejects")
def q_export_rejects(spark, sf_dir):
    """K4: rejected rows, all columns, issues joined."""
    from ratebook.sinks.forms import rejects_frame
    return rejects_frame(_processed(spark, sf_dir)).select(*PROCESSED_COLS)


@register("export_confirm")
def q_export_confirm(spark, sf_dir):
    """K5: accepted rows needing confirmation, issues joined."""
    from ratebook.sinks.forms import confirm_frame
    return confirm_frame(_processed(spark, sf_dir)).select(*PROCESSED_COLS)


@register("process_report")
def q_process_report(spark, sf_dir):
    """K6: outcome counts and per-file mapping diagnostics as one long table."""
    from ratebook.sinks.forms import report_frame
    res = process_forms(form_files(spark, sf_dir), rates=rates_view(spark, sf_dir))
    return report_frame(spark, res)


@register("column_mapping")
def q_column_mapping(spark, sf_dir):
    """Both files mapped to canonical columns (English: remark missing, customer unmatched)."""
    combined, _ = map_files(form_files(spark, sf_dir), DEFAULT_MAPPING)
    return combined.select("amount", "currency", "date", "project", "description", "Customer", "source_file", "source_row")


@register("constant_columns")
def q_constant_columns(spark, sf_dir):
    """P5: constants from the mapping config on every row."""
    combined, _ = map_files(form_files(spark, sf_dir), DEFAULT_MAPPING)
    return combined.select("source_file", "source_row", "base_currency", "exchange_rate_source")


@register("lineage")
def q_lineage(spark, sf_dir):
    """File name and data-row number (header is row 1) of every row."""
    combined, _ = map_files(form_files(spark, sf_dir), DEFAULT_MAPPING)
    return combined.select("source_file", "source_row", F.col("_key").alias("order_key"))


@register("source_rows")
def q_source_rows(spark, sf_dir):
    """1-based position per file plus one, numbered without a per-file task."""
    from ratebook.operators.ordinal import number_rows
    raw = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    keyed = raw.withColumn("_ord", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    numbered = number_rows(keyed, ["_ord", "l_partkey"], ["l_suppkey"], out="_n")
    return numbered.select(F.col("l_suppkey").alias("source_file"), "l_orderkey", "l_linenumber",
                           (F.col("_n") + 1).alias("source_row"))


@register("forms_union")
def q_forms_union(spark, sf_dir):
    """Both mapped files concatenated by name (absent columns null)."""
    combined, _ = map_files(form_files(spark, sf_dir), DEFAULT_MAPPING)
    return combined.select("source_file", "source_row", "amount", "currency", "date", "project",
                           "description", "Customer")


@register("drop_fill")
def q_drop_fill(spark, sf_dir):
    """F8: drop rows null in amount, then fill nulls (description per column, others by value)."""
    from ratebook.operators.layout import drop_fill
    combined, _ = map_files(form_files(spark, sf_dir), DEFAULT_MAPPING)
    df = combined.select("source_file", "source_row", "amount", "currency", "description", "Customer")
    return drop_fill(df, ["amount"], {"description": "n/a", "Customer": "none"})


# ---- rate store -------------------------------------------------------------------------

from ratebook.operators import store as st  # noqa: E402
from ratebook.sources import bindings as bd  # noqa: E402


def _records(spark, sf_dir):
    return bd.rate_records_raw(spark, sf_dir).withColumnRenamed("_ordinal", "record_no")


@register("rates_normalize")
def q_rates_normalize(spark, sf_dir):
    """Records normalised to the store's columns, with the first error per record."""
    return st.normalize_records(_records(spark, sf_dir))


@register("parse_store_date")
def q_parse_store_date(spark, sf_dir):
    """Strict ISO dates (datetime text gives its local date)."""
    from ratebook.functions.dates import parse_store_date
    r = _records(spark, sf_dir)
    return r.select("record_no", parse_store_date("rate_date").alias("rate_date"))


@register("normalize_fetch_ts")
def q_normalize_fetch_ts(spark, sf_dir):
    """Fetch timestamps as ISO text with offset, blank -> midnight of the rate date."""
    from ratebook.functions.dates import normalize_fetch_ts, parse_store_date
    r = _records(spark, sf_dir)
    return r.select("record_no", normalize_fetch_ts("fetch_date", parse_store_date("rate_date")).alias("fetch_ts"))


@register("round_rate_even")
def q_round_rate_even(spark, sf_dir):
    """4 decimals, half-even (dict and CSV path)."""
    r = _records(spark, sf_dir)
    return r.select("record_no", st.rate_from_text("rate_mid", "half_even").alias("rate_mid"))


@register("round_rate_up")
def q_round_rate_up(spark, sf_dir):
    """4 decimals, half-up (typed records, monthly rows), with its fixed-point text."""
    r = _records(spark, sf_dir)
    rate = st.rate_from_text("rate_mid", "half_up")
    return r.select("record_no", rate.alias("rate_mid"), rate.cast("string").alias("rate_text"))


@register("year_month_derive")
def q_year_month_derive(spark, sf_dir):
    """year/month recomputed from the date over stored values that drifted."""
    s = bd.stored_rates(spark, sf_dir).withColumn("year", F.col("year") + 1).withColumn("month", F.lit(0))
    return st.derive_year_month(s).select("base_currency", "quote_currency", "rate_date", "year", "month")


@register("fallback_default")
def q_fallback_default(spark, sf_dir):
    """Blank source -> argument; blank fallback -> '' (store) or 'none' (monthly)."""
    r = _records(spark, sf_dir)
    return r.select("record_no",
                    st.fallback_default("source", "manual").alias("source"),
                    st.fallback_default("fallback_strategy", None, "").alias("fallback_strategy"),
                    st.fallback_default("fallback_strategy", None, "none").alias("fallback_used"))


def _valid_batch(spark, sf_dir):
    norm = st.normalize_records(bd.rate_batch(spark, sf_dir))
    return norm.where(F.col("error").isNull()).drop("error")


@register("last_wins")
def q_last_wins(spark, sf_dir):
    """Per key the last record of the batch; created_at the last one given."""
    return st.dedupe_batch(_valid_batch(spark, sf_dir), "_ordinal").drop("_consumed")


@register("rates_upsert")
def q_rates_upsert(spark, sf_dir):
    """One merge of the batch into the stored table at a fixed clock."""
    return st.upsert(bd.stored_rates(spark, sf_dir), _valid_batch(spark, sf_dir), bd.MERGE_NOW)


def _store_table(spark, sf_dir):
    return bd.stored_rates(spark, sf_dir, even_days=False)


@register("rates_range_query")
def q_rates_range_query(spark, sf_dir):
    """usd/cny between two dates, inclusive."""
    return st.range_query(_store_table(spark, sf_dir), "usd", "cny", "1997-03-15", "1999-10-20") \
        .select("base_currency", "quote_currency", "rate_mid", "rate_date")


@register("pair_filter")
def q_pair_filter(spark, sf_dir):
    """'eur/cny' split into base and quote, then F1 without dates."""
    base, quote = st.parse_pair("eur/cny")
    return st.range_query(_store_table(spark, sf_dir), base, quote) \
        .select("base_currency", "quote_currency", "rate_mid", "rate_date")


@register("rates_sorted")
def q_rates_sorted(spark, sf_dir):
    """O1: ascending by date, nulls last, with the position in that order."""
    return st.sorted_rates(st.sorted_positions(_store_table(spark, sf_dir))).select(
        "base_currency", "quote_currency", "rate_mid", "rate_date", "position")


@register("rates_preview")
def q_rates_preview(spark, sf_dir):
    """O2: first five rows of the ordered hkd result, rate as 4-decimal text."""
    return st.preview(st.range_query(_store_table(spark, sf_dir), "hkd", "cny"), 5).select(
        "base_currency", "quote_currency", "rate_mid", "rate_date")


@register("store_write")
def q_store_write(spark, sf_dir):
    """K1: the table written as a new version, read back from that version."""
    from ratebook.session import scratch_dir
    from ratebook.sinks.store import RateStore
    store = RateStore(spark, scratch_dir(spark, "store"))
    store.write(_store_table(spark, sf_dir))
    return store.read()


def _write_rates_csv(spark, sf_dir) -> str:
    """Rates landed as CSV files with the monthly cache's Chinese headers, in one folder per currency (``base_currency=...``)."""
    from ratebook.session import scratch_dir
    path = scratch_dir(spark, "rates-csv")
    r = bd.rates_view(spark, sf_dir)
    dn = F.dayofmonth("rate_date")
    iso = F.date_format("rate_date", "yyyy-MM-dd")
    out = r.select(
        "base_currency",
        F.year("rate_date").cast("string").alias("年份"),
        F.month("rate_date").cast("string").alias("月份"),
        F.when(dn % 2 == 0, F.concat(F.col("rate_mid").cast("string"), F.lit("5")))
        .otherwise(F.col("rate_mid").cast("string")).alias("中间价"),
        F.when(dn == 1, F.lit("")).otherwise(iso).alias("查询日期"),
        iso.alias("来源日期"),
        F.when(dn % 4 == 0, F.lit("")).otherwise(F.lit("pbc_notice")).alias("数据源"),
        F.when(dn % 3 == 0, F.lit("forward")).otherwise(F.lit("")).alias("回退策略"))
    out.write.partitionBy("base_currency").option("escape", "\"").option("header", True).csv(path)
    return path


LANDED = ("USD", "EUR", "HKD")  # the currencies of the derived rates


@register("rates_csv_scan")
def q_rates_csv_scan(spark, sf_dir):
    """S3: CSV rows -> records (base/quote from arguments, source/fallback from rows first)."""
    from ratebook.sources.tables import read_csv_text
    from ratebook.operators.mapping import union_by_name
    root = _write_rates_csv(spark, sf_dir)
    return union_by_name([st.load_csv_records(read_csv_text(spark, f"{root}/base_currency={c}"), c, "CNY", "csv_import", "none")
                          for c in LANDED])


@register("alias_rates")
def q_alias_rates(spark, sf_dir):
    """CSV headers mapped to canonical names (unknown names pass through trimmed)."""
    from ratebook.operators.mapping import RATES_CSV_ALIASES, alias_columns
    from ratebook.sources.tables import read_csv_text
    raw = read_csv_text(spark, _write_rates_csv(spark, sf_dir))
    return alias_columns(raw, RATES_CSV_ALIASES, keep_unknown=True)


@register("import_rates")
def q_import_rates(spark, sf_dir):
    """CSV import merged into the store of even days, written as a new version."""
    from ratebook.plans.import_rates import import_csv
    from ratebook.session import scratch_dir
    from ratebook.sinks.store import RateStore
    store = RateStore(spark, scratch_dir(spark, "import"))
    store.write(bd.stored_rates(spark, sf_dir))
    root = _write_rates_csv(spark, sf_dir)
    for c in LANDED:
        import_csv(spark, store, f"{root}/base_currency={c}", c, "CNY", "csv_import", "none", now=bd.MERGE_NOW)
    return store.read()


@register("upsert_one")
def q_upsert_one(spark, sf_dir):
    """One corrected record per pair (its latest day) merged into the store."""
    from ratebook.plans.import_rates import upsert_records
    from ratebook.session import scratch_dir
    from ratebook.sinks.store import RateStore
    store = RateStore(spark, scratch_dir(spark, "upsert"))
    store.write(bd.stored_rates(spark, sf_dir))
    latest = bd.rates_view(spark, sf_dir).groupBy("base_currency", "quote_currency").agg(
        F.max("rate_date").alias("rate_date"), F.max_by("rate_mid", "rate_date").alias("rate_mid"))
    rec = latest.select(
        F.lit(0).cast("bigint").alias("_ordinal"),
        F.lower("base_currency").alias("base_currency"), "quote_currency",
        (F.col("rate_mid") + F.lit(0.00005)).cast("decimal(18,5)").cast("string").alias("rate_mid"),
        F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"),
        F.concat(F.date_format("rate_date", "yyyy-MM-dd"), F.lit("T09:15:00")).alias("fetch_date"),
        F.lit("manual").alias("source"))
    return upsert_records(store, rec, download_url="http://rates.example/manual", now=bd.MERGE_NOW)


# ---- calendar, routing and the monthly cache -------------------------------------------

import datetime as _dt  # noqa: E402

from ratebook.operators import calendar as cal  # noqa: E402
from ratebook.operators import monthly as mo  # noqa: E402
from ratebook.operators import routing as ro  # noqa: E402


def _calendar(spark):
    holidays, workdays = cal.rule_calendar()
    return cal.calendar_frame(spark, holidays, workdays)


def _months(spark, sf_dir):
    firsts = F.sequence(F.trunc("a", "month"), F.trunc("b", "month"), F.expr("INTERVAL 1 MONTH"))
    return cal.with_month_fields(bd.span_frame(spark, sf_dir).where("a is not null")
                                 .select(F.explode(firsts).alias("month_start")))


def _span_months(spark, sf_dir):
    a, b = bd.rate_span(spark, sf_dir)
    return a[:7], b[:7]


@register("first_business_day")
def q_first_business_day(spark, sf_dir):
    """First business day of every month in the rate span."""
    months = _months(spark, sf_dir)
    fbd = cal.first_business_days(months, _calendar(spark))
    return months.join(fbd, "month_start").select("year", "month", "first_business_day")


@register("month_series")
def q_month_series(spark, sf_dir):
    """Month starts and ends over the rate span."""
    return _months(spark, sf_dir).select("month_start", "year", "month", "month_end")


@register("calendar_membership")
def q_calendar_membership(spark, sf_dir):
    """Business-day flag of every rate day."""
    days = bd.rates_view(spark, sf_dir).select(F.col("rate_date").alias("day")).distinct()
    return cal.with_business_flag(days, "day", _calendar(spark))


@register("missing_months")
def q_missing_months(spark, sf_dir):
    """Months of the span missing from the stored cache."""
    a, b = bd.rate_span(spark, sf_dir)
    return mo.missing_months(spark, bd.monthly_existing(spark, sf_dir), _dt.date.fromisoformat(a),
                             _dt.date.fromisoformat(b)).select("year", "month")


def _todo(spark, sf_dir):
    a, b = _span_months(spark, sf_dir)
    return mo.months_to_process(spark, bd.monthly_existing(spark, sf_dir), a, b, bd.REFRESH_MONTHS,
                                today=_dt.date.fromisoformat(bd.MONTHLY_TODAY))


@register("months_to_process")
def q_months_to_process(spark, sf_dir):
    """Missing months plus refresh months, distinct."""
    return _todo(spark, sf_dir).select("year", "month")


@register("monthly_rate_lookup")
def q_monthly_rate_lookup(spark, sf_dir):
    """One rate per month of the span, first business day with date and source fallbacks."""
    return ro.monthly_lookup(_months(spark, sf_dir), bd.quotes_view(spark, sf_dir), _calendar(spark))


@register("pending_months")
def q_pending_months(spark, sf_dir):
    """A4: requested months as success or pending with a reason."""
    todo = _todo(spark, sf_dir)
    res = ro.monthly_lookup(todo, bd.quotes_view(spark, sf_dir), _calendar(spark))
    return mo.pending_report(todo, res)


def _all_days(spark, sf_dir):
    span = bd.span_frame(spark, sf_dir).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("target_date"))


@register("source_routing")
def q_source_routing(spark, sf_dir):
    """Every day of the span routed pbc -> cfets -> safe."""
    return ro.route(_all_days(spark, sf_dir), bd.quotes_view(spark, sf_dir), "auto")


@register("forward_window_lookup")
def q_forward_window_lookup(spark, sf_dir):
    """Per month, the earliest safe quote in [first weekday, +10 days] cut at month end."""
    return ro.forward_window(bd.quotes_view(spark, sf_dir), _months(spark, sf_dir))


@register("single_rate")
def q_single_rate(spark, sf_dir):
    """A table of dates (every order date) routed with cfets preferred."""
    dates = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("target_date")).distinct()
    return ro.single_rate(dates, bd.quotes_view(spark, sf_dir), "usd", "cny", "cfets")


def _build(spark, sf_dir, existing=None):
    from ratebook.plans.monthly_rates import build_monthly_rates
    a, b = _span_months(spark, sf_dir)
    existing = bd.monthly_existing(spark, sf_dir) if existing is None else existing
    return build_monthly_rates(spark, existing, bd.quotes_view(spark, sf_dir), _calendar(spark), a, b,
                               bd.REFRESH_MONTHS, today=_dt.date.fromisoformat(bd.MONTHLY_TODAY))


@register("monthly_upsert")
def q_monthly_upsert(spark, sf_dir):
    """The cache after merging the month results (whole-record replace)."""
    return _build(spark, sf_dir).table


@register("upsert_stats")
def q_upsert_stats(spark, sf_dir):
    """A5: rows consumed, changed and total after the merge."""
    return _build(spark, sf_dir).stats


@register("monthly_normalize")
def q_monthly_normalize(spark, sf_dir):
    """Month results handed in two key layouts (English and Chinese), normalised."""
    rows = mo.result_rows(ro.monthly_lookup(_months(spark, sf_dir), bd.quotes_view(spark, sf_dir),
                                            _calendar(spark)))
    even = rows.where(F.col("month").cast("int") % 2 == 0).select(
        F.concat(F.lit(" "), F.col("year")).alias("year"), F.col("month").cast("int").cast("string").alias("month"),
        F.col("mid_rate").alias("mid_rate"),
        F.when(F.col("month").cast("int") % 4 == 0, F.lit("")).otherwise(F.col("query_date")).alias("query_date"),
        "source_date", "rate_source",
        F.when(F.col("fallback_used") == "none", F.lit("")).otherwise(F.col("fallback_used")).alias("fallback"))
    odd = rows.where(F.col("month").cast("int") % 2 == 1).select(
        F.col("year").alias("年份"), F.col("month").alias("月份"), F.col("mid_rate").alias("中间价"),
        F.col("query_date").alias("首个工作日"), F.col("source_date").alias("公告日期"),
        F.col("rate_source").alias("来源渠道"), F.col("fallback_used").alias("回退策略"),
        F.lit("x").alias("note"))
    return mo.normalize_monthly(even).unionByName(mo.normalize_monthly(odd)).drop("error")


def _write_monthly_csv(spark, sf_dir):
    """The stored cache landed as CSV: one folder with a Chinese header, one headerless,
    with blank rows and rows without a usable year."""
    from ratebook.schemas import MONTHLY_OUTPUT_HEADER
    from ratebook.session import scratch_dir
    root = scratch_dir(spark, "monthly-csv")
    ex = bd.monthly_existing(spark, sf_dir)
    early = ex.where(F.col("year").cast("int") <= 1997).select(
        *[F.col(f).alias(MONTHLY_OUTPUT_HEADER[f]) for f in ex.columns])
    early.write.option("escape", "\"").option("header", True).csv(f"{root}/with_header")
    late = ex.where(F.col("year").cast("int") > 1997)
    m = F.col("month").cast("int")
    late = late.select(
        F.when(m == 5, F.lit("")).when(m == 7, F.lit("n/a")).otherwise(F.col("year")).alias("year"),
        *[F.when(m == 5, F.lit("")).otherwise(F.col(c)).alias(c) for c in ex.columns[1:]])
    late.write.option("escape", "\"").option("header", False).csv(f"{root}/positional")
    return [f"{root}/with_header", f"{root}/positional"]


@register("monthly_csv_scan")
def q_monthly_csv_scan(spark, sf_dir):
    """Header detected per file; blank rows dropped; rows without year/month skipped."""
    from ratebook.sources.monthly_csv import scan_monthly
    return scan_monthly(spark, _write_monthly_csv(spark, sf_dir))


@register("monthly_write")
def q_monthly_write(spark, sf_dir):
    """K2: the merged cache written with Chinese headers and read back as text."""
    from ratebook.session import scratch_dir
    from ratebook.sinks.monthly import write_monthly
    from ratebook.sources.tables import read_csv_text
    path = write_monthly(_build(spark, sf_dir).table, scratch_dir(spark, "monthly-out"))
    return read_csv_text(spark, path)


@register("months_sorted")
def q_months_sorted(spark, sf_dir):
    """O3: cache months in ascending order, with the position in that order."""
    return mo.month_positions(_build(spark, sf_dir).table).orderBy("position").select("year", "month", "position")


@register("alias_monthly")
def q_alias_monthly(spark, sf_dir):
    """Cache headers in mixed spellings -> canonical names; unknown headers dropped."""
    from ratebook.operators.mapping import MONTHLY_ALIASES, alias_columns
    ex = bd.monthly_existing(spark, sf_dir)
    mixed = ex.select(F.col("year").alias("年份"), F.col("month").alias("Month"), F.col("mid_rate").alias(" 中间价 "),
                      F.col("source_date").alias("公告日期"), "rate_source", F.lit("x").alias("extra"),
                      F.col("query_date").alias("首个工作日"))
    return alias_columns(mixed, MONTHLY_ALIASES, keep_unknown=False)


@register("build_monthly_rates")
def q_build_monthly_rates(spark, sf_dir):
    """The monthly job end to end (existing cache read from CSV), final cache rows."""
    from ratebook.sources.monthly_csv import scan_monthly
    existing = scan_monthly(spark, _write_monthly_csv(spark, sf_dir))
    return _build(spark, sf_dir, existing).table


# ---- HTML extraction --------------------------------------------------------------------

from ratebook.operators import notices as nt  # noqa: E402


@register("pages_scan")
def q_pages_scan(spark, sf_dir):
    """Landed pages and their snapshot size (cut at 200,000 bytes)."""
    return nt.snapshot(table(spark, sf_dir, "pages")).drop("snapshot")


@register("notice_parse")
def q_notice_parse(spark, sf_dir):
    """Both notice readings of every notice page."""
    return nt.parse_notices(bd.notice_pages(spark, sf_dir))


@register("keychart_rows")
def q_keychart_rows(spark, sf_dir):
    """Rate per day from the first table of the key-chart pages."""
    days = bd.rates_view(spark, sf_dir).select(F.col("rate_date").alias("target_date")).distinct()
    return nt.keychart_lookup(days, bd.keychart_pages(spark, sf_dir))


@register("notice_then_chart")
def q_notice_then_chart(spark, sf_dir):
    """Every day of the span: notice of that day, else key chart, else miss."""
    return nt.notice_then_chart(_all_days(spark, sf_dir), bd.notice_pages(spark, sf_dir),
                                bd.keychart_pages(spark, sf_dir))


@register("table_rows")
def q_table_rows(spark, sf_dir):
    """Parsed rows of the portal tables (date, raw USD value)."""
    return nt.portal_tables(bd.portal_pages(spark, sf_dir)).select("page_id", "row_pos", "quote_date", "raw_rate")


@register("parse_table_date")
def q_parse_table_date(spark, sf_dir):
    """Dates of the portal rows ('/' -> '-', or yyyy<sep>m<sep>d anywhere)."""
    return nt.portal_tables(bd.portal_pages(spark, sf_dir)).select("page_id", "row_pos", "quote_date")


@register("per100_detect")
def q_per100_detect(spark, sf_dir):
    """Per page, whether quotes are per 100 units."""
    return nt.portal_tables(bd.portal_pages(spark, sf_dir)).select("page_id", "per100").distinct()


@register("scale_per100")
def q_scale_per100(spark, sf_dir):
    """Portal rates divided by 100 where per 100, half-up 4; last row per date wins."""
    return nt.portal_quotes(bd.portal_pages(spark, sf_dir))


@register("extract_quotes")
def q_extract_quotes(spark, sf_dir):
    """C4: quotes from notices (both readings), key chart rows and portal tables."""
    notices = nt.parse_notices(bd.notice_pages(spark, sf_dir))
    pbc = notices.where(F.col("notice_date").isNotNull() & F.col("rate_a").isNotNull()).select(
        F.lit("pbc_notice").alias("source"), "page_id", F.col("notice_date").alias("quote_date"),
        F.col("rate_a").alias("rate"))
    cfets = notices.where(F.col("rate_b").isNotNull()).select(
        F.lit("cfets_notice").alias("source"), "page_id", F.col("date_b").alias("quote_date"),
        F.col("rate_b").cast("decimal(18,6)").alias("rate"))
    chart = nt.keychart_rows(bd.keychart_pages(spark, sf_dir)).where(F.col("rate").isNotNull()).select(
        F.lit("pbc_keychart").alias("source"), "page_id",
        F.substring("first_cell", 1, 10).try_cast("date").alias("quote_date"), "rate")
    chart = chart.where(F.col("quote_date").isNotNull())
    safe = nt.portal_quotes(bd.portal_pages(spark, sf_dir)).select(
        F.lit("safe_portal").alias("source"), "page_id", "quote_date", F.col("rate").cast("decimal(18,6)").alias("rate"))
    return pbc.unionByName(cfets).unionByName(chart).unionByName(safe)


@register("page_quotes")
def q_page_quotes(spark, sf_dir):
    """C4 as a job: landed pages of all publishers -> one quote per source and day."""
    from ratebook.plans.extract_quotes import extract_quotes
    return extract_quotes(bd.notice_pages(spark, sf_dir), bd.keychart_pages(spark, sf_dir), bd.portal_pages(spark, sf_dir))


@register("pages_to_monthly")
def q_pages_to_monthly(spark, sf_dir):
    """C4 into C2: landed pages of all publishers -> quotes -> one rate per month of the span."""
    from ratebook.plans.extract_quotes import extract_quotes
    quotes = extract_quotes(bd.notice_pages(spark, sf_dir), bd.keychart_pages(spark, sf_dir), bd.portal_pages(spark, sf_dir))
    return ro.monthly_lookup(_months(spark, sf_dir), quotes, _calendar(spark))


def _titled_pages(spark, sf_dir):
    """The pages with the notices' title in place of a frequent word, as they hold no such title."""
    return table(spark, sf_dir, "pages").withColumn("html", F.replace("html", F.lit("the"), F.lit(RATE_LINK_KEYWORD)))


@register("extract_links")
def q_extract_links(spark, sf_dir):
    """Anchors of every page with resolved URLs."""
    return nt.page_links(table(spark, sf_dir, "pages"))


@register("rate_link_filter")
def q_rate_link_filter(spark, sf_dir):
    """anchors whose text contains the notices' title."""
    return nt.rate_links(_titled_pages(spark, sf_dir), RATE_LINK_KEYWORD).select("page_id", "pos", "text", "link")


@register("link_dedupe")
def q_link_dedupe(spark, sf_dir):
    """Unique matching URLs with their first position."""
    return nt.first_seen_links(nt.rate_links(_titled_pages(spark, sf_dir), RATE_LINK_KEYWORD))


@register("strip_query")
def q_strip_query(spark, sf_dir):
    """Page URLs without query string."""
    from ratebook.functions.text import strip_query
    return table(spark, sf_dir, "pages").select("page_id", strip_query("url").alias("url"))


@register("mask_digits")
def q_mask_digits(spark, sf_dir):
    """Documents with runs of three or more digits masked, whole text."""
    from ratebook.functions.text import mask_digits
    return table(spark, sf_dir, "documents").select("doc_id", mask_digits("text").alias("text"))


@register("text_preview")
def q_text_preview(spark, sf_dir):
    """The first 1000 characters of every document (the preview is the feature)."""
    from ratebook.functions.text import text_preview
    return table(spark, sf_dir, "documents").select("doc_id", text_preview("text", 1000).alias("preview"))


# ---- drive listings, paths, uploads, file index ------------------------------------------

from ratebook.operators import inventory as iv  # noqa: E402


@register("drive_listing")
def q_drive_listing(spark, sf_dir):
    """P10: listing JSON normalised to drive items (unknown types dropped); the extra map as sorted text."""
    items = iv.parse_listing(bd.listing_json(spark, sf_dir))
    pairs = F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return items.withColumn("extra", F.array_join(F.array_sort(pairs), ";"))


@register("parse_api_time")
def q_parse_api_time(spark, sf_dir):
    """Listing creation times by the first of four ISO layouts."""
    from ratebook.functions.dates import parse_api_time
    j = bd.listing_json(spark, sf_dir)
    text = F.coalesce(F.get_json_object("json", "$.createdAt"), F.get_json_object("json", "$.gmtCreate"))
    return j.select("event_id", parse_api_time(text).cast("timestamp_ntz").alias("created_at"))


@register("path_validate")
def q_path_validate(spark, sf_dir):
    """upload paths checked (empty, trailing slash, blank, illegal, repeated)."""
    p = bd.upload_paths(spark, sf_dir)
    return p.select("c_custkey", "path", iv.validate_path("path").alias("v")).select("c_custkey", "path", "v.*")


@register("path_normalize")
def q_path_normalize(spark, sf_dir):
    """parent ids, item names and joined drive paths."""
    f = bd.drive_fragments(spark, sf_dir)
    name, err = iv.normalize_item_name("name_raw")
    return f.select("c_custkey", iv.normalize_parent_id("parent_raw").alias("parent_id"), name.alias("item_name"),
                    err.alias("name_error"), iv.join_drive_path("part1", "part2", "part3").alias("drive_path"))


@register("folder_resolve")
def q_folder_resolve(spark, sf_dir):
    """Requested folder paths resolved against the tree (id or first missing prefix)."""
    return iv.walk_folders(bd.folder_requests(spark, sf_dir), bd.drive_listing(spark, sf_dir))


@register("conflict_policy")
def q_conflict_policy(spark, sf_dir):
    """Planned action and final name of every upload given the destination listing."""
    return iv.plan_conflicts(bd.upload_items(spark, sf_dir), bd.drive_listing(spark, sf_dir), bd.UPLOAD_CLOCK)


@register("retryable")
def q_retryable(spark, sf_dir):
    """Transient failures by message words or error class."""
    from ratebook.functions.text import retryable
    a = bd.upload_attempts(spark, sf_dir)
    return a.select("ordinal", retryable("message", "error_class").alias("retryable"))


@register("mask_names")
def q_mask_names(spark, sf_dir):
    """Masked file names and sanitised failure reasons."""
    from ratebook.functions.text import mask_filename, sanitize_reason
    a = bd.upload_attempts(spark, sf_dir)
    return a.select("ordinal", mask_filename("requested_name").alias("masked_name"),
                    sanitize_reason("message", "file_path", "requested_name").alias("reason"))


def _outcomes(spark, sf_dir):
    return iv.attempt_outcomes(bd.upload_attempts(spark, sf_dir), max_retries=2)


@register("batch_report")
def q_batch_report(spark, sf_dir):
    """Per batch, items by outcome after retries (the deciding attempt per item)."""
    return iv.batch_report(_outcomes(spark, sf_dir))


@register("batch_items")
def q_batch_items(spark, sf_dir):
    """A7 lists: every item of every batch in its lists, numbered."""
    return iv.batch_items(_outcomes(spark, sf_dir))


@register("batch_durations")
def q_batch_durations(spark, sf_dir):
    """A7 duration: seconds between a batch's first and last attempt."""
    return iv.batch_durations(bd.upload_attempts(spark, sf_dir)).select("batch_id", "seconds")


@register("upload_outcomes")
def q_upload_outcomes(spark, sf_dir):
    """A7 detail: the deciding attempt of every item with its redacted reason."""
    return _outcomes(spark, sf_dir).select("batch_id", "item", "attempts", "status", "final_name", "reason")


def _glob(sf_dir):
    return f"{sf_dir}/*.parquet"


def _landed(spark, sf_dir):
    """The documents as files: path, content, length."""
    docs = table(spark, sf_dir, "documents")
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"),
                    F.when(F.col("doc_id") % 3 == 0, ".txt").when(F.col("doc_id") % 3 == 1, ".csv.gz").otherwise(""))
    return docs.select(F.col("doc_id").alias("number"), path.alias("path"), content.alias("content"),
                       F.octet_length(content).cast("bigint").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))


@register("file_index")
def q_file_index(spark, sf_dir):
    """S9 + X30: every document as a landed file, with size, sha256 and MIME type."""
    return iv.index_rows(spark, _landed(spark, sf_dir)).drop("modified_at")


@register("prefix_hash")
def q_prefix_hash(spark, sf_dir):
    """sha256 of the first 8192 bytes of every document."""
    return iv.prefix_rows(_landed(spark, sf_dir))


@register("mime_type")
def q_mime_type(spark, sf_dir):
    """MIME type of every drive file name (and table file)."""
    names = bd.drive_listing(spark, sf_dir).where(F.col("item_type") == "file").select(F.col("name").alias("file_name"))
    return iv.with_mime_type(spark, names, "file_name")


@register("table_index")
def q_table_index(spark, sf_dir):
    """Per table file: hash, path, table name, row count, mapping version."""
    idx = iv.file_index(spark, _glob(sf_dir)).select("path", "sha256", "file_name")
    counts = spark.read.parquet(_glob(sf_dir)).groupBy(F.col("_metadata.file_path").alias("path")).count()
    return idx.join(counts, "path", "left").select(
        "sha256", "path", F.regexp_replace("file_name", r"\.parquet$", "").alias("sheet"),
        F.coalesce("count", F.lit(0)).alias("row_count"), F.lit("v1").alias("mapping_version"))


@register("download_verify")
def q_download_verify(spark, sf_dir):
    """A listing whose sizes are off by one, absent or of lost files, against the bytes there."""
    files = _landed(spark, sf_dir)
    name = F.element_at(F.split("path", "/"), -1)
    size = F.col("length") + F.when(F.col("number") % 7 == 0, 1).otherwise(0)
    manifest = files.select(name.alias("file_name"), F.when(F.col("number") % 11 != 0, size).alias("listed_size"))
    there = files.where("number % 13 != 0").select(name.alias("file_name"), F.length("content").cast("bigint").alias("actual_size"))
    return iv.verify_sizes(manifest, there)


# ---- template filling and layout ---------------------------------------------------------

from ratebook.operators import layout as la  # noqa: E402

# Fixed parameters of the template queries.
TEMPLATE_TODAY = _dt.date(2025, 1, 31)
TEMPLATE_PROFILE = {"name": "acme", "tax": {"rate": 0.06}}
TEMPLATE_CELLS = {"B2": "sum:Amount", "B3": "first:Project", "B4": "today", "B5": "$profile.name",
                  "B6": "$profile.tax.rate", "B7": "$profile.nope", "B8": 42, "B9": "Invoice", "B10": None}
LAYOUT = la.FixedMapping.from_dict({"sheet": "Invoice", "start_row": 10, "max_rows_per_sheet": 3,
                                    "columns": {"l_partkey": "A", "l_suppkey": "B", "l_returnflag": "C"}})


def _per_file_cells(spark, sf_dir, cells, clean=None):
    parts = []
    for name, frame in form_files(spark, sf_dir):
        parts.append(la.fill_cells(frame.drop("_key"), cells, ("source_file",), "source_row", TEMPLATE_PROFILE,
                                   TEMPLATE_TODAY, clean))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("number", F.round("number", 4))


@register("cell_sum")
def q_cell_sum(spark, sf_dir):
    """A1: sum:Amount per form file (text coerced, bad -> 0; commas are not stripped)."""
    return _per_file_cells(spark, sf_dir, {"B2": "sum:Amount"})


@register("cell_first")
def q_cell_first(spark, sf_dir):
    """A2: first:Project per form file (first non-null in row order)."""
    return _per_file_cells(spark, sf_dir, {"B3": "first:Project"})


@register("cell_literals")
def q_cell_literals(spark, sf_dir):
    """Literal, date and profile cells of each form file's template."""
    lit_cells = {k: v for k, v in TEMPLATE_CELLS.items() if not (isinstance(v, str) and ":" in v)}
    return _per_file_cells(spark, sf_dir, lit_cells)


@register("fill_template")
def q_fill_template(spark, sf_dir):
    """Every template cell of every form file in one aggregate per file (after clean-up)."""
    return _per_file_cells(spark, sf_dir, TEMPLATE_CELLS, {"fillna": {"Customer": "none"}})


@register("page_index")
def q_page_index(spark, sf_dir):
    """Line items paged per order, three lines per page, in line-number order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return la.page_index(li, ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"], 3).drop("_row_no")


@register("cell_layout")
def q_cell_layout(spark, sf_dir):
    """K7: line items placed in template cells per order, pages of three rows from row 10."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                                 "l_returnflag")
    return la.cell_layout(li, LAYOUT, "invoice.xlsx", ["l_linenumber", "l_partkey", "l_suppkey"], ["l_orderkey"])


# ---- scans ------------------------------------------------------------------------------

def _write_form_csvs(spark, sf_dir) -> str:
    """The derived form files landed as CSV, English and Chinese layouts in two folders,
    each with an order-key column."""
    from ratebook.session import scratch_dir
    root = scratch_dir(spark, "forms-csv")
    for (name, frame), key_header in zip(form_files(spark, sf_dir), ("Order", "订单")):
        (frame.drop("source_file", "source_row").withColumnRenamed("_key", key_header)
         .write.option("escape", "\"").option("header", True).option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(f"{root}/{name}"))
    return root


def _scan_union(spark, root, patterns):
    from ratebook.plans.process_forms import map_files
    from ratebook.sources.forms import scan_forms
    groups = scan_forms(spark, [f"{root}/{p}" for p in patterns])
    combined, _ = map_files(groups, DEFAULT_MAPPING)
    key = F.coalesce(*[F.col(c) for c in ("Order", "订单") if c in combined.columns])
    folder = F.element_at(F.split(F.col("_path"), "/"), -2)
    return combined.select(folder.alias("folder"), key.cast("bigint").alias("order_key"), "amount", "currency",
                           "date", "project", "description")


@register("forms_scan")
def q_forms_scan(spark, sf_dir):
    """CSV form files grouped by header, each group read once, mapped and unioned."""
    root = _write_form_csvs(spark, sf_dir)
    return _scan_union(spark, root, ["orders_en/*.csv", "orders_cn/*.csv"])


@register("multi_path_scan")
def q_multi_path_scan(spark, sf_dir):
    """Overlapping glob patterns expanded, directories skipped, files deduplicated."""
    root = _write_form_csvs(spark, sf_dir)
    return _scan_union(spark, root, ["orders_en/*.csv", "orders_*/part-*", "orders_cn/*"]).select(
        "folder", "order_key")


def _write_odd_forms(spark, sf_dir) -> str:
    """Orders landed as CSV files of up to 500 records each, written by hand: a header with a quoted line break,
    quoted cells with line breaks, commas and quotes, blank lines, and records with too many or too few cells."""
    from ratebook.session import scratch_dir
    root = scratch_dir(spark, "forms-odd")
    k = F.col("o_orderkey")
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    note = (F.when(k % 7 == 0, F.concat(F.lit('"two'), F.lit("\n"), F.lit('lines, of '), k.cast("string"), F.lit('"')))
            .when(k % 5 == 0, F.concat(F.lit('"said ""'), k.cast("string"), F.lit('"""'))).otherwise(F.lit('5" pipe')))
    cells = [k.cast("string"), amount, F.lit("USD"), F.date_format("o_orderdate", "yyyy-MM-dd"), note]
    line = (F.when(k % 53 == 0, F.concat_ws(",", *cells, F.lit("x"), F.lit("")))
            .when(k % 59 == 0, F.concat_ws(",", *cells[:3]))
            .when(k % 61 == 0, F.concat(F.lit(" \n"), F.concat_ws(",", *cells))).otherwise(F.concat_ws(",", *cells)))
    orders = table(spark, sf_dir, "orders").select(k, F.floor(k / 500).alias("part"), line.alias("value"))
    header = orders.select("part").distinct().select(F.lit(-1).cast("long").alias("o_orderkey"), "part",
                                                     F.lit('Order,"Amo\nunt",Currency,Date,Project').alias("value"))
    (orders.unionByName(header).repartition("part").sortWithinPartitions("part", "o_orderkey").select("part", "value")
     .write.partitionBy("part").text(root))
    return root


@register("form_records")
def q_form_records(spark, sf_dir):
    """Every record of such files with its place: mapped, or in the side table with a reason."""
    from ratebook.sources.forms import expand_paths, read_csv_forms
    scanned = read_csv_forms(spark, expand_paths(spark, [f"{_write_odd_forms(spark, sf_dir)}/part=*/*"]))
    (_, frame), = scanned.groups
    part = F.regexp_extract("_path", "part=([0-9]+)", 1).cast("bigint").alias("part")
    good = frame.select(part, "source_row", F.col("Order").alias("order_text"), F.col("Amo\nunt").alias("amount_text"),
                        F.col("Date").alias("date_text"), F.col("Project").alias("project_text"))
    odd = scanned.malformed.select(part, "source_row", "reason", F.col("cells").cast("bigint").alias("cells"), "kept")
    return good.join(odd, ["part", "source_row"], "full").select("part", "source_row", "order_text", "amount_text", "date_text",
                                                                 "project_text", "reason", "cells", "kept")


@register("scan_usecols")
def q_scan_usecols(spark, sf_dir):
    """One table with a column subset (pruned at the Parquet scan)."""
    from ratebook.sources.tables import read_table
    return read_table(spark, f"{sf_dir}/lineitem.parquet", usecols=["l_orderkey", "l_partkey", "l_quantity"])


@register("sheet_conform")
def q_sheet_conform(spark, sf_dir):
    """Both form files conformed to a column list (trimmed names, missing -> '')."""
    from ratebook.operators.mapping import conform, union_by_name
    columns = ["金额", "币种", " 日期 ", "项目名称", "附件", "Amount", "source_file", "source_row"]
    return union_by_name([conform(frame.drop("_key"), columns) for _, frame in form_files(spark, sf_dir)])


@register("schema_migrate")
def q_schema_migrate(spark, sf_dir):
    """A stored table with a drifted header rewritten in the target column order as a new version; both versions read back."""
    from ratebook.schemas import RATES_COLUMNS
    from ratebook.session import scratch_dir
    from ratebook.sinks.tables import VersionedTable
    s = bd.stored_rates(spark, sf_dir, even_days=False)
    drifted = s.select(F.col("rate_date").cast("string").alias(" rate_date"), "source",
                       F.col("rate_mid").cast("string").alias("rate_mid"), "base_currency", "quote_currency",
                       "fetch_date", F.col("year").cast("string").alias("year"),
                       F.col("month").cast("string").alias("month"), F.lit("x").alias("legacy"))
    stored = VersionedTable(spark, scratch_dir(spark, "migrate"))
    first = stored.write(drifted)
    second = stored.migrate(list(RATES_COLUMNS))
    before, after = stored.read(first), stored.read(second)
    old = before.withColumnRenamed(" rate_date", "rate_date").withColumn("version", F.lit(first))
    return after.withColumn("version", F.lit(second)).unionByName(old, allowMissingColumns=True)


@register("date_from_year_month")
def q_date_from_year_month(spark, sf_dir):
    """A blank rate date falls back to year-month-01 (a bad month gives null)."""
    from ratebook.functions.dates import date_from_year_month, parse_store_date
    r = bd.rates_view(spark, sf_dir)
    dn = F.dayofmonth("rate_date")
    text = F.when(dn % 10 == 0, F.lit("")).otherwise(F.date_format("rate_date", "yyyy-MM-dd"))
    month = F.when(dn == 20, F.lit("13")).otherwise(F.month("rate_date").cast("string"))
    rows = r.select("base_currency", "rate_date", text.alias("date_text"),
                    F.year("rate_date").cast("string").alias("year_text"), month.alias("month_text"))
    return rows.select("base_currency", "rate_date",
                       date_from_year_month(parse_store_date("date_text"), F.col("year_text"), F.col("month_text"))
                       .alias("resolved_date"))


@register("mapping_diagnostics")
def q_mapping_diagnostics(spark, sf_dir):
    """Per form file, rows read plus missing and unmatched columns of its header."""
    from ratebook.operators.mapping import apply_column_mapping
    parts = []
    for name, frame in form_files(spark, sf_dir):
        res = apply_column_mapping(frame, DEFAULT_MAPPING, passthrough=("_key", "source_file", "source_row"))
        parts.append(frame.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows")).select(
            F.col("source_file").alias("file"), "rows",
            F.lit(", ".join(res.missing)).alias("missing_columns"),
            F.lit(", ".join(res.unmatched)).alias("unmatched_columns")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
