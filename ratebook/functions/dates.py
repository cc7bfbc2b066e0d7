"""Date and timestamp parsing as Column expressions (ANSI-safe: ``try_*`` only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.functions.text import blank_to_null, col_, try_cast

# Layouts tried in order for free-form dates on fee forms
# (month-first for slashed day/month, as pandas does), each with the text
# shape it can parse. A value is parsed only with the layout whose shape it
# has, so failing layouts are never attempted (a failed parse is costly).
FORM_DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy/M/d H:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
)

# Timestamp layouts of the drive listing API, tried in order,
# each with the text shape it parses (a value is parsed with one layout only).
_T = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
API_TIME_FORMATS = (
    (_T + r"\.\d{6}Z$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
    (_T + r"Z$", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    (_T + r"[+-]\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ssXXX"),
    (_T + r"[+-]\d{4}$", "yyyy-MM-dd'T'HH:mm:ssXX"),
    (_T + r"$", "yyyy-MM-dd'T'HH:mm:ss"),
)


def _shape_parse(text: Column, formats) -> Column:
    out = None
    for shape, fmt in formats:
        branch = F.try_to_timestamp(text, F.lit(fmt))
        out = F.when(text.rlike(shape), branch) if out is None else out.when(text.rlike(shape), branch)
    return out


def parse_form_date(c) -> tuple[Column, Column]:
    """(date, invalid flag). Missing -> (null, false); time part dropped."""
    text = blank_to_null(c)
    parsed = _shape_parse(text, FORM_DATE_FORMATS).cast("date")
    return parsed, text.isNotNull() & parsed.isNull()


_ISO_DATE = r"^(\d{4}-\d{2}-\d{2})$"
_ISO_BASIC = r"^(\d{4})(\d{2})(\d{2})$"
_ISO_DT = (r"^(\d{4}-\d{2}-\d{2})[T](\d{2}):(\d{2})(?::(\d{2})(?:\.\d{1,6})?)?"
           r"(Z|[+-]\d{2}:?\d{2})?$")


def parse_store_date(c) -> Column:
    """Strict ISO date; with ``T`` the local date of the ISO datetime. Null when invalid."""
    text = blank_to_null(c)
    plain = F.when(text.rlike(_ISO_DATE), try_cast(text, "date"))
    basic = F.when(text.rlike(_ISO_BASIC),
                   F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date"))
    dated = F.when(text.rlike(_ISO_DT), try_cast(F.regexp_extract(text, _ISO_DT, 1), "date"))
    return F.coalesce(plain, basic, dated)


def _valid_clock(h: Column, m: Column, s: Column) -> Column:
    return (try_cast(h, "int") < 24) & (try_cast(m, "int") < 60) & (try_cast(s, "int") < 60)


def normalize_fetch_ts(c, fallback_date) -> Column:
    """ISO timestamp text with offset at second precision.

    Date -> midnight ``+00:00``; naive datetime -> ``+00:00``; a given offset is
    kept (``Z`` becomes ``+00:00``); blank -> midnight of ``fallback_date``;
    anything else -> null (an error for the caller).
    """
    text = blank_to_null(c)
    fb = F.concat(F.date_format(col_(fallback_date), "yyyy-MM-dd"), F.lit("T00:00:00+00:00"))
    day = F.regexp_extract(text, _ISO_DT, 1)
    hh = F.regexp_extract(text, _ISO_DT, 2)
    mm = F.regexp_extract(text, _ISO_DT, 3)
    ss_raw = F.regexp_extract(text, _ISO_DT, 4)
    ss = F.when(ss_raw == "", F.lit("00")).otherwise(ss_raw)
    off_raw = F.regexp_extract(text, _ISO_DT, 5)
    off = (F.when((off_raw == "") | (off_raw == "Z"), F.lit("+00:00"))
           .when(F.length(off_raw) == 5,
                 F.concat(F.substring(off_raw, 1, 3), F.lit(":"), F.substring(off_raw, 4, 2)))
           .otherwise(off_raw))
    with_time = F.when(
        text.rlike(_ISO_DT) & try_cast(day, "date").isNotNull() & _valid_clock(hh, mm, ss),
        F.concat(day, F.lit("T"), hh, F.lit(":"), mm, F.lit(":"), ss, off))
    date_only = F.when(text.rlike(_ISO_DATE) & try_cast(text, "date").isNotNull(),
                       F.concat(text, F.lit("T00:00:00+00:00")))
    return F.when(text.isNull(), fb).otherwise(F.coalesce(date_only, with_time))


def date_from_year_month(date_col, year, month) -> Column:
    """The given date, else ``year-month-01`` (null when year/month are bad)."""
    y = try_cast(blank_to_null(year), "int")
    m = try_cast(blank_to_null(month), "int")
    first = F.try_make_timestamp(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.coalesce(col_(date_col), first)


def parse_table_date(c) -> Column:
    """``/`` -> ``-`` then ISO; else ``yyyy<sep>m<sep>d`` anywhere in the text."""
    text = blank_to_null(c)
    iso = F.replace(text, F.lit("/"), F.lit("-"))
    direct = F.when(iso.rlike(_ISO_DATE), try_cast(iso, "date"))
    pat = r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})"
    loose = F.try_make_timestamp(
        try_cast(F.nullif(F.regexp_extract(text, pat, 1), F.lit("")), "int"),
        try_cast(F.nullif(F.regexp_extract(text, pat, 2), F.lit("")), "int"),
        try_cast(F.nullif(F.regexp_extract(text, pat, 3), F.lit("")), "int"),
        F.lit(0), F.lit(0), F.lit(0)).cast("date")
    return F.coalesce(direct, loose)


def parse_api_time(c) -> Column:
    """First of four ISO layouts that parses, else null."""
    text = F.nullif(col_(c), F.lit(""))
    return _shape_parse(text, API_TIME_FORMATS)


def month_start(c) -> Column:
    return F.trunc(col_(c), "month")


def month_end(c) -> Column:
    """Last day of the month."""
    return F.last_day(col_(c))


def month_series(start, end) -> Column:
    """Array of month starts from start's month to end's month, inclusive."""
    return F.sequence(F.trunc(col_(start), "month"), F.trunc(col_(end), "month"),
                      F.expr("INTERVAL 1 MONTH"))


def first_weekday(month_first) -> Column:
    """First Monday-to-Friday day of the month (no holiday calendar)."""
    d = col_(month_first)
    dow = F.dayofweek(d)  # 1 = Sunday ... 7 = Saturday
    return F.when(dow == 7, F.date_add(d, 2)).when(dow == 1, F.date_add(d, 1)).otherwise(d)
