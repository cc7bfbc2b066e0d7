"""DuckDB oracle SQL for every registered query (independent formulations).

Views ``forms`` and ``rates`` are derived from ``orders`` with the same rules
as ``ratebook.sources.bindings``; each oracle query is a CTE chain on the
pre-registered test tables.
"""

from __future__ import annotations

import datetime as _dt

# The white space of Unicode in the basic plane, as a text strip takes it.
WS = ("[\\x{0009}-\\x{000D}\\x{001C}-\\x{0020}\\x{0085}\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}"
      "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]")
TRIM_RE = f"^{WS}+|{WS}+$"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '{TRIM_RE}', '', 'g')"


def blank_null(x: str) -> str:
    return f"NULLIF({trim(x)}, '')"


RATES = """
rates AS (
  SELECT CASE o_orderstatus WHEN 'O' THEN 'USD' WHEN 'F' THEN 'EUR' WHEN 'P' THEN 'HKD' END AS base_currency,
         'CNY' AS quote_currency,
         CAST(o_orderdate AS DATE) AS rate_date,
         CAST(CAST(60000 + MIN(o_orderkey) % 20000 AS DECIMAL(18,4)) / 10000 AS DECIMAL(18,4)) AS rate_mid
  FROM orders WHERE dayofweek(o_orderdate) NOT IN (0, 6)
  GROUP BY 1, 2, 3)"""

QUOTES = RATES + """,
quotes AS (
  SELECT CASE base_currency WHEN 'USD' THEN 'pbc' WHEN 'EUR' THEN 'cfets' WHEN 'HKD' THEN 'safe' END AS source,
         rate_date AS quote_date, rate_mid AS rate
  FROM rates)"""

FORMS_RAW = """
forms_src AS (
  SELECT o_orderkey AS _key, o_orderstatus, o_orderpriority, o_orderdate, o_custkey,
         CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * 100 AS BIGINT) AS cents
  FROM orders),
forms_raw AS (
  SELECT _key,
    CASE WHEN _key % 2 = 0 THEN 'orders_en' ELSE 'orders_cn' END AS source_file,
    CASE WHEN _key % 29 = 0 THEN 'n-a'
         WHEN _key % 31 = 0 THEN '-' || CAST(price AS VARCHAR)
         WHEN _key % 47 = 0 THEN NULL
         ELSE CAST(cents // 100000 AS VARCHAR) || ',' || lpad(CAST((cents % 100000) // 100 AS VARCHAR), 3, '0')
              || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') END AS amount_raw,
    CASE WHEN _key % 11 = 0 THEN 'CNY' WHEN _key % 37 = 0 THEN 'DOLLAR' WHEN _key % 41 = 0 THEN 'XYZ'
         WHEN o_orderstatus = 'O' THEN ' usd ' WHEN o_orderstatus = 'F' THEN 'EUR' ELSE 'Hkd' END AS currency_raw,
    CASE WHEN _key % 43 = 0 THEN 'not a date'
         WHEN _key % 13 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
         WHEN _key % 17 = 0 THEN strftime(o_orderdate, '%Y%m%d')
         WHEN _key % 2 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_raw,
    CASE WHEN _key % 23 = 0 THEN '  '
         WHEN _key % 19 = 0 THEN '\u3000' || o_orderpriority || '\u00a0'
         ELSE o_orderpriority END AS project_raw,
    'status ' || o_orderstatus AS remark_raw,
    CAST(o_custkey AS VARCHAR) AS customer_raw
  FROM forms_src),
forms AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY source_file ORDER BY _key) + 1 AS BIGINT) AS source_row
  FROM forms_raw)"""

FORMS_TYPED = FORMS_RAW + f""",
typed0 AS (
  SELECT source_file, source_row, _key,
    {blank_null('amount_raw')} AS amount_t,
    upper({blank_null('currency_raw')}) AS currency,
    {blank_null('date_raw')} AS date_t,
    {trim('project_raw')} AS project,
    CASE WHEN source_file = 'orders_cn' THEN {trim('remark_raw')} END AS description
  FROM forms),
typed AS (
  SELECT source_file, source_row, _key, currency, project, description,
    TRY_CAST(replace(amount_t, ',', '') AS DECIMAL(19,6)) AS amount,
    amount_t IS NOT NULL AND TRY_CAST(replace(amount_t, ',', '') AS DECIMAL(19,6)) IS NULL AS bad_amount,
    COALESCE(length(currency) NOT IN (2, 3), FALSE) AS bad_currency,
    CAST(try_strptime(date_t, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y', '%Y%m%d']) AS DATE) AS date,
    date_t IS NOT NULL AND try_strptime(date_t, ['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y/%m/%d', '%m/%d/%Y', '%Y%m%d']) IS NULL AS bad_date
  FROM typed0)"""


def forms_converted(window: int = 7, base: str = "CNY") -> str:
    return RATES + "," + FORMS_TYPED + f""",
cny_rates AS (SELECT base_currency, rate_date, rate_mid FROM rates WHERE quote_currency = '{base}'),
looked AS (
  SELECT t.*, r.rate_date AS r_date, r.rate_mid AS r_mid,
         (t.amount IS NOT NULL AND t.currency IS NOT NULL AND t.date IS NOT NULL) AS elig
  FROM typed t ASOF LEFT JOIN cny_rates r ON t.currency = r.base_currency AND t.date >= r.rate_date),
conv AS (
  SELECT *,
    CASE WHEN NOT elig THEN NULL WHEN currency = '{base}' THEN CAST(1 AS DECIMAL(18,6))
         WHEN r_date IS NOT NULL AND date_diff('day', r_date, date) <= {window} THEN CAST(r_mid AS DECIMAL(18,6)) END AS exchange_rate,
    CASE WHEN NOT elig THEN NULL WHEN currency = '{base}' THEN date
         WHEN r_date IS NOT NULL AND date_diff('day', r_date, date) <= {window} THEN r_date END AS rate_date_used
  FROM looked),
conv2 AS (
  SELECT *,
    CASE WHEN NOT elig OR currency = '{base}' THEN NULL
         WHEN exchange_rate IS NULL THEN 'rate_unavailable'
         WHEN rate_date_used <> date THEN 'rate_fallback' END AS rate_issue,
    CAST(round(amount * exchange_rate, 2) AS DECIMAL(38,6)) AS base_pre,
    '{base}' AS base_currency
  FROM conv)"""


def forms_validated(window: int = 7, threshold: int = 20000, decisions: bool = False) -> str:
    dec_cte = ""
    dec_join = "SELECT c.*, CAST(NULL AS BOOLEAN) AS confirmed FROM conv2 c"
    if decisions:
        dec_cte = """,
decisions AS (
  SELECT source_file, source_row, (_key % 4 <> 1) AS confirmed FROM forms WHERE _key % 2 = 1 OR _key % 4 = 0)"""
        dec_join = """SELECT c.*, d.confirmed FROM conv2 c
  LEFT JOIN decisions d ON c.source_file = d.source_file AND c.source_row = d.source_row"""
    return forms_converted(window) + dec_cte + f""",
withdec AS ({dec_join}),
flags AS (
  SELECT *,
    COALESCE(base_pre >= {threshold}, FALSE) AS over,
    COALESCE(base_pre >= {threshold}, FALSE) AND COALESCE(NOT confirmed, FALSE) AS declined,
    COALESCE(base_pre >= {threshold}, FALSE) AND COALESCE(confirmed, FALSE) AS cleared,
    (amount IS NULL OR currency IS NULL OR date IS NULL OR project IS NULL OR project = ''
     OR COALESCE(amount < 0, FALSE) OR COALESCE(rate_issue = 'rate_unavailable', FALSE)
     OR (amount IS NOT NULL AND base_pre IS NULL)) AS rejected
  FROM withdec),
validated AS (
  SELECT source_file, source_row, _key, project, description, currency, date, base_currency,
    exchange_rate, rate_date_used, rate_issue, base_pre,
    CAST(round(amount, 2) AS DECIMAL(19,6)) AS amount,
    CAST(round(base_pre, 2) AS DECIMAL(38,6)) AS base_amount,
    concat_ws('; ',
      CASE WHEN bad_amount THEN 'invalid_amount' END,
      CASE WHEN bad_currency THEN 'invalid_currency' END,
      CASE WHEN bad_date THEN 'invalid_date' END,
      rate_issue,
      CASE WHEN amount IS NULL THEN 'missing_amount' END,
      CASE WHEN currency IS NULL THEN 'missing_currency' END,
      CASE WHEN date IS NULL THEN 'missing_date' END,
      CASE WHEN project IS NULL OR project = '' THEN 'missing_project' END,
      CASE WHEN amount < 0 THEN 'negative_amount' END,
      CASE WHEN amount IS NOT NULL AND base_pre IS NULL AND COALESCE(rate_issue, '') <> 'rate_unavailable'
           THEN 'missing_base_amount' END,
      CASE WHEN declined THEN 'confirmation_declined' WHEN over AND NOT cleared THEN 'requires_confirmation' END
    ) AS issues,
    CASE WHEN rejected THEN 'reject' ELSE 'ok' END AS status,
    over AND NOT cleared AS need_confirm
  FROM flags)"""


PROCESSED_COLS = ("source_file, source_row, project, description, amount, currency, date, base_currency, "
                  "exchange_rate, base_amount, rate_date_used, issues, status, need_confirm")


def q(ctes: str, select: str) -> str:
    return "WITH " + ctes.strip() + "\n" + select


ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql


oracle("process_forms", q(forms_validated(), f"SELECT {PROCESSED_COLS} FROM validated"))

oracle("trim_unicode", q(FORMS_RAW, f"""SELECT source_file, source_row,
  {trim('project_raw')} AS project, {trim('currency_raw')} AS currency FROM forms"""))

oracle("parse_amount", q(FORMS_TYPED, "SELECT source_file, source_row, amount, bad_amount AS invalid_amount FROM typed"))

oracle("normalize_currency", q(FORMS_TYPED,
       "SELECT source_file, source_row, currency, bad_currency AS invalid_currency FROM typed"))

oracle("parse_form_date", q(FORMS_TYPED, "SELECT source_file, source_row, date, bad_date AS invalid_date FROM typed"))

oracle("rate_lookup_asof", q(forms_converted(), """SELECT source_file, source_row, currency, date,
  exchange_rate, rate_date_used, rate_issue FROM conv2"""))

oracle("outcome_counts", q(forms_validated(), """SELECT count(*) FILTER (WHERE status = 'ok') AS ok_rows,
  count(*) FILTER (WHERE status <> 'ok') AS rejected_rows,
  count(*) FILTER (WHERE status = 'ok' AND need_confirm) AS need_confirm_rows FROM validated"""))

VALID = forms_validated()
CONV = forms_converted()

oracle("required_check", q(CONV, """SELECT source_file, source_row,
  concat_ws('; ', CASE WHEN amount IS NULL THEN 'missing_amount' END,
    CASE WHEN currency IS NULL THEN 'missing_currency' END,
    CASE WHEN date IS NULL THEN 'missing_date' END,
    CASE WHEN project IS NULL OR project = '' THEN 'missing_project' END) AS issues,
  (amount IS NULL OR currency IS NULL OR date IS NULL OR project IS NULL OR project = '') AS rejected
FROM conv2"""))

oracle("non_negative_check", q(CONV, """SELECT source_file, source_row, amount,
  concat_ws('; ', CASE WHEN amount < 0 THEN 'negative_amount' END) AS issues,
  COALESCE(amount < 0, FALSE) AS rejected FROM conv2"""))

oracle("rate_missing_check", q(CONV, """SELECT source_file, source_row, rate_issue,
  CASE WHEN amount IS NOT NULL AND base_pre IS NULL AND COALESCE(rate_issue, '') <> 'rate_unavailable'
       THEN 'missing_base_amount' END AS base_issue,
  (COALESCE(rate_issue = 'rate_unavailable', FALSE) OR (amount IS NOT NULL AND base_pre IS NULL)) AS rejected
FROM conv2"""))

oracle("confirm_threshold", q(VALID, "SELECT source_file, source_row, base_amount, status FROM validated WHERE need_confirm"))

oracle("status_split", q(VALID, """SELECT CASE WHEN status = 'ok' THEN 'accepted' ELSE 'rejected' END AS output_set,
  count(*) AS row_count, count(*) FILTER (WHERE status = 'ok' AND need_confirm) AS need_confirm_rows
FROM validated GROUP BY 1"""))

oracle("convert_amount", q(CONV, "SELECT source_file, source_row, amount, exchange_rate, base_pre AS base_amount FROM conv2"))

oracle("round_columns", q(VALID, "SELECT source_file, source_row, amount, base_amount FROM validated"))

oracle("issues_append", q(VALID, "SELECT source_file, source_row, issues FROM validated"))

oracle("rate_lookup_static", q(FORMS_TYPED, """, s AS (
  SELECT source_file, source_row, currency, amount,
    CASE WHEN amount IS NULL OR currency IS NULL OR date IS NULL THEN NULL
         WHEN currency = 'CNY' THEN CAST(1 AS DECIMAL(18,6))
         WHEN currency = 'USD' THEN CAST(7.1 AS DECIMAL(18,6))
         WHEN currency = 'EUR' THEN CAST(7.8 AS DECIMAL(18,6))
         ELSE CAST(1 AS DECIMAL(18,6)) END AS exchange_rate
  FROM typed)
SELECT source_file, source_row, currency, exchange_rate,
  CAST(round(amount * exchange_rate, 2) AS DECIMAL(38,6)) AS base_amount FROM s""".replace("\n", "\n", 1)))

oracle("confirm_decisions", q(forms_validated(decisions=True),
       "SELECT source_file, source_row, base_amount, issues, status, need_confirm FROM validated"))

oracle("export_accepted", q(VALID, """SELECT project, date, currency, amount, base_currency, base_amount,
  exchange_rate, rate_date_used, need_confirm, source_file, source_row FROM validated WHERE status = 'ok'"""))

oracle("export_rejects", q(VALID, f"SELECT {PROCESSED_COLS} FROM validated WHERE status <> 'ok'"))

oracle("export_confirm", q(VALID, f"SELECT {PROCESSED_COLS} FROM validated WHERE status = 'ok' AND need_confirm"))

oracle("process_report", q(VALID, """SELECT 'outcome' AS section, CAST(NULL AS VARCHAR) AS file, item, value FROM (
  SELECT 'accepted' AS item, count(*) FILTER (WHERE status = 'ok') AS value FROM validated
  UNION ALL SELECT 'rejected', count(*) FILTER (WHERE status <> 'ok') FROM validated
  UNION ALL SELECT 'need_confirm', count(*) FILTER (WHERE status = 'ok' AND need_confirm) FROM validated)
UNION ALL SELECT 'missing_column', 'orders_en', 'description', CAST(NULL AS BIGINT)
UNION ALL SELECT 'unmapped_column', 'orders_en', 'Customer', CAST(NULL AS BIGINT)"""))

oracle("column_mapping", q(FORMS_RAW, """SELECT amount_raw AS amount, currency_raw AS currency, date_raw AS date,
  project_raw AS project, CASE WHEN source_file = 'orders_cn' THEN remark_raw END AS description,
  CASE WHEN source_file = 'orders_en' THEN customer_raw END AS Customer, source_file, source_row
FROM forms"""))

oracle("constant_columns", q(FORMS_RAW, """SELECT source_file, source_row, 'CNY' AS base_currency,
  'MockProvider' AS exchange_rate_source FROM forms"""))

oracle("lineage", q(FORMS_RAW, "SELECT source_file, source_row, _key AS order_key FROM forms"))

oracle("source_rows", """SELECT l_suppkey AS source_file, l_orderkey, l_linenumber,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 100 + l_linenumber, l_partkey) + 1 AS source_row
FROM lineitem""")

oracle("forms_union", q(FORMS_RAW, """SELECT source_file, source_row, amount_raw AS amount, currency_raw AS currency,
  date_raw AS date, project_raw AS project,
  CASE WHEN source_file = 'orders_cn' THEN remark_raw END AS description,
  CASE WHEN source_file = 'orders_en' THEN customer_raw END AS Customer
FROM forms"""))

oracle("drop_fill", q(FORMS_RAW, """SELECT source_file, source_row, amount_raw AS amount, currency_raw AS currency,
  COALESCE(CASE WHEN source_file = 'orders_cn' THEN remark_raw END, 'n/a') AS description,
  COALESCE(CASE WHEN source_file = 'orders_en' THEN customer_raw END, 'none') AS Customer
FROM forms WHERE amount_raw IS NOT NULL"""))


# ---- rate store ---------------------------------------------------------------------------

ISO_DATE = r"^(\d{4}-\d{2}-\d{2})$"
ISO_BASIC = r"^(\d{4})(\d{2})(\d{2})$"
ISO_DT = r"^(\d{4}-\d{2}-\d{2})[T](\d{2}):(\d{2})(?::(\d{2})(?:\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"


def store_date(t: str) -> str:
    """X5 on an already blank-nulled text expression."""
    return f"""(CASE WHEN regexp_matches({t}, '{ISO_DATE}') THEN TRY_CAST({t} AS DATE)
  WHEN regexp_matches({t}, '{ISO_BASIC}') THEN CAST(try_strptime({t}, '%Y%m%d') AS DATE)
  WHEN regexp_matches({t}, '{ISO_DT}') THEN TRY_CAST(regexp_extract({t}, '{ISO_DT}', 1) AS DATE) END)"""


def fetch_ts(t: str, fb: str) -> str:
    """X6 on a blank-nulled text and a fallback date expression."""
    g = lambda i: f"regexp_extract({t}, '{ISO_DT}', {i})"
    ss = f"(CASE WHEN {g(4)} = '' THEN '00' ELSE {g(4)} END)"
    off = (f"(CASE WHEN {g(5)} IN ('', 'Z') THEN '+00:00' WHEN length({g(5)}) = 5 "
           f"THEN substr({g(5)}, 1, 3) || ':' || substr({g(5)}, 4, 2) ELSE {g(5)} END)")
    return f"""(CASE WHEN {t} IS NULL THEN strftime({fb}, '%Y-%m-%d') || 'T00:00:00+00:00'
  WHEN regexp_matches({t}, '{ISO_DATE}') AND TRY_CAST({t} AS DATE) IS NOT NULL THEN {t} || 'T00:00:00+00:00'
  WHEN regexp_matches({t}, '{ISO_DT}') AND TRY_CAST({g(1)} AS DATE) IS NOT NULL
       AND TRY_CAST({g(2)} AS INT) < 24 AND TRY_CAST({g(3)} AS INT) < 60 AND TRY_CAST({ss} AS INT) < 60
  THEN {g(1)} || 'T' || {g(2)} || ':' || {g(3)} || ':' || {ss} || {off} END)"""


def rate_text(t: str, mode: str) -> str:
    fn = "round_even" if mode == "half_even" else "round"
    return f"CAST({fn}(TRY_CAST({blank_null(t)} AS DECIMAL(30,10)), 4) AS DECIMAL(18,4))"


RECORDS_RAW = RATES + """,
recs_src AS (
  SELECT *, dayofmonth(rate_date) AS dn, strftime(rate_date, '%Y-%m-%d') AS iso,
    CASE base_currency WHEN 'USD' THEN 0 WHEN 'EUR' THEN 1 ELSE 2 END AS idx,
    CASE base_currency WHEN 'USD' THEN 'pbc' WHEN 'EUR' THEN 'cfets' WHEN 'HKD' THEN 'safe' END AS src
  FROM rates),
records_raw AS (
  SELECT CAST((date_diff('day', DATE '1990-01-01', rate_date) * 10 + idx) * 2 AS BIGINT) AS record_no, dn,
    CASE WHEN dn % 5 = 0 THEN lower(base_currency) ELSE base_currency END AS base_currency,
    CASE WHEN dn % 3 = 0 THEN 'cny' ELSE quote_currency END AS quote_currency,
    CASE WHEN dn % 2 = 0 THEN CAST(rate_mid AS VARCHAR) || '5' ELSE CAST(rate_mid AS VARCHAR) END AS rate_mid,
    CASE WHEN dn % 7 = 0 THEN iso || 'T08:30:00+08:00' WHEN dn % 11 = 0 THEN 'bad-' || iso ELSE iso END AS rate_date,
    CASE WHEN dn % 4 = 0 THEN '' WHEN dn % 4 = 1 THEN iso || 'T10:11:12'
         WHEN dn % 4 = 2 THEN iso || 'T10:11:12.123456Z' ELSE iso || 'T23:59:59+0800' END AS fetch_date,
    CASE WHEN dn % 13 = 0 THEN ' ' ELSE src END AS source,
    CASE WHEN dn % 6 = 0 THEN 'forward' END AS fallback_strategy,
    CASE WHEN dn % 8 = 0 THEN 'http://rates.example/' || iso END AS download_url,
    CASE WHEN dn % 9 = 0 THEN '2023-06-01T00:00:00+00:00' END AS created_at,
    CAST(NULL AS VARCHAR) AS updated_at
  FROM recs_src)"""


def normalized(src: str, out: str, rounding: str = "half_even", url: str | None = None) -> str:
    req = ["base_currency", "quote_currency", "rate_mid", "rate_date", "fetch_date", "source"]
    checks = "\n".join(f"    WHEN {blank_null(c)} IS NULL THEN 'Missing required field: {c}'" for c in req)
    url_expr = f"'{url}'" if url is not None else f"COALESCE({blank_null('download_url')}, '')"
    return f""",
{out}_0 AS (
  SELECT *, {rate_text('rate_mid', rounding)} AS n_rate, {store_date(blank_null('rate_date'))} AS n_date
  FROM {src}),
{out}_1 AS (SELECT *, {fetch_ts(blank_null('fetch_date'), 'n_date')} AS n_fetch FROM {out}_0),
{out} AS (
  SELECT * EXCLUDE (base_currency, quote_currency, rate_mid, rate_date, fetch_date, source, fallback_strategy,
                    download_url, created_at, updated_at, n_rate, n_date, n_fetch),
    upper(base_currency) AS base_currency, upper(quote_currency) AS quote_currency,
    n_rate AS rate_mid, n_date AS rate_date, n_fetch AS fetch_date, source,
    COALESCE({blank_null('fallback_strategy')}, '') AS fallback_strategy,
    CAST(year(n_date) AS INTEGER) AS year, CAST(month(n_date) AS INTEGER) AS month,
    {url_expr} AS download_url,
    {blank_null('created_at')} AS created_at, {blank_null('updated_at')} AS updated_at,
    CASE
{checks}
    WHEN n_rate IS NULL THEN 'Invalid rate_mid: ' || {trim('rate_mid')}
    WHEN n_date IS NULL THEN 'Invalid rate_date: ' || {trim('rate_date')}
    WHEN n_fetch IS NULL THEN 'Invalid fetch_date: ' || {trim('fetch_date')}
    END AS error
  FROM {out}_1)"""


RATES_COLS = ("base_currency, quote_currency, rate_mid, rate_date, fetch_date, source, fallback_strategy, "
              "year, month, download_url, created_at, updated_at")

STORED = """,
stored AS (
  SELECT base_currency, quote_currency, rate_mid, rate_date,
    strftime(rate_date, '%Y-%m-%d') || 'T00:00:00+00:00' AS fetch_date,
    CASE base_currency WHEN 'USD' THEN 'pbc' WHEN 'EUR' THEN 'cfets' WHEN 'HKD' THEN 'safe' END AS source,
    '' AS fallback_strategy, CAST(year(rate_date) AS INTEGER) AS year, CAST(month(rate_date) AS INTEGER) AS month,
    '' AS download_url, '2024-01-01T00:00:00+00:00' AS created_at, '2024-01-01T00:00:00+00:00' AS updated_at,
    dayofmonth(rate_date) % 2 = 0 AS even_day
  FROM rates)"""

BATCH = RECORDS_RAW + """,
batch_raw AS (
  SELECT * EXCLUDE (record_no), record_no AS _ordinal FROM records_raw
  UNION ALL BY NAME
  SELECT * EXCLUDE (record_no, rate_mid, created_at), record_no + 1 AS _ordinal, '1' || rate_mid AS rate_mid,
         CAST(NULL AS VARCHAR) AS created_at
  FROM records_raw WHERE dn % 9 = 0)""" + normalized("batch_raw", "batch_n") + """,
batch AS (SELECT * FROM batch_n WHERE error IS NULL),
deduped AS (
  SELECT base_currency, quote_currency, rate_date,
    arg_max(rate_mid, _ordinal) AS rate_mid, arg_max(fetch_date, _ordinal) AS fetch_date,
    arg_max(source, _ordinal) AS source, arg_max(fallback_strategy, _ordinal) AS fallback_strategy,
    arg_max(year, _ordinal) AS year, arg_max(month, _ordinal) AS month,
    arg_max(download_url, _ordinal) AS download_url,
    arg_max(created_at, _ordinal) FILTER (WHERE created_at IS NOT NULL) AS created_at,
    arg_max(updated_at, _ordinal) AS updated_at
  FROM batch GROUP BY 1, 2, 3)"""

oracle("rates_normalize", q(RECORDS_RAW + normalized("records_raw", "normalized"),
                            f"SELECT record_no, {RATES_COLS}, error FROM normalized"))

oracle("parse_store_date", q(RECORDS_RAW, f"SELECT record_no, {store_date(blank_null('rate_date'))} AS rate_date FROM records_raw"))

oracle("normalize_fetch_ts", q(RECORDS_RAW, f"""SELECT record_no,
  {fetch_ts(blank_null('fetch_date'), store_date(blank_null('rate_date')))} AS fetch_ts FROM records_raw"""))

oracle("round_rate_even", q(RECORDS_RAW, f"SELECT record_no, {rate_text('rate_mid', 'half_even')} AS rate_mid FROM records_raw"))

oracle("round_rate_up", q(RECORDS_RAW, f"""SELECT record_no, {rate_text('rate_mid', 'half_up')} AS rate_mid,
  CAST({rate_text('rate_mid', 'half_up')} AS VARCHAR) AS rate_text FROM records_raw"""))

oracle("year_month_derive", q(RATES + STORED, """SELECT base_currency, quote_currency, rate_date,
  CAST(year(rate_date) AS INTEGER) AS year, CAST(month(rate_date) AS INTEGER) AS month FROM stored WHERE even_day"""))

oracle("fallback_default", q(RECORDS_RAW, f"""SELECT record_no,
  COALESCE({blank_null('source')}, 'manual') AS source,
  COALESCE({blank_null('fallback_strategy')}, '') AS fallback_strategy,
  COALESCE({blank_null('fallback_strategy')}, 'none') AS fallback_used FROM records_raw"""))

oracle("last_wins", q(BATCH, f"SELECT {RATES_COLS} FROM deduped"))

MERGE = """,
merged AS (
  SELECT COALESCE(d.base_currency, s.base_currency) AS base_currency,
    COALESCE(d.quote_currency, s.quote_currency) AS quote_currency,
    COALESCE(d.rate_date, s.rate_date) AS rate_date,
    CASE WHEN d.base_currency IS NOT NULL THEN d.rate_mid ELSE s.rate_mid END AS rate_mid,
    CASE WHEN d.base_currency IS NOT NULL THEN d.fetch_date ELSE s.fetch_date END AS fetch_date,
    CASE WHEN d.base_currency IS NOT NULL THEN d.source ELSE s.source END AS source,
    CASE WHEN d.base_currency IS NOT NULL THEN d.fallback_strategy ELSE s.fallback_strategy END AS fallback_strategy,
    CASE WHEN d.base_currency IS NOT NULL THEN d.year ELSE s.year END AS year,
    CASE WHEN d.base_currency IS NOT NULL THEN d.month ELSE s.month END AS month,
    CASE WHEN d.base_currency IS NOT NULL THEN d.download_url ELSE s.download_url END AS download_url,
    CASE WHEN d.base_currency IS NOT NULL THEN COALESCE(d.created_at, s.created_at, '{now}')
         ELSE s.created_at END AS created_at,
    CASE WHEN d.base_currency IS NOT NULL THEN '{now}' ELSE s.updated_at END AS updated_at
  FROM deduped d FULL OUTER JOIN (SELECT * FROM stored WHERE even_day) s
    ON d.base_currency = s.base_currency AND d.quote_currency = s.quote_currency AND d.rate_date = s.rate_date)"""
MERGE_NOW = "2025-01-01T00:00:00+00:00"

oracle("rates_upsert", q(BATCH + STORED + MERGE.replace("{now}", MERGE_NOW), f"SELECT {RATES_COLS} FROM merged"))

oracle("rates_range_query", q(RATES, """SELECT base_currency, quote_currency, rate_mid, rate_date FROM rates
  WHERE base_currency = 'USD' AND quote_currency = 'CNY' AND rate_date BETWEEN DATE '1997-03-15' AND DATE '1999-10-20'"""))

oracle("pair_filter", q(RATES, """SELECT base_currency, quote_currency, rate_mid, rate_date FROM rates
  WHERE base_currency = 'EUR' AND quote_currency = 'CNY'"""))

oracle("rates_sorted", q(RATES, """SELECT base_currency, quote_currency, rate_mid, rate_date,
  row_number() OVER (ORDER BY rate_date NULLS LAST, base_currency, quote_currency) AS position FROM rates ORDER BY position"""))

oracle("rates_preview", q(RATES, """SELECT base_currency, quote_currency, CAST(rate_mid AS VARCHAR) AS rate_mid, rate_date
  FROM rates WHERE base_currency = 'HKD' AND quote_currency = 'CNY' ORDER BY rate_date NULLS LAST, 1, 2 LIMIT 5"""))

oracle("store_write", q(RATES + STORED, f"SELECT {RATES_COLS} FROM stored"))

RATES_CSV = RATES + """,
rates_csv AS (
  SELECT base_currency, rate_date AS d, dayofmonth(rate_date) AS dn, strftime(rate_date, '%Y-%m-%d') AS iso,
    CASE WHEN dayofmonth(rate_date) % 2 = 0 THEN CAST(rate_mid AS VARCHAR) || '5' ELSE CAST(rate_mid AS VARCHAR) END AS rate_text
  FROM rates),
csv_records AS (
  SELECT base_currency, 'CNY' AS quote_currency,
    CAST(round_even(CAST(rate_text AS DECIMAL(30,10)), 4) AS DECIMAL(18,4)) AS rate_mid,
    d AS rate_date,
    iso || 'T00:00:00+00:00' AS fetch_date,
    CASE WHEN dn % 4 = 0 THEN 'csv_import' ELSE 'pbc_notice' END AS source,
    CASE WHEN dn % 3 = 0 THEN 'forward' ELSE 'none' END AS fallback_strategy,
    CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month,
    '' AS download_url, CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS VARCHAR) AS updated_at
  FROM rates_csv)"""

oracle("rates_csv_scan", q(RATES_CSV, f"SELECT {RATES_COLS}, CAST(NULL AS VARCHAR) AS error FROM csv_records"))

oracle("alias_rates", q(RATES_CSV, """SELECT base_currency, CAST(year(d) AS VARCHAR) AS year, CAST(month(d) AS VARCHAR) AS month,
  rate_text AS rate_mid, CASE WHEN dn = 1 THEN NULL ELSE iso END AS rate_date, iso AS fetch_date,
  CASE WHEN dn % 4 = 0 THEN NULL ELSE 'pbc_notice' END AS source,
  CASE WHEN dn % 3 = 0 THEN 'forward' END AS fallback_strategy FROM rates_csv"""))

oracle("import_rates", q(RATES_CSV + STORED + """,
deduped AS (SELECT * FROM csv_records)""" + MERGE.replace("{now}", MERGE_NOW), f"SELECT {RATES_COLS} FROM merged"))

oracle("upsert_one", q(RATES + STORED + """,
latest AS (
  SELECT base_currency, quote_currency, max(rate_date) AS rate_date, arg_max(rate_mid, rate_date) AS rate_mid
  FROM rates GROUP BY 1, 2),
deduped AS (
  SELECT base_currency, quote_currency, rate_date,
    CAST(round(CAST(CAST(rate_mid + 0.00005 AS DECIMAL(18,5)) AS DECIMAL(30,10)), 4) AS DECIMAL(18,4)) AS rate_mid,
    strftime(rate_date, '%Y-%m-%d') || 'T09:15:00+00:00' AS fetch_date, 'manual' AS source,
    '' AS fallback_strategy, CAST(year(rate_date) AS INTEGER) AS year, CAST(month(rate_date) AS INTEGER) AS month,
    'http://rates.example/manual' AS download_url, CAST(NULL AS VARCHAR) AS created_at
  FROM latest)""" + MERGE.replace("{now}", MERGE_NOW), f"SELECT {RATES_COLS} FROM merged"))


# ---- calendar, routing, monthly cache -----------------------------------------------------

# The monthly job's refresh months, and its calendar: fixed holidays, and the last Sunday of September worked.
REFRESH_MONTHS = ("1996-05", "1999-07", "2003-01")
_HOL = [f"{y}-{d}" for y in range(1990, 2031) for d in ("01-01", "05-01", "10-01", "10-02", "10-03")]
_WORK = [max(d for d in (_dt.date(y, 9, n) for n in range(24, 31)) if d.isoweekday() == 7).isoformat() for y in range(1990, 2031)]
CAL = ",\ncal_raw AS (SELECT * FROM (VALUES " + ", ".join(
    [f"(DATE '{d}', 'holiday')" for d in _HOL] + [f"(DATE '{d}', 'workday')" for d in _WORK]) + """) t(day, kind)),
cal AS (SELECT day, bool_or(kind = 'holiday') AS is_holiday, bool_or(kind = 'workday') AS is_workday
        FROM cal_raw GROUP BY day),
span AS (SELECT min(rate_date) AS a, max(rate_date) AS b FROM rates),
months AS (
  SELECT CAST(unnest(generate_series(CAST(date_trunc('month', a) AS TIMESTAMP), CAST(date_trunc('month', b) AS TIMESTAMP),
         INTERVAL 1 MONTH)) AS DATE) AS month_start FROM span),
safe_q AS (SELECT quote_date, rate, CAST(date_trunc('month', quote_date) AS DATE) AS ms FROM quotes WHERE source = 'safe'),
safe_win AS (
  SELECT ms AS month_start, CASE dayofweek(ms) WHEN 6 THEN ms + 2 WHEN 0 THEN ms + 1 ELSE ms END AS window_start
  FROM (SELECT DISTINCT ms FROM safe_q)),
safe_best AS (
  SELECT w.month_start, w.window_start, least(w.window_start + 10, last_day(w.month_start)) AS window_end,
         arg_min(q.rate, q.quote_date) AS safe_rate, min(q.quote_date) AS safe_date
  FROM safe_win w JOIN safe_q q ON q.ms = w.month_start
  WHERE q.quote_date BETWEEN w.window_start AND least(w.window_start + 10, last_day(w.month_start))
  GROUP BY 1, 2, 3)"""

MONTHLY_BASE = QUOTES + CAL


def business(day: str) -> str:
    return (f"CASE WHEN COALESCE(c.is_holiday, FALSE) THEN FALSE WHEN dayofweek({day}) IN (0, 6) "
            f"THEN COALESCE(c.is_workday, FALSE) ELSE TRUE END")


def candidates(n: str, months: str) -> str:
    return f""",
{n}_days AS (
  SELECT d.month_start, d.day, {business('d.day')} AS is_business
  FROM (SELECT month_start, CAST(unnest(generate_series(CAST(month_start AS TIMESTAMP), CAST(last_day(month_start) AS TIMESTAMP),
        INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT month_start FROM {months})) d
  LEFT JOIN cal c ON c.day = d.day),
{n}_fbd AS (SELECT month_start, min(day) FILTER (WHERE is_business) AS query_date FROM {n}_days GROUP BY 1),
{n}_cands AS (
  SELECT d.month_start, f.query_date, 0 AS cand_rank, d.day AS target_date
  FROM {n}_days d JOIN {n}_fbd f USING (month_start) WHERE d.day = f.query_date
  UNION ALL
  SELECT month_start, query_date, cand_rank, target_date FROM (
    SELECT d.month_start, f.query_date, row_number() OVER (PARTITION BY d.month_start ORDER BY d.day) AS cand_rank,
           d.day AS target_date
    FROM {n}_days d JOIN {n}_fbd f USING (month_start) WHERE d.day > f.query_date AND d.is_business)
  WHERE cand_rank <= 3
  UNION ALL
  SELECT d.month_start, f.query_date, 3 + date_diff('day', d.day, f.query_date), d.day
  FROM {n}_days d JOIN {n}_fbd f USING (month_start) WHERE d.day < f.query_date)"""


ORDERS_SQL = {"auto": ("pbc", "cfets", "safe"), "cfets": ("cfets", "safe")}


def route_sql(n: str, targets: str, group: str, order: str = "", prefer: str = "auto") -> str:
    vals = ", ".join(f"('{s}', {i})" for i, s in enumerate(ORDERS_SQL[prefer]))
    order_by = (order + ", " if order else "") + "src_rank"
    return f""",
{n}_src AS (SELECT * FROM (VALUES {vals}) s(source, src_rank)),
{n}_tries AS (
  SELECT t.*, s.source, s.src_rank,
    CASE WHEN s.source = 'safe' THEN sb.safe_rate ELSE q.rate END AS rate,
    CASE WHEN s.source = 'safe' THEN sb.safe_date ELSE q.quote_date END AS source_date
  FROM {targets} t CROSS JOIN {n}_src s
  LEFT JOIN quotes q ON s.source IN ('pbc', 'cfets') AND q.source = s.source AND q.quote_date = t.target_date
  LEFT JOIN safe_best sb ON s.source = 'safe' AND sb.month_start = CAST(date_trunc('month', t.target_date) AS DATE)),
{n}_best AS (
  SELECT *, target_date AS request_date,
    CASE source WHEN 'pbc' THEN 'pbc_notice' WHEN 'cfets' THEN 'cfets_notice' ELSE 'safe_portal' END AS rate_source,
    CASE WHEN source = 'safe' AND source_date <> target_date THEN 'forward'
         WHEN src_rank = 0 THEN 'none' ELSE source END AS fallback_used
  FROM {n}_tries WHERE rate IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {group} ORDER BY {order_by}) = 1)"""


def monthly_results(n: str, months: str) -> str:
    return candidates(n, months) + route_sql(n, f"{n}_cands", "month_start, query_date", "cand_rank") + f""",
{n}_res AS (
  SELECT CAST(year(month_start) AS INTEGER) AS year, CAST(month(month_start) AS INTEGER) AS month, query_date,
    request_date, CAST(round(rate, 4) AS DECIMAL(18,4)) AS mid_rate, source_date, rate_source, fallback_used
  FROM {n}_best)"""


MON_EXIST = """,
mon_exist AS (
  SELECT CAST(y AS VARCHAR) AS year, lpad(CAST(m AS VARCHAR), 2, '0') AS month, CAST(r AS VARCHAR) AS mid_rate,
    strftime(d, '%Y-%m-%d') AS query_date, strftime(d, '%Y-%m-%d') AS source_date,
    'pbc_notice' AS rate_source, 'none' AS fallback_used
  FROM (SELECT year(rate_date) AS y, month(rate_date) AS m, min(rate_date) AS d, arg_min(rate_mid, rate_date) AS r
        FROM rates WHERE base_currency = 'USD' GROUP BY 1, 2) WHERE m % 3 <> 0),
mon_scanned AS (
  SELECT * FROM mon_exist WHERE NOT (CAST(year AS INTEGER) > 1997 AND CAST(month AS INTEGER) IN (5, 7)))"""

REFRESH_VALUES = ", ".join(f"({int(r[:4])}, {int(r[5:])})" for r in REFRESH_MONTHS)


def todo_sql(n: str, existing: str) -> str:
    return f""",
{n}_todo AS (
  SELECT DISTINCT year, month, make_date(year, month, 1) AS month_start FROM (
    SELECT CAST(year(month_start) AS INTEGER) AS year, CAST(month(month_start) AS INTEGER) AS month FROM months
    WHERE (year(month_start), month(month_start)) NOT IN
          (SELECT (CAST(year AS INTEGER), CAST(month AS INTEGER)) FROM {existing})
    UNION ALL SELECT * FROM (VALUES {REFRESH_VALUES}) r(year, month)))"""


def merge_sql(n: str, existing: str) -> str:
    return todo_sql(n, existing) + monthly_results(n, f"{n}_todo") + f""",
{n}_rows AS (
  SELECT CAST(year AS VARCHAR) AS year, lpad(CAST(month AS VARCHAR), 2, '0') AS month, CAST(mid_rate AS VARCHAR) AS mid_rate,
    strftime(query_date, '%Y-%m-%d') AS query_date, strftime(source_date, '%Y-%m-%d') AS source_date,
    rate_source, fallback_used
  FROM {n}_res),
{n}_table AS (
  SELECT * FROM {existing} e WHERE NOT EXISTS (SELECT 1 FROM {n}_rows r WHERE r.year = e.year AND r.month = e.month)
  UNION ALL SELECT * FROM {n}_rows),
{n}_stats AS (
  SELECT (SELECT count(*) FROM {n}_rows) AS consumed,
    (SELECT count(*) FROM {n}_rows r LEFT JOIN {existing} e ON r.year = e.year AND r.month = e.month
     WHERE e.year IS NULL OR NOT (r.mid_rate = e.mid_rate AND r.query_date = e.query_date AND r.source_date = e.source_date
       AND r.rate_source = e.rate_source AND r.fallback_used = e.fallback_used)) AS changed,
    (SELECT count(*) FROM {n}_table) AS total_rows)"""


MONTHLY_COLS = "year, month, mid_rate, query_date, source_date, rate_source, fallback_used"

oracle("first_business_day", q(MONTHLY_BASE + candidates("m", "months"), """SELECT CAST(year(month_start) AS INTEGER) AS year,
  CAST(month(month_start) AS INTEGER) AS month, query_date AS first_business_day FROM m_fbd"""))

oracle("month_series", q(MONTHLY_BASE, """SELECT month_start, CAST(year(month_start) AS INTEGER) AS year,
  CAST(month(month_start) AS INTEGER) AS month, last_day(month_start) AS month_end FROM months"""))

oracle("calendar_membership", q(MONTHLY_BASE, f"""SELECT d.day, {business('d.day')} AS is_business
  FROM (SELECT DISTINCT rate_date AS day FROM rates) d LEFT JOIN cal c ON c.day = d.day"""))

oracle("missing_months", q(MONTHLY_BASE + MON_EXIST, """SELECT CAST(year(month_start) AS INTEGER) AS year,
  CAST(month(month_start) AS INTEGER) AS month FROM months
  WHERE (year(month_start), month(month_start)) NOT IN (SELECT (CAST(year AS INTEGER), CAST(month AS INTEGER)) FROM mon_exist)"""))

oracle("months_to_process", q(MONTHLY_BASE + MON_EXIST + todo_sql("t", "mon_exist"), "SELECT year, month FROM t_todo"))

oracle("monthly_rate_lookup", q(MONTHLY_BASE + monthly_results("m", "months"),
       "SELECT year, month, query_date, request_date, mid_rate, source_date, rate_source, fallback_used FROM m_res"))

oracle("pending_months", q(MONTHLY_BASE + MON_EXIST + todo_sql("t", "mon_exist") + monthly_results("t", "t_todo"),
       """SELECT t.year, t.month, CASE WHEN r.year IS NULL THEN 'pending' ELSE 'success' END AS status,
  CASE WHEN r.year IS NULL THEN 'USD/CNY rate unavailable for ' || CAST(t.year AS VARCHAR) || '-' || lpad(CAST(t.month AS VARCHAR), 2, '0') END AS reason,
  'auto' AS prefer_source
FROM t_todo t LEFT JOIN t_res r ON r.year = t.year AND r.month = t.month"""))

oracle("source_routing", q(MONTHLY_BASE + """,
all_days AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS target_date FROM span)"""
       + route_sql("r", "all_days", "target_date"),
       "SELECT target_date, request_date, rate, source_date, rate_source, fallback_used FROM r_best"))

oracle("forward_window_lookup", q(MONTHLY_BASE, "SELECT month_start, window_start, window_end, safe_rate, safe_date FROM safe_best"))

oracle("single_rate", q(MONTHLY_BASE + """,
order_days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS target_date FROM orders)"""
       + route_sql("r", "order_days", "target_date", prefer="cfets"),
       "SELECT target_date, request_date, rate, source_date, rate_source, fallback_used FROM r_best"))

oracle("monthly_upsert", q(MONTHLY_BASE + MON_EXIST + merge_sql("u", "mon_exist"), f"SELECT {MONTHLY_COLS} FROM u_table"))

oracle("upsert_stats", q(MONTHLY_BASE + MON_EXIST + merge_sql("u", "mon_exist"), "SELECT consumed, changed, total_rows FROM u_stats"))

oracle("monthly_normalize", q(MONTHLY_BASE + monthly_results("m", "months"), """SELECT CAST(year AS VARCHAR) AS year,
  lpad(CAST(month AS VARCHAR), 2, '0') AS month, CAST(mid_rate AS VARCHAR) AS mid_rate,
  CASE WHEN month % 4 = 0 THEN strftime(source_date, '%Y-%m-%d') ELSE strftime(query_date, '%Y-%m-%d') END AS query_date,
  strftime(source_date, '%Y-%m-%d') AS source_date, rate_source, fallback_used FROM m_res"""))

oracle("monthly_csv_scan", q(MONTHLY_BASE + MON_EXIST, f"SELECT {MONTHLY_COLS} FROM mon_scanned"))

oracle("monthly_write", q(MONTHLY_BASE + MON_EXIST + merge_sql("u", "mon_exist"), """SELECT year AS "年份", month AS "月份",
  mid_rate AS "中间价", query_date AS "查询日期", source_date AS "来源日期", rate_source AS "数据源", fallback_used AS "回退策略"
FROM u_table"""))

oracle("months_sorted", q(MONTHLY_BASE + MON_EXIST + merge_sql("u", "mon_exist"),
       """SELECT year, month, row_number() OVER (ORDER BY CAST(year AS INTEGER), CAST(month AS INTEGER)) AS position
FROM u_table ORDER BY position"""))

oracle("alias_monthly", q(MONTHLY_BASE + MON_EXIST,
       "SELECT year, month, mid_rate, source_date, rate_source, query_date FROM mon_exist"))

oracle("build_monthly_rates", q(MONTHLY_BASE + MON_EXIST + merge_sql("b", "mon_scanned"), f"SELECT {MONTHLY_COLS} FROM b_table"))


# ---- HTML extraction ----------------------------------------------------------------------
# Derived pages (notices, key chart, portal tables) are checked against the values they were
# generated from; links on the real pages are parsed with DuckDB's regex functions.

# Anchors, and the character references decoded in text.
ANCHOR_PATTERN = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

PAGE_DAYS = RATES + """,
per_day AS (SELECT rate_date AS d, rate_mid AS r, dayofmonth(rate_date) AS dn, month(rate_date) AS mon,
  1000000 * CASE base_currency WHEN 'USD' THEN 0 WHEN 'EUR' THEN 1 ELSE 2 END AS set_id FROM rates),
notice_truth AS (
  SELECT CAST(set_id + date_diff('day', DATE '1990-01-01', d) AS BIGINT) AS page_id, d AS target_date,
    CASE WHEN dn % 7 = 0 THEN NULL ELSE d END AS notice_date,
    CASE WHEN dn % 5 = 0 OR dn % 9 = 0 THEN NULL
         WHEN dn % 4 = 0 THEN CAST(CAST(round(r, 2) AS DECIMAL(18,2)) AS DECIMAL(18,6))
         ELSE CAST(r AS DECIMAL(18,6)) END AS rate_a,
    CASE WHEN dn % 5 = 0 OR dn % 9 = 0 OR dn % 4 = 0 THEN NULL ELSE r END AS rate_b,
    d AS date_b
  FROM per_day),
chart_truth AS (
  SELECT CAST(set_id + year(d) * 100 + month(d) AS BIGINT) AS page_id, d, CAST(r AS DECIMAL(18,6)) AS rate
  FROM per_day WHERE dn % 6 <> 0),
chart_first AS (SELECT d, arg_min(rate, page_id) AS rate FROM chart_truth GROUP BY d),
portal_rows AS (
  SELECT CAST(set_id + year(d) * 100 + month(d) AS BIGINT) AS page_id, mon, d AS quote_date, dn,
    CAST(row_number() OVER (PARTITION BY set_id, year(d), month(d) ORDER BY d) - 1 AS INTEGER) AS row_pos,
    CASE WHEN mon % 2 = 0 OR mon % 3 = 0 THEN CAST(CAST(r * 100 AS DECIMAL(18,2)) AS DECIMAL(30,10))
         ELSE CAST(r AS DECIMAL(30,10)) END AS raw_rate
  FROM per_day),
portal_valid AS (SELECT * FROM portal_rows WHERE dn % 7 <> 0),
portal_pages AS (
  SELECT page_id, (bool_or(raw_rate >= 50) OR any_value(mon) % 2 = 0
                   OR (any_value(mon) % 2 = 1 AND any_value(mon) % 5 = 0)) AS per100
  FROM portal_valid GROUP BY page_id),
portal_scaled AS (
  SELECT v.page_id, v.quote_date, v.row_pos, v.raw_rate, p.per100,
    CAST(round(CASE WHEN p.per100 THEN v.raw_rate * 0.01 ELSE v.raw_rate END, 4) AS DECIMAL(18,4)) AS rate
  FROM portal_valid v JOIN portal_pages p USING (page_id))"""

oracle("notice_parse", q(PAGE_DAYS, "SELECT page_id, target_date, notice_date, rate_a, rate_b, date_b FROM notice_truth"))

oracle("keychart_rows", q(PAGE_DAYS, """SELECT u.d AS target_date, c.rate FROM (SELECT DISTINCT d FROM per_day) u
  JOIN chart_first c ON c.d = u.d"""))

oracle("notice_then_chart", q(PAGE_DAYS + """,
span AS (SELECT min(rate_date) AS a, max(rate_date) AS b FROM rates),
all_days AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS target_date FROM span),
first_notice AS (
  SELECT notice_date, arg_min(rate_a, page_id) AS rate_a FROM notice_truth
  WHERE notice_date IS NOT NULL AND rate_a IS NOT NULL GROUP BY notice_date)""",
       """SELECT t.target_date, CAST(COALESCE(n.rate_a, c.rate) AS DECIMAL(18,6)) AS rate,
  CASE WHEN COALESCE(n.rate_a, c.rate) IS NOT NULL THEN t.target_date END AS source_date,
  CASE WHEN n.rate_a IS NOT NULL THEN 'pbc_notice' WHEN c.rate IS NOT NULL THEN 'pbc_keychart' END AS rate_source
FROM all_days t LEFT JOIN first_notice n ON n.notice_date = t.target_date LEFT JOIN chart_first c ON c.d = t.target_date"""))

oracle("table_rows", q(PAGE_DAYS, "SELECT page_id, row_pos, quote_date, raw_rate FROM portal_valid"))
oracle("parse_table_date", q(PAGE_DAYS, "SELECT page_id, row_pos, quote_date FROM portal_valid"))
oracle("per100_detect", q(PAGE_DAYS, "SELECT page_id, per100 FROM portal_pages"))
oracle("scale_per100", q(PAGE_DAYS, "SELECT page_id, quote_date, rate FROM portal_scaled"))

oracle("extract_quotes", q(PAGE_DAYS, """
SELECT 'pbc_notice' AS source, page_id, notice_date AS quote_date, rate_a AS rate FROM notice_truth
  WHERE notice_date IS NOT NULL AND rate_a IS NOT NULL
UNION ALL SELECT 'cfets_notice', page_id, date_b, CAST(rate_b AS DECIMAL(18,6)) FROM notice_truth WHERE rate_b IS NOT NULL
UNION ALL SELECT 'pbc_keychart', page_id, d, rate FROM chart_truth
UNION ALL SELECT 'safe_portal', page_id, quote_date, CAST(rate AS DECIMAL(18,6)) FROM portal_scaled"""))

PAGE_QUOTES = PAGE_DAYS + """,
quotes AS (
  SELECT 'pbc' AS source, quote_date, arg_min(rate, (o, page_id)) AS rate FROM (
    SELECT 0 AS o, page_id, notice_date AS quote_date, rate_a AS rate FROM notice_truth
      WHERE notice_date IS NOT NULL AND rate_a IS NOT NULL
    UNION ALL SELECT 1, page_id, d, rate FROM chart_truth) GROUP BY quote_date
  UNION ALL SELECT 'cfets', date_b, arg_min(CAST(rate_b AS DECIMAL(18,6)), page_id) FROM notice_truth
    WHERE rate_b IS NOT NULL AND date_b IS NOT NULL GROUP BY date_b
  UNION ALL SELECT 'safe', quote_date, arg_max(CAST(rate AS DECIMAL(18,6)), page_id) FROM portal_scaled GROUP BY quote_date)"""

oracle("page_quotes", q(PAGE_QUOTES, "SELECT source, quote_date, rate FROM quotes"))
oracle("pages_to_monthly", q(PAGE_QUOTES + CAL + monthly_results("m", "months"),
       "SELECT year, month, query_date, request_date, mid_rate, source_date, rate_source, fallback_used FROM m_res"))

oracle("pages_scan", """SELECT page_id, url, CAST(octet_length(encode(html)) AS INTEGER) AS html_bytes,
  CAST(least(octet_length(encode(html)), 200000) AS INTEGER) AS snapshot_bytes FROM pages""")


def decode_sql(x: str) -> str:
    out = x
    for ent, ch in ENTITIES:
        out = "replace(%s, '%s', '%s')" % (out, ent, ch.replace("'", "''"))
    return out


DROP_BLOCKS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def nodes_sql(x: str) -> str:
    split = (f"string_split(regexp_replace(regexp_replace({x}, '{DROP_BLOCKS}', chr(1), 'g'), "
             f"'(?s)<[^>]*>', chr(1), 'g'), chr(1))")
    return f"list_filter(list_transform({split}, lambda t: {trim(decode_sql('t'))}), lambda t: t <> '')"


ANCHOR_SQL = ANCHOR_PATTERN.replace("'", "''")
SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def fold_sql(p: str) -> str:
    """Dot segments of a path applied one by one; query and fragment stay."""
    bare = f"regexp_extract({p}, '^([^?#]*)', 1)"
    parts = f"list_concat([[]::VARCHAR[]], list_transform(string_split({bare}, '/')[2:], lambda s: [s]))"
    kept = (f"list_reduce({parts}, lambda a, b: CASE WHEN b[1] = '..' THEN a[1:greatest(len(a) - 1, 0)] "
            f"WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END)")
    slash = f"CASE WHEN string_split({bare}, '/')[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END"
    return f"('/' || array_to_string({kept}, '/') || {slash} || substr({p}, length({bare}) + 1))"


def resolve_sql(b: str, h: str) -> str:
    scheme = f"regexp_extract({b}, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)"
    origin = f"regexp_extract({b}, '{ORIGIN}', 1)"
    no_frag = f"regexp_replace({b}, '#.*$', '')"
    no_query = f"regexp_replace({no_frag}, '\\?.*$', '')"
    base_dir = f"regexp_replace({no_query}, '[^/]*$', '')"
    base_path = f"substr({base_dir}, length({origin}) + 1)"
    return f"""(CASE WHEN {h} = '' THEN {no_frag}
  WHEN regexp_matches({h}, '{SCHEME}') THEN {h}
  WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h}
  WHEN starts_with({h}, '/') THEN {origin} || {fold_sql(h)}
  WHEN starts_with({h}, '?') THEN {no_query} || {h}
  WHEN starts_with({h}, '#') THEN {no_frag} || {h}
  ELSE {origin} || {fold_sql(f"(CASE WHEN {base_path} = '' THEN '/' ELSE {base_path} END) || {h}")} END)"""


LINKS = f"""
anchors AS (
  SELECT page_id, url, unnest(h) AS href_raw, unnest(t) AS inner_html, unnest(range(1, len(h) + 1)) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '{ANCHOR_SQL}', 1) AS h,
               regexp_extract_all(html, '{ANCHOR_SQL}', 2) AS t FROM pages)),
links0 AS (
  SELECT page_id, url, CAST(pos AS INTEGER) AS pos, {trim(decode_sql('href_raw'))} AS href,
    array_to_string({nodes_sql('inner_html')}, '') AS text FROM anchors),
links AS (SELECT page_id, pos, text, href, {resolve_sql('url', 'href')} AS link FROM links0),
rate_links AS (SELECT * FROM links WHERE text <> '' AND href <> '' AND contains(text, '人民币汇率中间价'))"""
TITLED_LINKS = "titled AS (SELECT * REPLACE (replace(html, 'the', '人民币汇率中间价') AS html) FROM pages)," + LINKS.replace(
    "FROM pages)", "FROM titled)")

oracle("extract_links", q(LINKS, "SELECT page_id, pos, text, href, link FROM links"))
oracle("rate_link_filter", q(TITLED_LINKS, "SELECT page_id, pos, text, link FROM rate_links"))
oracle("link_dedupe", q(TITLED_LINKS, """SELECT link, arg_min(page_id, (page_id, pos)) AS page_id, arg_min(pos, (page_id, pos)) AS pos
FROM rate_links GROUP BY link"""))

oracle("strip_query", "SELECT page_id, split_part(url, '?', 1) AS url FROM pages")
oracle("mask_digits", f"""SELECT doc_id, {trim("replace(regexp_replace(text, '\\p{Nd}{3,}', '***', 'g'), chr(10), ' ')")} AS text
FROM documents""")
oracle("text_preview", "SELECT doc_id, substr(COALESCE(text, ''), 1, 1000) AS preview FROM documents")


# ---- drive listings, paths, uploads -------------------------------------------------------

LISTING_TRUTH = """
truth AS (
  SELECT event_id,
    CASE WHEN event_id % 2 = 0 THEN 'e' || CAST(event_id AS VARCHAR) ELSE 'f' || CAST(event_id AS VARCHAR) END AS id,
    'item_' || CAST(event_id AS VARCHAR) AS name,
    CASE WHEN event_type = 'view' THEN 'folder' ELSE 'file' END AS item_type,
    'u' || CAST(user_id AS VARCHAR) AS parent_id,
    CASE event_id % 4 WHEN 0 THEN ts WHEN 2 THEN date_trunc('second', ts) - INTERVAL 8 HOUR
         ELSE date_trunc('second', ts) END AS created_at,
    date_trunc('second', ts) AS updated_at,
    CASE WHEN event_type <> 'view' AND event_id % 5 <> 0 AND CAST(trunc(value * 100) AS BIGINT) <> 0
         THEN CAST(trunc(value * 100) AS BIGINT) END AS size,
    CASE WHEN event_type <> 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'application/pdf' ELSE 'text/csv' END END AS mime_type,
    event_type
  FROM events)"""

oracle("drive_listing", q(LISTING_TRUTH, """SELECT event_id, id, name, item_type, parent_id, created_at, updated_at, size,
  mime_type, CASE WHEN event_id % 6 = 0 THEN 'owner={"name":"o"};starred=true;' ELSE '' END || 'version=' || CAST(event_id % 9 AS VARCHAR) AS extra
FROM truth WHERE event_type <> 'error'"""))
oracle("parse_api_time", q(LISTING_TRUTH, "SELECT event_id, created_at FROM truth"))

GEO = """
geo AS (
  SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n_name, n_regionkey, r_name
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

oracle("path_validate", q(GEO, """SELECT c_custkey,
  CASE WHEN c_custkey % 19 = 0 THEN ''
       WHEN c_custkey % 7 = 0 THEN '企业盘/' || r_name || '/' || n_name || '/' || c_mktsegment || '/'
       WHEN c_custkey % 11 = 0 THEN '企业盘//' || n_name
       WHEN c_custkey % 13 = 0 THEN '企业盘/' || r_name || '/' || n_name || '/' || c_mktsegment || '/财务?'
       WHEN c_custkey % 17 = 0 THEN '企业盘/' || n_name || '/' || n_name
       ELSE '企业盘/' || r_name || '/' || n_name || '/' || c_mktsegment END AS path,
  c_custkey % 19 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 AS valid,
  CASE WHEN c_custkey % 19 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0
            AND c_custkey % 17 <> 0 THEN '企业盘' END AS space_label,
  CASE WHEN c_custkey % 19 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0
            AND c_custkey % 17 <> 0 THEN r_name || '/' || n_name || '/' || c_mktsegment END AS folders,
  CASE WHEN c_custkey % 19 = 0 THEN '路径不能为空' WHEN c_custkey % 7 = 0 THEN '路径尾部存在空段'
       WHEN c_custkey % 11 = 0 THEN '路径包含空段' WHEN c_custkey % 13 = 0 THEN '路径段包含非法字符: 财务?'
       WHEN c_custkey % 17 = 0 THEN '路径存在重复段: ' || n_name END AS error
FROM geo"""))

oracle("path_normalize", q(GEO, """SELECT c_custkey,
  CASE WHEN c_custkey % 5 = 4 THEN 'n' || CAST(c_nationkey AS VARCHAR) ELSE 'root' END AS parent_id,
  CASE WHEN c_custkey % 9 <> 0 THEN c_name END AS item_name,
  CASE WHEN c_custkey % 9 = 0 THEN 'Drive item name must not be empty' END AS name_error,
  CASE WHEN c_custkey % 4 = 0 THEN r_name || '/' || n_name ELSE r_name || '/' || n_name || '/' || c_mktsegment END AS drive_path
FROM geo"""))

oracle("folder_resolve", q(GEO, """SELECT DISTINCT
  CASE WHEN c_custkey % 25 = 0 THEN 'root/' || r_name || '/NOPE/' || c_mktsegment
       WHEN c_custkey % 10 = 0 THEN r_name || '/' || n_name || '/' || c_mktsegment || '/archive_' || CAST(c_custkey % 3 AS VARCHAR)
       ELSE r_name || '/' || n_name || '/' || c_mktsegment END AS path,
  CASE WHEN c_custkey % 10 <> 0 AND c_custkey % 25 <> 0
       THEN 's' || CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment END AS folder_id,
  CASE WHEN c_custkey % 25 = 0 THEN r_name || '/NOPE'
       WHEN c_custkey % 10 = 0 THEN r_name || '/' || n_name || '/' || c_mktsegment || '/archive_' || CAST(c_custkey % 3 AS VARCHAR)
       END AS missing_prefix
FROM geo"""))

oracle("conflict_policy", q(GEO, """SELECT c_custkey, 's' || CAST(c_nationkey AS VARCHAR) || '_' || c_mktsegment AS folder_id,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || '.xlsx' ELSE 'new_' || c_name || '.xlsx' END AS requested_name,
  CASE c_custkey % 3 WHEN 0 THEN 'skip' WHEN 1 THEN 'overwrite' ELSE 'rename' END AS strategy,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'skipped' ELSE 'uploaded' END AS status,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 2 THEN c_name || '_20250102-030405.xlsx'
       WHEN c_custkey % 2 = 0 THEN c_name || '.xlsx' ELSE 'new_' || c_name || '.xlsx' END AS final_name
FROM geo"""))

ATTEMPTS = f"""
attempts AS (
  SELECT user_id AS batch_id, 'doc_' || CAST(event_id % 7 AS VARCHAR) AS item, event_id AS ordinal,
    CASE WHEN event_type IN ('purchase', 'click') THEN 'uploaded' WHEN event_type = 'view' THEN 'skipped'
         ELSE 'failed' END AS status,
    'doc_' || CAST(event_id % 7 AS VARCHAR) || '.xlsx' AS requested_name,
    CASE WHEN event_type = 'click' THEN 'doc_' || CAST(event_id % 7 AS VARCHAR) || '_' || strftime(ts, '%Y%m%d-%H%M%S') || '.xlsx'
         WHEN event_type IN ('purchase', 'view') THEN 'doc_' || CAST(event_id % 7 AS VARCHAR) || '.xlsx' END AS final_name,
    event_type = 'error' AS retryable,
    CASE WHEN event_type = 'error' THEN 'upload Timeout for ***.xlsx please retry'
         WHEN event_type = 'signup' THEN 'permission denied: ***.xlsx' END AS reason
  FROM events),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY batch_id, item ORDER BY ordinal) AS attempt_no FROM attempts),
chosen AS (
  SELECT *, (status <> 'failed' OR NOT retryable OR attempt_no > 2) AS ends FROM numbered
  QUALIFY row_number() OVER (PARTITION BY batch_id, item
    ORDER BY CASE WHEN (status <> 'failed' OR NOT retryable OR attempt_no > 2) THEN 0 ELSE 1 END,
             CASE WHEN (status <> 'failed' OR NOT retryable OR attempt_no > 2) THEN attempt_no ELSE -attempt_no END) = 1)"""

oracle("retryable", q(ATTEMPTS, "SELECT ordinal, retryable FROM attempts"))
oracle("mask_names", q(ATTEMPTS, "SELECT ordinal, '***.xlsx' AS masked_name, reason FROM attempts"))
oracle("upload_outcomes", q(ATTEMPTS, """SELECT batch_id, item, CAST(attempt_no AS BIGINT) AS attempts, status, final_name,
  CASE WHEN status = 'failed' THEN reason END AS reason FROM chosen"""))
oracle("batch_report", q(ATTEMPTS, """SELECT batch_id, count(*) AS total,
  count(*) FILTER (WHERE status = 'uploaded') AS succeeded, count(*) FILTER (WHERE status = 'failed') AS failed,
  count(*) FILTER (WHERE status = 'skipped') AS skipped,
  count(*) FILTER (WHERE status = 'uploaded' AND final_name IS NOT NULL AND final_name <> requested_name) AS renamed,
  CAST(sum(attempt_no) AS BIGINT) AS attempts
FROM chosen GROUP BY batch_id"""))

oracle("batch_items", q(ATTEMPTS + """,
renames AS (SELECT *, CASE WHEN status = 'uploaded' AND final_name <> requested_name THEN final_name END AS renamed_to FROM chosen),
listed AS (
  SELECT *, CASE status WHEN 'uploaded' THEN 'success' ELSE status END AS list FROM renames
  UNION ALL SELECT *, 'renamed' FROM renames WHERE renamed_to IS NOT NULL)""", """
SELECT batch_id, list, row_number() OVER (PARTITION BY batch_id, list ORDER BY item) AS position,
  COALESCE(final_name, requested_name) AS name, requested_name AS requested, renamed_to,
  CASE WHEN status = 'failed' THEN reason END AS reason, CAST(attempt_no AS BIGINT) AS attempts FROM listed"""))
oracle("batch_durations", """SELECT user_id AS batch_id, CAST(date_sub('second', min(ts), max(ts)) AS BIGINT) AS seconds
FROM events GROUP BY user_id""")

import mimetypes as _mt  # noqa: E402

_MIME_ROWS = sorted({(e.lstrip(".").lower(), t) for e, t in _mt.MimeTypes().types_map[True].items()})
oracle("mime_type", q(GEO + ",\nmime(ext, mime_type) AS (VALUES " + ", ".join(
    "('%s', '%s')" % (e, t) for e, t in _MIME_ROWS) + ")",
    """SELECT g.c_name || '.xlsx' AS file_name, COALESCE(m.mime_type, 'application/octet-stream') AS mime_type
FROM geo g LEFT JOIN mime m ON m.ext = 'xlsx'"""))


# ---- template filling, layout and scans ------------------------------------------------------

FILES = FORMS_RAW + """,
files AS (SELECT DISTINCT source_file FROM forms)"""


def cells_sql(kinds: list[str]) -> str:
    parts = []
    if "sum" in kinds:
        parts.append("""SELECT source_file, 'B2' AS cell, CAST(NULL AS VARCHAR) AS value,
  round(CASE WHEN source_file = 'orders_en'
             THEN COALESCE(sum(COALESCE(TRY_CAST(amount_raw AS DOUBLE), 0)), 0) ELSE 0 END, 4) AS number
FROM forms GROUP BY source_file""")
    if "first" in kinds:
        parts.append("""SELECT source_file, 'B3' AS cell,
  CASE WHEN source_file = 'orders_en' THEN arg_min(project_raw, source_row) FILTER (WHERE project_raw IS NOT NULL) END AS value,
  CAST(NULL AS DOUBLE) AS number
FROM forms GROUP BY source_file""")
    if "literals" in kinds:
        parts.append("""SELECT f.source_file, c.cell, c.value, CAST(NULL AS DOUBLE) AS number FROM files f CROSS JOIN (VALUES
  ('B4', '2025-01-31'), ('B5', 'acme'), ('B6', '0.06'), ('B7', NULL), ('B8', '42'), ('B9', 'Invoice'), ('B10', NULL)) c(cell, value)""")
    return "\nUNION ALL\n".join(parts)


oracle("cell_sum", q(FILES, cells_sql(["sum"])))
oracle("cell_first", q(FILES, cells_sql(["first"])))
oracle("cell_literals", q(FILES, cells_sql(["literals"])))
oracle("fill_template", q(FILES, cells_sql(["sum", "first", "literals"])))

PAGED = """
paged AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS z
  FROM lineitem)"""

oracle("page_index", q(PAGED, """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(z // 3 AS BIGINT) AS page,
  CAST(z % 3 AS BIGINT) AS "offset" FROM paged"""))

oracle("cell_layout", q(PAGED + """,
parts AS (
  SELECT *, CASE WHEN z // 3 = 0 THEN 'invoice.xlsx' ELSE 'invoice_part' || CAST(z // 3 + 1 AS VARCHAR) || '.xlsx' END AS part_name,
         CAST(z % 3 + 10 AS VARCHAR) AS r FROM paged)""", """
SELECT l_orderkey, part_name, 'A' || r AS cell_ref, CAST(l_partkey AS VARCHAR) AS value FROM parts
UNION ALL SELECT l_orderkey, part_name, 'B' || r, CAST(l_suppkey AS VARCHAR) FROM parts
UNION ALL SELECT l_orderkey, part_name, 'C' || r, l_returnflag FROM parts"""))

oracle("forms_scan", q(FORMS_RAW, """SELECT source_file AS folder, _key AS order_key, amount_raw AS amount,
  currency_raw AS currency, date_raw AS date, project_raw AS project,
  CASE WHEN source_file = 'orders_cn' THEN remark_raw END AS description FROM forms"""))

oracle("form_records", """
WITH o AS (SELECT o_orderkey AS k, o_orderkey // 500 AS part, o_totalprice, o_orderdate FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k) + 1 AS source_row FROM o)
SELECT part, source_row,
  CASE WHEN k % 53 <> 0 THEN CAST(k AS VARCHAR) END AS order_text,
  CASE WHEN k % 53 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS amount_text,
  CASE WHEN k % 53 <> 0 AND k % 59 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_text,
  CASE WHEN k % 53 = 0 OR k % 59 = 0 THEN NULL WHEN k % 7 = 0 THEN 'two' || chr(10) || 'lines, of ' || k
       WHEN k % 5 = 0 THEN 'said "' || k || '"' ELSE '5" pipe' END AS project_text,
  CASE WHEN k % 53 = 0 THEN 'long' WHEN k % 59 = 0 THEN 'short' END AS reason,
  CASE WHEN k % 53 = 0 THEN CAST(7 AS BIGINT) WHEN k % 59 = 0 THEN CAST(3 AS BIGINT) END AS cells,
  CASE WHEN k % 53 = 0 THEN FALSE WHEN k % 59 = 0 THEN TRUE END AS kept
FROM n""")

oracle("multi_path_scan", q(FORMS_RAW, "SELECT source_file AS folder, _key AS order_key FROM forms"))

oracle("scan_usecols", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem")

def _cn(column):
    return f"CASE WHEN source_file = 'orders_cn' THEN COALESCE({column}, '') ELSE '' END"


oracle("sheet_conform", q(FORMS_RAW, f"""SELECT {_cn('amount_raw')} AS "金额", {_cn('currency_raw')} AS "币种",
  {_cn('date_raw')} AS " 日期 ", {_cn('project_raw')} AS "项目名称", '' AS "附件",
  CASE WHEN source_file = 'orders_en' THEN COALESCE(amount_raw, '') ELSE '' END AS "Amount",
  source_file, CAST(source_row AS VARCHAR) AS source_row FROM forms"""))

LANDED = """
landed AS (SELECT doc_id AS number, '/' || source || '/' || lang || '/' || doc_id ||
    CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.csv.gz' ELSE '' END AS path,
    encode(COALESCE(text, '')) AS content, CAST(strlen(COALESCE(text, '')) AS BIGINT) AS size FROM documents),
named AS (SELECT *, string_split(path, '/')[-1] AS file_name FROM landed)"""

oracle("file_index", q(LANDED, """SELECT path, file_name, size, sha256(content) AS sha256, false AS parsed,
  CASE number % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/csv' ELSE 'application/octet-stream' END AS mime_type FROM named"""))
oracle("prefix_hash", q(LANDED, """SELECT path, sha256(unhex(left(hex(content), 2 * 8192))) AS prefix_sha256,
  least(size, 8192) AS sampled_bytes FROM named"""))
oracle("download_verify", q(LANDED, """SELECT file_name, listed_size, actual_size,
  CASE WHEN listed_size IS NOT NULL AND listed_size IS DISTINCT FROM actual_size
       THEN 'size mismatch: expected ' || listed_size || ', got ' || COALESCE(CAST(actual_size AS VARCHAR), 'none') END AS error
FROM (SELECT file_name, CASE WHEN number % 11 <> 0 THEN size + CASE WHEN number % 7 = 0 THEN 1 ELSE 0 END END AS listed_size,
             CASE WHEN number % 13 <> 0 THEN size END AS actual_size FROM named)"""))

oracle("schema_migrate", q(RATES + STORED, """SELECT base_currency, quote_currency, CAST(rate_mid AS VARCHAR) AS rate_mid,
  CAST(rate_date AS VARCHAR) AS rate_date, fetch_date, source, '' AS fallback_strategy, CAST(year AS VARCHAR) AS year,
  CAST(month AS VARCHAR) AS month, '' AS download_url, '' AS created_at, '' AS updated_at, 2 AS version,
  CAST(NULL AS VARCHAR) AS legacy FROM stored
UNION ALL SELECT base_currency, quote_currency, CAST(rate_mid AS VARCHAR), CAST(rate_date AS VARCHAR), fetch_date, source, NULL,
  CAST(year AS VARCHAR), CAST(month AS VARCHAR), NULL, NULL, NULL, 1, 'x' FROM stored"""))

oracle("date_from_year_month", q(RATES, """SELECT base_currency, rate_date,
  CASE WHEN dayofmonth(rate_date) % 10 <> 0 THEN rate_date
       WHEN dayofmonth(rate_date) = 20 THEN NULL
       ELSE make_date(year(rate_date), month(rate_date), 1) END AS resolved_date FROM rates"""))

oracle("mapping_diagnostics", q(FORMS_RAW, """SELECT source_file AS file, count(*) AS rows,
  CASE WHEN source_file = 'orders_en' THEN 'description' ELSE '' END AS missing_columns,
  CASE WHEN source_file = 'orders_en' THEN 'Customer' ELSE '' END AS unmatched_columns
FROM forms GROUP BY source_file"""))
