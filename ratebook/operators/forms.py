"""Fee-form cleaning, conversion and validation as column expressions.

Row flags are carried as columns and the ordered issue list is built once,
at the end, with ``array_compact(array(...))`` in the reference's order:
cleaning (amount, currency, date), rate, required, negative,
missing_base_amount, confirmation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratebook.functions.dates import parse_form_date
from ratebook.functions.numbers import parse_amount
from ratebook.functions.text import blank_to_null, is_missing, strip_unicode
from ratebook.operators.mapping import MappingConfig
from ratebook.operators.staging import barrier
from ratebook.operators.rates_lookup import lookup_asof, lookup_static
from ratebook.schemas import AMOUNT, BASE_AMOUNT, EXCHANGE_RATE


def trim_strings(df: DataFrame, skip=("issues",)) -> DataFrame:
    """Strip Unicode whitespace from every string column."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StringType) and f.name not in skip:
            exprs.append(strip_unicode(F.col(f"`{f.name}`")).alias(f.name))
        else:
            exprs.append(F.col(f"`{f.name}`"))
    return df.select(*exprs)


def clean_forms(df: DataFrame) -> DataFrame:
    """Trimmed text; typed amount, currency and date with issue flags.

    Values are parsed once; the flags are computed from the parsed columns
    after a barrier, so no parse runs twice.
    """
    out = trim_strings(df)
    cols = set(out.columns)
    none = F.lit(None).cast("string")
    amount, _ = parse_amount(F.col("amount")) if "amount" in cols else (F.lit(None).cast(AMOUNT), None)
    ccy = F.upper(blank_to_null(F.col("currency"))) if "currency" in cols else none
    d, _ = parse_form_date(F.col("date")) if "date" in cols else (F.lit(None).cast("date"), None)
    staged = barrier(out.select(
        "*",
        (blank_to_null(F.col("amount")) if "amount" in cols else none).alias("_amount_t"),
        (blank_to_null(F.col("date")) if "date" in cols else none).alias("_date_t"),
        amount.alias("_amount_v"), ccy.alias("_ccy_v"), d.alias("_date_v")))
    return (staged
            .withColumn("_bad_amount", F.col("_amount_t").isNotNull() & F.col("_amount_v").isNull())
            .withColumn("_bad_currency", F.coalesce(~F.length("_ccy_v").isin(2, 3), F.lit(False)))
            .withColumn("_bad_date", F.col("_date_t").isNotNull() & F.col("_date_v").isNull())
            .withColumn("amount", F.col("_amount_v")).withColumn("currency", F.col("_ccy_v"))
            .withColumn("date", F.col("_date_v"))
            .drop("_amount_t", "_date_t", "_amount_v", "_ccy_v", "_date_v"))


def convert(df: DataFrame, base_currency: str = "CNY", round_digits: int = 2, rates: DataFrame | None = None,
            window_days: int = 7, static_overrides: dict | None = None, default_rate: str = "1") -> DataFrame:
    """X10 with J4 (``rates`` given) or J5 (static): exchange_rate, base_amount, rate_date_used.

    base_amount = half-up(amount x rate, round_digits); skipped when amount,
    currency or date is missing.
    """
    eligible = F.col("amount").isNotNull()
    if rates is not None:
        out = lookup_asof(df, rates, base_currency, window_days, eligible=eligible)
    else:
        out = lookup_static(df, base_currency, static_overrides, default_rate, eligible=eligible)
    if round_digits > BASE_AMOUNT.scale:
        raise ValueError(f"round_digits must be at most {BASE_AMOUNT.scale}")
    base = F.round(F.col("amount").cast(AMOUNT) * F.col("_rate"), round_digits).cast(BASE_AMOUNT)
    return (out.withColumn("base_currency", F.lit(base_currency))
            .withColumn("exchange_rate", F.col("_rate").cast(EXCHANGE_RATE))
            .withColumn("base_amount", base)
            .withColumn("rate_date_used", F.col("_rate_day"))
            .drop("_rate", "_rate_day"))


def required_issues(df: DataFrame, required) -> tuple[Column, Column]:
    """(issues in rule order, failed) for missing required columns."""
    cols = set(df.columns)
    misses = [(is_missing(F.col(c)) if c in cols else F.lit(True), c) for c in required]
    issues = [F.when(m, F.lit(f"missing_{c}")) for m, c in misses]
    failed = F.lit(False)
    for m, _ in misses:
        failed = failed | m
    return issues, failed


def negative_issues(df: DataFrame, non_negative) -> tuple[list, Column]:
    """(issues, failed) for decimal columns below zero; nulls ignored."""
    decimal_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    checked = [c for c in non_negative if c in decimal_cols]
    issues = [F.when(F.col(c) < 0, F.lit(f"negative_{c}")) for c in checked]
    failed = F.lit(False)
    for c in checked:
        failed = failed | F.coalesce(F.col(c) < 0, F.lit(False))
    return issues, failed


def rate_check() -> tuple[Column, Column]:
    """(missing_base_amount issue, failed). Reject on ``rate_unavailable`` or on a
    set amount without base amount; the issue is added only without ``rate_unavailable``."""
    unavailable = F.coalesce(F.col("_rate_issue") == "rate_unavailable", F.lit(False))
    no_base = F.col("amount").isNotNull() & F.col("base_amount").isNull()
    return F.when(no_base & ~unavailable, F.lit("missing_base_amount")), unavailable | no_base


def confirm_state(threshold) -> tuple[Column, Column, Column]:
    """(over threshold, declined, cleared) from the pre-rounding base amount."""
    over = F.coalesce(F.col("base_amount") >= F.lit(threshold).cast("decimal(38,6)"), F.lit(False))
    declined = over & F.coalesce(~F.col("_confirmed"), F.lit(False))
    cleared = over & F.coalesce(F.col("_confirmed"), F.lit(False))
    return over, declined, cleared


def attach_decisions(df: DataFrame, decisions: DataFrame | None) -> DataFrame:
    """Join a decisions table (source_file, source_row, confirmed) in place of prompts."""
    if decisions is None:
        return df.withColumn("_confirmed", F.lit(None).cast("boolean"))
    d = decisions.select("source_file", "source_row", F.col("confirmed").alias("_confirmed"))
    return df.join(d, ["source_file", "source_row"], "left")


def round_columns(df: DataFrame, rules: dict, round_digits: int, over: Column) -> DataFrame:
    """X11: half-up rounding per rule; rows over the threshold get base_amount
    rewritten from its pre-rule value at ``round_digits``."""
    decimal_cols = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DecimalType)}
    out = df.withColumn("_over", over)
    for c, digits in rules.items():
        if c in decimal_cols:
            dtype = out.schema[c].dataType
            rounded = F.round(F.col(c), digits).cast(dtype)
            if c == "base_amount":
                rounded = F.when(F.col("_over"), F.round(F.col(c), round_digits).cast(dtype)).otherwise(rounded)
            out = out.withColumn(c, rounded)
    return out.drop("_over")


def validate(df: DataFrame, config: MappingConfig, round_digits: int = 2, threshold=None,
             decisions: DataFrame | None = None) -> DataFrame:
    """Issues (ordered array), status and need_confirm.

    ``decisions`` (source_file, source_row, confirmed) replaces the interactive
    prompt: declined -> ``confirmation_declined``; confirmed -> cleared; no
    decision -> ``requires_confirmation``.
    """
    if threshold is None:
        threshold = config.confirm_over_amount if config.confirm_over_amount is not None else 20000
    out = attach_decisions(df, decisions)
    req_issues, req_failed = required_issues(out, config.required)
    neg_issues, neg_failed = negative_issues(out, config.non_negative)
    base_issue, rate_failed = rate_check()
    over, declined, cleared = confirm_state(threshold)
    confirm_issue = (F.when(declined, F.lit("confirmation_declined"))
                     .when(over & ~cleared, F.lit("requires_confirmation")))
    issues = F.array_compact(F.array(
        F.when(F.col("_bad_amount"), F.lit("invalid_amount")),
        F.when(F.col("_bad_currency"), F.lit("invalid_currency")),
        F.when(F.col("_bad_date"), F.lit("invalid_date")),
        F.col("_rate_issue"),
        *req_issues, *neg_issues, base_issue, confirm_issue))
    reject = req_failed | neg_failed | rate_failed
    out = (out.withColumn("issues", issues)
           .withColumn("status", F.when(reject, F.lit("reject")).otherwise(F.lit("ok")))
           .withColumn("need_confirm", over & ~cleared))
    out = round_columns(out, config.round, round_digits, over)
    return out.drop("_bad_amount", "_bad_currency", "_bad_date", "_rate_issue", "_confirmed")
