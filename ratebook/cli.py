"""Command line for the main jobs (run with ``spark-submit -m`` style or ``python -m ratebook``).

    process-forms        forms (CSV/Parquet globs) -> processed table, exports and report
    import-rates         rate CSV -> new version of the rate store
    query-rates          range query on the rate store (first rows printed)
    build-monthly-rates  quotes + calendar -> monthly cache CSV, with pending months reported
    extract-quotes       landed HTML pages -> quotes table (what build-monthly-rates reads)
    single-rate          rates of given days from a quotes table
    upsert-rate          one rate record merged into the store
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from pyspark.sql import functions as F

from ratebook.sources.tables import csv_reader


def _spark():
    from ratebook.session import get_spark
    return get_spark()


def _read(spark, path: str):
    return spark.read.parquet(path) if path.endswith(".parquet") or "." not in path.rsplit("/", 1)[-1] \
        else csv_reader(spark).csv(path)


def cmd_process_forms(a) -> int:
    from ratebook.operators.mapping import DEFAULT_MAPPING, MappingConfig
    from ratebook.plans.process_forms import FormsConfig, process_forms
    from ratebook.sinks.forms import write_outcomes
    from ratebook.sources.forms import read_forms
    spark = _spark()
    mapping = MappingConfig.from_yaml(a.mapping) if a.mapping else DEFAULT_MAPPING
    scanned = read_forms(spark, a.inputs)
    files = scanned.groups
    rates = _read(spark, a.rates) if a.rates else None
    overrides = {}
    for item in a.rate or []:
        pair, value = item.split("=")
        f, t = pair.split(":")
        overrides[(f.upper(), t.upper())] = value
    decisions = None
    if a.decisions:
        decisions = _read(spark, a.decisions).select(
            "source_file", F.col("source_row").cast("bigint").alias("source_row"), F.col("confirmed").cast("boolean").alias("confirmed"))
    if a.confirm_over is not None:
        mapping = replace(mapping, confirm_over_amount=a.confirm_over)
    res = process_forms(files, mapping, FormsConfig(a.base_currency, a.round_digits, window_days=a.window),
                        rates=rates, static_overrides=overrides, default_rate=a.default_rate, decisions=decisions)
    out = write_outcomes(res, a.output)
    if scanned.malformed is not None:
        scanned.malformed.write.mode("overwrite").parquet(f"{a.output}/malformed")
    print(json.dumps(out["counts"]))
    return 0


def cmd_import_rates(a) -> int:
    from ratebook.plans.import_rates import import_csv
    from ratebook.sinks.store import RateStore
    spark = _spark()
    n, _ = import_csv(spark, RateStore(spark, a.store), a.csv, a.base, a.quote, a.source, a.fallback, a.download_url)
    print(n)
    return 0


def cmd_query_rates(a) -> int:
    from ratebook.operators.store import parse_pair, preview, range_query
    from ratebook.sinks.store import RateStore
    spark = _spark()
    base, quote = parse_pair(a.pair, a.base, a.quote)
    df = range_query(RateStore(spark, a.store).read(), base, quote, a.start, a.end)
    for row in preview(df, a.limit).collect():
        print(row["rate_date"], row["base_currency"], row["quote_currency"], row["rate_mid"])
    return 0


def cmd_build_monthly(a) -> int:
    from ratebook.operators.calendar import calendar_frame
    from ratebook.plans.monthly_rates import build_monthly_rates
    from ratebook.sinks.monthly import write_monthly
    from ratebook.sources.monthly_csv import scan_monthly
    spark = _spark()
    existing = scan_monthly(spark, [a.cache]) if a.cache and not a.rebuild else \
        spark.createDataFrame([], "year string, month string, mid_rate string, query_date string, "
                                  "source_date string, rate_source string, fallback_used string")
    quotes = _read(spark, a.quotes)
    cal = calendar_frame(spark, a.holiday or [], a.workday or [])
    job = build_monthly_rates(spark, existing, quotes, cal, a.start, a.end, a.refresh or [], a.rebuild, a.prefer)
    write_monthly(job.table, a.output)
    pending = job.report.where(F.col("status") == "pending").collect()
    for row in pending:
        print(f"pending {row['year']}-{row['month']:02d}: {row['reason']}", file=sys.stderr)
    print(json.dumps(job.stats.first().asDict()))
    return 0


def cmd_extract_quotes(a) -> int:
    from ratebook.plans.extract_quotes import extract_quotes
    spark = _spark()
    pages = [_read(spark, path) if path else None for path in (a.notices, a.charts, a.portals)]
    extract_quotes(*pages).write.mode("errorifexists").parquet(a.output)
    return 0


def cmd_single_rate(a) -> int:
    from ratebook.operators.routing import single_rate
    spark = _spark()
    dates = spark.createDataFrame([(d,) for d in a.dates], "d string").select(F.col("d").cast("date").alias("target_date"))
    for row in single_rate(dates, _read(spark, a.quotes), a.base, a.quote, a.prefer).orderBy("target_date").collect():
        print(json.dumps(row.asDict(), default=str))
    return 0


def cmd_upsert_rate(a) -> int:
    from ratebook.plans.import_rates import upsert_records
    from ratebook.sinks.store import RateStore
    from ratebook.streaming.rates_stream import RECORD_COLUMNS
    spark = _spark()
    given = {"base_currency": a.base, "quote_currency": a.quote, "rate_mid": a.rate, "rate_date": a.date,
             "fetch_date": a.fetch_date or a.date, "source": a.source, "fallback_strategy": a.fallback}
    schema = ", ".join(f"{c} string" for c in RECORD_COLUMNS)
    record = spark.createDataFrame([tuple(given.get(c) for c in RECORD_COLUMNS)], schema).withColumn("_ordinal", F.lit(0))
    upsert_records(RateStore(spark, a.store), record, a.download_url)
    return 0


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="ratebook")
    sub = p.add_subparsers(dest="cmd", required=True)
    f = sub.add_parser("process-forms")
    f.add_argument("inputs", nargs="+")
    f.add_argument("--output", required=True)
    f.add_argument("--mapping")
    f.add_argument("--rates", help="rate table (Parquet or CSV) for the as-of lookup")
    f.add_argument("--rate", action="append", help="static FROM:TO=VALUE override")
    f.add_argument("--default-rate", default="1")
    f.add_argument("--base-currency", default="CNY")
    f.add_argument("--round-digits", type=int, default=2)
    f.add_argument("--window", type=int, default=7)
    f.add_argument("--confirm-over", type=float, help="base amount from which rows need confirming")
    f.add_argument("--decisions", help="table of source_file, source_row, confirmed")
    f.set_defaults(fn=cmd_process_forms)
    i = sub.add_parser("import-rates")
    i.add_argument("csv")
    i.add_argument("--store", required=True)
    i.add_argument("--base", required=True)
    i.add_argument("--quote", required=True)
    i.add_argument("--source", required=True)
    i.add_argument("--fallback")
    i.add_argument("--download-url")
    i.set_defaults(fn=cmd_import_rates)
    q = sub.add_parser("query-rates")
    q.add_argument("--store", required=True)
    q.add_argument("--pair")
    q.add_argument("--base")
    q.add_argument("--quote")
    q.add_argument("--start")
    q.add_argument("--end")
    q.add_argument("--limit", type=int, default=5)
    q.set_defaults(fn=cmd_query_rates)
    m = sub.add_parser("build-monthly-rates")
    m.add_argument("--start", required=True)
    m.add_argument("--end")
    m.add_argument("--quotes", required=True)
    m.add_argument("--cache", help="existing monthly CSV")
    m.add_argument("--output", required=True)
    m.add_argument("--refresh", action="append")
    m.add_argument("--rebuild", action="store_true")
    m.add_argument("--prefer", default="auto")
    m.add_argument("--holiday", action="append")
    m.add_argument("--workday", action="append")
    m.set_defaults(fn=cmd_build_monthly)
    e = sub.add_parser("extract-quotes")
    e.add_argument("--notices", help="pages with page_id, html and target_date")
    e.add_argument("--charts", help="key chart pages")
    e.add_argument("--portals", help="portal table pages")
    e.add_argument("--output", required=True)
    e.set_defaults(fn=cmd_extract_quotes)
    r = sub.add_parser("single-rate")
    r.add_argument("dates", nargs="+")
    r.add_argument("--quotes", required=True)
    r.add_argument("--base", default="USD")
    r.add_argument("--quote", default="CNY")
    r.add_argument("--prefer", default="auto")
    r.set_defaults(fn=cmd_single_rate)
    u = sub.add_parser("upsert-rate")
    u.add_argument("--store", required=True)
    for name in ("base", "quote", "rate", "date", "source"):
        u.add_argument(f"--{name}", required=True)
    for name in ("fetch-date", "fallback", "download-url"):
        u.add_argument(f"--{name}")
    u.set_defaults(fn=cmd_upsert_rate)
    args = p.parse_args(argv)
    return args.fn(args)


if __name__ == "__main__":
    sys.exit(main())
