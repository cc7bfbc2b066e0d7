"""Documented quirks of the reference, kept on purpose."""

import datetime as dt

from pyspark.sql import functions as F

from ratebook.functions.dates import normalize_fetch_ts, parse_store_date
from ratebook.operators import inventory as iv
from ratebook.operators.mapping import (MONTHLY_ALIASES, RATES_CSV_ALIASES, MappingConfig, alias_columns,
                                        apply_column_mapping)


def test_canonical_named_column_not_in_candidates_is_used_and_reported(spark):
    """A raw column already named as a canonical but not listed is missing and unmatched,
    yet its data is used."""
    cfg = MappingConfig(input_columns={"amount": ["金额"], "currency": ["币种"]})
    df = spark.createDataFrame([("12", "USD")], "amount string, `币种` string")
    res = apply_column_mapping(df, cfg)
    assert res.missing == ["amount"] and res.unmatched == ["amount"]
    assert res.frame.first()["amount"] == "12"


def test_one_column_two_canonicals_goes_to_the_later(spark):
    """One raw column matching two canonicals is taken by the later one."""
    cfg = MappingConfig(input_columns={"project": ["Description"], "description": ["Description"]})
    df = spark.createDataFrame([("x",)], "Description string")
    res = apply_column_mapping(df, cfg)
    row = res.frame.first()
    assert row["project"] is None and row["description"] == "x" and res.missing == []


def test_equal_normalised_headers_last_wins(spark):
    cfg = MappingConfig(input_columns={"amount": ["Amount"]})
    df = spark.createDataFrame([("1", "2")], "`Amount` string, ` amount` string")
    assert apply_column_mapping(df, cfg).frame.first()["amount"] == "2"


def test_alias_later_header_wins_even_if_empty(spark):
    df = spark.createDataFrame([("7.1", "")], "`中间价` string, mid_rate string")
    assert alias_columns(df, RATES_CSV_ALIASES, keep_unknown=True).first()["rate_mid"] == ""
    m = alias_columns(spark.createDataFrame([("1", "x")], "`年份` string, other string"), MONTHLY_ALIASES, False)
    assert m.columns == ["year"]


def test_monthly_file_with_numeric_first_row_is_positional(spark, tmp_path):
    from ratebook.sources.monthly_csv import scan_monthly
    (tmp_path / "a.csv").write_text("2023,1,6.96,2023-01-02,2023-01-03,cfets_notice,\n,,,,,,\n"
                                    "2023,2,6.75,,2023-02-01,safe_portal,none\n2023,2,6.76,,2023-02-02,safe_portal,forward\n"
                                    "x,3,6.8,,,,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("年份,月份,中间价,首个工作日,公告日期\n2024,5,7.1,,2024-05-06\n", encoding="utf-8")
    rows = {(r["year"], r["month"]): r for r in scan_monthly(spark, [str(tmp_path / "*.csv")]).collect()}
    assert set(rows) == {("2023", "01"), ("2023", "02"), ("2024", "05")}
    assert rows[("2023", "01")]["fallback_used"] == "none"
    assert rows[("2023", "02")]["mid_rate"] == "6.76"  # later duplicate wins
    assert rows[("2023", "02")]["query_date"] == "2023-02-02"  # empty query date <- source date
    assert rows[("2024", "05")]["query_date"] == "2024-05-06"


def test_store_dates_and_fetch_timestamps(spark):
    df = spark.createDataFrame([("2025-09-04",), ("2025-9-4",), ("2025-09-04T23:30:00+08:00",), ("20250904",),
                                ("2025-02-30",), ("",)], "t string")
    got = [r[0] for r in df.select(parse_store_date("t")).collect()]
    d = dt.date(2025, 9, 4)
    assert got == [d, None, d, d, None, None]
    ts = spark.createDataFrame([("2025-09-04",), ("2025-09-04T10:11",), ("2025-09-04T10:11:12.5Z",),
                                ("2025-09-04T10:11:12+0800",), ("",), ("bad",)], "t string")
    out = [r[0] for r in ts.select(normalize_fetch_ts("t", F.lit(dt.date(2025, 9, 1)))).collect()]
    assert out == ["2025-09-04T00:00:00+00:00", "2025-09-04T10:11:00+00:00", "2025-09-04T10:11:12+00:00",
                   "2025-09-04T10:11:12+08:00", "2025-09-01T00:00:00+00:00", None]


def test_drive_path_helpers(spark):
    df = spark.createDataFrame([(" root ", "  a.xlsx ", "/x/", "//y/./z/", "")], "p string, n string, a string, b string, c string")
    row = df.select(iv.normalize_parent_id("p").alias("p"), iv.normalize_item_name("n")[0].alias("n"),
                    iv.join_drive_path("a", "b", "c").alias("j")).first()
    assert (row["p"], row["n"], row["j"]) == ("root", "a.xlsx", "x/y/z")
    stem, suffix = iv.split_name(F.lit(".bashrc"))
    assert spark.range(1).select(stem, suffix).first() == ("", ".bashrc")


def test_layout_write_and_dry_run(spark, tmp_path):
    from ratebook.operators import layout as la
    df = spark.range(0, 5).selectExpr("id as n", "cast(id as string) as v")
    m = la.FixedMapping.from_dict({"sheet": "S", "start_row": 2, "max_rows_per_sheet": 2, "columns": {"v": "A"}})
    cells = la.cell_layout(df, m, "out.xlsx", ["n"])
    planned = sorted(r[0] for r in la.write_layout(cells, str(tmp_path / "dry"), dry_run=True).collect())
    assert planned == ["out.xlsx", "out_part2.xlsx", "out_part3.xlsx"]
    assert not (tmp_path / "dry").exists()
    la.write_layout(cells, str(tmp_path / "real"))
    assert (tmp_path / "real" / "part_name=out_part3.xlsx").exists()


def test_monthly_typed(spark):
    from decimal import Decimal
    from ratebook.operators.monthly import monthly_typed
    t = spark.createDataFrame([("2023", "01", "6.9600", "2023-01-02", "2023-01-03", "cfets_notice", "cfets")],
                              "year string, month string, mid_rate string, query_date string, source_date string, "
                              "rate_source string, fallback_used string")
    r = monthly_typed(t).first()
    assert (r["year"], r["month"], r["mid_rate"], r["query_date"]) == (2023, 1, Decimal("6.9600"),
                                                                         dt.date(2023, 1, 2))
