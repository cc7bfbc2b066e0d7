"""The reference's own test expectations, replayed as DataFrames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratebook.operators import calendar as cal
from ratebook.operators import inventory as iv
from ratebook.operators import layout as la
from ratebook.operators import monthly as mo
from ratebook.operators import notices as nt
from ratebook.operators import routing as ro
from ratebook.operators import store as st

D = dt.date.fromisoformat


def rates_frame(spark, rows):
    return spark.createDataFrame(
        [(b, q, D(d), Decimal(r)) for b, q, d, r in rows],
        "base_currency string, quote_currency string, rate_date date, rate_mid decimal(18,4)")


def test_process_forms_sample_csv(spark, tmp_path):
    """Sample form: ok 2, rejected 3, need-confirm 2; EUR falls back to 2024-05-10."""
    from ratebook.plans.process_forms import FormsConfig, process_forms
    from ratebook.sources.forms import scan_forms
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "sample_input.csv").write_text(
        "Amount,Currency,Date,Project,Remark\n"
        "3000,EUR,2024-05-11,Project D,欧元回填\n"
        "40000,USD,2024-05-11,Project E,高金额需确认\n"
        "100,HKD,2024-05-11,,缺项目名\n"
        "600,XYZ,2024-05-12,Project F,未知币种\n"
        "50,CNY,,Project G,缺日期\n", encoding="utf-8")
    rates = rates_frame(spark, [("USD", "CNY", "2024-05-10", "7.20"), ("USD", "CNY", "2024-05-11", "7.25"),
                                ("EUR", "CNY", "2024-05-10", "8.00")])
    files = scan_forms(spark, [str(tmp_path / "in" / "*.csv")])
    res = process_forms(files, rates=rates, config=FormsConfig(window_days=5))
    rows = {r["currency"]: r for r in res.processed.collect()}
    eur = rows["EUR"]
    assert eur["exchange_rate"] == Decimal("8.000000")
    assert eur["rate_date_used"] == D("2024-05-10")
    assert eur["base_amount"] == Decimal("24000.000000")
    assert eur["issues"] == ["rate_fallback", "requires_confirmation"]
    assert eur["status"] == "ok"
    assert rows["USD"]["base_amount"] == Decimal("290000.000000")
    assert rows["HKD"]["issues"] == ["rate_unavailable", "missing_project"]
    assert rows["XYZ"]["issues"] == ["rate_unavailable"]
    assert rows["CNY"]["issues"] == ["missing_date", "missing_base_amount"]
    assert rows["CNY"]["source_row"] == 6
    assert res.accepted.count() == 2
    assert res.rejected.count() == 3
    assert res.need_confirm.count() == 2


def test_confirm_decisions(spark):
    """Answers replace the prompt: a 'no' gives confirmation_declined, a 'yes' clears."""
    from ratebook.plans.process_forms import process_forms
    raw = spark.createDataFrame([("f", 2, "30000", "CNY", "2024-05-11", "A"), ("f", 3, "40000", "CNY", "2024-05-11", "B"),
                                 ("f", 4, "50000", "CNY", "2024-05-11", "C")],
                                "source_file string, source_row long, Amount string, Currency string, Date string, "
                                "Project string")
    decisions = spark.createDataFrame([("f", 2, True), ("f", 3, False)], "source_file string, source_row long, confirmed boolean")
    res = process_forms([("f", raw)], decisions=decisions)
    out = {r["project"]: r for r in res.processed.collect()}
    assert out["A"]["need_confirm"] is False and out["A"]["issues"] == []
    assert out["B"]["need_confirm"] is True and out["B"]["issues"] == ["confirmation_declined"]
    assert out["C"]["issues"] == ["requires_confirmation"]
    assert res.need_confirm.count() == 2


@pytest.mark.parametrize("month, holidays, workdays, expected", [
    ("2023-01-01", [], [], "2023-01-02"),
    ("2025-09-01", [], [], "2025-09-01"),
    ("2025-09-01", ["2025-09-01"], [], "2025-09-02"),
    ("2023-07-01", [], ["2023-07-01"], "2023-07-01"),
])
def test_first_business_day(spark, month, holidays, workdays, expected):
    months = spark.createDataFrame([(D(month),)], "month_start date")
    out = cal.first_business_days(months, cal.calendar_frame(spark, holidays, workdays)).first()
    assert out["first_business_day"] == D(expected)


def test_missing_months(spark):
    existing = spark.createDataFrame([("2023", "01"), ("2023", "03")], "year string, month string")
    out = mo.missing_months(spark, existing, D("2023-01-01"), D("2023-04-01")).orderBy("month").collect()
    assert [(r["year"], r["month"]) for r in out] == [(2023, 2), (2023, 4)]


def quotes(spark, rows):
    return spark.createDataFrame([(s, D(d), Decimal(r)) for s, d, r in rows],
                                 "source string, quote_date date, rate decimal(18,4)")


def test_monthly_forward_and_backward(spark):
    """Only 2023-01-03 has a rate -> query 2023-01-02, request 2023-01-03; only Saturday
    2023-07-01 has one -> query 2023-07-03, request 2023-07-01."""
    months = spark.createDataFrame([(D("2023-01-01"),), (D("2023-07-01"),)], "month_start date")
    q = quotes(spark, [("pbc", "2023-01-03", "6.9"), ("pbc", "2023-07-01", "7.2")])
    out = {r["month"]: r for r in ro.monthly_lookup(months, q, cal.calendar_frame(spark), "pbc").collect()}
    assert (out[1]["query_date"], out[1]["request_date"]) == (D("2023-01-02"), D("2023-01-03"))
    assert (out[7]["query_date"], out[7]["request_date"]) == (D("2023-07-03"), D("2023-07-01"))


def test_monthly_upsert_merges(spark):
    rec = lambda y, m, r, q, s, src, fb: (y, m, r, q, s, src, fb)
    first = [rec("2023", "1", "6.9600", "2023-01-02", "2023-01-03", "cfets_notice", "cfets"),
             rec("2023", "2", "6.7500", "2023-02-01", "2023-02-01", "safe_portal", "none")]
    second = [rec("2023", "2", "6.7600", "2023-02-01", "2023-02-02", "safe_portal", "forward"),
              rec("2023", "3", "6.8300", "2023-03-01", "2023-03-01", "cfets_notice", "cfets")]
    schema = "year string, month string, mid_rate string, query_date string, source_date string, " \
             "rate_source string, fallback_used string"

    def norm(rows):
        df = spark.createDataFrame(rows, schema).withColumn("_ordinal", F.monotonically_increasing_id())
        return mo.normalize_monthly(df, extra=("_ordinal",)).drop("error")

    empty = spark.createDataFrame([], schema)
    table1, _ = mo.upsert_monthly(empty, norm(first))
    table2, stats = mo.upsert_monthly(table1, norm(second))
    rows = [",".join(r) for r in mo.to_output(table2).collect()]
    assert rows == ["2023,01,6.9600,2023-01-02,2023-01-03,cfets_notice,cfets",
                    "2023,02,6.7600,2023-02-01,2023-02-02,safe_portal,forward",
                    "2023,03,6.8300,2023-03-01,2023-03-01,cfets_notice,cfets"]
    s = stats.first()
    assert (s["consumed"], s["changed"], s["total_rows"]) == (2, 2, 3)


def test_rounding_modes(spark):
    df = spark.createDataFrame([("7.12345",), ("7.12344",), ("7.10525",)], "t string")
    up = [r[0] for r in df.select(st.rate_from_text("t", "half_up")).collect()]
    even = [r[0] for r in df.select(st.rate_from_text("t", "half_even")).collect()]
    assert up == [Decimal("7.1235"), Decimal("7.1234"), Decimal("7.1053")]
    assert even[2] == Decimal("7.1052")


def test_rates_store_workflow(spark, tmp_path):
    """Re-upsert keeps created_at and takes the new download_url; CSV import counts 2 and
    replaces the same key; range queries by month."""
    from ratebook.plans.import_rates import import_csv, upsert_records
    from ratebook.sinks.store import RateStore
    store = RateStore(spark, str(tmp_path / "store"))
    rec = spark.createDataFrame([(0, "USD", "CNY", "7.1052", "2025-09-04", "2025-09-01", "safe_portal", "forward")],
                                "_ordinal long, base_currency string, quote_currency string, rate_mid string, "
                                "rate_date string, fetch_date string, source string, fallback_strategy string")
    t1 = upsert_records(store, rec, now="2025-09-05T00:00:00+00:00").first()
    assert t1["rate_mid"] == Decimal("7.1052") and t1["fetch_date"] == "2025-09-01T00:00:00+00:00"
    t2 = upsert_records(store, rec, download_url="https://example.com/rate.xlsx", now="2025-09-06T00:00:00+00:00").first()
    assert t2["created_at"] == t1["created_at"] == "2025-09-05T00:00:00+00:00"
    assert t2["updated_at"] == "2025-09-06T00:00:00+00:00"
    assert t2["download_url"] == "https://example.com/rate.xlsx"
    csv = tmp_path / "rates.csv"
    csv.write_text("年份,月份,中间价,查询日期,来源日期,数据源,回退策略\n"
                   "2025,09,7.2000,2025-09-04,2025-09-04,safe_portal,forward\n"
                   "2025,10,7.1888,2025-10-08,2025-10-08,safe_portal,forward\n", encoding="utf-8")
    n, table_now = import_csv(spark, store, str(csv), "USD", "CNY", "safe_portal", "forward")
    assert n == 2
    sept = st.range_query(table_now, "USD", "CNY", "2025-09-01", "2025-09-30").collect()
    assert [r["rate_mid"] for r in sept] == [Decimal("7.2000")]
    octo = st.range_query(table_now, "usd", "cny", "2025-10-01").collect()
    assert [r["rate_mid"] for r in octo] == [Decimal("7.1888")]


def test_csv_import_strict_fails_before_write(spark, tmp_path):
    from ratebook.plans.import_rates import import_csv
    from ratebook.sinks.store import RateStore
    store = RateStore(spark, str(tmp_path / "store"))
    csv = tmp_path / "bad.csv"
    csv.write_text("中间价,查询日期\n7.1,2025-09-04\nabc,2025-09-05\n", encoding="utf-8")
    with pytest.raises(Exception):
        import_csv(spark, store, str(csv), "USD", "CNY", "x")
    assert store.current_path() is None


def test_routing_labels(spark):
    """pbc misses, cfets hits -> 'cfets'; only safe hits on another day -> 'forward';
    cfets preferred and hitting -> 'none'."""
    t = spark.createDataFrame([(D("2025-09-15"),), (D("2025-09-02"),)], "target_date date")
    q = quotes(spark, [("cfets", "2025-09-15", "7.1056"), ("safe", "2025-09-03", "7.1052")])
    out = {r["target_date"]: r for r in ro.route(t, q, "auto").collect()}
    assert (out[D("2025-09-15")]["rate_source"], out[D("2025-09-15")]["fallback_used"]) == ("cfets_notice", "cfets")
    assert (out[D("2025-09-02")]["rate_source"], out[D("2025-09-02")]["fallback_used"]) == ("safe_portal", "forward")
    pref = ro.route(t.where(F.col("target_date") == D("2025-09-15")), q, "cfets").first()
    assert pref["fallback_used"] == "none"
    with pytest.raises(ValueError):
        ro.route(t, q, "ecb")


def test_forward_window(spark):
    q = quotes(spark, [("safe", "2025-09-04", "7.1052"), ("safe", "2025-02-04", "7.1700"),
                       ("safe", "2025-10-20", "7.1000")])
    out = {r["month_start"]: r for r in ro.forward_window(q).collect()}
    assert out[D("2025-09-01")]["safe_date"] == D("2025-09-04")
    assert out[D("2025-02-01")]["window_start"] == D("2025-02-03")
    assert out[D("2025-02-01")]["window_end"] == D("2025-02-13")
    assert D("2025-10-01") not in out  # 2025-10-20 lies outside 2025-10-01..2025-10-11


def test_portal_per_100(spark):
    html = ("<table id='InfoTable'><tr><th>日期</th><th>美元(每100美元)</th></tr>"
            "<tr><td>2025-09-04</td><td>710.52</td></tr><tr><td>2025/09/05</td><td>712.34</td></tr></table>")
    plain = ("<table id='InfoTable'><tr><th>日期</th><th>美元</th></tr>"
             "<tr><td>2025-09-04</td><td>710.11</td></tr></table>")
    pages = spark.createDataFrame([(1, html), (2, plain)], "page_id long, html string")
    out = {(r["page_id"], r["quote_date"]): r["rate"] for r in nt.portal_quotes(pages).collect()}
    assert out[(1, D("2025-09-04"))] == Decimal("7.1052")
    assert out[(1, D("2025-09-05"))] == Decimal("7.1234")
    assert out[(2, D("2025-09-04"))] == Decimal("7.1011")


def test_notice_and_keychart(spark):
    notice = "<p>2025年9月15日银行间外汇市场人民币汇率中间价为：1美元对人民币7.1056元</p>"
    no_rate = "<p>2025年9月16日 公告</p>"
    pages = spark.createDataFrame([(1, D("2025-09-15"), notice), (2, D("2025-09-16"), no_rate)],
                                  "page_id long, target_date date, html string")
    out = {r["page_id"]: r for r in nt.parse_notices(pages).collect()}
    assert (out[1]["notice_date"], out[1]["rate_a"], out[1]["rate_b"]) == (D("2025-09-15"), Decimal("7.105600"),
                                                                          Decimal("7.1056"))
    assert out[2]["rate_a"] is None and out[2]["rate_b"] is None
    chart = spark.createDataFrame([(1, "<table><tr><td>2025-01-02</td><td>1美元对人民币7.1879元</td></tr></table>")],
                                  "page_id long, html string")
    t = spark.createDataFrame([(D("2025-01-02"),)], "target_date date")
    assert nt.keychart_lookup(t, chart).first()["rate"] == Decimal("7.187900")


def test_cell_layout_pages(spark):
    df = spark.createDataFrame([(1, "服务费", 1, 1200), (2, "备件", 2, 800), (3, "咨询", 3, 450)],
                               "n long, `项目名称` string, `数量` int, `金额(USD)` int")
    m = la.FixedMapping.from_dict({"sheet": "Invoice", "start_row": 10, "header_row": 9, "max_rows_per_sheet": 2,
                                   "columns": {"项目名称": "A", "数量": "B", "金额(USD)": "C"}})
    cells = {(r["part_name"], r["cell_ref"]): r["value"] for r in la.cell_layout(df, m, "invoice.xlsx", ["n"]).collect()}
    assert cells[("invoice.xlsx", "A10")] == "服务费"
    assert cells[("invoice.xlsx", "B11")] == "2"
    assert cells[("invoice_part2.xlsx", "A10")] == "咨询"
    with pytest.raises(KeyError):
        la.cell_layout(df.drop("金额(USD)"), m, "invoice.xlsx", ["n"])


@pytest.mark.parametrize("path", ["", "企业盘/", "企业盘//财务", "企业盘/财务/财务", "企业盘/财务?"])
def test_invalid_paths(spark, path):
    r = spark.createDataFrame([(path,)], "p string").select(iv.validate_path("p").alias("v")).first()["v"]
    assert r["valid"] is False and r["error"]


def test_retry_then_success_and_masking(spark):
    rows = [(1, "report", 1, "failed", "report.xlsx", None, "timeout", "TimeoutError", "/tmp/report.xlsx"),
            (1, "report", 2, "failed", "report.xlsx", None, "timeout", "TimeoutError", "/tmp/report.xlsx"),
            (1, "report", 3, "uploaded", "report.xlsx", "report.xlsx", None, None, "/tmp/report.xlsx"),
            (1, "secret", 4, "failed", "secret.xlsx", None, "denied /tmp/secret.xlsx\nsecret.xlsx", "UploadFlowError",
             "/tmp/secret.xlsx")]
    att = spark.createDataFrame(rows, "batch_id long, item string, ordinal long, status string, requested_name string, "
                                      "final_name string, message string, error_class string, file_path string")
    out = {r["item"]: r for r in iv.attempt_outcomes(att, max_retries=3).collect()}
    assert out["report"]["status"] == "uploaded" and out["report"]["attempts"] == 3
    assert out["secret"]["reason"] == "denied ***.xlsx ***.xlsx"
    rep = iv.batch_report(iv.attempt_outcomes(att, max_retries=3)).first()
    assert (rep["succeeded"], rep["failed"]) == (1, 1)


def test_text_preview(spark):
    from ratebook.functions.text import text_preview
    df = spark.createDataFrame([("abcdef",), (None,)], "t string")
    assert [r[0] for r in df.select(text_preview("t", 3)).collect()] == ["abc", ""]
    with pytest.raises(ValueError):
        text_preview("t", 0)


def test_folder_resolve_with_anchor(spark):
    listing = spark.createDataFrame([("a", "A", "root", "folder"), ("b", "B", "a", "folder"), ("c", "C", "b", "folder")],
                                    "id string, name string, parent_id string, item_type string")
    req = spark.createDataFrame([("A/B/C",), ("id:b/C",), ("root/A/X/C",), ("id:a/B/Z",), ("",)], "path string")
    out = {r["path"]: (r["folder_id"], r["missing_prefix"])
           for r in iv.resolve_folders(req, iv.folder_paths(listing)).collect()}
    assert out["A/B/C"] == ("c", None)
    assert out["id:b/C"] == ("c", None)
    assert out["root/A/X/C"] == (None, "A/X")
    assert out["id:a/B/Z"] == (None, "B/Z")
    assert out[""] == ("root", None)


def test_forms_from_parquet_and_bad_suffix(spark, tmp_path):
    from ratebook.plans.process_forms import process_forms
    from ratebook.sources.forms import scan_forms
    df = spark.createDataFrame([("10", "CNY", "2024-05-11", "P")], "`金额` string, `币种` string, `日期` string, `项目名称` string")
    df.coalesce(1).write.parquet(str(tmp_path / "pq"))
    files = scan_forms(spark, [str(tmp_path / "pq" / "*.parquet")])
    row = process_forms(files).processed.first()
    assert (row["amount"], row["status"], row["source_row"]) == (Decimal("10.000000"), "ok", 2)
    (tmp_path / "x.txt").write_text("a")
    with pytest.raises(ValueError):
        scan_forms(spark, [str(tmp_path / "x.txt")])


def test_only_usd_cny_mid_rates(spark):
    t = spark.createDataFrame([(D("2025-09-15"),)], "target_date date")
    q = quotes(spark, [("cfets", "2025-09-15", "7.1056")])
    assert ro.single_rate(t, q, "usd", "cny").first()["rate"] == Decimal("7.1056")
    with pytest.raises(NotImplementedError):
        ro.single_rate(t, q, "EUR", "CNY")
