"""Jobs end to end: CLI commands, written outputs, and a sample of oracle comparisons."""

import glob
import json

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.check_oracle import TABLES, digest

SAMPLE = ("Amount,Currency,Date,Project,Remark\n"
          "3000,EUR,2024-05-11,Project D,欧元回填\n"
          "40000,USD,2024-05-11,Project E,高金额需确认\n"
          "100,HKD,2024-05-11,,缺项目名\n"
          "600,XYZ,2024-05-12,Project F,未知币种\n"
          "50,CNY,,Project G,缺日期\n")


def test_cli_process_forms_writes_outcomes(spark, tmp_path, capsys):
    from ratebook.cli import main
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(SAMPLE, encoding="utf-8")
    out = tmp_path / "out"
    assert main(["process-forms", str(tmp_path / "in" / "*.csv"), "--output", str(out),
                 "--rate", "USD:CNY=7.25", "--rate", "EUR:CNY=8.00"]) == 0
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    # static rates: HKD falls to the default rate 1, XYZ too -> only the two missing-field rows fail
    assert counts == {"accepted": 3, "rejected": 2, "need_confirm": 2}
    report = (out / "processed_forms_report.md").read_text(encoding="utf-8")
    assert "- Accepted rows: 3" in report and "Rejected rows: 2" in report
    assert glob.glob(str(out / "processed" / "status=ok" / "*.parquet"))
    rejects = spark.read.option("header", True).csv(str(out / "processed_forms_rejects"))
    assert rejects.count() == 2 and "issues" in rejects.columns


def test_cli_rates_import_and_query(spark, tmp_path, capsys):
    from ratebook.cli import main
    csv = tmp_path / "rates.csv"
    csv.write_text("年份,月份,中间价,查询日期,来源日期,数据源,回退策略\n"
                   "2025,09,7.2000,2025-09-04,2025-09-04,safe_portal,forward\n"
                   "2025,10,7.18885,,2025-10-08,,\n", encoding="utf-8")
    store = str(tmp_path / "store")
    assert main(["import-rates", str(csv), "--store", store, "--base", "USD", "--quote", "CNY",
                 "--source", "safe_portal"]) == 0
    assert capsys.readouterr().out.strip().splitlines()[-1] == "2"
    assert main(["query-rates", "--store", store, "--pair", "usd/cny", "--start", "2025-10-01"]) == 0
    line = capsys.readouterr().out.strip().splitlines()[-1]
    assert line.startswith("2025-10-01 USD CNY 7.1888")  # year-month fallback, half-even


def test_cli_build_monthly(spark, tmp_path, capsys):
    from ratebook.cli import main
    quotes = spark.createDataFrame([("cfets", "2023-01-03", "6.96"), ("safe", "2023-02-03", "6.75")],
                                   "source string, quote_date string, rate string")
    quotes = quotes.selectExpr("source", "cast(quote_date as date) quote_date", "cast(rate as decimal(18,4)) rate")
    qpath = str(tmp_path / "quotes.parquet")
    quotes.write.parquet(qpath)
    out = str(tmp_path / "monthly")
    assert main(["build-monthly-rates", "--start", "2023-01", "--end", "2023-03", "--quotes", qpath,
                 "--output", out]) == 0
    captured = capsys.readouterr()
    stats = json.loads(captured.out.strip().splitlines()[-1])
    assert stats == {"consumed": 2, "changed": 2, "total_rows": 2}
    assert "pending 2023-03" in captured.err
    rows = spark.read.option("header", True).csv(out).collect()
    assert [r["回退策略"] for r in rows] == ["cfets", "forward"]


@pytest.mark.parametrize("name", ["process_forms", "rate_lookup_asof", "rates_upsert", "monthly_rate_lookup",
                                  "source_routing", "extract_quotes", "extract_links", "drive_listing",
                                  "batch_report", "cell_layout", "fill_template", "path_validate"])
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    orows = res.fetchall()
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_batch_reports_written_per_batch(spark, tmp_path):
    from ratebook.operators.inventory import attempt_outcomes
    from ratebook.sinks.uploads import write_batch_reports
    from ratebook.sources.bindings import upload_attempts
    out = write_batch_reports(attempt_outcomes(upload_attempts(spark, SMALL)), str(tmp_path / "reports"))
    items = spark.read.json(out["items"])
    summary = spark.read.json(out["summary"])
    assert items.select("batch_id").distinct().count() == summary.count()
    assert set(r["list"] for r in items.select("list").distinct().collect()) <= {"success", "failed", "skipped"}
    assert items.where("list = 'failed'").where("reason like '%***.xlsx%'").count() == \
        items.where("list = 'failed'").count()
