"""CLI: pages to quotes to single rates, one rate upserted, decisions and threshold of the form job, outside master kept."""

import json

import pytest

from ratebook.cli import main
from ratebook.session import get_spark, scratch_dir


def test_pages_to_quotes_to_rates(spark, tmp_path, capsys):
    notice = "<p>2024年3月1日</p><p>1美元对人民币7.1050元</p>"
    portal = '<table id="InfoTable"><tr><th>日期</th><th>美元</th></tr><tr><td>2024-03-04</td><td>710.60</td></tr></table>'
    spark.createDataFrame([(1, notice, None)], "page_id long, html string, target_date date").write.parquet(str(tmp_path / "n"))
    spark.createDataFrame([(1, portal), (2, portal.replace("710.60", "711.00"))], "page_id long, html string").write.parquet(str(tmp_path / "p"))
    out = str(tmp_path / "q")
    assert main(["extract-quotes", "--notices", str(tmp_path / "n"), "--portals", str(tmp_path / "p"), "--output", out]) == 0
    got = {(r.source, str(r.quote_date)): float(r.rate) for r in spark.read.parquet(out).collect()}
    assert got == {("pbc", "2024-03-01"): 7.105, ("cfets", "2024-03-01"): 7.105, ("safe", "2024-03-04"): 7.11}
    capsys.readouterr()
    assert main(["single-rate", "2024-03-01", "--quotes", out]) == 0
    row = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert row["target_date"] == "2024-03-01" and float(row["rate"]) == pytest.approx(7.105)


def test_upsert_rate(spark, tmp_path):
    store = str(tmp_path / "s")
    for rate in ("7.1", "7.2"):
        assert main(["upsert-rate", "--store", store, "--base", "usd", "--quote", "cny", "--rate", rate, "--date", "2024-03-01",
                     "--source", "manual"]) == 0
    from ratebook.sinks.store import RateStore
    rows = RateStore(spark, store).read().collect()
    assert [(r.base_currency, float(r.rate_mid)) for r in rows] == [("USD", 7.2)]


def test_forms_with_threshold_and_decisions(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("Amount,Currency,Date,Project\n500,CNY,2024-05-10,A\n900,CNY,2024-05-10,B\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("source_file,source_row,confirmed\na.csv,2,true\na.csv,3,false\n", encoding="utf-8")
    assert main(["process-forms", str(tmp_path / "a.csv"), "--output", str(tmp_path / "o"), "--confirm-over", "400",
                 "--decisions", str(tmp_path / "d.csv")]) == 0
    counts = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert counts == {"accepted": 2, "rejected": 0, "need_confirm": 1}  # a declined row stays flagged


def test_session_keeps_outside_settings(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert get_spark().conf.get("spark.sql.shuffle.partitions") == before
    assert get_spark().sparkContext.master == spark.sparkContext.master
    assert scratch_dir(spark, "x").startswith(spark.sparkContext.getCheckpointDir())


def test_no_scratch_folder_on_a_cluster_is_an_error():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(Session(), "x")
