"""Inputs that once lost rows or cells: null group keys, wide rows, deep trees, odd CSV, long URL paths."""

import pytest
from pyspark.sql import functions as F

from ratebook.functions.html import resolve_url
from ratebook.operators import inventory as iv
from ratebook.operators.layout import fill_cells, page_index
from ratebook.operators.mapping import DEFAULT_MAPPING, apply_column_mapping
from ratebook.operators.notices import first_seen_links, keychart_rows
from ratebook.operators.ordinal import number_rows
from ratebook.sinks.store import RateStore
from ratebook.sources.forms import header_names, scan_forms
from ratebook.sources.monthly_csv import _headings, _width, scan_monthly
from ratebook.streaming.rates_stream import RECORD_COLUMNS, merge_batch


def test_numbering_keeps_null_groups(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1), ("a", 5)], "g string, k int")
    got = {(r.g, r.k): r.row_no for r in number_rows(df, ["k"], ["g"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, ("a", 1): 1, ("a", 5): 2}
    assert page_index(df, ["k"], ["g"], 1).count() == 4


def test_monthly_columns_beyond_the_sixteenth(spark, tmp_path):
    head = [f"x{i}" for i in range(16)] + ["year", "month", "mid_rate", "query_date"]
    (tmp_path / "m.csv").write_text(",".join(head) + "\n" + ",".join(["a"] * 16 + ["2024", "1", "7.1", "2024-01-02"]) + "\n")
    (tmp_path / "p.csv").write_text("2023,12,7.25,2023-12-01,2023-12-01,x,\n")
    rows = {(int(r.year), int(r.month)): r.mid_rate for r in scan_monthly(spark, str(tmp_path / "*.csv")).collect()}
    assert set(rows) == {(2024, 1), (2023, 12)}


def test_monthly_layouts_are_the_headings_that_name_fields(spark, tmp_path):
    for i in range(6):  # first rows differ in every file, the layouts do not
        (tmp_path / f"h{i}.csv").write_text(f"note{i}, Year ,month,MID_RATE,query_date,year\nx,1,{i + 1},7.{i},2020-01-02,2020\n")
        (tmp_path / f"p{i}.csv").write_text(f"2021,{i + 1},6.{i},2021-01-04,2021-01-04,x,\n")
    (tmp_path / "swapped.csv").write_text("月份,年份,中间价,首个工作日\n3,2022,6.5,2022-03-01\n月份,年份,中间价,首个工作日\n")
    (tmp_path / "empty.csv").write_text("")
    rows = {(r.year, r.month): r.mid_rate for r in scan_monthly(spark, str(tmp_path / "*.csv")).collect()}
    assert rows == ({("2020", f"0{i + 1}"): f"7.{i}" for i in range(6)} | {("2021", f"0{i + 1}"): f"6.{i}" for i in range(6)}
                    | {("2022", "03"): "6.5"})
    raw = spark.createDataFrame([(["a", " Year", None],), (["2020", "1", ""],), ([],)], "cells array<string>")
    assert [r[0] for r in raw.select(_headings(F.col("cells"))).collect()] == [[None, "Year", None], None, None]


def test_folder_chain_of_any_depth(spark):
    chain = [(f"n{i}", f"f{i}", "root" if i == 0 else f"n{i - 1}", "folder") for i in range(70)]
    chain += [("c1", "loop", "c2", "folder"), ("c2", "loop", "c1", "folder")]
    paths = iv.folder_paths(spark.createDataFrame(chain, "id string, name string, parent_id string, item_type string"))
    assert paths.count() == 70 and paths.agg(F.max("depth")).first()[0] == 70


def test_folder_anchors_and_root_names(spark):
    listing = spark.createDataFrame([("n5", "ASIA", "root", "folder"), ("n6", "JAPAN", "n5", "folder"), ("n7", "Root", "root", "folder")],
                                    "id string, name string, parent_id string, item_type string")
    asked = ["id:n5", "id:gone", "id:n5/JAPAN", "id:gone/x", "Root", "ROOT", "root/ASIA", "　ASIA/JAPAN", "ASIA/KOREA", ""]
    got = iv.resolve_folders(spark.createDataFrame([(p,) for p in asked], "path string"), iv.folder_paths(listing))
    assert {r.path: (r.folder_id, r.missing_prefix) for r in got.collect()} == {
        "id:n5": ("n5", None), "id:gone": ("gone", None), "id:n5/JAPAN": ("n6", None), "id:gone/x": (None, "x"),
        "Root": ("n7", None), "ROOT": ("root", None), "root/ASIA": ("n5", None), "　ASIA/JAPAN": ("n6", None),
        "ASIA/KOREA": (None, "ASIA/KOREA"), "": ("root", None)}


@pytest.mark.parametrize("href,want", [
    ("../../../../x.html", "/x.html"), ("../../../../../x.html", "/x.html"), ("../x", "/a/b/c/x"), ("./y?u=/../z", "/a/b/c/d/y?u=/../z"),
    ("..", "/a/b/c/"), (".", "/a/b/c/d/"), ("/p/./q/../r", "/p/r"), ("e/../../f", "/a/b/c/f")])
def test_url_paths_fold_at_any_depth(spark, href, want):
    df = spark.createDataFrame([("http://h.org/a/b/c/d/page.html", href)], "b string, h string")
    assert df.select(resolve_url(F.col("b"), F.col("h")).alias("u")).first().u == "http://h.org" + want


def test_csv_quotes_line_breaks_and_repeated_headers(spark, tmp_path):
    (tmp_path / "one.csv").write_text('Amount,Currency,Date,Project,Amount\n1.5,USD,2025-01-01,"He said ""hi"", ok",9\n'
                                      '2,USD,2025-01-02,"two\nlines",8\n', encoding="utf-8")
    (tmp_path / "two.csv").write_text("Amount,Currency,Date,Project,Amount\n3,USD,2025-01-03,p,7\n", encoding="utf-8")
    (names, frame), = scan_forms(spark, [str(tmp_path / "*.csv")])
    assert names == ("one.csv", "two.csv")
    rows = {(r.source_file, r.source_row): (r.amount, r.project) for r in
            apply_column_mapping(frame, DEFAULT_MAPPING, ("source_file", "source_row")).frame.collect()}
    assert rows == {("one.csv", 2): ("1.5", 'He said "hi", ok'), ("one.csv", 3): ("2", "two\nlines"), ("two.csv", 2): ("3", "p")}
    assert header_names(["a", "a", "", "a"]) == ["a", "a.1", "Unnamed: 2", "a.2"]


def test_cells_of_odd_numbers(spark):
    df = spark.createDataFrame([("f", 1, "1.005"), ("f", 2, "0.0004"), ("f", 3, "NAN"), ("f", 4, "1.5f"), ("f", 5, None), ("f", 6, " 1e2 ")],
                               "source_file string, source_row int, Amount string")
    row = fill_cells(df, {"B2": "sum:Amount"}).first()
    assert row.number == pytest.approx(101.0054, abs=1e-12) and row.value is None
    same = fill_cells(df, {"B2": "first:Amount"}, clean={"fillna": 0}).first()
    assert same.value == "1.005"


def test_listing_size_zero_gives_way_to_file_size(spark):
    df = spark.createDataFrame([('{"type":"file","id":"1","name":"n","size":0,"fileSize":500}',)], "json string")
    assert iv.parse_listing(df).first()["size"] == 500


def test_mime_types_of_double_suffixes(spark):
    names = {"a.csv.gz": "text/csv", "a.tgz": "application/x-tar", "a.PDF": "application/pdf", "none": "application/octet-stream"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.mime_type for r in iv.with_mime_type(spark, df, "n").collect()} == names


def test_links_of_text_page_ids_and_many_cells(spark):
    links = spark.createDataFrame([("p2", 3_000_000, "u"), ("p1", 7, "u"), ("p1", 2, "v")], "page_id string, pos int, link string")
    assert {(r.link, r.page_id, r.pos) for r in first_seen_links(links).collect()} == {("u", "p1", 7), ("v", "p1", 2)}
    cells = "".join("<td>x</td>" for _ in range(1200)) + "<td>1美元对人民币7.1元</td>"
    page = spark.createDataFrame([(1, f"<table><tr><td>2024-01-02</td>{cells}</tr></table>")], "page_id long, html string")
    assert str(keychart_rows(page).first().rate).startswith("7.1")


def test_two_streams_do_not_skip_each_other(spark, tmp_path):
    store = RateStore(spark, str(tmp_path / "s"))
    schema = ", ".join(f"{c} string" for c in RECORD_COLUMNS) + ", _file string"
    row = dict.fromkeys(RECORD_COLUMNS) | {"quote_currency": "CNY", "rate_mid": "7.1", "rate_date": "2025-01-02", "fetch_date": "2025-01-02",
                                           "source": "x", "_file": "f"}
    names = [*RECORD_COLUMNS, "_file"]
    for query, base in (("q-1", "USD"), ("q-2", "EUR")):
        batch = spark.createDataFrame([tuple((row | {"base_currency": base})[c] for c in names)], schema)
        assert merge_batch(store, batch, 0, query_id=query)
        assert not merge_batch(store, batch, 0, query_id=query)
    bad = spark.createDataFrame([tuple((row | {"base_currency": "USD", "rate_mid": "x"})[c] for c in names)], schema)
    assert merge_batch(store, bad, 1, query_id="q-1", rejects=str(tmp_path / "r"))
    assert {r.base_currency for r in store.read().collect()} == {"USD", "EUR"}
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1


def test_merge_rewrites_touched_months_only(spark, tmp_path):
    store = RateStore(spark, str(tmp_path / "s"))
    names = [*RECORD_COLUMNS, "_file"]
    schema = ", ".join(f"{c} string" for c in names)
    row = dict.fromkeys(names) | {"base_currency": "USD", "quote_currency": "CNY", "source": "x", "_file": "f"}
    for n, days in enumerate((("2025-01-02", "2025-02-03"), ("2025-02-03", "2025-03-04"))):
        batch = spark.createDataFrame([tuple((row | {"rate_date": d, "fetch_date": d, "rate_mid": f"7.{n + 1}"})[c] for c in names)
                                       for d in days], schema)
        before = store.month_folders()
        assert merge_batch(store, batch, n, query_id="q")
    after = store.month_folders()
    assert after["year=2025/month=1"] == before["year=2025/month=1"]
    assert after["year=2025/month=2"] != before["year=2025/month=2"]
    assert {(str(r.rate_date), float(r.rate_mid)) for r in store.read().collect()} == {
        ("2025-01-02", 7.1), ("2025-02-03", 7.2), ("2025-03-04", 7.2)}
    assert store.read([(2025, 3)]).count() == 1
    store.write(store.read().where("month = 1"))
    assert list(store.month_folders()) == ["year=2025/month=1"]


def test_monthly_csv_whose_records_all_hold_a_line_break(spark, tmp_path):
    from ratebook.schemas import MONTHLY_FIELDS
    rows = []
    for month in ("1", "2"):
        cells = [{"year": "2024", "month": month}.get(f, "") for f in MONTHLY_FIELDS]
        at = [i for i, f in enumerate(MONTHLY_FIELDS) if f not in ("year", "month")]
        cells[at[0]] = '"\n7.5"'
        cells[at[-1]] = "7.25"
        rows.append(",".join(cells))
    path = tmp_path / "m.csv"
    path.write_text("\n".join(rows) + "\n")
    assert _width(spark, [str(path)]) == len(MONTHLY_FIELDS)
    got = {r["month"].lstrip("0"): r for r in scan_monthly(spark, [str(path)]).collect()}
    assert sorted(got) == ["1", "2"] and all(r[MONTHLY_FIELDS[at[-1]]] for r in got.values())
