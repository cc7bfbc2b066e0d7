"""CSV records of files cut into splits anywhere, against a plain reading of the whole file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from ratebook.sources.forms import read_forms
from ratebook.sources.records import stays_open


def write(path, text):
    path.write_bytes(text.encode())
    return path


def by_row(scan):
    (_, frame), = scan.groups
    return {(r._path.rsplit("/", 1)[-1], r.source_row): tuple(r)[:-3] for r in frame.collect()}


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_open_quotes_as_a_csv_reader_sees_them():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choice('"",a b') for _ in range(rng.randint(0, 9)))
        # two more lines: if the cell is open, they are part of the record
        assert stays_open(line, False) == (len(list(csv.reader([line + "\n", "z\n"]))) == 1 and bool(line)), line
        opened = list(csv.reader(['"\n', line + "\n", "z\n"]))
        assert stays_open(line, True) == (len(opened) == 1), line


@pytest.mark.parametrize("seed", [1])
def test_splits_anywhere_give_the_same_records(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    cells = ["", "a", 'q"uote', "com,ma", "line\nbreak", "\n\n", '"', "é一", "x" * 90, "tail\r\nback", 'a""b']
    want = {}
    for f in range(2):
        rows = [["h1", "h\n2", "h3"], *[[rng.choice(cells) or "v", rng.choice(cells), rng.choice(cells)] for _ in range(60)]]
        text = ""
        for row in rows:
            text += ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n\r') else c for c in row)
            text += rng.choice(["\n", "\r\n"]) + ("" if rng.random() < .8 else "  \n")
        write(tmp_path / f"f{f}.csv", ("﻿" if f == 1 else "") + text)
        want |= {(f"f{f}.csv", i): tuple(c or None for c in row) for i, row in enumerate(rows[1:], 2)}
    scan = read_forms(spark, [str(tmp_path / "*.csv")])
    (names, frame), = scan.groups
    assert names == ("f0.csv", "f1.csv") and frame.columns[:3] == ["h1", "h\n2", "h3"]
    assert by_row(scan) == want
    assert scan.malformed.collect() == []


def test_nothing_is_dropped_in_silence(spark, tmp_path):
    write(tmp_path / "a.csv", '"Amo\nunt",Currency,Date\n1,USD,2025-01-01\n2,USD,2025-01-02,x,y\n3\n\n4,USD,2025-01-04,\n5,EUR,2025-01-05\n')
    write(tmp_path / "b.csv", '"Amo\nunt",Currency,Date\n1,USD,2025-01-01\n2,"never closed,2025\n3,USD,2025-01-03\n4,USD,x')
    write(tmp_path / "empty.csv", "")
    write(tmp_path / "blank.csv", "\n  \n")
    write(tmp_path / "header.csv", "Other,Columns\n")
    scan = read_forms(spark, [str(tmp_path / "*.csv")])
    odd = sorted((r.source_file, r.source_row, r.reason, r.cells, r.expected, r.kept) for r in scan.malformed.collect())
    assert odd == [("a.csv", 3, "long", 5, 3, False), ("a.csv", 4, "short", 1, 3, True), ("a.csv", 5, "long", 4, 3, False),
                   ("b.csv", 3, "unclosed quote", 2, 3, False), ("blank.csv", 0, "empty file", None, None, False),
                   ("empty.csv", 0, "empty file", None, None, False)]
    frames = {f.columns[0]: f for _, f in scan.groups}
    assert sorted(frames) == ["Amo\nunt", "Other"]
    assert sorted((r.source_file, r.source_row, r["Amo\nunt"]) for r in frames["Amo\nunt"].collect()) == [
        ("a.csv", 2, "1"), ("a.csv", 4, "3"), ("a.csv", 6, "5"), ("b.csv", 2, "1")]
    assert frames["Other"].count() == 0


def test_no_window_over_a_file(spark, tmp_path):
    write(tmp_path / "a.csv", "A,B\n1,2\n")
    (_, frame), = read_forms(spark, [str(tmp_path / "a.csv")]).groups
    assert "Window" not in frame._jdf.queryExecution().executedPlan().toString()
    assert frame.select(F.max("source_row")).first()[0] == 2


def test_many_paths_are_listed_in_few_tasks(spark, tmp_path):
    """A path is not a listing task of its own; the session's setting stays as it was."""
    from ratebook.sources.records import read_records
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    for i in range(80):
        (tmp_path / f"f{i}.csv").write_text(f"A,B\n{i},x\n")
    tracker = spark.sparkContext.statusTracker()
    old = set(tracker.getJobIdsForGroup())
    read = read_records(spark, [str(tmp_path / f"f{i}.csv") for i in range(80)])
    new = [tracker.getStageInfo(s) for j in set(tracker.getJobIdsForGroup()) - old for s in tracker.getJobInfo(j).stageIds]
    assert new and max(s.numTasks for s in new if s) <= 4 * spark.sparkContext.defaultParallelism
    assert read.where("source_row = 2").count() == 80 and spark.conf.get(name) == before
