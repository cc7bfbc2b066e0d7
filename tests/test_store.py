"""The rate store's manifest: conditional commits, conflicts, retired folders, equal cost after many merges."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ratebook.schemas import RATES
from ratebook.sinks import store as module
from ratebook.sinks.store import RateStore, StoreConflict


def rates(spark, rows):
    full = [("USD", "CNY", Decimal(r), d, f"{d}T00:00:00+00:00", "x", "", d.year, d.month, "", None, None) for d, r in rows]
    names = ("base_currency", "quote_currency", "rate_mid", "rate_date", "fetch_date", "source", "fallback_strategy", "year", "month",
             "download_url", "created_at", "updated_at")
    assert {f.name for f in RATES.fields} == set(names)
    schema = ", ".join(f"{n} {RATES[n].dataType.simpleString()}" for n in names)
    return spark.createDataFrame(full, schema).withColumn("_ordinal", F.monotonically_increasing_id())


def held(store):
    return sorted((str(r.rate_date), str(r.rate_mid)) for r in store.read().collect())


DAY = dt.date(2025, 1, 2), dt.date(2025, 2, 3)


def test_two_writers_of_one_month_both_survive(spark, tmp_path, monkeypatch):
    store, other = RateStore(spark, str(tmp_path / "s")), RateStore(spark, str(tmp_path / "s"))
    store.merge(rates(spark, [(DAY[0], "1.0000")]), "t0")
    real, done = store._lay_down, []

    def slow(df):
        made = real(df)
        if not done:  # the other writer commits between this one's write and its commit
            done.append(other.merge(rates(spark, [(dt.date(2025, 1, 9), "2.0000")]), "t1"))
        return made
    monkeypatch.setattr(store, "_lay_down", slow)
    store.merge(rates(spark, [(dt.date(2025, 1, 8), "3.0000")]), "t2")
    assert held(store) == [("2025-01-02", "1.0000"), ("2025-01-08", "3.0000"), ("2025-01-09", "2.0000")]
    assert store.versions() == [1, 2, 3]


def test_other_months_are_carried_over_and_full_writes_conflict(spark, tmp_path, monkeypatch):
    store, other = RateStore(spark, str(tmp_path / "s")), RateStore(spark, str(tmp_path / "s"))
    real, calls = store._lay_down, []

    def slow(df):
        made = real(df)
        calls.append(1)
        if len(calls) in (1, 2):
            other.merge(rates(spark, [(DAY[1], f"{len(calls)}.0000")]), "t1")
        return made
    monkeypatch.setattr(store, "_lay_down", slow)
    store.merge(rates(spark, [(DAY[0], "5.0000")]), "t2")
    assert len(calls) == 1 and held(store) == [("2025-01-02", "5.0000"), ("2025-02-03", "1.0000")]
    with pytest.raises(StoreConflict):
        store.write(rates(spark, [(DAY[0], "9.0000")]).drop("_ordinal"))
    assert held(store) == [("2025-01-02", "5.0000"), ("2025-02-03", "2.0000")]


def test_a_number_is_claimed_once(spark, tmp_path):
    store = RateStore(spark, str(tmp_path / "s"))
    name = f"{store.root}/_manifests/000000000001.json"
    assert store.files.claim(name, "a") and not store.files.claim(name, "b") and store.files.read(name) == "a"
    assert os.listdir(tmp_path / "s" / "_manifests") != [] and not [n for n in os.listdir(tmp_path / "s" / "_manifests") if n.endswith(".tmp")]


def test_old_versions_are_retired(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(module, "KEPT", 3)
    store = RateStore(spark, str(tmp_path / "s"))
    store.merge(rates(spark, [(DAY[1], "7.0000")]), "t")
    for n in range(6):
        store.merge(rates(spark, [(DAY[0], f"{n}.0000")]), "t", tag=f"qe{n}")
        assert store.has_tag(f"qe{n}") and not store.has_tag(f"qe{n + 1}") and not store.has_tag(f"re{n}")
    assert store.versions() == [5, 6, 7] and held(store) == [("2025-01-02", "5.0000"), ("2025-02-03", "7.0000")]
    assert [held_at.count() for held_at in (store.read(version=5), store.read(version=6))] == [2, 2]
    januaries = [p for p, _, _ in os.walk(tmp_path / "s") if p.endswith("year=2025/month=1")]
    assert len(januaries) == 3
    assert len([p for p, _, _ in os.walk(tmp_path / "s") if p.endswith("year=2025/month=2")]) == 1


def test_schema_versions_read_before_and_after(spark, tmp_path):
    from ratebook.sinks.tables import VersionedTable
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.write(spark.createDataFrame([("1", " a ", None), (None, " ", "")], "`b ` string, `a.x` string, gone string")) == 1
    assert table.migrate(["a.x", "b", "new"]) == 2 and table.migrate(["a.x", "b", "new"]) == 2
    assert [tuple(r) for r in table.read(1).collect()] == [("1", " a ", None), (None, " ", "")] and table.read(1).columns == ["b ", "a.x", "gone"]
    assert [tuple(r) for r in table.read().collect()] == [(" a ", "1", "")]
    with pytest.raises(KeyError):
        table.read(9)
