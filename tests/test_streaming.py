"""Rate files merged by Structured Streaming; a rerun over the same checkpoint adds nothing."""

from decimal import Decimal

from ratebook.sinks.store import RateStore
from ratebook.streaming.rates_stream import start_rates_stream


def test_rate_files_stream_into_store(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "a.csv").write_text(
        "base_currency,quote_currency,rate_mid,rate_date,fetch_date,source\n"
        "usd,cny,7.10525,2025-09-04,2025-09-04,safe_portal\n"
        "usd,cny,7.2,2025-09-05,2025-09-05T08:00:00+08:00,safe_portal\n", encoding="utf-8")
    (landing / "b.csv").write_text(
        "base_currency,quote_currency,rate_mid,rate_date,fetch_date,source\n"
        "eur,cny,8.0,2025-09-04,,cfets\n"
        "eur,cny,8.1,2025-09-04,2025-09-04,cfets\n", encoding="utf-8")
    store_root, ckpt = str(tmp_path / "store"), str(tmp_path / "ckpt")
    q = start_rates_stream(spark, str(landing), store_root, ckpt, now="2025-09-06T00:00:00+00:00")
    q.awaitTermination(120)
    store = RateStore(spark, store_root)
    rows = {(r["base_currency"], str(r["rate_date"])): r for r in store.read().collect()}
    assert rows[("USD", "2025-09-04")]["rate_mid"] == Decimal("7.1052")
    assert rows[("USD", "2025-09-05")]["fetch_date"] == "2025-09-05T08:00:00+08:00"
    assert ("EUR", "2025-09-04") in rows  # the fetch_date-less record is rejected, the other kept
    assert rows[("EUR", "2025-09-04")]["rate_mid"] == Decimal("8.1000")
    versions = store.versions()
    q2 = start_rates_stream(spark, str(landing), store_root, ckpt)
    q2.awaitTermination(120)
    assert store.versions() == versions
