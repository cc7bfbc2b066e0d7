"""C3 import_rates and C7 upsert_one: CSV or records -> normalised -> merged -> new store version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.operators.store import load_csv_records, normalize_records, require_valid
from ratebook.operators.staging import written
from ratebook.sinks.store import RateStore
from ratebook.sources.tables import read_csv_text


def csv_ordinal() -> F.Column:
    """Input order of CSV rows: (file, block, position in the task). A multi-line CSV
    file is read by one task, so the order inside a file is stable."""
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"),
                    F.monotonically_increasing_id().alias("i"))


def import_csv(spark: SparkSession, store: RateStore, csv_path: str, base: str, quote: str, source: str,
               fallback: str | None = None, download_url: str | None = None, now: str | None = None,
               strict: bool = True, rejects: str | None = None) -> tuple[int, DataFrame]:
    """Returns (rows consumed, merged table). One bad row fails the file before any write
    in strict mode; otherwise bad rows go, with their error, to the table ``rejects``."""
    raw = read_csv_text(spark, csv_path).withColumn("_ordinal", csv_ordinal())
    records = load_csv_records(raw, base, quote, source, fallback)
    if download_url is not None:
        records = records.withColumn("download_url", F.lit(download_url))
    if strict:
        valid = require_valid(records)
    elif rejects is None:
        raise ValueError("name a rejects table for the rows that are skipped")
    else:
        records = written(records, "import-records")
        records.where(F.col("error").isNotNull()).drop("_ordinal").write.mode("append").parquet(rejects)
        valid = records.where(F.col("error").isNull()).drop("error")
    valid = written(valid, "import-valid")  # also runs the strict check before the store is touched
    consumed = valid.count()  # from the written files' footers
    store.merge(valid, now or _utcnow())
    return consumed, store.read()


def upsert_records(store: RateStore, records: DataFrame, download_url: str | None = None,
                   now: str | None = None, ordinal: str = "_ordinal") -> DataFrame:
    """Normalise a (small) batch of records strictly and merge it as a new version."""
    norm = require_valid(normalize_records(records, download_url, rounding="half_up"))
    store.merge(norm, now or _utcnow(), ordinal)
    return store.read()


def _utcnow() -> str:
    import datetime as dt
    return dt.datetime.now(dt.timezone.utc).replace(microsecond=0).isoformat()
