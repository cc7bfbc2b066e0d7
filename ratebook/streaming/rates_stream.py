"""Rate records landing as CSV files, merged into the rate store as they arrive.

Structured Streaming reads the landing folder; every micro-batch runs the
batch job (P8 normalise, W3 last-wins, J1 merge, K1 new version) through
``foreachBatch``. A micro-batch writes one store version tagged with its
query id (kept in the stream's checkpoint) and epoch, and a batch already
committed is skipped, so a restarted query that replays its last epoch does
not merge it twice, while other streams into the store are not confused
with it. Invalid records go to a rejects table beside the store.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ratebook.operators.store import normalize_records
from ratebook.sinks.store import RateStore

RECORD_COLUMNS = ("base_currency", "quote_currency", "rate_mid", "rate_date", "fetch_date", "source",
                  "fallback_strategy", "download_url", "created_at")
RECORD_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RECORD_COLUMNS])


def merge_batch(store: RateStore, batch: DataFrame, epoch_id: int, now: str | None = None,
                query_id: str | None = None, rejects: str | None = None) -> bool:
    """Merge one micro-batch; returns False when it was already committed.

    Records with an error are written, with it, under ``rejects`` (one folder
    a batch, replaced on replay).
    """
    query_id = query_id or batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    tag = f"q{query_id.replace('-', '')}e{epoch_id}"
    if store.has_tag(tag):
        return False
    records = batch.withColumn("_ordinal", F.struct(F.col("_file"), F.monotonically_increasing_id()))
    norm = normalize_records(records.drop("_file"))
    valid = norm.where(F.col("error").isNull()).drop("error")
    if rejects:
        norm.where(F.col("error").isNotNull()).drop("_ordinal").write.mode("overwrite").parquet(f"{rejects}/batch={tag}")
    stamp = now or dt.datetime.now(dt.timezone.utc).replace(microsecond=0).isoformat()
    store.merge(valid, stamp, tag=tag)
    return True


def start_rates_stream(spark: SparkSession, landing_dir: str, store_root: str, checkpoint: str,
                       available_now: bool = True, now: str | None = None) -> StreamingQuery:
    """Start the stream (``availableNow`` processes what has landed, then stops)."""
    store = RateStore(spark, store_root)
    src = (spark.readStream.schema(RECORD_SCHEMA).option("header", True).option("multiLine", True).option("escape", '"')
           .csv(landing_dir).withColumn("_file", F.col("_metadata.file_path")))
    writer = src.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, epoch: merge_batch(store, df, epoch, now, rejects=f"{store_root.rstrip('/')}-rejects"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
